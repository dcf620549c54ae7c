"""Property-investment analytics and training-data operations on Spark."""
