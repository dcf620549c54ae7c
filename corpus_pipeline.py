"""The corpus pipeline: STAGES over documents, each written as Parquet and reread as the next one's input.

Four stages keep the columns of documents; the last returns the packed pieces. Null text counts as empty in all of
them, repeated rows and texts of any length are worked on like others, columns of any other names are kept, and empty
tables give empty results; what more each stage defines is in its docstring and in its operator's module.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hearthline.llm import langid, mixing, packing, quality, simhash
from hearthline.llm.common import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware quality classifier rejects go; a score at the threshold stays, and all stay without labels of both classes."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter), or without one that covers half their letters, go; just half stays."""
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of 5-word shingles of at least 0.8) stays: that of smallest doc_id, null last, then of smallest text hash."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: 0 to 2; null is the last source."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, with their token ids; a document without text is one piece, the end token."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]
#: Classifiers, hashing and tokenizers are beyond SQL: tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
