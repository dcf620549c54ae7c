"""Streaming twins of the job queue and the attempt limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.records import job_parts, merge_parts


def event_stream(spark: SparkSession, path: str, like: DataFrame, glob: str = "*.parquet") -> DataFrame:
    """A file stream of Parquet events with the schema of `like`; ts as a timestamp."""
    stream = spark.readStream.schema(like.schema).option("pathGlobFilter", glob).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def failed_attempts(events: DataFrame, key: str, limit: int = 5, seconds: int = 900, late: str = "15 minutes") -> DataFrame:
    """(key, ts, since) of each failure that is the limit-th within the trailing window; since: the first of these.

    The state of a key is its last limit - 1 failures, dropped once the watermark has passed the window. Failures of one
    micro-batch count in the order of their times; one that comes in a later batch than a younger one counts from there on.
    """

    def judge(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        new = sorted(int(t.value // 1000) for b in batches for t in b["ts"])
        out = []
        for t in new:
            held = sorted([*held, t])[-limit:]
            if len(held) == limit and held[-1] - held[0] <= seconds * 1_000_000:
                out.append((k[0], pd.Timestamp(t, unit="us"), pd.Timestamp(held[0], unit="us")))
        state.update((held[-(limit - 1) :] if limit > 1 else [],))
        state.setTimeoutTimestamp(max(held[-1] // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "ts", "since"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark("ts", late).select(key, "ts")
    return rows.groupBy(key).applyInPandasWithState(judge, f"{key} {kind}, ts timestamp, since timestamp", "held array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_states(events: DataFrame, job: str = "user_id") -> DataFrame:
    """Each job's latest status by event time, an aggregation whose state is one row a job."""
    return job_parts(events, job, "ts", "event_id").select(job, "status", "progress", "updated_at")


def merge_states(events: DataFrame, table: str, checkpoint: str, job: str = "user_id") -> StreamingQuery:
    """Merge each micro-batch's events into a table of job states: version v=n holds all batches up to n.

    States combine by event time, not by batch: a late batch never sets a job back. A batch that is replayed starts again
    from the version before it and writes the same rows.
    """
    spark = events.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        parts = job_parts(batch, job, "ts", "event_id")
        if batch_id:
            before = spark.read.schema(parts.schema).parquet(f"{table}/v={batch_id - 1}")
            parts = merge_parts(before, parts, job=job)
        parts.write.mode("overwrite").parquet(f"{table}/v={batch_id}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states_at(spark: SparkSession, table: str, version: int) -> DataFrame:
    """The merged states after a batch."""
    return spark.read.parquet(f"{table}/v={version}").drop("status_at", "progress_at")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Events once each, repeats within the watermark dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_memory(stream: DataFrame, name: str, mode: str = "append", timeout_s: int = 120) -> DataFrame:
    """Run all there is into an in-memory table and return it: for small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(timeout_s):
            raise TimeoutError(name)
    finally:
        q.stop()
    return stream.sparkSession.table(name)
