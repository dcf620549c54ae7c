"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside ASCII white space; bytes.split() cuts at exactly these six bytes.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Python tasks work on at most so many bytes of text at once, however Arrow has batched the rows.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session of one machine gets a temporary one where it is unset; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
        if not found:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hearthline-"))
            found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df as Parquet into the shared folder, split by columns if given, and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hearthline/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(df: DataFrame) -> Column:
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Each name, underscored until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that an operator's own columns can't meet them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null gives b''."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_numpy(zero_copy_only=False).tolist()]  # much faster than to_pylist()


def ranges(sizes: Iterable[int], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` in size each; a larger row stands alone."""
    begin = end = total = 0
    for size in sizes:
        if total and total + size > most:
            yield begin, end
            begin, total = end, 0
        end, total = end + 1, total + size
    if begin < end:
        yield begin, end


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    return ranges(map(len, texts), most)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices of about `most` bytes of text: only a slice is ever turned into Python's objects."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        for i, j in ranges(sizes, most):
            yield batch.slice(i, j - i)
    pa.default_memory_pool().release_unused()
