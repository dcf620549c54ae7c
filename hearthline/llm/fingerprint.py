"""Canonical exact digests, in DataFrame and SQL functions only.

The canonical form of a text is NFKC, full case folding, NFKC again, runs of
Unicode white space as one space, ends trimmed; normalisation and folding are
ICU's, called through SQL's reflect(). The fingerprint is 128 bits of two
differently seeded xxhash64. Texts of equal fingerprint form a bucket, and the
canonical bytes in it are compared (their least against their greatest, so
copies meet map-side); in a bucket that holds different bytes the fingerprint
is extended by the SHA-256 of the canonical bytes.

Defined results: null text is empty; a null doc_id is the smallest, and a
doc_id of -2^63 counts as null; rows that
share a doc_id have the same next document, the next larger doc_id's, and of
several rows there the smallest; texts of any length are digested whole; columns
other than doc_id and text are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty


def canonical(text: Column) -> Column:
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), canon)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """An exact digest knows only equal and different."""
    return (a == b).cast("double")


def _successors(ids: DataFrame) -> DataFrame:
    """ids (k, distinct) with next_k, the next larger k, and the smallest after the largest.

    Range partitions are numbered and written; a window per partition finds all successors but the
    last one's, which is the smallest k of the next partition: one row a partition.
    """
    ranged = materialize(ids.repartitionByRange("k").withColumn("pid", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("pid").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    ends = ends.withColumn("after", F.lead("low").over(Window.orderBy("pid"))).select(F.col("high").alias("k"), "after")
    smallest = ranged.agg(F.min("k")).first()[0]
    inside = ranged.withColumn("inside", F.lead("k").over(Window.partitionBy("pid").orderBy("k")))
    return inside.join(ends, "k", "left").withColumn("next_k", F.coalesce("inside", "after", F.lit(smallest).cast("long"))).drop("inside", "after", "pid")


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """k (doc_id, null as the smallest long), text and fp (the wide hash). No more columns: all uses share one exchange."""
    text = text_or_empty(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), text.alias("text"))
    return rows.withColumn("canon", canonical(F.col("text"))).select("k", "text", wide_hash(F.col("canon")).alias("fp"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited (text), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last n_chars // 2 code points replaced by the first as many of the next document.
    """
    rows = fingerprint_rows(docs)
    narrow = materialize(rows.select("k", F.length("text").alias("n_chars"), "fp"), "digests")
    copies = narrow.groupBy("fp").agg(F.count("*").alias("copies"))
    ids = narrow.join(copies, "fp").groupBy("k").agg(F.max(F.floor(F.col("n_chars") / 2)).alias("half"), F.max("copies").alias("most"))
    after = materialize(_successors(ids), "successors")

    # Each document sends the document before it what its edit takes, and no more.
    before = after.select(F.col("next_k").alias("k"), F.col("k").alias("prev_k"), F.col("half").alias("prev_half"))
    before = materialize(before.join(after.select("k", "most"), "k"), "predecessors")
    placed = rows.join(before, "k")
    sent = placed.select("prev_k", F.struct(F.substring("text", F.lit(1), F.col("prev_half").cast("int")).alias("head"), F.col("fp").alias("next_fp")).alias("s"))
    sent = sent.groupBy("prev_k").agg(F.min("s").alias("s")).select(F.col("prev_k").alias("k"), "s.head", "s.next_fp")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("head", F.lit(1), half))
    out = placed.join(sent, "k").withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited")))
    out = out.select(
        F.when(F.col("k") != -(1 << 63), F.col("k")).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), "edited", F.sha2("edited", 256).alias("edited_sha256"),
        "fp", F.when(F.col("most") > 1, F.sha2(canonical(F.col("text")), 256)).alias("sha"), "next_fp",
        wide_hash(F.col("edited_canon")).alias("edited_fp"), F.sha2("edited_canon", 256).alias("edited_sha"),
    )

    # Byte comparison inside buckets of two and more.
    members = placed.where("most > 1").select("fp", canonical(F.col("text")).alias("canon"))
    mixed = members.groupBy("fp").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select(F.col("fp").alias("mixed_fp"))
    out = out.join(mixed, F.col("fp") == F.col("mixed_fp"), "left")
    own = F.when(F.col("mixed_fp").isNull(), F.col("fp")).otherwise(F.concat_ws("-", "fp", "sha"))
    theirs = F.when(F.col("mixed_fp").isNull() | (F.col("edited_fp") != F.col("fp")), F.col("edited_fp")).otherwise(F.concat_ws("-", "edited_fp", "edited_sha"))
    return out.select(
        "doc_id", "n_chars", "edited", "edited_sha256", own.alias("fingerprint"), theirs.alias("edited_fingerprint"),
        likeness(own, theirs).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
