"""As-of join: of each moment the last entry at or before it.

Moments and entries are cut into spans of time. Within a span a running last value finds the entry; for moments that
have none there, the last entry of an earlier span is carried in, found among one row per span. So neither a long
history nor one busy key is in one task, and equal moments are looked up once however many rows ask for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPAN = 86_400


def asof_join(rows: DataFrame, entries: DataFrame, by: list[str], ts: str, values: list[str], span: int = SPAN) -> DataFrame:
    """rows with values and `entry_ts` of the last of entries (by, ts, values) at or before the row's ts, within equal by.

    Entries of equal by and ts: the greatest values count. Nulls in by are a key like others; a row without a moment, or
    before all entries, has nulls. ts is a whole number, in rows and in entries.
    """
    names = [f"_k{i}" for i in range(len(by))]
    keyed = lambda df: df.select(*(F.struct(F.col(c)).alias(n) for c, n in zip(by, names, strict=True)), F.col(ts).cast("long").alias("_t"), *(v for v in values if df is entries))
    part = F.floor(F.col("_t") / span).alias("_span")
    held = keyed(entries).where("_t IS NOT NULL").groupBy(*names, "_t").agg(F.max(F.struct("_t", *values)).alias("_e")).select(*names, "_t", part, "_e")
    asked = keyed(rows).where("_t IS NOT NULL").distinct().select(*names, "_t", part, F.lit(None).cast(held.schema["_e"].dataType).alias("_e"))
    both = held.withColumn("_asks", F.lit(False)).unionByName(asked.withColumn("_asks", F.lit(True)))
    within = Window.partitionBy(*names, "_span").orderBy("_t", "_asks").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_near", F.last("_e", ignorenulls=True).over(within)).where("_asks")
    spans = both.groupBy(*names, "_span").agg(F.max("_e").alias("_last"))
    earlier = Window.partitionBy(*names).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*names, "_span", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    told = found.join(carried, [*names, "_span"]).select(*names, "_t", F.coalesce("_near", "_carried").alias("_e"))
    out = rows.withColumns({n: F.struct(F.col(c)) for c, n in zip(by, names, strict=True)} | {"_t": F.col(ts).cast("long")})
    return out.join(told, [*names, "_t"], "left").select(*rows.columns, *(F.col("_e")[v].alias(v) for v in values), F.col("_e._t").alias("entry_ts"))
