"""Readers and writers of the engine's own tables and files."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import decimal
from ..functions.texts import safe_id

RENT = "city string, bucket string, segment string, kr_per_m2 string, updated string"
HISTORY = "id string, ts string, finn_url string, title string, price bigint, summary string, image string, address string, result_args map<string,string>"
SEGMENTS = ("hybel", "liten", "standard", "stor")


def _ordered(df: DataFrame) -> DataFrame:
    """df with _at, a number that follows the order of a file's rows."""
    return df.withColumn("_at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))


def rent_table(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """city, bucket, segment, kr_per_m2, updated. The last row of a key counts; rows without a readable price go.

    strict: city, bucket and segment are required too, and an unknown segment is `standard`.
    """
    raw = _ordered(spark.read.schema(RENT).option("header", True).csv(path))
    text = lambda c, empty: F.coalesce(F.trim(c), F.lit(empty))
    seg = F.lower(text("segment", "standard"))
    df = raw.select(text("city", "").alias("city"), text("bucket", "").alias("bucket"), seg.alias("segment"), decimal(F.col("kr_per_m2"), None).alias("kr_per_m2"), text("updated", "—").alias("updated"), "_at").where("kr_per_m2 is not null")
    if strict:
        df = df.where("city <> '' and bucket <> '' and segment <> ''").withColumns({"segment": F.when(F.col("segment").isin(*SEGMENTS), F.col("segment")).otherwise("standard"), "kr_per_m2": F.round("kr_per_m2", 6)})
    last = F.row_number().over(Window.partitionBy("city", "bucket", "segment").orderBy(F.col("_at").desc()))
    return df.withColumn("_n", last).where("_n = 1").drop("_n", "_at")


def postcode_table(spark: SparkSession, path: str) -> DataFrame:
    """postnr (four digits as text), bydel, bucket; empty names are null."""
    df = spark.read.option("header", True).csv(path)
    names = {c.lower(): c for c in df.columns}
    pick = lambda *cs: F.nullif(F.trim(F.coalesce(*(F.col(names[c]) for c in cs if c in names), F.lit(""))), F.lit(""))
    return df.select(pick("postnr", "postnummer").alias("postnr"), pick("bydel", "bydelsnavn").alias("bydel"), pick("bucket").alias("bucket")).where(F.col("postnr").rlike("^[0-9]{4}$"))


def prefix_table(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("prefix2 string, bucket string").option("header", True).csv(path)
    return df.select(F.trim("prefix2").alias("prefix2"), F.trim("bucket").alias("bucket")).where("prefix2 <> '' and bucket <> ''")


def range_table(spark: SparkSession, path: str) -> DataFrame:
    """start, end, bucket, priority (the order of the rows)."""
    df = _ordered(spark.read.schema("start int, end int, bucket string").option("header", True).csv(path))
    return df.withColumn("priority", F.row_number().over(Window.orderBy("_at"))).drop("_at")  # a few rows


def geojson(spark: SparkSession, path: str, name_key: str = "name") -> DataFrame:
    """priority, name, polygons (array of ring lists) of the polygons in a feature collection, in order."""
    features = spark.read.schema("features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>").option("multiLine", True).json(path)
    each = features.select(F.posexplode("features").alias("priority", "f"))
    kind, raw = F.lower("f.geometry.type"), F.col("f.geometry.coordinates")
    one = F.array(F.from_json(raw, "array<array<array<double>>>"))
    polygons = F.when(kind == "polygon", one).when(kind == "multipolygon", F.from_json(raw, "array<array<array<array<double>>>>"))
    return each.select("priority", F.trim(F.try_element_at("f.properties", F.lit(name_key))).alias("name"), polygons.alias("polygons")).where("polygons is not null")


def history(spark: SparkSession, path: str, permissive: bool = False) -> DataFrame:
    """Analyses from JSON lines, ts as a timestamp. A malformed line fails the read, or is an empty record if permissive."""
    df = spark.read.schema(HISTORY).option("mode", "PERMISSIVE" if permissive else "FAILFAST").json(path)
    return df.withColumn("ts", F.try_to_timestamp("ts"))


def cache_entries(spark: SparkSession, path: str) -> DataFrame:
    """name, value, timestamp, ts of a JSON object of cached rates."""
    df = spark.read.option("wholetext", True).text(path)
    entries = F.from_json("value", "map<string,struct<value:double,timestamp:string,ts:bigint>>")
    return df.select(F.explode(entries).alias("name", "e")).select("name", "e.*")


def document_table(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, content, size, key (hash of the content) and whether it starts like a PDF."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return df.select("path", "content", F.col("length").alias("size"), F.sha2("content", 256).alias("key"), F.startswith("content", F.lit(b"%PDF-")).alias("is_pdf"))


def decode_upload(text):
    """Bytes of a base64 text with or without a data-URI prefix; null if it isn't base64."""
    return F.try_to_binary(F.regexp_replace(text, r"(?s)^data:[^,]*,", ""), F.lit("base64"))


def page_lines(pages: DataFrame) -> DataFrame:
    """Segments (doc_id, pos, text, source) from page texts: the non-blank lines, each with its page number."""
    each = pages.select("doc_id", "page_no", F.posexplode(F.split("text", r"\R")).alias("line_no", "line")).where(F.trim("line") != "")
    return each.select("doc_id", (F.col("page_no").cast("long") * 1_000_000 + F.col("line_no")).alias("pos"), F.trim("line").alias("text"), (F.col("page_no") + 1).cast("string").alias("source"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def write_cache(df: DataFrame, path: str, key: str) -> None:
    """df as Parquet, split by the file-safe form of its key."""
    df.withColumn("cache_id", safe_id(F.col(key))).write.mode("overwrite").partitionBy("cache_id").parquet(path)


def with_columns_added(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """df with missing columns added as nulls (name to type): schema evolution."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})


def replace_table(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Rewrite a table whole: written beside it, then put in its place, so readers see the old rows or the new ones.

    df may read the table itself.
    """
    spark = df.sparkSession
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.format(fmt).save(staged)
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    if not fs.rename(at(staged), at(path)):
        raise OSError(f"{staged} can't be put in place of {path}")
    fs.delete(at(old), True)


def write_rates(entries: DataFrame, path: str) -> None:
    """name, value, timestamp, ts as one JSON object, the form that cache_entries() reads; a few rows."""
    value = F.struct("value", "timestamp", "ts")
    entries.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", value)))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def is_current(payload):
    """Whether a cached extraction (JSON text) is an object of version 2 with a list of details; what can't be read isn't."""
    ok = (F.get_json_object(payload, "$.tg_version") == "2") & F.startswith(F.get_json_object(payload, "$.tg2_details"), F.lit("["))
    return F.coalesce(F.try_parse_json(payload).isNotNull() & F.startswith(F.trim(payload), F.lit("{")) & ok, F.lit(False))


def save_cache(payloads: DataFrame, path: str, key: str = "analysis_id") -> None:
    """payloads (key, payload) as Parquet, one folder a file-safe id; ids that come again are replaced, the others stay."""
    out = payloads.select(safe_id(F.trim(F.col(key))).alias("cache_id"), F.col(key), "payload")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cache_id").parquet(path)


def load_cache(wanted: DataFrame, path: str, key: str = "analysis_id") -> DataFrame:
    """wanted with payload and hit: a missing entry, one that isn't a JSON object, or one of another version is a miss."""
    held = wanted.sparkSession.read.schema(f"{key} string, payload string, cache_id string").parquet(path)
    out = wanted.withColumn("cache_id", safe_id(F.trim(F.col(key)))).join(held.select("cache_id", "payload"), "cache_id", "left").drop("cache_id")
    return out.withColumn("hit", is_current(F.col("payload")))


def persist_documents(found: DataFrame, path: str, key: str = "finnkode") -> None:
    """found (key, url, content): each content once, under its hash, and for each key the row of its metadata, last one."""
    hashed = found.withColumn("content_key", F.sha2("content", 256))
    hashed.select("content_key", "content", F.length("content").alias("size")).dropDuplicates(["content_key"]).write.mode("append").parquet(f"{path}/content")
    meta = hashed.select(F.col(key).cast("string").alias(key), "url", "content_key", F.current_timestamp().alias("stored_at"))
    meta.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{path}/meta")


EXPORT = ("Adresse", "Dato analysert", "Total score", "Risiko", "FINN-kode", "Pris", "Kilde")


def export_line(*fields):
    """Fields as one CSV line: in quotes only those that hold a comma or a quote, nulls empty."""
    quote = lambda c: F.when(c.rlike('[,"]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    return F.concat_ws(",", *(quote(c) for c in fields))


def export_lines(saved: DataFrame) -> DataFrame:
    """pos, line of the seven columns that are exported of saved analyses (pos, address, title, saved_at, score, risk, code, price, url)."""
    whole = lambda c: F.floor(F.col(c) + 0.5).cast("long").cast("string")
    address = F.regexp_replace(F.coalesce(F.nullif(F.col("address"), F.lit("")), F.col("title"), F.lit("")), r"(?U)\s+", " ")
    line = export_line(address, F.date_format("saved_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), whole("score"), F.col("risk"), F.col("code"), F.when(F.col("price") != 0, whole("price")), F.col("url"))
    return saved.select("pos", line.alias("line"))


def write_export(saved: DataFrame, path: str) -> None:
    """The export as one text file: a byte-order mark, the header, the rows in order. What a user has selected is small."""
    head = saved.sparkSession.createDataFrame([(-1, "﻿" + ",".join(EXPORT))], "pos long, line string")
    head.unionByName(export_lines(saved).select(F.col("pos").cast("long").alias("pos"), "line")).coalesce(1).sortWithinPartitions("pos").select("line").write.mode("overwrite").text(path)


def probed(urls: DataFrame, probe, column: str = "url") -> DataFrame:
    """urls with ok, seconds and error of probe(url), called in parallel in the tasks; what it raises is the error."""

    def run(batches):
        for b in batches:
            rows = []
            for u in b[column]:
                began = time.monotonic()
                try:
                    rows.append((bool(probe(u)), None))
                except Exception as fault:  # noqa: BLE001
                    rows.append((False, str(fault)))
                rows[-1] = (*rows[-1], time.monotonic() - began)
            yield b.assign(ok=[r[0] for r in rows], error=[r[1] for r in rows], seconds=[r[2] for r in rows])

    return urls.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema) + ", ok boolean, error string, seconds double")


def write_probes(results: DataFrame, path: str, column: str = "url") -> None:
    """All results as CSV, and the good ones' URLs as text."""
    write_csv(results.select(column, "ok", "seconds", "error"), f"{path}/results")
    results.where("ok").select(F.col(column).cast("string")).write.mode("overwrite").text(f"{path}/good")


def quarantine(rows: DataFrame, ok, path: str, label: str) -> DataFrame:
    """The rows that are ok; the others are added to a table of failures, by label, as JSON."""
    failed = rows.where(~F.coalesce(ok, F.lit(False)))
    failed.select(F.lit(label).alias("label"), F.current_timestamp().alias("at"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("row")).write.mode("append").partitionBy("label").json(path)
    return rows.where(F.coalesce(ok, F.lit(False)))


def migrated(df: DataFrame, wanted: dict[str, str], lower: dict[str, str], values: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """df with missing columns added, lower-cased copies (new: of) filled where they are null, and old values of columns renamed."""
    out = with_columns_added(df, wanted)
    out = out.withColumns({new: F.coalesce(F.col(new) if new in out.columns else F.lit(None).cast("string"), F.lower(F.trim(of))) for new, of in lower.items()})
    for column, names in (values or {}).items():
        renamed = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        out = out.withColumn(column, F.coalesce(F.try_element_at(renamed, F.col(column)), F.col(column)))
    return out
