import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hearthline.operators import records
from hearthline.sources import tables
from hearthline.streaming import jobs

T0 = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(minutes=m), u, s) for i, (m, u, s) in enumerate(rows)], "event_id long, ts timestamp, user_id long, status string").withColumn("progress", F.col("event_id") * 10)


def test_latest_and_summary(spark):
    e = events(spark, [(0, 1, "a"), (5, 1, "b"), (5, 2, "c"), (9, 3, "d")])
    assert [r.user_id for r in records.recent(e, "user_id", "ts", 2, F.col("event_id")).collect()] == [3, 1]
    r = records.summary(e, "ts", F.lit(T0 + timedelta(minutes=5))).first()
    assert (r.total, r.recent, r.last_run_at) == (4, 3, T0 + timedelta(minutes=9))
    assert records.summary(e.limit(0), "ts", F.lit(T0)).first().total == 0


def test_windows(spark):
    e = events(spark, [(0, 1, "x"), (10, 1, "x"), (15, 1, "x"), (40, 1, "x"), (3, 2, "x")])
    assert {r.event_id: r.failures for r in records.failures_in_window(e, "user_id", "ts", 900).collect()} == {0: 1, 1: 2, 2: 3, 3: 1, 4: 1}
    assert {r.event_id: r.refused for r in records.too_soon(e, "user_id", "ts", 600).collect()} == {0: False, 1: False, 2: True, 3: False, 4: False}


def test_upsert_sets_and_pages(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    c = spark.createDataFrame([(2, "B", 1), (3, "C", 1)], "id int, v string, version int")
    assert sorted(map(tuple, records.upsert(t, c, ["id"], "version").select("id", "v").collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert records.replace_by_key(t, c, "id").count() == 3
    parent, kids = records.delete_cascade(t, {"k": c}, "id", spark.createDataFrame([(2,)], "id int"))
    assert parent.count() == 1 and kids["k"].count() == 1
    s = spark.createDataFrame([(float(i) if i % 3 else None, T0, f"l{i:02}") for i in range(20)], "score double, saved_at timestamp, label string")
    assert [r.score for r in records.page(s, records.saved_order("score_asc"), 99).collect()][-1] is None
    assert records.page(s, records.saved_order("score_desc"), 0).first().score == 19.0
    assert records.ilike(s, ["label"], "L_1").count() == 2 and records.search(s, ["label"], " L01 ").count() == 1


def test_users_and_tokens(spark):
    users = spark.createDataFrame([(1, "s1", "c1"), (2, None, "c2")], "id long, subscription_id string, customer_id string")
    e = spark.createDataFrame([(1, None, None), (None, "s1", "c2"), (9, None, "c2"), (None, None, None)], "user_id long, subscription_id string, customer_id string")
    assert sorted(str(r.resolved_id) for r in records.resolve_user(e, users).collect()) == ["1", "1", "2", "None"]
    h = spark.range(1).select(F.sha2(F.lit("t"), 256).alias("token_hash"), F.lit(None).cast("timestamp").alias("used_at"), F.lit(T0).alias("expires_at"))
    assert records.valid_tokens(h, "t", F.lit(T0)).count() == 1 and records.valid_tokens(h, "u", F.lit(T0)).count() == 0
    assert records.conflicts(spark.createDataFrame([(1, "A"), (2, " a"), (3, "b")], "id int, n string"), "id", records.canonical_username(F.col("n"))).count() == 2


def test_rent_table(spark, tmp_path):
    f = tmp_path / "rent.csv"
    f.write_text("city,bucket,segment,kr_per_m2,updated\nOslo,Oslo vest,Standard,\"410,5\",Q1\nOslo,Oslo vest,standard,420,Q2\nOslo,x,,1,\nOslo,y,standard,bad,Q1\n")
    got = {(r.bucket, r.segment): (r.kr_per_m2, r.updated) for r in tables.rent_table(spark, str(f)).collect()}
    assert got == {("Oslo vest", "standard"): (420.0, "Q2"), ("x", "standard"): (1.0, "—")}
    p = tmp_path / "post.csv"
    p.write_text("postnr,bydel,bucket\n0150,Sentrum,\n15,x,y\n")
    assert [tuple(r) for r in tables.postcode_table(spark, str(p)).collect()] == [("0150", "Sentrum", None)]


def test_json_sources(spark, tmp_path):
    f = tmp_path / "h.jsonl"
    f.write_text(json.dumps({"id": "1", "ts": "2024-01-01T00:00:00+00:00", "finn_url": "u", "price": 5, "result_args": {"a": "b"}}) + "\n\n{bad\n")
    assert tables.history(spark, str(f), permissive=True).where("id is not null").first().ts == T0
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        tables.history(spark, str(f)).collect()
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"dnb_rate": {"value": 5.5, "timestamp": "x", "ts": 7}}))
    assert [(r.name, r.value, r.ts) for r in tables.cache_entries(spark, str(c)).collect()] == [("dnb_rate", 5.5, 7)]
    g = tmp_path / "g.json"
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    g.write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"name": " A "}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [square]}}, {"properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}}]}))
    assert [(r.name, len(r.polygons)) for r in tables.geojson(spark, str(g)).orderBy("priority").collect()] == [("A", 1), ("B", 1)]
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1")
    assert tables.document_table(spark, str(tmp_path)).first().is_pdf
    assert spark.range(1).select(tables.decode_upload(F.lit("data:application/pdf;base64,JVBERg=="))).first()[0] == b"%PDF"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    e = events(spark, [(0, 1, "queued"), (1, 1, "running"), (2, 1, "done"), (3, 2, "queued"), (200, 3, "queued")])
    e.coalesce(1).write.parquet(str(src))
    stream = jobs.event_stream(spark, str(src), e)
    hit = jobs.run_to_memory(jobs.failed_attempts(stream, "user_id", limit=3), "hits")
    assert {r.user_id for r in hit.collect()} == {1}
    states = jobs.run_to_memory(jobs.latest_states(jobs.event_stream(spark, str(src), e)), "states", "complete")
    assert {r.user_id: r.status for r in states.collect()} == {1: "done", 2: "queued", 3: "queued"}
    q = jobs.merge_states(jobs.event_stream(spark, str(src), e), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    assert {r.user_id: r.status for r in spark.read.parquet(str(tmp_path / "out/v=0")).collect()} == {1: "done", 2: "queued", 3: "queued"}
