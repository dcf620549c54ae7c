import json

import pytest
from pyspark.sql import functions as F

from hearthline.functions import web
from hearthline.operators import brokers, listing, records
from hearthline.sources import html, tables
from hearthline.streaming import jobs


def one(spark, *columns, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(*columns).first()


# -- brokers --


@pytest.mark.parametrize(
    ("url", "name"),
    [
        ("https://www.dnbeiendom.no/x", "dnbeiendom"), ("https://PRIVATMEGLEREN.no/1234567", "privatmegleren"), ("https://krogsveen.no/kjope/1", "krogsveen"), ("https://krogsveen.no/om", "generic_local"),
        ("https://partners.no/eiendom/1", "partners"), ("https://x.no/?tenant=4", "partners"), ("https://meglervisning.no/salgsoppgave/hent?instid=MSEXBO", "exbo"), ("https://meglervisning.no/salgsoppgave/hent?id=1", "exbo"),
        ("https://meglervisning.no/salgsoppgave/hent?instid=ABC", "generic_local"), ("https://sormegleren.no/1", "sormegleren"), (None, "generic_local"), ("", "generic_local"),
    ],
)
def test_broker_of(spark, url, name):
    assert spark.range(1).select(brokers.broker_of(F.lit(url).cast("string"))).first()[0] == name


def judge(spark, name, url, label="", page="https://x.no/1234567"):
    n, u, t, p = (F.lit(x).cast("string") for x in (name, url, label, page))
    return tuple(spark.range(1).select(brokers.allowed(n, u, t), brokers.score(n, u, t, p)).first())


@pytest.mark.parametrize(
    ("name", "url", "label", "want"),
    [
        ("aktiv", "https://file-proxy.rfcdn.io/a/salgsoppgave.pdf", "Salgsoppgave", (True, 125)),
        ("aktiv", "https://a.no/tilstandsrapport.pdf", "Prospekt", (False, 85)),
        ("eie", "https://cdn.eiendomssentralen.no/digital_salgsoppgave.pdf", "Prospekt", (True, 150)),
        ("eie", "https://a.no/files/salgsoppgave.pdf", "", (False, 20)),
        ("ask", "https://outgoing.webtopsolutions.com/hires/1.pdf", "", (True, 55)),
        ("ask", "https://a.no/salgsoppgave", "", (False, 30)),
        ("privatmegleren", "https://a.no/docs/klikk.pdf#1", "Se PDF", (False, -460)),
        ("privatmegleren", "https://a.no/1234567.pdf", "", (True, 65)),
        ("partners", "https://a.no/proxy/webmegler/1/wngetfile.ashx", "", (True, 350)),
        ("nordvik", "https://a.no/salgsoppgave", "x.pdf", (True, 90)),
        ("heimdal", "https://meglervisning.no/salgsoppgave/hent?estateid=1", "", (True, 0)),
        ("heimdal", "https://meglervisning.no/salgsoppgave/hent?x=1", "", (False, 0)),
        ("garanti", "https://digitalsalgsoppgave.garanti.no/1", "", (True, 0)),
        ("rele", "https://a.no/proxy/vitec/document/1", "Prospekt", (True, 320)),
        ("semjohnsen", "https://cdn.sanity.io/files/a.pdf", "For utskrift", (True, 220)),
        ("sormegleren", "https://a.no/Vedlegg/Document/1", "Energiattest", (False, 0)),
        ("boa", "https://a.no/vedlegg.pdf", "Takst", (False, -162)),
        ("exbo", "https://meglervisning.no/salgsoppgave/hent?id=2", "", (True, 0)),
        ("generic_local", "https://a.no/prospekt.pdf", "", (True, 35)),
        ("generic_local", "https://a.no/klikk.pdf", "Prospekt", (False, 10)),
        ("generic_local", None, "Prospekt", (False, 0)),
    ],
)
def test_broker_rules(spark, name, url, label, want):
    assert judge(spark, name, url, label) == want


def test_prospectus_links_of_pages(spark):
    page = "<a href='/energiattest.pdf'>Energiattest</a><a href='/a.pdf'>Salgsoppgave</a><a href='/prospekt.pdf'>Se PDF</a>"
    df = spark.createDataFrame([(1, "https://boaeiendom.no/1", page), (2, "https://x.no/2", "<p>none</p>"), (3, None, None)], "page_id long, url string, html string")
    assert [(r["page_id"], r["broker"], r["link"], r["score"]) for r in brokers.prospectus_links(df).collect()] == [(1, "boa", "https://boaeiendom.no/a.pdf", 80)]


# -- listings --


def test_json_entries_are_read_once_in_order(spark):
    docs = [json.dumps({"Asking Price": {"amount": None, "formatted": "3 kr"}, "list": [{"byggeår": 1990}, {"ownershipType": ["Selveier"]}], "flag": True}), json.dumps([{"asking_price": 9}])]
    got = html.json_entries(docs)
    assert [(e["key"], e["value"]) for e in got] == [("asking price", "3 kr"), ("amount", None), ("formatted", "3 kr"), ("list", None), ("byggear", "1990"), ("ownershiptype", "Selveier"), ("flag", "True"), ("asking price", "9")]
    assert html.json_entries(None) == []
    df = spark.createDataFrame([(docs,), (None,)], "d array<string>")
    rows = df.select(html.json_value(F.col("d"), "askingprice").alias("a"), html.json_value(F.col("d"), "byggeår").alias("b"), html.json_value(F.col("d"), "type ownership").alias("c")).collect()
    assert tuple(rows[0]) == ("3 kr", "1990", None) and tuple(rows[1]) == (None, None, None)


def test_key_numbers_of_a_page(spark):
    doc = {"location": {"streetAddress": "Gate 1", "postalCode": "5003", "addressLocality": "Bergen"}, "price": {"totalPrice": 3500000.0, "sharedCost": {"value": "4 200 kr"}}, "viewings": [{"viewingFrom": "2024-05-01T12:00", "viewingTo": "2024-05-01T13:00"}], "bedrooms": "3 stk"}
    df = spark.createDataFrame([(1, [json.dumps(doc)], "https://x.no/?finnkode=12345678")], "id int, d array<string>, url string").withColumn("entries", html.entries(F.col("d")))
    df = df.withColumn("pairs", F.array(F.struct(F.lit("energimerking").alias("key"), F.lit(" B ").alias("value")), F.struct(F.lit("bruksareal bra").alias("key"), F.lit("62,5 m²").alias("value"))))
    got = {k: v for k, v in listing.key_numbers(df, "id").first()["key_numbers"].items() if v is not None}
    assert got == {"adresse": "Gate 1, 5003 Bergen", "totalpris": "3500000", "felleskostnader": "4200", "soverom": "3", "energimerke": "B", "BRA (m²)": "62.5", "finn-kode": "12345678", "visningstidspunkter": "2024-05-01T12:00/2024-05-01T13:00"}
    empty = listing.key_numbers(df.withColumns({"entries": F.lit(None).cast(html.ENTRIES), "pairs": F.lit(None).cast("array<struct<key:string,value:string>>"), "url": F.lit(None).cast("string")}), "id").select(listing.has_any_number(F.col("key_numbers")), "key_numbers").first()
    assert empty[0] is False


# -- streaming --


EVENTS = "event_id long, user_id long, status string, progress long, ts timestamp"


def event(spark, *rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, status string, progress long, at string").select("event_id", "user_id", "status", "progress", F.to_timestamp("at").alias("ts"))


def run_batches(spark, tmp_path, *batches):
    """Each batch arrives as a file after the one before was merged."""
    source, table, mark = (f"{tmp_path}/{x}" for x in ("in", "table", "mark"))
    for b in batches:
        b.coalesce(1).write.mode("append").parquet(source)
        jobs.merge_states(jobs.event_stream(spark, source, b), table, mark).awaitTermination()
    return source, table, mark


def test_merged_states_equal_those_of_all_events(spark, tmp_path):
    one_ = event(spark, (1, 1, "queued", 5, "2024-01-01 10:00:00"), (2, 1, "running", 70, "2024-01-01 10:05:00"), (3, 2, "running", 30, "2024-01-01 10:00:00"))
    two = event(spark, (4, 1, "running", 40, "2024-01-01 10:06:00"), (5, 2, "failed", 99, "2024-01-01 10:07:00"), (6, 3, "done", 55, "2024-01-01 10:00:00"))
    late = event(spark, (7, 1, "queued", 5, "2024-01-01 09:00:00"))
    _, table, _ = run_batches(spark, tmp_path, one_, two, late)
    every = one_.unionByName(two).unionByName(late)
    want = sorted(map(tuple, records.job_states(every, "user_id", "ts", "event_id").collect()))
    got = jobs.states_at(spark, table, 2)
    assert sorted(map(tuple, got.select("user_id", "status", "progress", "created_at", "updated_at", "n_events").collect())) == want
    state = {r["user_id"]: (r["status"], r["progress"], r["n_events"]) for r in got.collect()}
    assert state == {1: ("running", 40, 4), 2: ("failed", 30, 2), 3: ("done", 100, 1)}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    first, second = event(spark, (1, 1, "queued", 5, "2024-01-01 10:00:00")), event(spark, (2, 1, "running", 40, "2024-01-01 10:06:00"))
    source, table, mark = run_batches(spark, tmp_path, first, second)
    before = jobs.states_at(spark, table, 1).collect()
    # As after a crash between the write and the commit: the last batch runs again.
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name in ("1", ".1.crc"):
        hadoop.Path(mark).getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop.Path(f"{mark}/commits/{name}"), False)
    jobs.merge_states(jobs.event_stream(spark, source, first), table, mark).awaitTermination()
    assert jobs.states_at(spark, table, 1).collect() == before and before[0]["n_events"] == 2


def test_trailing_window_of_failures(spark, tmp_path):
    """Three failures across any edge count; state and batches don't matter."""
    rows = [(i, 1, "error", 0, f"2024-01-01 10:{m:02d}:00") for i, m in enumerate((4, 9, 14, 40, 52, 56))]
    first, second = event(spark, *rows[:2]), event(spark, *rows[2:], (99, 2, "error", 0, "2024-01-01 10:00:00"))
    source = f"{tmp_path}/in"
    first.coalesce(1).write.parquet(source)
    out, mark = f"{tmp_path}/out", f"{tmp_path}/mark"
    for batch in (None, second):
        if batch is not None:
            batch.coalesce(1).write.mode("append").parquet(source)
        alerts = jobs.failed_attempts(jobs.event_stream(spark, source, first), "user_id", limit=3, seconds=900)
        alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["user_id"], str(r["ts"]), str(r["since"])) for r in spark.read.parquet(out).collect())
    assert got == [(1, "2024-01-01 10:14:00", "2024-01-01 10:04:00")]


# -- sources --


def test_replace_table_may_read_what_it_replaces(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.json(path)
    tables.replace_table(spark.read.json(path).withColumn("id", F.col("id") + 10), path)
    assert sorted(r["id"] for r in spark.read.json(path).collect()) == [10, 11, 12]
    tables.replace_table(spark.range(2), f"{tmp_path}/new")
    assert spark.read.json(f"{tmp_path}/new").count() == 2


def test_cache_hits_and_misses(spark, tmp_path):
    path = f"{tmp_path}/cache"
    rows = [("a/1", '{"tg_version": 2, "tg2_details": [{"label": "x"}]}'), ("b", '{"tg_version": 1, "tg2_details": []}'), ("c", "{broken"), ("d", "[1]")]
    tables.save_cache(spark.createDataFrame(rows, "analysis_id string, payload string"), path)
    tables.save_cache(spark.createDataFrame([("b", '{"tg_version": 2, "tg2_details": []}')], "analysis_id string, payload string"), path)
    got = tables.load_cache(spark.createDataFrame([("a/1",), (" b ",), ("c",), ("d",), ("none",)], "analysis_id string"), path)
    assert {r["analysis_id"].strip(): r["hit"] for r in got.collect()} == {"a/1": True, "b": True, "c": False, "d": False, "none": False}


def test_rates_round_trip(spark, tmp_path):
    rows = [("dnb_rate", 5.1, "2024", 17), ("policy_rate", 4.5, "2023", 9)]
    tables.write_rates(spark.createDataFrame(rows, "name string, value double, timestamp string, ts long"), f"{tmp_path}/r")
    assert sorted(map(tuple, tables.cache_entries(spark, f"{tmp_path}/r").collect())) == rows


def test_export_file(spark, tmp_path):
    rows = [(2, 'Hus "Ro"', None, None, None, None, None, 0.0, None), (1, "Gate 1,  Bergen", None, "2024-01-02 03:04:05", 71.5, "Lav", "12", 3.5e6, "u")]
    df = spark.createDataFrame(rows, "pos long, address string, title string, s string, score double, risk string, code string, price double, url string").withColumn("saved_at", F.to_timestamp("s"))
    tables.write_export(df, f"{tmp_path}/x")
    (part,) = (tmp_path / "x").glob("part-*")  # Spark's own reader would drop the mark
    assert part.read_text(encoding="utf-8").splitlines() == ["﻿Adresse,Dato analysert,Total score,Risiko,FINN-kode,Pris,Kilde", '"Gate 1, Bergen",2024-01-02T03:04:05.000Z,72,Lav,12,3500000,u', '"Hus ""Ro""",,,,,,']


def test_documents_probes_failures_and_migration(spark, tmp_path):
    docs = spark.createDataFrame([("1", "u", b"x"), ("2", "v", b"x"), ("3", "w", None)], "finnkode string, url string, content binary")
    tables.persist_documents(docs, f"{tmp_path}/d")
    assert spark.read.parquet(f"{tmp_path}/d/content").where("content is not null").count() == 1 and spark.read.parquet(f"{tmp_path}/d/meta").count() == 3

    def probe(url):
        if url == "bad":
            raise OSError("no route")
        return url == "good"

    results = tables.probed(spark.createDataFrame([("good",), ("bad",), ("off",)], "url string"), probe)
    tables.write_probes(results, f"{tmp_path}/p")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/p/good").collect()] == ["good"]
    assert {r["url"]: r["error"] for r in spark.read.option("header", True).csv(f"{tmp_path}/p/results").collect()} == {"good": None, "bad": "no route", "off": None}

    kept = tables.quarantine(spark.range(4), F.col("id") > 1, f"{tmp_path}/q", "small")
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]
    assert sorted(json.loads(r["row"])["id"] for r in spark.read.json(f"{tmp_path}/q").collect()) == [0, 1]

    users = spark.createDataFrame([(" Ola ", "USER"), (None, "ADMIN")], "username string, role string")
    out = tables.migrated(users, {"avatar": "string"}, {"username_canonical": "username"}, {"role": {"USER": "user", "ADMIN": "admin"}})
    assert sorted(map(tuple, out.select("username_canonical", "role", "avatar").collect()), key=str) == [("ola", "user", None), (None, "admin", None)]


def test_values_of_nothing(spark):
    """Nulls give null, false or the stated text, never a failure."""
    n = F.lit(None).cast("string")
    d = F.lit(None).cast("double")
    t = F.lit(None).cast("timestamp")
    got = spark.range(1).select(
        web.click_score(n, n), web.clickable(n), web.dummy_pdf(n), web.url_allowed(n), web.listing_image(n), web.floor_plan(n), web.saved_summary(d, d, n), web.economy_in(n), web.username_ok(n), web.password_ok(n),
        web.avatar_emoji(n), web.avatar_colour(n), web.membership(t, F.current_timestamp()), web.history_title(n, n, n), F.size(web.clean_strings(F.lit(None).cast("array<string>"))), web.number_or_null(n), web.object_or_null(n),
    ).first()
    assert tuple(got) == (0, False, False, True, False, False, None, None, False, False, None, None, "Medlem siden ukjent", "Ukjent adresse", 0, None, None)
