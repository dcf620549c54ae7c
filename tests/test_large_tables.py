"""Values and plans that only large tables bring about."""

import duckdb
import pyspark.sql.functions as F

from hearthline.functions import texts
from hearthline.operators import facts, issues
from hearthline.plans import accounts, catalog, listings  # noqa: F401
from hearthline.sources import html

SF = "/root/testdata/sf0.001"


def test_membership_of_large_ids_equals_its_twin(spark, tmp_path):
    """Moments after the year 9999, which the small tables don't reach."""
    spark.read.parquet(f"{SF}/events.parquet").limit(60).withColumn("event_id", F.col("event_id") * 97_003 + 1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = sorted(map(tuple, catalog.QUERIES["membership"](spark, str(tmp_path)).select("event_id", "told", "stamp").collect()))
    assert got == sorted(con.execute(catalog.ORACLE["membership"]).fetchall())
    assert any(stamp and stamp.index("-") == 5 for _, _, stamp in got)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_are_normalised_once(spark):
    """A filter on the normal form computes it anew for each use, all its patterns included."""
    lines = spark.range(5).select("id", F.lit("TG3 Bad: fukt i membran").alias("line")).selectExpr("id doc_id", "id pos", "line")
    tagged = issues.tagged(lines, 3)
    assert optimized(tagged).count("tilstands") == 1
    assert [tuple(r) for r in tagged.select("doc_id", "plain", "key").where("doc_id = 3").collect()] == [(3, "Bad: fukt i membran", "bad: fukt i membran")]


def test_terms_as_one_pattern(value):
    """Terms within tokens, tokens within terms, and edge punctuation before a line's end, as the loop over terms had them."""
    got = [value(issues.is_specific(F.lit(t), ("takst", "x y"), ("fukt", "dør", "a.b c"))) for t in ("taksten: fuktig", "takst: fu", "stakst og fukt", "  ex y: fukt", "takster a.b c", "takster axb c", "takst: d osv", "takst: dxr os")]
    assert got == [True, True, False, True, True, False, True, False]
    assert value(texts.trim_edges(F.lit(". a -.\n")), texts.trim_edges(F.lit("–a ")), texts.has_any(F.lit("axb"), ("a.b",)), texts.has_any(F.lit("x(a.b"), ("(a.b",))) == ("a\n", "a", False, True)


def test_saved_records_are_spread(spark):
    """Parts lie in one small file: their facts are made in as many tasks as there are cores."""
    df = catalog.QUERIES["saved_facts"](spark, SF)
    assert "Repartition" in optimized(df)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    raw = F.lit('[{"key": " a ", "order": "nan"}, [1], {}, null, "x", {"id": "b", "value": null, "order": "1e1"}, {"key": 1, "slug": "c", "amount": [1], "order": "Infinity"}]')
    got = [tuple(r) for r in spark.range(1).select(F.inline(facts.saved_facts(raw))).collect()]
    assert got == [("b", "b", None, None, 10.0), ("a", "a", None, None, None), ("c", "c", "[1]", None, float("inf"))]


def test_image_rules_look_at_a_path_once(spark):
    """No loop over words within which a URL's path is taken out anew for each."""
    plan = optimized(catalog.QUERIES["image_kinds"](spark, SF))
    assert "lambdafunction" not in plan


def test_pages_are_read_by_slices(spark):
    """What becomes Python's objects at one time is bounded in rows and characters, and no page is lost at a bound."""
    assert list(html._slices([1] * 130)) == [(0, 64), (64, 128), (128, 130)] and list(html._slices([])) == []
    assert list(html._slices([5, 2 << 20, 1 << 19, 1 << 19, 1])) == [(0, 1), (1, 2), (2, 4), (4, 5)]
    pages = spark.range(0, 150, 1, 1).select("id", F.when(F.col("id") != 7, F.format_string("<dl><dt>Rom</dt><dd>%d</dd></dl><img src='images/%d.png'>", "id", "id")).alias("html"))
    got = {r["id"]: (r["labels"], r["marks"], r["text"]) for r in html.with_listing(pages).collect()}
    assert len(got) == 150 and got[7] == ([], {}, "") and got[149] == ([("Rom", "149", 0)], {"gallery": "images/149.png"}, "Rom 149")
