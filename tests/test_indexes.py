"""Joins by blocks, cells, grams and spans against all pairs, and plans without nested loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hearthline.operators import asof, geo, links, rates, rent
from hearthline.plans import accounts, catalog, listings  # noqa: F401

SF = "/root/testdata/sf0.001"
RANGES = "start long, end long, bucket string, priority int"


def test_ranges_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(a, a + rng.choice([0, 1, 7, 64, 500, -1]), f"b{i}", rng.randrange(20)) for i, a in enumerate(rng.randint(-600, 600) for _ in range(60))] + [(None, 5, "none", 0)]
    values = [*range(-700, 1200), None, 5, 5]
    got = rent.range_lookup(spark.createDataFrame([(v,) for v in values], "v long"), "v", spark.createDataFrame(rows, RANGES), "b").collect()
    want = lambda v: min([(p, b) for a, z, b, p in rows if v is not None and a is not None and a <= v <= z], default=(0, None))[1]
    assert sorted(map(str, got)) == sorted(f"Row(v={v!r}, b={want(v)!r})" for v in values)
    cut = rent.blocks(spark.createDataFrame([(1, 10**9, "wide", 0)], RANGES))
    assert cut.count() <= 2 * rent.WIDEST_BLOCK  # a range is a few blocks, however wide
    assert rent.range_lookup(spark.createDataFrame([(1,)], "v long"), "v", spark.createDataFrame([], RANGES), "b").first().b is None


def _inside(x, y, rings):
    def odd(ring):
        hit, n = False, len(ring)
        for i in range(n):
            (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return n >= 3 and hit

    return odd(rings[0]) and not any(map(odd, rings[1:])) if rings else False


def test_polygons_equal_all_pairs(spark):
    """Random rings with holes, of sizes from a hundredth to a hundred; points inside, on cell borders and on corners."""
    rng = random.Random(9)
    features = []
    for i in range(25):
        size, cx, cy = 10 ** rng.uniform(-2, 2), rng.uniform(-20, 20), rng.uniform(-20, 20)
        ring = lambda s: [[cx + rng.uniform(-s, s), cy + rng.uniform(-s, s)] for _ in range(rng.choice([3, 5, 9]))]  # noqa: B023, E731
        features.append((rng.randrange(6) * 100 + i, f"f{i}", [[ring(size), ring(size / 3)], [ring(size / 2)]][: rng.choice([1, 2])]))
    features += [(1, "flat", [[[[1.0, 1.0], [1.0, 1.0], [1.0, 1.0]]]]), (2, "none", []), (3, "point", [[[]]])]
    points = [(rng.uniform(-30, 30), rng.uniform(-30, 30)) for _ in range(1500)] + [(rng.randint(-80, 80) / 4, rng.randint(-80, 80) / 8) for _ in range(800)] + [tuple(p) for _, _, f in features for r in f for ring in r for p in ring]
    rows = [(i, *p) for i, p in enumerate(points)] + [(-1, None, 1.0), (-2, 1.0, None)]
    kind = "priority int, name string, polygons array<array<array<array<double>>>>"
    got = geo.locate(spark.createDataFrame(rows, "id int, lon double, lat double"), spark.createDataFrame(features, kind), "id").collect()
    for r in got:
        want = min([(p, n) for p, n, f in features if r.lon is not None and r.lat is not None and any(_inside(r.lon, r.lat, rings) for rings in f)], default=(0, None))[1]
        assert r.bucket == want, r
    assert len(got) == len(rows) and sum(r.bucket is not None for r in got) > 300
    assert geo.locate(spark.createDataFrame(rows[:2], "id int, lon double, lat double"), spark.createDataFrame([], kind), "id").where("bucket IS NULL").count() == 2


def test_cells_decide_most_points(spark):
    ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    f = spark.createDataFrame([(0, 0, 1 / 16, [[ring]], 0.0, 1.0, 0.0, 1.0)], "fid long, level int, side double, polygons array<array<array<array<double>>>>, x0 double, x1 double, y0 double, y1 double")
    assert {r.inner: r.n for r in geo.cover(f).groupBy("inner").agg(F.count("*").alias("n")).collect()} == {True: 15 * 15, False: 17 * 4 - 4}


def test_needles_equal_all_pairs(spark):
    rng = random.Random(2)
    hosts = ["".join(rng.choices("ab.c", k=rng.randint(0, 8))) for _ in range(80)]
    needles = [(i, f"d{i}", "".join(rng.choices("ab.c", k=rng.randint(1, 5)))) for i in range(12)]
    pages = spark.createDataFrame([(i, f"https://{h}/x") for i, h in enumerate(hosts)] + [(-1, None)], "page_id int, url string")
    for r in links.dispatch(pages, spark.createDataFrame(needles, "priority int, name string, needle string")).collect():
        host = hosts[r.page_id] if r.page_id >= 0 else None
        assert r.driver == next((n for _, n, w in needles if host is not None and w in host), None)


@pytest.mark.parametrize("span", [1, 10, 1000])
def test_asof_equals_a_loop(spark, span):
    rng = random.Random(span)
    entries = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-50, 200)]), rng.choice([None, 1.5, 2.5])) for _ in range(120)]
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(-60, 260)])) for i in range(300)]
    got = asof.asof_join(spark.createDataFrame(rows, "id int, k string, ts long"), spark.createDataFrame(entries, "k string, ts long, v double"), ["k"], "ts", ["v"], span).collect()
    assert len(got) == len(rows)
    for r in got:
        past = [(t, v is not None, v or 0) for k, t, v in entries if k == r.k and t is not None and r.ts is not None and t <= r.ts]
        at, known, v = max(past, default=(None, False, 0))
        assert (r.entry_ts, r.v) == (at, v if known else None)


def test_estimates_of_many_moments_equal_single_ones(spark):
    cache = spark.createDataFrame([("dnb_rate", 5.0, 10), ("dnb_rate", 5.5, 100), ("policy_rate", 4.5, 999_990), ("margin", 1.1, 5), ("dnb_rate", 9.0, 2_000_000), ("dnb_rate", 9.5, 2_000_000)], "name string, value double, ts long")
    moments = [0, 5, 10, 99, 604_810, 1_000_000, 1_086_390, 2_000_000, 9_000_000]
    many = {r.ts: tuple(r)[1:] for r in rates.interest_estimates(spark.createDataFrame([(t,) for t in moments] + [(5,)], "ts long"), cache).collect()}
    unique = cache.groupBy("name", "ts").agg(F.max("value").alias("value"))
    for t in moments:
        assert many[t] == tuple(rates.interest_estimate(unique, F.lit(t)).first())
    fetched = rates.interest_estimates(spark.createDataFrame([(1_000_000, 6.0), (None, None)], "ts long, fetched_bank double"), cache).collect()
    assert {(r.rate, r.source) for r in fetched} == {(6.0, "dnb"), (5.75, "policy+margin")}


@pytest.mark.parametrize("name", ["rent_estimate", "geo_bucket", "driver_dispatch", "rates_asof", "key_numbers", "finding_report", "bucket_ratio", "listing_projection"])
def test_no_nested_loops(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_candidates_are_dealt_by_page_once(spark):
    """Best candidates and a page's fields come from one exchange by the page; orders of one small file are dealt over all cores."""
    df = catalog.QUERIES["key_numbers"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and not re.search(r"Exchange hashpartitioning\(o_orderkey#\d+L, (field|obj)#", plan)
