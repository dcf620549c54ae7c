import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hearthline.llm import mixing
from hearthline.llm.entry import op10_mixing
from tests.llm.conftest import MEDIUM, SMALL, as_dicts

words = lambda t: len(re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()))


def brute_targets(sizes):
    """Raise a common level in small exact steps: targets are weight times level, held at twice the size."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    goal = min(1.5 * sum(sizes), 2 * sum(sizes))
    low, high = 0.0, 4.0 * sum(sizes) + 1
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(w * level, 2 * s) for w, s in zip(weights, sizes)) < goal else (low, level)
    return [min(w * high, 2 * s) for w, s in zip(weights, sizes)]


def check(got, rows):
    size_of = defaultdict(int)
    for r in rows:
        size_of[r["source"]] += words(r["text"])
    names = sorted(size_of, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, brute_targets([size_of[s] for s in names]), strict=True))
    assert len(got) == len(rows)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["source_size"] == size_of[r["source"]] and r["target"] == pytest.approx(target[r["source"]], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    repeated = max(Counter((r["doc_id"], r["source"], r["text"]) for r in rows).values())
    for s in names:
        assert abs(taken[s] - target[s]) <= longest[s] * repeated + 1e-6
    return {s: (taken[s], target[s]) for s in names}


@pytest.mark.parametrize("sf", [SMALL, MEDIUM])
def test_whole_table(spark, sf):
    got, rows = as_dicts(op10_mixing(spark, sf)), spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r["doc_id"], words(r["text"])) for r in rows)
    for source, (took, aim) in check(got, rows).items():
        usual = np.median([words(r["text"]) for r in rows if r["source"] == source])  # a tiny source can't come nearer than a small document
        assert took == pytest.approx(aim, rel=0.01, abs=usual)


def test_reruns_and_layouts_agree(small):
    key = lambda df: sorted((r["_id"], r["_copies"]) for r in df.collect())
    assert key(mixing.plan_copies(small)) == key(mixing.plan_copies(small.repartition(9))) != key(mixing.plan_copies(small, seed=4))


def test_tree(small, small_rows, monkeypatch):
    """Chunks of five rows and a fan-in of two: many levels."""
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 5)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    plan = as_dicts(mixing.plan_copies(small))
    got = [{"doc_id": r["_id"], "source": r["_source"], "size": r["_size"], "source_size": r["_source_size"], "target": r["_target"], "taken": r["_copies"] * r["_size"]} for r in plan for _ in range(r["_rows"])]
    check(got, small_rows)


def test_pivot_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    mass, prob = np.array([5, 1, 8, 0, 3, 7]), np.array([0.3, 0.9, 0.5, 0.25, 0.0, 0.6])
    total = np.zeros(6)
    for _ in range(4000):
        out = mixing.pivot(mass, prob, rng)
        assert out @ mass == pytest.approx(mass @ prob) and sum(0 < p < 1 for p in out) <= 1
        total += out
    assert total / 4000 == pytest.approx(prob, abs=0.03)


def test_settle_is_close_and_keeps_expectation():
    rng = np.random.default_rng(1)
    mass = np.array([900, 400, 300, 60, 50, 40, 30, 9, 5, 3, 2, 1, 1, 0])
    prob, total = np.full(14, 0.37), np.zeros(14)
    for _ in range(4000):
        out = mixing.settle(mass, prob, rng)
        assert set(out) <= {0.0, 1.0}
        total += out
    assert total / 4000 == pytest.approx(prob, abs=0.035)
    even = np.full(400, 7)
    assert abs(mixing.settle(even, np.full(400, 0.21), rng) @ even - 0.21 * even.sum()) <= 7
    assert mixing.settle(np.array([50.0]), np.array([0.5]), rng)[0] in (0, 1)


def made_targets(spark, sizes, share=1.5, most=2):
    rows = spark.createDataFrame([(f"s{i:06d}", s) for i, s in enumerate(sizes)], "_source string, _source_size long").repartition(7)
    out = sorted(mixing.with_targets(rows, (3, 1, 2), share, most).collect(), key=lambda r: r["_source"])
    assert [r["_rank"] for r in out] == list(range(len(sizes)))
    return [r["_target"] for r in out]


def test_targets(spark):
    assert made_targets(spark, [100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert made_targets(spark, []) == [] and made_targets(spark, [0, 0]) == [0, 0]
    assert made_targets(spark, [10, 20], share=5) == [20, 40]
    sizes = [5, 1000, 0, 70, 2, 900, 1]
    assert made_targets(spark, sizes) == pytest.approx(brute_targets(sizes), abs=1e-6)
    rng = np.random.default_rng(6)
    sizes = [int(x) for x in 10 ** rng.uniform(0, 6, 3000)]  # as many as hosts, say
    assert made_targets(spark, sizes) == pytest.approx(brute_targets(sizes), rel=1e-9, abs=1e-6)


def test_sources_are_ranked_by_code_point_with_null_last(spark):
    names = ["b", None, "", "a", "\U0001f600", "\uffee", "Z", "\u00e9", "a\x00", "\ud7ff"]
    got = mixing.ranked(spark.createDataFrame([(n,) for n in names], "_source string").repartition(4)).collect()
    assert [r["_source"] for r in sorted(got, key=lambda r: r["_rank"])] == [*sorted((n for n in names if n is not None)), None]


def reachable(mass, aim, most=2):
    """How near whole copies can come to the target, by trying all."""
    sums = {0}
    for m in mass:
        sums = {s + k * m for s in sums for k in range(most + 1)}
    return min(abs(s - aim) for s in sums)


def small_source(seed):
    """A handful of documents, one of which may hold half the words."""
    rng = np.random.default_rng(seed)
    mass = np.sort(rng.lognormal(5, 1, rng.integers(8, 13)).astype(int) + 1)[::-1].copy()
    if seed % 2:
        mass[0] = mass[1:].sum()
    return mass


def test_small_sources_against_all_choices():
    """A source of some ten documents ends within its smallest document, or 1 %, of the best that any choice of copies reaches; by far most do."""
    near = []
    for seed in range(60):
        mass, rate = small_source(seed), np.random.default_rng(seed).uniform(0.3, 1.7)
        aim = rate * mass.sum()
        took = mixing.settle(mass, np.full(len(mass), rate), np.random.default_rng(seed + 1000), 2, near=True) @ mass
        assert abs(took - aim) <= np.median(mass) + reachable(mass, aim)
        near.append(abs(took - aim) <= max(mass[-1], 0.01 * aim) + reachable(mass, aim))
    assert np.mean(near) >= 0.8


@pytest.mark.parametrize("near", [False, True])
def test_copies_keep_their_expectation_over_seeds(near):
    """A document of half the words: copies keep their expectation over 0 to 2, but for the small bias of `near` at the end."""
    mass, total = np.array([2770, 700, 500, 400, 300, 250, 200, 90, 50, 15]), np.zeros(10)
    for seed in range(6000):
        out = mixing.settle(mass, np.full(10, 1.2924), np.random.default_rng(seed), 2, near)
        assert set(out) <= {0.0, 1.0, 2.0} and abs(out @ mass - 1.2924 * mass.sum()) <= (90 if near else 300)
        total += out
    assert total[:7] / 6000 == pytest.approx(np.full(7, 1.2924), abs=0.05 if near else 0.03)
    assert total / 6000 == pytest.approx(np.full(10, 1.2924), abs=0.3 if near else 0.03)


def test_every_source_is_pivoted(spark):
    """Pairs are exchanged in a source of any size, not only in large ones."""
    rows = [(i, " ".join(["w"] * (5 + i)), "few" if i < 6 else "many") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    work = mixing._units(df, "source").selectExpr("*", "if(_source = 'few', 0L, 1L) _rank", "0L _group", "1L _groups", "xxhash64(_id) _order", "_size _mass", "1.3D _x", "true _up")
    out = mixing._rounded(work, 1, 0, 2).collect()
    for name, n in (("few", 6), ("many", 194)):
        own = [r for r in out if r["_source"] == name]
        assert len(own) == n and any(r["_x"] in (1.0, 2.0) for r in own)
        assert sum(r["_x"] * r["_mass"] for r in own) == pytest.approx(1.3 * sum(r["_mass"] for r in own))


def test_long_ids_and_nulls_stay_exact(spark):
    big = (1 << 62) + 1
    df = spark.createDataFrame([(big + i, "a b c", "s") for i in range(20)] + [(None, "d e", "s")], "doc_id long, text string, source string")
    assert {r["_id"] for r in mixing.plan_copies(df).collect()} == {None, *(big + i for i in range(20))}


def test_odd_rows(odd, empty):
    rows = odd.collect()
    plan = {(r["_id"], r["_source"], r["_hash"]): r for r in as_dicts(mixing.plan_copies(odd))}
    assert sum(r["_rows"] for r in plan.values()) == len(rows)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    out = as_dicts(mixed)
    assert {r["_copies"] for r in out} <= {1} and len(out) == sum(r["_copies"] * r["_rows"] for r in plan.values())
    assert sum(words(r["text"]) for r in out) == sum(r["_copies"] * r["_rows"] * r["_size"] for r in plan.values())
    assert mixing.mix(empty).count() == 0
