import numpy as np
import pytest

from hearthline.llm import topk
from hearthline.llm.entry import op2_exact_topk
from tests.llm.conftest import SMALL


def brute(vectors: dict, k=10, every=100, scale=1024):
    q = {i: np.floor(np.array(v, float) * scale).astype(object) for i, v in vectors.items()}
    out = []
    for i in q:
        if i % every == 0:
            score = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)
            out += [(i, r + 1, j, int(-s)) for r, (s, j) in enumerate(score[:k])]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_whole_table(spark):
    table = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    assert rows(op2_exact_topk(spark, SMALL)) == brute(table)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    table = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (100, [-1.0]), (7, []), (8, [3.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 1) for r in table], "vec_id long, embedding array<double>, score int, rank int")
    padded = {0: [1, 2], 1: [1, 2], 2: [1, 2], 100: [-1, 0], 7: [0, 0], 8: [3, 0]}
    assert rows(topk.exact_topk(df)) == brute(padded)
    assert topk.exact_topk(df.limit(0)).count() == 0


def test_huge_values_are_exact(spark):
    table = {0: [3e8, -1.0], 1: [2e3, 5.0], 2: [2e3, 6.0], 3: [-2e3, 1e9]}
    assert rows(topk.exact_topk(spark.createDataFrame(list(table.items()), "vec_id long, embedding array<double>"))) == brute(table)


@pytest.mark.parametrize("clustered", [True, False])
def test_pruning_skips_blocks_and_stays_exact(clustered):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 3, (20, 8))
    x = (np.repeat(centres, 100, axis=0) + rng.normal(0, 0.2, (2000, 8)) if clustered else rng.normal(0, 1, (2000, 8))) * 1024
    x, ids = np.floor(x).astype(np.int64), np.arange(2000)
    blocks = [(ids[i : i + 100], x[i : i + 100], x[i : i + 100].max(axis=0), x[i : i + 100].min(axis=0)) for i in range(0, 2000, 100)]
    own = ids[::50]
    scores, names, scored = topk.search_blocks(blocks, own, x[own], np.full(len(own), -(1 << 63)), 10)
    for r, q in enumerate(own):
        full = x @ x[q]
        order = [j for j in np.lexsort((ids, -full)) if j != q][:10]
        assert names[r].tolist() == order and scores[r].tolist() == full[order].tolist()
    if clustered:
        assert scored < len(own) * len(blocks) / 2


def test_repeated_ids_stay_apart(spark):
    """Each row is a candidate of all rows but itself; rows of a query's id are queries each, and find one another."""
    table = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 2.0]), (5, [4.0, 1.0]), (5, [4.0, 1.0]), (5, [1.0, 1.0]), (7, [0.5, 0.5])]
    q = [(i, [int(1024 * x) for x in v]) for i, v in table]
    want = []
    for a, (i, x) in enumerate(q):
        if i % 100 == 0:
            score = sorted((-sum(s * t for s, t in zip(x, y)), j) for b, (j, y) in enumerate(q) if b != a)
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(score[:4])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    assert rows(topk.exact_topk(df, k=4)) == sorted(want)


def test_pairs_are_pruned_before_blocks_are_copied(spark, monkeypatch):
    """Many groups and batches: whole pairs drop out by their maxima, the result stays that of brute force."""
    monkeypatch.setattr(topk, "GROUP_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "BATCH_QUERIES", 4)
    monkeypatch.setattr(topk, "BOUND_GROUPS", 3)
    seen, keep = {}, topk.materialize
    monkeypatch.setattr(topk, "materialize", lambda df, name, *by: seen.setdefault(name, keep(df, name, *by)))
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4, (12, 6))
    table = {i: (centres[i % 12] + rng.normal(0, 0.1, 6)).tolist() for i in range(600)}
    df = spark.createDataFrame(list(table.items()), "vec_id long, embedding array<double>")
    assert rows(topk.exact_topk(df, query_every=10)) == brute(table, every=10)
    parts, batches = seen["blocks"].select("part").distinct().count(), seen["queries"].count()
    assert parts >= 10 and batches >= 10 and seen["pairs"].count() < parts * batches / 2
