import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hearthline.llm import sharding
from hearthline.llm.entry import op9_sharding
from tests.llm.conftest import SMALL, as_dicts


def check_shards(rows, total, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(shards)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_whole_table(spark, small_rows):
    rows = as_dicts(op9_sharding(spark, SMALL))
    check_shards(rows, len(small_rows), 16)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in small_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_reruns_and_layouts_agree(small):
    table = small.select("doc_id", "source")
    key = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())
    assert key(sharding.shard_rows(table)) == key(sharding.shard_rows(table.repartition(7))) != key(sharding.shard_rows(table, seed=1))


def test_matrix_has_exact_margins():
    counts, sizes = [5, 0, 17, 200, 1], sharding.shard_sizes(223, 7)
    m = sharding.communication_matrix(counts, sizes, 3)
    assert [sum(r) for r in m] == counts and [sum(c) for c in zip(*m)] == sizes and min(map(min, m)) >= 0


@pytest.mark.parametrize("limit", [10**9, 1])
def test_hypergeometric_law(monkeypatch, limit):
    """Both generators follow the hypergeometric probabilities."""
    monkeypatch.setattr(sharding, "_NUMPY_MOST", limit)
    rng, n = np.random.default_rng(0), 20_000
    seen = Counter(sharding.hypergeometric(rng, 7, 9, 6) for _ in range(n))
    for k in range(7):
        p = math.comb(7, k) * math.comb(9, 6 - k) / math.comb(16, 6)
        assert seen[k] / n == pytest.approx(p, abs=4 * math.sqrt(p * (1 - p) / n) + 1e-4)


def test_uniform(spark):
    """Every row reaches every shard and slot alike, over seeds."""
    table, seen = spark.range(24).withColumnRenamed("id", "k"), Counter()
    for seed in range(12):
        seen.update((r["shard"], r["k"] < 12) for r in sharding.shard_rows(table, 4, seed=seed).collect())
    assert all(seen[s, half] > 15 for s in range(4) for half in (True, False))  # 36 expected, sd 3


def test_odd_rows(odd, empty):
    out = sharding.shard_rows(odd, 5)
    assert out.columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = as_dicts(out)
    check_shards(rows, odd.count(), 5)
    assert {r["_p"] for r in rows} == {1}
    assert sharding.shard_rows(empty).count() == 0


def test_small_blocks(spark):
    table = spark.createDataFrame([(None if i % 3 else i, {"a": i}) for i in range(500)], "k long, m map<string,long>")
    check_shards(as_dicts(sharding.shard_rows(table, 3, block_rows=20)), 500, 3)


def test_repeated_rows_are_spread(spark):
    """A row that is most of the table reaches all shards, each evenly, and is permuted by more than one task's worth of keys."""
    table = spark.range(900).selectExpr("if(id < 600, -1L, id) as k")
    rows = as_dicts(sharding.shard_rows(table, 4))
    check_shards(rows, 900, 4)
    hot = Counter(r["shard"] for r in rows if r["k"] == -1)
    assert sum(hot.values()) == 600 and min(hot.values()) > 110  # 150 expected, sd 7
    slots = sorted(r["slot"] for r in rows if r["k"] == -1 and r["shard"] == 0)
    assert np.diff(slots).max() < 20
