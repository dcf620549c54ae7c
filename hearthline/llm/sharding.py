"""Uniform sharding with exact shard sizes, in DataFrame operations only.

Method: a hypergeometric communication matrix. Rows lie in P content-addressed
partitions. The driver draws, from the P partition counts alone, how many rows
each partition sends to each shard: a multivariate hypergeometric row per
partition, so that column sums are the exact shard sizes. Each partition is
permuted locally and cut by its row of the matrix, the pieces are exchanged,
and each shard is permuted again.

Above 10^9 rows in a draw numpy's generator ends, and draws come from log-gamma
values, exact to about 1e-9 of a probability; shard sizes stay exact.

Defined results: an empty table gives an empty result; null columns are
ordinary values; rows equal in every column are interchangeable and each keeps
a slot of its own, and however many they are, they are spread like others;
ties of hashes fall in either order; texts of any length are carried whole;
columns named like the outputs are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_row

#: numpy's hypergeometric generator takes populations below this.
_NUMPY_MOST = 10**9


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Exact draw for populations of any size: beyond numpy's limit, inversion outwards from the mode."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    if good + bad < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left = rng.random() - at
    down = up = mode
    p_down = p_up = at
    while left > 0 and (down > low or up < high):
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Row p: how many of partition p's rows go to each shard. Row sums are counts, column sums are sizes."""
    rng, left, matrix = np.random.default_rng(seed), list(sizes), []
    for count in counts:
        row, rest, todo = [], sum(left), count
        for have in left:
            rest -= have
            got = hypergeometric(rng, have, rest, todo)
            row.append(got)
            todo -= got
        left = [a - b for a, b in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def shard_rows(df: DataFrame, shards: int = 16, seed: int = 20_240_101, block_rows: int = 250_000) -> DataFrame:
    """df with `shard` (0 to shards-1, sizes at most one apart) and `slot` (gapless from 0, uniformly permuted).

    block_rows bounds the rows that one task permutes; more rows make more partitions, not larger ones.
    """
    df = df.drop("shard", "slot")
    content = [F.col(f"`{c}`") if "map<" not in k else F.to_json(F.col(f"`{c}`")) for c, k in df.dtypes]
    total = df.count()
    # Equal rows meet before any exchange of theirs, as one row and a number, and are told apart by their number from then on.
    alike = df.groupBy(*(c.alias(f"_g{i}") for i, c in enumerate(content))).agg(F.first(whole_row(df)).alias("_row"), F.count("*").alias("_alike"))
    apart = alike.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_alike"))).alias("_same"))
    inside = [F.col(f"_row.`{c}`") if "map<" not in k else F.to_json(F.col(f"_row.`{c}`")) for c, k in df.dtypes]
    key = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "_same", *inside)
    parts = max(64, math.ceil(total / block_rows))
    blocks = max(4, math.ceil(total / shards / block_rows))
    rows = apart.select("_row", F.pmod(key(0), F.lit(parts)).alias("_p"), key(1).alias("_a"), key(2).alias("_b"), F.pmod(key(3), F.lit(blocks)).alias("_c"))

    counts = {r["_p"]: r["n"] for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one number a partition
    held = sorted(counts)
    matrix = communication_matrix([counts[p] for p in held], shard_sizes(total, shards), seed)
    table = [(int(p), np.cumsum(row).tolist()) for p, row in zip(held, matrix, strict=True)]
    cuts = materialize(df.sparkSession.createDataFrame(table, "_p long, _cuts array<long>"), "shard-cuts")

    local = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_p").orderBy("_a", "_b")).cast("long") - 1)
    sent = local.join(cuts, "_p").withColumn("shard", F.size(F.filter("_cuts", lambda c: c <= F.col("_rank")))).drop("_cuts", "_rank")
    before = sent.groupBy("shard", "_c").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy("shard", "_c").orderBy("_b", "_a")).cast("long") - 1
    placed = sent.withColumn("_rank", at).join(before, ["shard", "_c"]).withColumn("slot", F.col("_before") + F.col("_rank"))
    return placed.select("_row.*", "shard", "slot")
