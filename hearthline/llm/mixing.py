"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target over
source size. Chunks of about a thousand documents are rounded by the pivotal
method: two fractional documents exchange mass, in words, so that their joint
expected words stay and each keeps its expectation, until one is integral.
What stays fractional, some documents held back for that, and some integral
ones go up a reduction tree of fan-in 64. At its root each fractional document,
the largest first, exchanges mass with the smaller ones: within their fractions
as long as these can outweigh it, else over the whole range of 0 to `most`
copies, so that others may give up a copy for a large one. One that can't be
outweighed either way goes to the side that comes nearer to the target, against
its expectation. A source's words so miss its target by a small document, or by
less than a document that outweighs all others. All sources, of any size, go
the same way.

Targets: sources are ranked by a range partitioning, and the common level comes
from a few sums over the table of sources; neither is gathered.

Defined results: null text has size 0; null is a source of its own, the last;
rows alike in id, source and text are one unit and get the same number of
copies; ties in size are ordered by a seeded hash; texts of any length only
count; columns with other names, also those of the operator's own, are kept as
they are; an empty table gives an empty result. Results depend on the rows and
the seed alone, not on the layout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, text_or_empty, word_count

CHUNK_ROWS = 1000
FAN_IN = 64
#: Fractional documents of a group that are held back from its pairs, at most half of it; documents that it hands up besides.
HELD, CARRIED = 16, 48
#: A table of so many sources, 1 MB at most, may be broadcast; a longer one is joined by a shuffle.
SMALL_TABLE = 10_000
_KEY = ["_id", "_source", "_hash", "_size"]


def ranked(sources: DataFrame) -> DataFrame:
    """sources with _rank, from 0 by code point of _source, null last: a number inside each range partition, plus the rows of those before."""
    last = F.col("_source").isNull()
    ranges = materialize(sources.repartitionByRange(last, "_source").withColumn("_pid", F.spark_partition_id()), "mix-ranges")
    before = ranges.groupBy("_pid").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n"))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("_pid").orderBy(last, "_source")) - 1
    return ranges.withColumn("_rank", inside).join(before.select("_pid", "_before"), "_pid").withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_pid", "_before")


def with_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """sources (_source, _source_size, ...) with _rank, _target and _rate: weight times a common level, no more than most times the source.

    The level is found by Newton steps on the sum of targets, from below: each step is one sum over the sources.
    """
    weight = F.element_at(F.lit([float(w) for w in weights]), F.pmod("_rank", F.lit(len(weights))).cast("int") + 1)
    table = materialize(ranked(sources).withColumn("_weight", weight), "mix-sources")
    top = most * F.col("_source_size")
    sums = table.agg(F.sum("_source_size").alias("s"), F.sum("_weight").alias("w")).first()
    goal, level, step = share * float(sums["s"] or 0), 0.0, 0.0
    open_weight = sums["w"] or 0.0
    full_size = 0.0
    while open_weight and (step := (goal - full_size) / open_weight) > level:
        level = step
        full = level * F.col("_weight") >= top
        now = table.agg(F.sum(F.when(full, top).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("_weight"))).alias("open")).first()
        full_size, open_weight = float(now["full"]), now["open"]
    target = F.least(F.lit(level) * F.col("_weight"), top.cast("double"))
    return table.withColumn("_target", target).withColumn("_rate", F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)).drop("_weight")


def _snap(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    return np.where(np.abs(x - near) < 1e-9, near, x)


def pivot(mass: np.ndarray, prob: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round prob in order, keeping sum(mass * prob); at most one entry stays fractional."""
    out, rest, draws = prob.astype(float).tolist(), -1, rng.random(len(prob)).tolist()
    weight = mass.astype(float).tolist()
    snap = lambda p: 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p
    for i, q in enumerate(out):
        if q in (0.0, 1.0):
            continue
        if not weight[i]:
            out[i] = float(draws[i] < q)
            continue
        if rest < 0:
            rest = i
            continue
        p, a, b = out[rest], weight[rest], weight[i]
        gain, loss = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
        move = gain if draws[i] * (gain + loss) < loss else -loss
        out[rest], out[i] = snap(p + move / a), snap(q - move / b)
        open_ = [k for k in (rest, i) if 0 < out[k] < 1]
        rest = open_[0] if open_ else -1
    return np.array(out)


def _fill(need: float, most: np.ndarray) -> np.ndarray:
    """need, taken from the first entries on, of each no more than most."""
    return np.clip(need - (np.cumsum(most) - most), 0, most)


def settle(mass: np.ndarray, copies: np.ndarray, rng: np.random.Generator, most: int = 1, near: bool = False) -> np.ndarray:
    """Round copies, given by falling mass, whole: each fractional entry exchanges mass with those after it, the largest first, until it is integral.

    They move inside their own fractions if these outweigh the entry, else between 0 and most. An entry that they can't
    outweigh either way is drawn; with `near` one of over 1 % of the words goes to the side that they outweigh best, whatever it expected.
    """
    x, n, words = _snap(copies.astype(float)), len(copies), (copies * mass).sum()
    for i in range(n):
        if x[i] == np.rint(x[i]):
            continue
        own, m = float(mass[i]), np.maximum(mass[i + 1 :].astype(float), 1e-300)
        if own:
            up, down = (np.ceil(x[i]) - x[i]) * own, (x[i] - np.floor(x[i])) * own
            for whole in (False, True):
                pool = x[i + 1 :]
                low, high = (np.zeros(n - i - 1), np.full(n - i - 1, float(most))) if whole else (np.floor(pool), np.ceil(pool))
                share = _fill(1.0, np.minimum((pool - low) * m / up, (high - pool) * m / down))
                if share.sum() > 1 - 1e-12:
                    break
            move = up if rng.random() * (up + down) < down else -down
            x[i], x[i + 1 :] = x[i] + share.sum() * move / own, pool - share * move / m
            x[i:] = _snap(x[i:])
        part = x[i] - np.floor(x[i])
        if not part:
            continue
        rise, pool = rng.random() < part, x[i + 1 :]
        if near and own > 0.01 * words:
            up, down = (1 - part) * own, part * own
            lack = (pool * m).sum() - up, ((most - pool) * m).sum() - down
            rise = rise if min(lack) >= 0 else lack[0] > lack[1]
            x[i + 1 :] = _snap(pool - _fill(up, pool * m) / m if rise else pool + _fill(down, (most - pool) * m) / m)
        x[i] = np.floor(x[i]) + rise
    return x


def _spread(n: int, k: int) -> np.ndarray:
    """k of n places: half of them evenly over all, half at the end."""
    k = min(n, k)
    return np.unique(np.concatenate([np.linspace(0, n - 1, k - k // 2).astype(int) if n else [], np.arange(n - k // 2, n)])).astype(int)


def _units(docs: DataFrame, source: str) -> DataFrame:
    text = text_or_empty(docs)
    return docs.select(F.col("doc_id").alias("_id"), F.col(source).alias("_source"), F.xxhash64(text).alias("_hash"), word_count(text).alias("_size"))


def _rounded(df: DataFrame, seed: int, level: int, most: int) -> DataFrame:
    """df with _x moved on, group by group, and _up: what goes to the next level. The only group of a source is its root, and leaves nothing."""
    held, carried = HELD, CARRIED

    def one(key: tuple, t: pa.Table) -> pa.Table:
        mass, x, order = (t[c].to_numpy() for c in ("_mass", "_x", "_order"))
        # Falling mass: what stays fractional in the end tends to be small.
        by = np.lexsort((t["_hash"].to_numpy(), order, -mass))
        mass, x = mass[by], _snap(x[by])
        rng = np.random.default_rng([seed, level, key[0].as_py(), key[1].as_py()])
        root = level > 0 and t["_groups"][0].as_py() == 1
        if root:
            x, up = settle(mass, x, rng, most, near=True), np.zeros(len(x), bool)
        else:
            open_ = np.flatnonzero((x != np.rint(x)) & (mass > 0))
            now = np.ones(len(x), bool)
            now[open_[_spread(len(open_), min(held, len(open_) // 2))]] = False
            x[now] = np.floor(x[now]) + pivot(mass[now], x[now] - np.floor(x[now]), rng)
            up = x != np.rint(x)
            solid = np.flatnonzero(mass > 0)
            up[solid[_spread(len(solid), carried)]] = True
        back = np.empty(len(by), int)
        back[by] = np.arange(len(by))
        out = {"_x": pa.array(x[back]), "_up": pa.array(up[back])}
        return pa.table({c: out.get(c, t[c]) for c in t.column_names}, schema=t.schema)

    return df.groupBy("_rank", "_group").applyInArrow(one, df.schema)


def plan_copies(docs: DataFrame, *, source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """One row per unit: _id, _source, _hash, _size, _copies (of each of its _rows rows), _source_size, _target."""
    if most != int(most):
        raise ValueError("most is a number of whole copies")
    units = materialize(_units(docs, source).groupBy(*_KEY).agg(F.count("*").alias("_rows")), "mix-units")
    sources = units.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_rows")).alias("_source_size"), F.count("*").alias("_n"))
    config = materialize(with_targets(sources, weights, share, int(most)), "mix-targets").withColumnRenamed("_source", "_name")
    config = config.withColumn("_groups", F.ceil(F.col("_n") / CHUNK_ROWS))
    extent = config.agg(F.count("*").alias("n"), F.max("_groups").alias("widest")).first()
    if extent["n"] <= SMALL_TABLE:
        config = F.broadcast(config)

    order = F.xxhash64(F.lit(seed), "_id", "_hash")
    work = units.join(config, F.col("_source").eqNullSafe(F.col("_name"))).select(
        *_KEY, "_rows", "_source_size", "_target", "_rank", order.alias("_order"), F.pmod(order, F.col("_groups")).alias("_group"), "_groups",
        (F.col("_size") * F.col("_rows")).alias("_mass"), F.col("_rate").alias("_x"), F.lit(True).alias("_up"),
    )
    level, widest, done = 0, FAN_IN * (extent["widest"] or 1), []
    while widest > 1:
        # Level 0 is the chunks; each next one joins FAN_IN groups of the one before, up to one group a source.
        done.append(materialize(_rounded(work, seed, level, int(most)), "mix-level"))
        level, widest = level + 1, -(-widest // FAN_IN)
        work = done[-1].where("_up").withColumns({"_group": F.floor(F.col("_group") / FAN_IN), "_groups": F.ceil(F.col("_groups") / FAN_IN)})
    done.append(materialize(_rounded(work, seed, level, int(most)), "mix-level"))
    out = done[0].where("not _up")
    for rows in done[1:]:
        out = out.unionByName(rows.where("not _up"))
    return out.select(*_KEY, "_rows", "_source_size", "_target", F.col("_x").cast("long").alias("_copies"))


def mix(docs: DataFrame, *, source: str = "source", **options) -> DataFrame:
    """The mixed rows: each row of docs as many times as its unit has copies, with the columns of docs."""
    names = dict(zip(("_id", "_source", "_hash", "_copies"), free_names(docs, "_id", "_source", "_hash", "_copies"), strict=True))
    id_, from_, hash_, copies = (F.col(n) for n in names.values())
    plan = plan_copies(docs, source=source, **options).where("_copies > 0").select(*(F.col(c).alias(n) for c, n in names.items()))
    h, copy = free_names(docs, "_h", "_copy")
    keyed = docs.withColumn(h, F.xxhash64(text_or_empty(docs)))
    same: Column = F.col("doc_id").eqNullSafe(id_) & F.col(source).eqNullSafe(from_) & (F.col(h) == hash_)
    return keyed.join(plan, same).withColumn(copy, F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
