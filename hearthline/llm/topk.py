"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors are ordered by the nearest of a few centroids and then by id, and cut
into document-range blocks. A block keeps a forward index (its ids and its
matrix) and, for each term (component), its greatest and least value. A query
bounds a block by the sum of its term maxima (for a negative query component,
the least value gives the maximum), visits blocks by falling bound, and stops
once a bound falls below its k-th score; a threshold from a bounded sample of
vectors lets every group of blocks start pruning at once. Bounds are never
below a score, so the result is exact whatever the order of the vectors.

Work is dealt as (group of blocks) x (batch of queries), both of vectors that
lie close. Before any block is copied, one row a group with its term maxima
meets the batches, and a pair is dropped unless some query's bound reaches its
threshold. Neither side is ever whole in one task, and only each pair's k best
rows are shuffled on.

Defined results: vectors that are null or hold null or non-finite components,
and rows without id, take no part; rows with the same id stay apart: each is a
query if its id is one, and a candidate of all rows but itself; vectors of
different length meet as if padded with zeros; equal scores go to the smaller
id, of equal ids to the lesser vector; components and scores saturate at the
range of a long; columns other than vec_id and embedding are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK_ROWS, GROUP_ROWS, BATCH_QUERIES = 256, 8192, 4096
#: Groups of blocks whose maxima meet a batch in one task.
BOUND_GROUPS = 1024
#: Bounded sample that centroids and first thresholds come from.
SAMPLE_ROWS, CENTROIDS = 4096, 128
_LONG = 1 << 63


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T over integers, exact: in floats where these hold every sum, else in longs, else in Python's integers, saturated."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    wide = a.astype(object) @ b.astype(object).T
    return np.array([[min(max(int(x), -_LONG), _LONG - 1) for x in row] for row in wide], np.int64).reshape(wide.shape)


def _pad(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _matrix(vectors: list) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), width)
    return np.array([list(v) + [0] * (width - len(v)) for v in vectors], np.int64).reshape(len(vectors), width)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores.astype(np.float64) if abs(scores).max(initial=0) < 2**53 else ~scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def search_blocks(blocks: list[tuple], query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and ids (query x up to k, unused: the least long) among the blocks (ids, matrix, greatest, least), and blocks scored."""
    width = max([queries.shape[1], *(b[1].shape[1] for b in blocks)])
    queries = _pad(queries, width)
    high, low = (_pad_rows([b[i] for b in blocks], width) for i in (2, 3))
    bound = product(np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]), np.hstack([high, low]))
    order = np.argsort(-bound.astype(float), axis=1, kind="stable")
    scores, ids = np.full((len(queries), k), -_LONG), np.full((len(queries), k), _LONG - 1)
    scored = 0
    active = np.arange(len(queries))
    for r in range(len(blocks)):
        limit = np.maximum(scores[active, k - 1], floor[active])
        active = active[bound[active, order[active, r]] >= limit]  # a tie may still win by its id
        if not len(active):
            break
        at = order[active, r]
        for b in np.unique(at):
            own = active[at == b]
            got = product(queries[own], _pad(blocks[b][1], width))
            names = np.broadcast_to(blocks[b][0], got.shape)
            self_ = names == query_ids[own][:, None]
            some = ((got >= np.maximum(scores[own, k - 1], floor[own])[:, None]) & ~self_).any(axis=0)
            got, names, self_ = got[:, some], names[:, some], self_[:, some]
            got = np.where(self_, -_LONG, got)
            names = np.where(self_, _LONG - 1, names)
            scores[own], ids[own] = _best(np.hstack([scores[own], got]), np.hstack([ids[own], names]), k)
            scored += len(own)
    return scores, ids, scored


def _pad_rows(rows: list[np.ndarray], width: int) -> np.ndarray:
    return np.array([np.pad(r, (0, width - len(r))) for r in rows], np.int64).reshape(len(rows), width)


def _centroids(x: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    if not len(x):
        return np.zeros((1, x.shape[1]))
    rng = np.random.default_rng(5)
    c = x[rng.permutation(len(x))[:n]].astype(float)
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        for j in np.unique(near):
            c[j] = x[near == j].mean(axis=0)
    # Centroids that lie close get numbers that lie close.
    axis = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0] if c.shape[1] else np.zeros(0)
    return c[np.argsort(c @ axis, kind="stable")]


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and q, the vector's components as floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    limit = F.lit(float(_LONG - 1024))  # the greatest double within a long's range, about
    whole = lambda v: F.floor(F.least(F.greatest(v * scale, -limit), limit)).cast("long")
    return rows.select("vec_id", F.transform("x", whole).alias("q"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with row, a number that rises with vec_id (then q): its number in a range partition, below the partition's."""
    ordered = rows.repartitionByRange("vec_id", "q").sortWithinPartitions("vec_id", "q")
    return materialize(ordered.withColumn("row", F.monotonically_increasing_id()), "vectors")


def _long_bytes(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a, np.int64).tobytes() for a in arrays]


def exact_topk(vectors: DataFrame, k: int = 10, query_every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query, each row whose id is divisible by query_every."""
    rows = numbered(quantised(vectors, scale))
    total, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % query_every == 0, 1))).first()
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_ROWS).select("row", "q").toPandas()
    sample_rows, sample_x = sample["row"].to_numpy(np.int64), _matrix(list(sample["q"]))
    centres = _centroids(sample_x, CENTROIDS)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(2).to_pylist())
            width = max(x.shape[1], centres.shape[1])
            c = _pad(centres, width)
            near = (_pad(x, width).astype(float) @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), *b.columns], ["near", "row", "vec_id", "q"])

    near = materialize(rows.select("row", "vec_id", "q").mapInArrow(assign, "near int, row bigint, vec_id bigint, q array<bigint>"), "assigned")

    def dealt(df: DataFrame, parts: int) -> DataFrame:
        return df.repartitionByRange(parts, "near", "row").sortWithinPartitions("near", "row").select("row", "vec_id", "q")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), ([], [], [])
        for last, b in [*((0, b) for b in batches), (1, None)]:
            if b is not None:
                for own, column in zip(held, b.columns, strict=True):
                    own += column.to_pylist()
            while len(held[0]) >= BLOCK_ROWS or last and held[0]:
                (own, ids, x), held = (h[:BLOCK_ROWS] for h in held), tuple(h[BLOCK_ROWS:] for h in held)
                x = _matrix(x)
                raw = _long_bytes(own, ids, x, x.max(axis=0, initial=-_LONG), x.min(axis=0, initial=_LONG - 1))
                yield pa.RecordBatch.from_pylist([{"part": part, "width": x.shape[1], **dict(zip(("rows", "ids", "x", "high", "low"), raw, strict=True))}], schema=_BLOCK)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch of queries with the k-th score of each among the sample, which no result can be below."""
        from pyspark import TaskContext

        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        own, ids, x = table["row"].to_numpy(), table["vec_id"].to_numpy(), _matrix(table["q"].to_pylist())
        width = max(x.shape[1], sample_x.shape[1])
        got = np.where(own[:, None] == sample_rows, -_LONG, product(_pad(x, width), _pad(sample_x, width)))
        floor = np.partition(got, -k, axis=1)[:, -k] if got.shape[1] >= k else np.full(len(ids), -_LONG)
        raw = _long_bytes(own, ids, x, floor)
        yield pa.RecordBatch.from_pylist([{"batch": TaskContext.get().partitionId(), "qwidth": x.shape[1], **dict(zip(("qrows", "qids", "qx", "floor"), raw, strict=True))}], schema=_QUERIES)

    def widest(pdf: pd.DataFrame) -> pd.DataFrame:
        """A group's term maxima and minima, of its blocks'. A shorter block's missing terms are 0."""
        high, low = ([_of(r) for r in pdf[c]] for c in ("high", "low"))
        width = max(map(len, high))
        raw = _long_bytes(_pad_rows(high, width).max(axis=0), _pad_rows(low, width).min(axis=0))
        return pd.DataFrame([{"part": pdf["part"].iloc[0], "high": raw[0], "low": raw[1]}])

    def reached(key: tuple, groups: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        """The groups in which some query of the batch may find one of its k best."""
        if not len(groups) or not len(q):
            return pd.DataFrame({"part": [], "batch": []}, dtype=np.int32)
        high, low, one = [_of(r) for r in groups["high"]], [_of(r) for r in groups["low"]], q.iloc[0]
        width = max(one.qwidth, *map(len, high))
        queries = _pad(_of(one.qx).reshape(-1, one.qwidth) if one.qwidth else np.zeros((len(_of(one.qrows)), 0), np.int64), width)
        bound = product(np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)]), np.hstack([_pad_rows(high, width), _pad_rows(low, width)]))
        hit = (bound >= _of(one.floor)[:, None]).any(axis=0)
        return pd.DataFrame({"part": groups["part"][hit], "batch": key[1]}).astype(np.int32)

    blocks = materialize(dealt(near, max(1, math.ceil(total / GROUP_ROWS))).mapInArrow(build, "part int, width int, rows binary, ids binary, x binary, high binary, low binary"), "blocks")
    asked = near.where(F.col("vec_id") % query_every == 0)
    batches = materialize(dealt(asked, max(1, math.ceil(n_queries / BATCH_QUERIES))).mapInArrow(start, "batch int, qwidth int, qrows binary, qids binary, qx binary, floor binary"), "queries")

    # One row a group of blocks and one a batch: what is dealt here are pairs of bounded pieces, without the blocks.
    maxima = blocks.select("part", "high", "low").groupBy("part").applyInPandas(widest, "part int, high binary, low binary").withColumn("super", F.expr(f"part div {BOUND_GROUPS}"))
    supers = -(-max(1, math.ceil(total / GROUP_ROWS)) // BOUND_GROUPS)
    n_batches = max(1, math.ceil(n_queries / BATCH_QUERIES))
    left = maxima.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(n_batches - 1))))
    right = batches.withColumn("super", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(supers - 1).cast("long"))))
    pairs = materialize(left.groupBy("super", "batch").cogroup(right.groupBy("super", "batch")).applyInPandas(reached, "part int, batch int"), "pairs")

    def search(key: tuple, b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(b) or not len(q):
            return pd.DataFrame({"query_row": [], "query_id": [], "row": [], "vec_id": [], "score": []}, dtype=np.int64)
        held = [(_of(r.rows), _of(r.x).reshape(len(_of(r.rows)), r.width), _of(r.high), _of(r.low)) for r in b.itertuples()]
        one = q.iloc[0]
        own = _of(one.qrows)
        scores, names, _ = search_blocks(held, own, _of(one.qx).reshape(len(own), one.qwidth), _of(one.floor), k)
        used = names != _LONG - 1
        every, ids = (np.concatenate([_of(r) for r in b[c]]) for c in ("rows", "ids"))
        at = np.argsort(every)
        n = used.sum(axis=1)
        return pd.DataFrame({"query_row": np.repeat(own, n), "query_id": np.repeat(_of(one.qids), n), "row": names[used], "vec_id": ids[at[np.searchsorted(every, names[used], sorter=at)]], "score": scores[used]})

    there, asking = blocks.join(pairs, "part"), batches.join(pairs, "batch")
    found = there.groupBy("part", "batch").cogroup(asking.groupBy("part", "batch")).applyInPandas(search, "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


_BLOCK = pa.schema([("part", pa.int32()), ("width", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("x", pa.binary()), ("high", pa.binary()), ("low", pa.binary())])
_QUERIES = pa.schema([("batch", pa.int32()), ("qwidth", pa.int32()), ("qrows", pa.binary()), ("qids", pa.binary()), ("qx", pa.binary()), ("floor", pa.binary())])
