"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The number of classes grows with the corpus, as the root of its word types:
three quarters are the most frequent words, one each, the others share the rest
of the words by a hash. As context a word is the sum of its class's vector and
of one that a second hash picks, so that words of one class still differ. The
model gives the probability of a class after the two words before, in two
levels: of its group, one of about as many as the root of the classes, and of
the class within the group, so that a token costs the fourth root of the word
types. A word's share of its class comes from counts: P(w | h) = P(group | h) *
P(class | group, h) * (c + 0.5) / sum over the class (with 0.5 for all unseen
words of a class).

The corpus is counted whole by a shuffled aggregation, and written once as a
stream of word codes. The network learns from every token of it in EPOCHS
passes: each task takes minibatch steps of noise-contrastive estimation through
all of its part, against the unigrams of both levels, and a pass ends with the
tasks' parameters averaged by their tokens in a shuffled sum; the driver holds
one set of parameters. They depend on how the rows lie in partitions; reruns
over the same files agree but for the order of sums. Scores are normalised in
the tasks, by batched matrix products. Counts of words beyond the most frequent reach
their documents by a join on the word, which the hot words never enter.

Defined results: null text is empty and scores its end token; a null doc_id
counts as the empty string when folds are dealt; repeated rows are scored
alike; ties in counts are ordered by the word; texts of any length are scored
whole; columns other than doc_id and text are ignored, whatever their names;
without training rows base is 0 for every text; an empty table gives an empty
result.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, materialize, slices, text_or_empty

#: Classes of a small corpus; a larger one has the root of its number of word types.
LEAST_CLASSES = 128
#: Passes over all training tokens.
EPOCHS = 1
#: Tokens of a minibatch; contexts normalised at once.
BATCH, CONTEXTS = 4096, 1 << 14
#: Text in one stream of codes.
STREAM_BYTES = 512 << 10
#: Word codes that a task keeps at hand.
HOLD_CODES = 200_000
#: Words whose counts every Python worker holds; about 120 bytes each.
HEAD_WORDS = 120_000
#: Distinct words a counting task holds before it passes them on.
HOLD_WORDS = 200_000
#: The end token: no word is empty.
END = b""
_COUNTED = pa.schema([("word", pa.binary()), ("c", pa.int64())])


def held_out(fold: int = 1, doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == fold


def count_words(texts: DataFrame) -> DataFrame:
    """word, c of all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for b in slices(batches, 0):
            rows = as_bytes(b.column(0))
            held[END] += len(rows)
            for text in rows:
                held.update(text.lower().split())
                if len(held) > HOLD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=_COUNTED)
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], schema=_COUNTED)

    return texts.mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0")


class Vocabulary:
    """Totals, the head words with their counts, and the classes."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.types = int(total["n"]), int(total["v"])
        # The least count whose words fit into the head, from a histogram of a few hundred log-count bins.
        edge = F.floor(F.log2("c") * 8).cast("int")
        kept, least = 0, None
        for row in sorted(counts.groupBy(edge.alias("e")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["e"]):
            if kept + row["n"] > HEAD_WORDS:
                break
            kept, least = kept + row["n"], row["e"]
        head = counts.where(edge >= least).collect() if least is not None else []  # at most HEAD_WORDS rows
        self.head = {bytes(r["word"]): r["c"] for r in sorted(head, key=lambda r: (-r["c"], bytes(r["word"])))}
        self.size = max(LEAST_CLASSES, math.isqrt(self.types))
        top = [w for w in self.head if w != END][: self.size * 3 // 4 - 1]
        self.top = {w: i for i, w in enumerate([END, *top])}
        self.shared = self.size - len(self.top)  # classes of the other words
        held = counts.groupBy((F.crc32("word") % self.shared).cast("int").alias("h")).agg(F.count("*").alias("n"), F.sum("c").alias("m")).collect()  # one row a class
        self.class_mass = np.full(self.size, 0.5)
        for r in held:
            self.class_mass[len(self.top) + r["h"]] += r["m"] + 0.5 * r["n"]
        for w in self.top:
            if w in self.head:
                self.class_mass[len(self.top) + zlib.crc32(w) % self.shared] -= self.head[w] + 0.5
        self.unigram = self.class_mass.copy()
        self.unigram[: len(self.top)] = [self.head.get(w, 0) + 0.5 for w in self.top]
        self.class_mass[: len(self.top)] = 1.0

    def codes(self) -> dict[bytes, int]:
        """Code of any word: its class, times size, plus its second hash."""
        size, top, shared, first = self.size, self.top, self.shared, len(self.top)

        class Codes(dict):
            def __missing__(self, word: bytes) -> int:
                crc = zlib.crc32(word)
                code = top.get(word, first + crc % shared) * size + crc // shared % size
                if len(self) >= HOLD_CODES:
                    self.clear()
                self[word] = code
                return code

        return Codes()


class Coder:
    """Numbers of the head words, and codes of all words, by one look-up each; the rest is hashed."""

    def __init__(self, vocabulary: Vocabulary):
        codes, self.first, self.shared, self.size = vocabulary.codes(), len(vocabulary.top), vocabulary.shared, vocabulary.size
        self.number = {w: i for i, w in enumerate(vocabulary.head)}
        self.head_codes, self.end = np.fromiter(map(codes.__getitem__, vocabulary.head), np.int64, len(self.number)), codes[END]

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For each word its number, or -1, and its code; the words without a number."""
        number = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        rest = number < 0
        rare = list(itertools.compress(words, rest.tolist()))
        crc = np.fromiter(map(zlib.crc32, rare), np.int64, len(rare))
        code = np.append(self.head_codes, 0)[number]
        code[rest] = (self.first + crc % self.shared) * self.size + crc // self.shared % self.size
        return number, code, rare


def _stream(texts: list[bytes], coder: Coder) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The stream of codes (two ends, the words, an end, for each text); where its tokens are; tokens of each text; the words' numbers; the words without one."""
    split = [t.lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    number, code, rare = coder(list(itertools.chain.from_iterable(split)))
    stream = np.full(len(number) + 3 * len(texts), coder.end, np.int64)
    stream[np.arange(len(number)) + np.repeat(3 * np.arange(len(texts)) + 2, sizes)] = code
    at = np.arange(len(number) + len(texts)) + np.repeat(2 * np.arange(len(texts)) + 2, sizes + 1)
    return stream, at, sizes + 1, number, rare


def encode(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """All texts as streams of codes of bounded length: two -1 before each text, an end after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary)
        for b in slices(batches, 0):
            rows = as_bytes(b.column(0))
            for i, j in chunks(rows, STREAM_BYTES):
                s, at, *_ = _stream(rows[i:j], coder)
                out = np.full(len(s), -1, np.int32)
                out[at] = s[at]
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["stream"])

    return texts.mapInArrow(run, "stream binary")


def _sum_rows(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """For each number below size the sum of the rows of x whose `at` it is."""
    width = x.shape[1]
    out = np.zeros(size * width, x.dtype)
    np.add.at(out, ((at * width)[:, None] + np.arange(width)).ravel(), x.ravel())  # fast in one dimension only
    return out.reshape(size, width)


def _short(x: np.ndarray) -> np.ndarray:
    """Small numbers in two bytes, which are sorted by radix."""
    return x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """In place; the reciprocal of infinity is zero."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(z, out=z), out=z)
    z += 1
    return np.reciprocal(z, out=z)


def _log_sum(z: np.ndarray) -> np.ndarray:
    """The logarithm of each row's sum of exponentials; overwrites z."""
    top = z.max(axis=1)
    z -= top[:, None]
    return top + np.log(np.exp(z, out=z).sum(axis=1))


class LogBilinear:
    """P(class w | u, v) = P(group of w | u, v) * P(w | its group, u, v), both log-bilinear in one context

    h = r(u) A + r(v) B with r(u) = R[class of u] + S[second hash of u]; a group scores h . G + g, a class h . Q + b.
    Groups are runs of classes of about equal shares of the roots of the unigrams, as many as the root of the classes.
    """

    def __init__(self, unigram: np.ndarray, width: int = 32, seed: int = 3):
        self.rng = np.random.default_rng(seed)
        normal = lambda *shape: self.rng.normal(0, 0.1, shape).astype(np.float32)
        eye, size = np.eye(width, dtype=np.float32), len(unigram)
        root = np.cumsum(np.sqrt(unigram))
        run = (root / root[-1] * math.isqrt(size) * (1 - 1e-9)).astype(np.int64)
        self.size, self.begin = size, np.append(np.unique(run, return_index=True)[1], size)
        self.group = np.repeat(np.arange(len(self.begin) - 1), np.diff(self.begin))
        # Noise at both levels: groups by their mass, the classes of a group by their share of it.
        mass = np.add.reduceat(unigram, self.begin[:-1])
        self.group_noise, self.class_noise = (np.log(x).astype(np.float32) for x in (mass / mass.sum(), unigram / mass[self.group]))
        self.group_draw, self.class_draw = np.cumsum(mass / mass.sum()), np.cumsum(unigram / mass[self.group])  # the group k from k to k + 1
        groups = len(mass)
        self.p = {"R": normal(size, width), "S": np.zeros((size, width), np.float32), "A": eye * 0.5 + normal(width, width) * 0.1, "B": eye + normal(width, width) * 0.1, "Q": normal(size, width), "b": self.class_noise.copy(), "G": normal(groups, width), "g": self.group_noise.copy()}
        self.squares = {k: np.full_like(v, 1e-8) for k, v in self.p.items()}
        self.seen = 0

    def _move(self, name: str, grad: np.ndarray, rate: float) -> None:
        squares = self.squares[name]
        squares += grad * grad
        self.p[name] -= np.float32(rate) * grad / np.sqrt(squares)

    def _runs(self, group: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Each group that the sorted numbers hold, with where its run begins and ends."""
        cut = np.searchsorted(group, np.arange(len(self.begin))).tolist()
        return ((k, i, j) for k, (i, j) in enumerate(itertools.pairwise(cut)) if i < j)

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, noise: int = 64, inner: int = 32, rate: float = 0.05) -> None:
        """One minibatch, by noise-contrastive estimation at both levels; the batch shares the noise groups, a group's tokens its noise classes.

        Draws of one class are alike, so a score counts as often as it was drawn. Rows of R and S meet A and B before
        they are looked up and after their gradients are summed, so a token costs look-ups, not products.
        """
        order = np.argsort(_short(self.group[w]), kind="stable")
        u, v, w = u[order], v[order], w[order]
        p, c, group, n = self.p, self.size, self.group[w], np.float32(1 / len(w))
        ends = [("R", "A", u // c), ("S", "A", u % c), ("R", "B", v // c), ("S", "B", v % c)]
        context = sum((p[x] @ p[k]).take(at, axis=0) for x, k, at in ends)

        def contrast(h: np.ndarray, real: np.ndarray, drawn: np.ndarray, vector: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, ...]:
            """How far each row's h moves each of the vectors, by the times that each was drawn; the gradients of h, the vectors and the biases."""
            off = h @ vector.T
            off += bias
            _sigmoid(off)
            rows = np.arange(len(h))
            true = off[rows, real] - 1
            off *= drawn
            off[rows, real] += true
            off *= n
            return off @ vector, off.T @ h, off.sum(axis=0)

        # Groups: the batch's against noise groups.
        count = lambda drawn, size: np.bincount(drawn, minlength=size).astype(np.float32)
        groups = len(self.group_draw)
        fake = np.minimum(np.searchsorted(self.group_draw, self.rng.random(noise)), groups - 1)
        back, *moved = contrast(context, group, count(fake, groups), p["G"], p["g"] - self.group_noise - np.float32(np.log(noise)))
        moves = [("G", moved[0]), ("g", moved[1])]
        # Classes: each token's against noise classes of its group.
        shifted = p["b"] - self.class_noise - np.float32(np.log(inner))
        vectors, biases = np.zeros_like(p["Q"]), np.zeros_like(p["b"])
        runs = list(self._runs(group))
        met = np.array([k for k, _, _ in runs])[:, None]
        drawn = count(np.clip(np.searchsorted(self.class_draw, met + self.rng.random((len(met), inner))), self.begin[met], self.begin[met + 1] - 1).ravel(), c)
        for k, i, j in runs:
            own = slice(self.begin[k], self.begin[k + 1])
            moved, vectors[own], biases[own] = contrast(context[i:j], w[i:j] - own.start, drawn[own], p["Q"][own], shifted[own])
            back[i:j] += moved
        moves += [("Q", vectors), ("b", biases)]
        sums = [(x, k, _sum_rows(at, back, c)) for x, k, at in ends]
        moves += [(x, sum(g @ p[k].T for y, k, g in sums if y == x)) for x in "RS"]
        moves += [(k, sum(p[x].T @ g for x, y, g in sums if y == k)) for k in "AB"]
        for name, grad in moves:
            self._move(name, grad, rate)
        self.seen += len(w)

    def scorer(self):
        """log10 P(class w | u, v) of codes u, v and classes w, normalised over all groups and over the classes of w's."""
        p, c = self.p, self.size
        r = {k: (p["R"] @ p[k], p["S"] @ p[k]) for k in "AB"}

        def score(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
            out = np.empty(len(w))
            for n in range(0, len(w), CONTEXTS):
                own = n + np.argsort(_short(self.group[w[n : n + CONTEXTS]]), kind="stable")
                x, y, z = u[own], v[own], w[own]
                group, rows = self.group[z], np.arange(len(z))
                context = sum(r[k][half].take(at, axis=0) for k, code in (("A", x), ("B", y)) for half, at in enumerate((code // c, code % c)))
                scores = context @ p["G"].T
                scores += p["g"]
                part = scores[rows, group] - _log_sum(scores)
                for k, i, j in self._runs(group):
                    first, end = self.begin[k], self.begin[k + 1]
                    scores = context[i:j] @ p["Q"][first:end].T
                    scores += p["b"][first:end]
                    part[i:j] += scores[rows[: j - i], z[i:j] - first] - _log_sum(scores)
                out[own] = part
            return out / np.log(10)

        return score


def train_model(texts: DataFrame, vocabulary: Vocabulary, epochs: int = EPOCHS) -> LogBilinear:
    """Passes over every token of the texts; the tasks' parameters are averaged, weighted by tokens, after each."""
    model = LogBilinear(vocabulary.unigram)
    if not vocabulary.tokens:
        return model
    streams, block, c = materialize(encode(texts, vocabulary), "lm-streams"), 1 << 14, vocabulary.size
    names, vocabulary_end = list(model.p), vocabulary.codes()[END]
    flat = lambda m: np.concatenate([x[k].ravel() for x in (m.p, m.squares) for k in names])
    total = 0
    for epoch in range(epochs):

        def run(batches: Iterator[pa.RecordBatch], model=model, epoch=epoch) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            model.rng, model.seen, end = np.random.default_rng([epoch, TaskContext.get().partitionId()]), 0, vocabulary_end
            for b in slices(batches, 0):
                for raw in b.column(0):
                    s = np.frombuffer(raw.as_buffer(), np.int32).astype(np.int64)
                    at = model.rng.permutation(np.flatnonzero(s >= 0))
                    s[s < 0] = end
                    for i in range(0, len(at), BATCH):
                        own = at[i : i + BATCH]
                        model.step(s[own - 2], s[own - 1], s[own] // c, rate=0.05 / (1 + epoch))
            if model.seen:
                x = flat(model)
                for n, i in enumerate(range(0, len(x), block)):
                    part = (x[i : i + block].astype(float) * model.seen).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([model.seen], pa.int64()), pa.array([part], pa.binary())], ["block", "n", "x"])

        def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            n, x = rows["n"].sum(), 0.0
            for raw in rows["x"]:
                x = x + np.frombuffer(raw)
            return pd.DataFrame({"block": [key[0]], "n": [n], "x": [x.tobytes()]})

        parts = sorted(streams.mapInArrow(run, "block int, n bigint, x binary").groupBy("block").applyInPandas(add, "block int, n bigint, x binary").collect())  # one set of parameters
        x = np.concatenate([np.frombuffer(r["x"]) / r["n"] for r in parts]).astype(np.float32)
        for held in (model.p, model.squares):
            for k in names:
                held[k], x = x[: held[k].size].reshape(held[k].shape), x[held[k].size :]
        for k in names:
            model.p[k], model.squares[k] = model.p[k].copy(), model.squares[k].copy()
        total += parts[0]["n"]
    model.seen = total
    return model


_ROWS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("word", pa.binary()), ("tf", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])
_ROWS_SQL = "doc_id bigint, th bigint, word binary, tf bigint, tokens bigint, known bigint, base double, model double"


def score_documents(docs: DataFrame, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    text = text_or_empty(docs)
    train = docs.where(~held_out(fold)).select(text.alias("text"))
    counts = materialize(count_words(train), "word-counts")
    vocabulary = Vocabulary(counts)
    model = train_model(train, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, coder, top, head = model.scorer(), Coder(vocabulary), vocabulary.top, vocabulary.head
        log_c = np.append(np.log10(np.fromiter(head.values(), float, len(head)) + 0.5), 0.0)
        log_rest = np.where(np.append(np.fromiter((w in top for w in head), bool, len(head)), False), 0.0, log_c)  # top words are classes of their own
        share = np.log10(vocabulary.class_mass)
        end, has_end = log_c[coder.number[END]] if END in head else np.log10(0.5), END in head
        for b in slices(batches, 2):
            rows = as_bytes(b.column(2))
            for i, j in chunks(rows):
                s, at, sizes, number, rare = _stream(rows[i:j], coder)
                klass = s[at] // vocabulary.size
                lm = np.add.reduceat(score(s[at - 2], s[at - 1], klass) - share[klass], np.cumsum(sizes) - sizes)
                doc = np.repeat(np.arange(j - i), sizes - 1)
                by_doc = lambda x: np.bincount(doc, x, minlength=j - i)  # noqa: E731, B023
                # A text's own row, whose word holds a space, so no word joins it; then a row for each of its rare words.
                own, extra = pa.table([b.column(x).slice(i, j - i) for x in (0, 1)], ["doc_id", "th"]), Counter(zip(doc[number < 0].tolist(), rare, strict=True))
                at_doc, n = np.append(np.arange(j - i), np.fromiter((d for d, _ in extra), np.int64, len(extra))), len(extra)
                marks = [f" {x} {y}".encode() for x, y in zip(*(x.to_pylist() for x in own.columns), strict=True)]
                zeros = lambda x: pa.array(np.append(x, np.zeros(n, x.dtype)))  # noqa: E731, B023
                table = own.take(pa.array(at_doc)).combine_chunks()
                yield pa.RecordBatch.from_arrays([
                    *(x.combine_chunks() for x in table.columns), pa.array([*marks, *(w for _, w in extra)], pa.binary()),
                    pa.array(np.append(np.zeros(j - i, np.int64), np.fromiter(extra.values(), np.int64, n))), pa.array(np.append(sizes, np.zeros(n, np.int64)), mask=np.arange(n + j - i) >= j - i),
                    zeros(by_doc(number >= 0).astype(np.int64) + has_end), zeros(by_doc(log_c[number]) + end), zeros(lm + by_doc(log_rest[number])),
                ], schema=_ROWS)

    parts = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, _ROWS_SQL)
    met = parts.join(counts, "word", "left")
    rare = F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)
    sums = met.groupBy("doc_id", "th").agg(
        F.count("tokens").cast("int").alias("rows"), F.max("tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.when(F.col("c").isNotNull(), F.col("tf")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + rare).alias("base"), F.sum(F.col("model") + rare).alias("score"),
    )
    n = F.col("rows")  # rows alike in id and text have summed up
    each = sums.withColumn("row", F.explode(F.sequence(F.lit(1), n)))
    whole = float(np.log10(vocabulary.tokens + 0.5 * (vocabulary.types + 1)))
    return each.select(
        "doc_id", held_out(fold).alias("held_out"), "n_tokens", (F.col("n_known") / n).cast("long").alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / n - F.col("n_tokens") * whole).alias("base_score"), (F.col("score") / n).alias("score"),
    )
