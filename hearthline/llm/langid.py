"""Language identification of mixed-language text.

A word's script, from code-point ranges, narrows its candidate languages to
those that write in it. Each candidate gets the word's score, the sum of its
byte trigrams' log probabilities in that language, and Viterbi with a penalty
for each change of language labels every word; runs of one label are spans.
The document's language is the one with most letters' bytes in its spans, and
the score its share of them.

The model is counted over all training rows: per language, trigrams in 2^16
hash buckets and words per script, so what reaches the driver is bounded by
the number of languages.

Defined results: null text, or text without a letter, is `und` with score 0; a
null doc_id counts as the empty string when folds are dealt; with no training
row every text is `und`; repeated rows are predicted alike; of equal masses the
first language by name counts; texts of any length are labelled whole; columns
other than doc_id, text and lang are ignored, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, chunks, free_names, ranges, slices

BUCKETS = 1 << 16
#: The first and last code point of scripts' main blocks.
SCRIPTS = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("ethiopic", 0x1200, 0x137F),
    ("khmer", 0x1780, 0x17FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
#: A language writes in a script that at least this share of its words have.
SCRIPT_SHARE = 0.001
_SPACE = 32
#: A-Z folded; other ASCII bytes that aren't letters separate words.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else _SPACE for c in range(256))
#: Script number of each two-byte UTF-8 lead and first continuation byte; 0: none.
_SCRIPT_OF = np.zeros(1 << 16, np.uint8)
for _number, (_, _low, _high) in enumerate(SCRIPTS, 1):
    for _c in range(max(_low, 0x80), _high + 1, 16):
        _b = chr(_c).encode()
        _SCRIPT_OF[(_b[0] << 8 | _b[1]) if len(_b) < 4 else 0] = _number
        for _k in range(16 if len(_b) == 2 else 1):
            _b = chr(min(_c + _k, _high)).encode()
            _SCRIPT_OF[_b[0] << 8 | _b[1]] = _number


@dataclass
class Words:
    """Words of some texts: first byte and length of each, trigram bucket of each byte, words of each text."""

    start: np.ndarray
    length: np.ndarray
    script: np.ndarray
    bucket: np.ndarray
    inside: np.ndarray
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def split_words(texts: list[bytes]) -> Words:
    a = np.frombuffer((b" " + b" ".join(texts) + b"  ").translate(_FOLD), np.uint8)
    inside = a != _SPACE
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    wide = a.astype(np.uint32)
    code = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]
    bucket = np.zeros(len(a), np.uint16)
    bucket[1:-1] = (code * np.uint32(2654435761)) >> np.uint32(16)
    pair = _SCRIPT_OF[wide[:-1] << 8 | wide[1:]]
    script = np.maximum(np.maximum.reduceat(pair, start), 1) if len(start) else np.zeros(0, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return Words(start, stop - start, script, bucket, inside, np.diff(np.searchsorted(start, np.concatenate([[0], ends]))))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language: log probability
    writes: np.ndarray  # script x language: whether the language is a candidate

    def scores(self, words: Words) -> np.ndarray:
        """Word x language, best 0; languages that the word's script rules out are far below."""
        part = self.table[words.bucket] * words.inside[:, None]
        out = np.add.reduceat(part, words.start, axis=0) if len(words.start) else np.zeros((0, len(self.languages)), np.float32)
        out = np.maximum(out - out.max(axis=1, keepdims=True, initial=-np.inf), -12)
        return np.where(self.writes[words.script], out, out - 50).astype(np.float32)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Label of each word. Texts advance side by side, the longest first, a word a step."""
    order = np.argsort(-counts, kind="stable")
    sizes, first = counts[order], (np.cumsum(counts) - counts)[order]
    width = scores.shape[1]
    stay, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.uint16)
    label = np.zeros(len(scores), np.uint16)
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    state, last = np.zeros((len(sizes), width), np.float32), np.zeros(len(sizes), np.int64)
    for t, k in enumerate(active):
        at, d = first[:k] + t, state[:k]
        stay[at] = d >= -penalty
        best[at] = d.argmax(axis=1)
        d = scores[at] + np.maximum(d, -penalty)
        d -= d.max(axis=1, keepdims=True)
        state[:k] = d
    last = state.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at, now = first[:k] + t, last[:k]
        label[at] = now
        last[:k] = np.where(stay[at, now], now, best[at])
    return label


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4


def fit(docs: DataFrame, held_out: int = 2) -> Model:
    """Counts over every row with text and lang outside the held-out fold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches, 0):
            texts, langs = as_bytes(b.column(0)), np.array(b.column(1).to_pylist(), object)
            for lang in set(langs.tolist()):
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                total = sums.setdefault(lang, np.zeros(BUCKETS + 256, np.int64))
                for i, j in chunks(own, 1 << 20):
                    words = split_words(own[i:j])
                    total[:BUCKETS] += np.bincount(words.bucket[words.inside], minlength=BUCKETS)
                    total[BUCKETS:] += np.bincount(words.script, minlength=256)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"])

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold_of() != held_out))
    counted = rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(count, "lang string, bucket int, n bigint")
    got = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most 2^16 + 256 rows a language
    languages = sorted(got["lang"].unique())
    sums = np.zeros((BUCKETS + 256, len(languages)))
    sums[got["bucket"].to_numpy(int), [languages.index(x) for x in got["lang"]]] = got["n"]
    tri, words = sums[:BUCKETS] + 0.5, sums[BUCKETS:]
    writes = words / np.maximum(words.sum(axis=0), 1) >= SCRIPT_SHARE
    writes[~writes.any(axis=1)] = True  # an unknown script rules nothing out
    return Model(languages, np.log(tri / tri.sum(axis=0)).astype(np.float32), writes)


_RESULT = "lang_pred string, score double, spans array<struct<start:int,words:int,lang:string>>"


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predictor(model: Model, penalty: float = 8.0, with_spans: bool = True):
    """A pandas UDF: text -> (lang_pred, score, spans). A span: its first word, number of words and language."""
    group = max(1 << 18, (16 << 20) // max(1, len(model.languages)))

    def few(texts: list[bytes]) -> Iterator[tuple]:
        parts, scores = [], []
        for i, j in chunks(texts, 1 << 20):
            parts.append(split_words(texts[i:j]))
            scores.append(model.scores(parts[-1]))
        counts, length = np.concatenate([p.counts for p in parts]), np.concatenate([p.length for p in parts])
        label = viterbi(np.concatenate(scores), counts, penalty)
        size = len(model.languages)
        which = np.repeat(np.arange(len(texts)), counts)
        mass = np.bincount(which * size + label, length, minlength=len(texts) * size).reshape(-1, size)
        top, total = mass.argmax(axis=1), mass.sum(axis=1)
        begin = np.cumsum(counts) - counts
        for i, text in enumerate(texts):
            if not total[i] or not _has_letter(text):
                yield "und", 0.0, []
                continue
            spans = []
            if with_spans:
                own = label[begin[i] : begin[i] + counts[i]]
                cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
                spans = [{"start": int(a), "words": int(b - a), "lang": model.languages[own[a]]} for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield model.languages[top[i]], float(mass[i, top[i]] / total[i]), spans

    @F.pandas_udf(_RESULT)
    def predict(text: pd.Series) -> pd.DataFrame:
        if not model.languages:
            rows = [("und", 0.0, [])] * len(text)
        else:
            sizes = (len(t) if t else 0 for t in text)
            rows = [r for i, j in ranges(sizes, group) for r in few([t.encode() if t else b"" for t in text.iloc[i:j]])]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "spans"])

    return predict


def identify(docs: DataFrame, held_out: int = 2, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score and spans of every row."""
    predict = predictor(fit(docs, held_out), **options)
    out = docs.select("doc_id", (fold_of() == held_out).alias("held_out"), predict(F.col("text").cast("string")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.spans")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those that are `und` or whose main language covers under `least` of their letters."""
    predict = predictor(fit(docs), with_spans=False)
    (name,) = free_names(docs, "_lang")
    judged = docs.withColumn(name, predict(F.col("text").cast("string")))
    return judged.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).select(*(F.col(f"`{c}`") for c in docs.columns))
