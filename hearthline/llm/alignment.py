"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often in the corpus.

The tokens of tokenizer A and of tokenizer B over the same bytes are the two
sides of a graph with an edge wherever two byte ranges overlap. Union-find over
its edges gives components, and these are exactly the minimal groups: the bytes
are cut wherever tokens of both sides end. The members of a component that end
together are linked, and links are counted by id pair over the whole corpus.

Both tokenizers cut wherever a space follows something that isn't white space
(B's pieces are checked for that when it is loaded), so no token and no group
crosses such a place, and what lies between two of them is encoded and aligned
once: a worker keeps the words that it met more than once.

Documents are worked on in chunks of bounded text. A chunk sends each of its id
pairs once, with a count, so a pair that occurs in every document is as many
rows as there are chunks; the corpus's counts come back to the chunks the same
way, and nothing of the size of the corpus or of the vocabularies' product is
gathered or broadcast.

Defined results: null or empty text, and text whose tokens' bytes differ from
its own, has no tokens: zeros and an empty string; repeated rows are aligned
one by one and each counts; texts of any length are aligned whole, one at a
time if long; equally frequent A ids of a B id are all its best; columns other
than doc_id and text are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, text_or_empty

#: Words that one Python worker keeps from one chunk to the next, some 300 bytes each.
CACHE_WORDS = 300_000
#: Longer words are encoded wherever they occur and not kept.
_KEPT_CHARS = 100
#: Words encoded as one text.
_JOINED = 1000
_SPACE = "▁"
_CUT, _WIDE = re.compile(r"(?<=\S) "), re.compile(r"\s ")
_DOC, _PAIRS = 0, 1
_SCHEMA = "kind int, chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, pairs array<bigint>, times array<bigint>"
_FIELDS = pa.schema([
    ("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
])


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: visible ones of Latin-1 stand for themselves, the others follow from U+0100."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = sorted(set(range(256)) - set(visible))
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Union-find over the overlaps of two gapless lists of byte ranges, given by their ends: of each range, A's first, the smallest member of its component.

    All edges hook the larger root to the smaller one at once, and paths are halved until every member points at its root.
    """
    starts_a = np.concatenate([[0], ends_a[:-1]])
    first, last = np.searchsorted(ends_b, starts_a, side="right"), np.searchsorted(ends_b, ends_a, side="left")
    size = last - first + 1
    stop = np.cumsum(size)
    x = np.repeat(np.arange(len(ends_a)), size)
    y = len(ends_a) + np.repeat(first - (stop - size), size) + np.arange(len(x))
    parent = np.arange(len(ends_a) + len(ends_b))
    while len(x):
        x, y = parent[x], parent[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
    return parent


def _gather(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    stop = np.cumsum(lengths)
    return flat[np.repeat(offsets - (stop - lengths), lengths) + np.arange(stop[-1] if len(stop) else 0)]


class Aligner:
    """Both tokenizers, and what words gave that were met before."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        known = {i: bytes(map(alphabet.__getitem__, t)) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in t)}
        pieces = list(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("pieces of the second tokenizer must hold spaces at their front only")
        self.bytes = (
            [known.get(i, b"") for i in range(max(known) + 1)],
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)],
        )
        self.sizes = tuple(np.array(list(map(len, x)), np.int64) for x in self.bytes)
        # Each id as text, followed by what stands after it inside a group and at the end of its side.
        self.texts = tuple(np.array([[f"{i},", f"{i}{end}"] for i in range(len(x))], object) for x, end in zip(self.bytes, "|;", strict=True))
        self.lone_space = self.b.encode("a ")[len(self.b.encode("a")):]  # the library gives nothing for an empty text
        self.known: dict[str, int] = {}
        self.strings: list[str] = []
        self.facts, self.met = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)  # facts: ok, tokens of A, of B, groups
        self.offset, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64)  # links as A's id << 32 | B's id, one a group

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B; each text stands for a space and itself."""
        a = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        return a, [x if t else self.lone_space for x, t in zip(self.b.encode(texts, num_threads=1), texts, strict=True)]

    def align(self, lines: list[list[str]]) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
        """Words in lines of one or more: the words in the order worked on, and of each its facts and groups as text, and all links.

        A line is encoded as one text. Words whose tokens' bytes differ from their own have no tokens; a line with such words is taken apart.
        """
        ids = self.encode([" ".join(line) for line in lines])
        same, odd = [], []
        for line, *own in zip(lines, *ids, strict=True):
            raw = f" {' '.join(line)}".encode()
            (same if all(b"".join(map(x.__getitem__, i)) == raw for x, i in zip(self.bytes, own, strict=True)) else odd).append((line, *own))
        words = [w for line, *_ in same for w in line]
        ends = np.cumsum([len(w.encode()) + 1 for w in words], dtype=np.int64)
        flat = [np.fromiter((t for line in same for t in line[side]), np.int64) for side in (1, 2)]
        token_ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, flat, strict=True)]
        _, group = np.unique(components(*token_ends), return_inverse=True)
        n_a, n_groups = len(flat[0]), int(group.max(initial=-1)) + 1
        sides = group[:n_a], group[n_a:]
        closes = [np.append(g[1:] != g[:-1], True)[: len(g)] for g in sides]
        text = np.concatenate([t[x, c.astype(np.int64)] for t, x, c in zip(self.texts, flat, closes, strict=True)])
        text = text[np.lexsort((np.repeat([0, 1], [n_a, len(flat[1])]), group))].tolist()  # a group's A ids, then its B ids
        last = [x[c] for x, c in zip(flat, closes, strict=True)]  # only these two of a component end together
        word_of = np.searchsorted(ends, token_ends[0][closes[0]], side="left")
        tokens = [np.bincount(np.searchsorted(ends, e, side="left"), minlength=len(words)) for e in token_ends]
        facts = np.stack([np.ones(len(words), np.int64), *tokens, np.bincount(word_of, minlength=len(words))], axis=1) if words else np.zeros((0, 4), np.int64)
        stop = np.cumsum(facts[:, 1] + facts[:, 2]).tolist()
        strings = ["".join(text[i:j])[:-1] for i, j in zip([0, *stop], stop, strict=False)]
        links = last[0] << 32 | last[1] if n_groups else np.zeros(0, np.int64)
        for line, *_ in odd:
            if len(line) == 1:
                part = line, np.zeros((1, 4), np.int64), [""], np.zeros(0, np.int64)
            else:
                part = self.align([[w] for w in line])
            words, facts, strings, links = words + part[0], np.concatenate([facts, part[1]]), strings + part[2], np.concatenate([links, part[3]])
        return words, facts, strings, links

    def _learn(self, words: list[str]) -> None:
        closed = [w for w in words if w and not w[-1].isspace() and not w[0].isspace()]
        lines = [closed[i : i + _JOINED] for i in range(0, len(closed), _JOINED)] + [[w] for w in words if not w or w[-1].isspace() or w[0].isspace()]
        found, facts, strings, links = self.align(lines)
        self.known.update(zip(found, range(len(self.strings), len(self.strings) + len(found)), strict=True))
        self.offset = np.concatenate([self.offset, len(self.flat) + np.cumsum(facts[:, 3]) - facts[:, 3]])
        self.facts, self.flat = np.concatenate([self.facts, facts]), np.concatenate([self.flat, links])
        self.strings += strings
        self.met = np.concatenate([self.met, np.zeros(len(found), np.int64)])

    def forget(self) -> None:
        """Words met once go, and long ones, and then the rarer ones if that isn't enough; counts fade, so that words can come and go."""
        if len(self.known) <= CACHE_WORDS:
            return
        keep = (self.met > 1) & (np.fromiter(map(len, self.known), np.int64, len(self.known)) <= _KEPT_CHARS)
        if keep.sum() > CACHE_WORDS // 2:
            keep[np.argsort(-(self.met * keep), kind="stable")[CACHE_WORDS // 2 :]] = False
        kept = np.flatnonzero(keep)
        words = list(self.known)
        self.known = {words[i]: n for n, i in enumerate(kept.tolist())}
        self.strings = [self.strings[i] for i in kept.tolist()]
        self.flat = _gather(self.flat, self.offset[kept], self.facts[kept, 3])
        self.facts, self.met = self.facts[kept], self.met[kept] // 2
        self.offset = np.cumsum(self.facts[:, 3]) - self.facts[:, 3]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Of each text: its tokens of A, of B and groups, and its groups as text; and all links, one a group."""
        cut = [(t.split(" ") if not _WIDE.search(t) and t[:1] != " " else _CUT.split(t)) if t else [] for t in texts]
        self._learn(list(dict.fromkeys(w for words in cut for w in words if w not in self.known)))
        counts = np.array(list(map(len, cut)), np.int64)
        at = np.fromiter((self.known[w] for words in cut for w in words), np.int64, counts.sum())
        self.met += np.bincount(at, minlength=len(self.met))
        stop = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.facts[at], axis=0)])
        facts = total[stop[1:]] - total[stop[:-1]]
        strings = [";".join(map(self.strings.__getitem__, at[i:j].tolist())) for i, j in zip(stop, stop[1:], strict=False)]
        links = _gather(self.flat, self.offset[at], self.facts[at, 3])
        for i in np.flatnonzero(facts[:, 0] < counts).tolist():  # some word's bytes differ: only the whole text can tell
            begin = facts[:i, 3].sum()
            _, own, text, pairs = self.align([[texts[i]]])
            links = np.concatenate([links[:begin], pairs, links[begin + facts[i, 3] :]])
            facts[i], strings[i] = own[0], text[0]
        return facts[:, 1:], strings, links


_held: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a Python worker: its words serve all tasks that the worker runs."""
    if (path_a, path_b) not in _held:
        _held[path_a, path_b] = Aligner(path_a, path_b)
    return _held[path_a, path_b]


def _aligned(docs: DataFrame, path_a: str, path_b: str, with_groups: bool) -> DataFrame:
    """Per document its numbers and distinct linked pairs, and per chunk all its pairs with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(path_a, path_b)
        chunk = TaskContext.get().partitionId() << 32
        for batch in slices(batches, 1):
            facts, groups, links = align(batch.column(1).to_pylist())
            n = len(groups)
            keys, place = np.unique(links, return_inverse=True)
            owner = np.repeat(np.arange(n), facts[:, 2])
            own, times = np.unique(owner * max(1, len(keys)) + place, return_counts=True)
            owner, place = np.divmod(own, max(1, len(keys)))
            sizes = np.concatenate([np.bincount(owner, minlength=n), [len(keys)]])
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
            columns = [
                [_DOC] * n + [_PAIRS], [chunk] * (n + 1), [*batch.column(0).to_pylist(), None], *([*c, None] for c in facts.T.tolist()), [*facts[:, 2].tolist(), None], [*digests, None],
                [*groups, None] if with_groups else [None] * (n + 1),
            ]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _FIELDS, strict=False)]
            lists = (np.concatenate([keys[place], keys]), np.concatenate([times, np.bincount(place, times, len(keys)).astype(np.int64)]))
            yield pa.RecordBatch.from_arrays(arrays + [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in lists], schema=_FIELDS)
            align.forget()
            chunk += 1

    cut = docs.select(F.col("doc_id").cast("long"), text_or_empty(docs).alias("text")).mapInArrow(run, _SCHEMA)
    return materialize(cut, "aligned", "kind")


def _chunk_pairs(aligned: DataFrame) -> DataFrame:
    return aligned.where(F.col("kind") == _PAIRS).select("chunk", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("chunk", "p.pairs", "p.times")


def _pair_counts(aligned: DataFrame) -> DataFrame:
    """(pairs, n, best): links of each id pair in the whole corpus, and whether no A id is linked to its B id more often. A B id has as many rows as A has ids at most."""
    n = _chunk_pairs(aligned).groupBy("pairs").agg(F.sum("times").alias("n")).withColumn("b", F.col("pairs").bitwiseAND(0xFFFFFFFF))
    top = n.groupBy("b").agg(F.max("n").alias("top"))
    return n.join(top, "b").select("pairs", "n", (F.col("n") == F.col("top")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a_id, b_id, links, best) of the corpus: the table that maps one vocabulary to the other."""
    counts = _pair_counts(_aligned(docs, path_a, path_b, False))
    return counts.select(F.shiftright("pairs", 32).alias("a_id"), F.col("pairs").bitwiseAND(0xFFFFFFFF).alias("b_id"), F.col("n").alias("links"), "best")


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; with_groups adds the groups as text."""
    aligned = _aligned(docs, path_a, path_b, with_groups)
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    last = ["groups_sha256"] + ["groups"] * with_groups
    schema = ", ".join([f"{c} bigint" for c in [*own, "n_best", "count_sum"]] + [f"{c} string" for c in last])

    def look_up(rows: pa.Table, counts: pa.Table) -> pa.Table:
        order = np.argsort(keys := counts["pairs"].to_numpy(), kind="stable")
        keys, n, best = keys[order], counts["n"].to_numpy()[order], counts["best"].to_numpy()[order]
        rows = rows.combine_chunks()
        found, sums, bests = rows["pairs"].combine_chunks(), [], []
        sizes = found.value_lengths().to_numpy(zero_copy_only=False)
        at = np.searchsorted(keys, found.flatten().to_numpy(zero_copy_only=False))
        times = rows["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        stop = np.concatenate([[0], np.cumsum(sizes)])
        for x, out in ((n[at] * times, sums), (best[at] * times, bests)):
            total = np.concatenate([[0], np.cumsum(x)])
            out += (total[stop[1:]] - total[stop[:-1]]).tolist()
        return pa.table([*(rows[c] for c in own), pa.array(bests, pa.int64()), pa.array(sums, pa.int64()), *(rows[c] for c in last)], [*own, "n_best", "count_sum", *last])

    counts = _chunk_pairs(aligned).join(_pair_counts(aligned), "pairs").select(F.col("chunk").alias("of"), "pairs", "n", "best")
    rows = aligned.where(F.col("kind") == _DOC).select("chunk", *own, *last, "pairs", "times")
    return rows.groupBy("chunk").cogroup(counts.groupBy("of")).applyInArrow(look_up, schema)
