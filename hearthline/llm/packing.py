"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces of the context length and of the
distinct powers of two that make up the rest, longest first. Each piece is a
sequence of its own, and sequences of equal length form one bucket, written
together. So no sequence crosses documents and none is padded.

Tokens: for tokenizers that lower-case, drop white space and close each
pre-token by a suffix (others raise), so that words can be tokenized one by
one. A worker keeps the words that it met most often and meets again; of the
others, those of plain letters are encoded many at a time, without the
normaliser and the pattern that can't change them, and closing punctuation is
looked up apart, so that a word costs the same with it and without.

Defined results: null or empty text is one piece, the end token; bytes that
aren't UTF-8 count as U+FFFD; repeated rows are packed one by one; texts of any
length are worked on whole, one at a time if long; columns other than doc_id
and text are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, slices, text_or_empty

#: Words that one Python worker keeps from one chunk of text to the next, about 150 bytes each.
CACHE_WORDS = 200_000
#: Words encoded in one call.
_JOINED = 1000
#: Lower-case ASCII and Latin-1 letters; punctuation at a word's end that never joins them.
_LETTERS, _TAIL = "^[a-zß-öø-ÿ]+$", ",.;:!?$%&#*"
_SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class WordTokenizer:
    """Token ids of many texts at once, as one flat array."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        suffix = kind["model"].get("end_of_word_suffix")
        if not suffix or "Lowercase" not in json.dumps(kind["normalizer"]):
            raise ValueError("the tokenizer must lower-case, drop white space and mark word ends")
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.end_id = end_id
        self.known: dict[bytes, int] = {b"": 0}
        self.offset, self.length, self.met, self.flat = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _add(self, words: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.length), len(self.length) + len(words)), strict=True))
        self.offset = np.concatenate([self.offset, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])
        self.flat = np.concatenate([self.flat, flat])

    def _places(self, words: list[bytes], letters: np.ndarray) -> np.ndarray:
        """Where each word is kept; those not known yet are encoded first."""
        lines, others = {}, {}
        for word, plain in zip(words, letters.tolist(), strict=True):
            if word not in self.known:
                (lines if plain else others)[word] = None
        lines = list(lines)
        encoded = self.plain.encode_batch_fast([b" ".join(lines[i : i + _JOINED]).decode() for i in range(0, len(lines), _JOINED)], add_special_tokens=False)
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in encoded)])
        self._add(lines, flat, np.diff(np.flatnonzero(self.closes[flat]) + 1, prepend=0))
        # Anything else goes through the whole tokenizer, word by word.
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode(errors="replace") for w in others], add_special_tokens=False)]
        self._add(list(others), np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _forget(self) -> None:
        """Keep the half of CACHE_WORDS that was met most often; counts fade, so that words can come and go."""
        self.met[0] = np.iinfo(np.int64).max
        keep = np.zeros(len(self.met), bool)
        keep[np.argsort(-self.met, kind="stable")[: CACHE_WORDS // 2 + 1]] = True
        place, kept = np.cumsum(keep) - 1, np.flatnonzero(keep)
        self.known = {w: i for (w, _), i, k in zip(self.known.items(), place.tolist(), keep.tolist(), strict=True) if k}
        self.flat, self.length, self.met = _gather(self.flat, self.offset[kept], self.length[kept]), self.length[kept], self.met[kept] // 2
        self.offset = np.cumsum(self.length) - self.length

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by the end token, and the number of ids of each text."""
        texts = pc.fill_null(texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        raw = np.frombuffer(b"".join(x.as_buffer() for x in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())), np.uint8)
        # Lower-casing first changes no id, but for what composes with marks and for the names of special tokens.
        odd = (raw == 0xCC) | (raw == 0xCD)
        odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        leave = np.zeros(len(sizes), bool)
        leave[np.searchsorted(np.cumsum(sizes), np.flatnonzero(odd), side="right")] = True
        own = pc.ascii_split_whitespace(pc.if_else(pa.array(leave), texts, pc.ascii_lower(texts)))
        counts = pc.list_value_length(own).to_numpy(zero_copy_only=False)
        coded = own.flatten().dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        # A word is what may be letters alone, and its end; either can be empty.
        base = pc.ascii_rtrim(distinct, _TAIL)
        letters = pc.match_substring_regex(base, _LETTERS)
        base, letters = pc.if_else(letters, base, distinct), letters.to_numpy(zero_copy_only=False)
        tail = pc.not_equal(pc.binary_length(distinct), cut := pc.binary_length(base))
        ended = [w[n:] for w, n in zip(as_bytes(distinct.filter(tail)), cut.filter(tail).to_pylist(), strict=True)]
        parts = np.zeros((len(distinct), 2), np.int64)
        parts[:, 0] = self._places(as_bytes(base), letters)
        parts[tail.to_numpy(zero_copy_only=False), 1] = self._places(ended, np.zeros(len(ended), bool))
        self.met += np.bincount(parts.ravel(), np.repeat(np.bincount(index, minlength=len(distinct)), 2), len(self.met)).astype(np.int64)

        lengths = self.length[parts].sum(axis=1)
        flat = np.append(_gather(self.flat, self.offset[parts.ravel()], self.length[parts.ravel()]), np.uint32(self.end_id))
        lengths, offsets = np.append(lengths, 1), np.append(np.cumsum(lengths) - lengths, len(flat) - 1)
        at = np.cumsum(counts, dtype=np.int64)
        index = np.insert(index, at, len(distinct))  # the end token after each text
        ids, stop = _gather(flat, offsets[index], lengths[index]), np.cumsum(lengths[index])
        if len(self.known) > CACHE_WORDS:
            self._forget()
        return ids, np.diff(stop[at + np.arange(len(at))], prepend=0)


def _gather(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    stop = np.cumsum(lengths)
    return flat[np.repeat(offsets - (stop - lengths), lengths) + np.arange(stop[-1] if len(stop) else 0)]


_held: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, end_id: int) -> WordTokenizer:
    """One a Python worker: its cache serves all tasks that the worker runs."""
    if (path, end_id) not in _held:
        _held[path, end_id] = WordTokenizer(path, end_id)
    return _held[path, end_id]


def piece_lengths(n: int, context: int) -> list[int]:
    return [context] * (n // context) + [1 << b for b in range(context.bit_length() - 1, -1, -1) if (n % context) >> b & 1]


def pack_documents(docs: DataFrame, tokenizer_path: str, *, context: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket; with_ids adds the ids.

    The pieces are a table in the shared folder, its files split by length: each bucket's sequences have one length.
    """
    if context & (context - 1):
        raise ValueError("context must be a power of two")
    schema = _SCHEMA + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path, end_id)
        for batch in slices(batches, 1):
            ids, sizes = encode(batch.column(1))
            rows, begin = [], 0
            for doc_id, n in zip(batch.column(0).to_pylist(), sizes.tolist(), strict=True):
                start = 0
                for length in piece_lengths(n, context):
                    own = ids[begin + start : begin + start + length]
                    rows.append((doc_id, start, length, zlib.crc32(own), n, *([own.astype(np.int32)] if with_ids else [])))
                    start += length
                begin += n
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names[: len(kinds)])

    cut = docs.select(F.col("doc_id").cast("long"), text_or_empty(docs).alias("text")).mapInArrow(pieces, schema)
    table = materialize(cut.withColumn("bucket", F.log2("length").cast("int")), "pieces", "bucket")
    # The written files don't change, so every read numbers their rows alike.
    return table.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
