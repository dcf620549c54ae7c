import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearthline.llm import packing
from hearthline.llm.entry import op4_packing
from tests.llm.conftest import SMALL, as_dicts

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, docs, context=4096):
    """Exact round trip against the tokenizer run over each whole text."""
    plain = Tokenizer.from_file(PATH)
    ids = [(i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")) for i, t in docs]
    want = Counter()
    for i, own in ids:
        start = 0
        for length in packing.piece_lengths(len(own), context):
            want[i, start, length, zlib.crc32(own[start : start + length].tobytes()), len(own)] += 1
            start += length
        assert start == len(own)
    assert Counter((p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]) for p in pieces) == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        assert p["length"] & (p["length"] - 1) == 0 and p["length"] <= context and 1 << p["bucket"] == p["length"]
    assert all(own == [(0, own[0][1])] for own in sequences.values())  # one piece each: no sequence crosses documents


def test_whole_table(spark, small_rows):
    df = op4_packing(spark, SMALL)
    pieces = as_dicts(df)
    check(pieces, [(r["doc_id"], r["text"]) for r in small_rows])
    assert sorted((p["doc_id"], p["start"], p["sequence_id"]) for p in pieces) == sorted((p["doc_id"], p["start"], p["sequence_id"]) for p in as_dicts(df))


def test_odd_rows(odd, empty, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    packing._held.clear()
    check(as_dicts(packing.pack_documents(odd, PATH, context=64)), [(r["doc_id"], r["text"]) for r in odd.collect()], 64)
    assert packing.pack_documents(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, PATH, context=100)


def test_special_tokens_and_white_space(spark):
    texts = ["a<|endoftext|>b <|startoftext|> c", "one two three　four", "x\x0by\x0cz\x85w", "HELLO don't we'LL 123abc", "é́ ẞ İ ﬁ", "\x00 nul \x1c sep"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = as_dicts(packing.pack_documents(df, PATH, with_ids=True))
    check(pieces, list(enumerate(texts)))
    assert all(zlib.crc32(np.array(p["ids"], "<u4").tobytes()) == p["ids_crc32"] for p in pieces)


def strings(*texts):
    return pa.array([t.encode() if isinstance(t, str) else t for t in texts], pa.binary()).view(pa.string())


def test_cache_forgets(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    encode, plain = packing.WordTokenizer(PATH, 2), Tokenizer.from_file(PATH)
    for text in ("a b c d e f g h", "h, g new f words!! here", "", "a b new again. a b"):
        ids, sizes = encode(strings(text, text))
        one = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert ids.tolist() == one * 2 and sizes.tolist() == [len(one)] * 2
        assert len(encode.known) <= 5


def test_awkward_words():
    """Cases that the short way for letters must leave to the whole tokenizer, and ends of words."""
    encode, plain = packing.WordTokenizer(PATH, 2), Tokenizer.from_file(PATH)
    bits = ["HELLO", "don't", "we'LL", "'s", "s'", "x,", "x.,", "...", "x$$$", "$", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b.", "J\u030c", "J\u030c,", "e\u0301", "\u00c9t\u00c9,", "\u0130", "\u00f7", "a\u00f7b",
            "\u00df", "\u00d7", "\u03a3\u03a3", "3.14", "a1", "\u1e9e", "\ufb01", "x\u0338", "\u2026,", "a\u2026,", "\u212a", "\u00ff.", "word" * 400, "\u3000", "\u00a0x", "x\u0085y", "\x1c"]
    texts = [*bits, *(f"{a} {b}" for a in bits for b in bits), "\u0300", " ".join(bits) * 3, "", " ", "\t\n"]
    for whole in (texts, texts[::-1]):
        ids, sizes = encode(strings(*whole))
        at = 0
        for t, n in zip(whole, sizes.tolist(), strict=True):
            assert ids[at : at + n].tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2], t
            at += n
    bad = b"ab\xff\xfec d\xc3 \xe2\x82 e"
    ids, _ = encode(strings(bad, None))
    assert ids.tolist() == [*plain.encode(bad.decode(errors="replace"), add_special_tokens=False).ids, 2, 2]


def test_other_tokenizers_raise():
    with pytest.raises(ValueError):
        packing.WordTokenizer(public_tokenizers.path("byte_bpe_50k.json"), 2)


def test_each_distinct_word_is_encoded_once_a_chunk(monkeypatch):
    """However large the vocabulary grows, frequent words stay known and no word is encoded twice in a chunk."""
    monkeypatch.setattr(packing, "CACHE_WORDS", 400)
    encode = packing.WordTokenizer(PATH, 2)
    letters = "abcdefghij"
    name = lambda n: "".join(letters[int(d)] for d in str(n))
    before, worked, add = [], [], encode._add
    monkeypatch.setattr(encode, "_add", lambda words, *rest: (worked.extend(words), add(words, *rest)))
    for n in range(40):
        worked.clear()
        encode(strings(" ".join([name(i) for i in range(100)] * 3 + [name(1000 + 300 * n + i) for i in range(300)])))
        before.append(len(worked))
        assert len(set(worked)) == len(worked)
    assert before[0] == 400 and set(before[1:]) == {300}


def test_invalid_utf8(spark):
    df = spark.sql("select 1L doc_id, cast(x'61FF20C362' as string) text")
    [row] = as_dicts(packing.pack_documents(df, PATH, with_ids=True).where("length > 1").limit(1))
    want = [*Tokenizer.from_file(PATH).encode(b"a\xff \xc3b".decode(errors="replace"), add_special_tokens=False).ids, 2]
    assert row["doc_tokens"] == len(want) and row["ids"] == want[: row["length"]]


def test_piece_lengths():
    for n in range(1, 300):
        own = packing.piece_lengths(n, 64)
        assert sum(own) == n and own == sorted(own, reverse=True) and len({x for x in own if x < 64}) == len([x for x in own if x < 64])
