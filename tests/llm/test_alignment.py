import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL, as_dicts
from tokenizers import Tokenizer

from hearthline.llm import alignment, entry

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Whole texts through both tokenizers, groups by the shared ends."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        self.a.encode_special_tokens = True
        alphabet = alignment.byte_alphabet()
        self.bytes_a = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items()}

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, text):
        """n_a, n_b, groups as text, links."""
        raw = f" {text}".encode()
        a, b = self.a.encode(f" {text}", add_special_tokens=False).ids, self.b.encode(text)
        own_a, own_b = [self.bytes_a[i] for i in a], [self.bytes_b(i) for i in b]
        if not text or b"".join(own_a) != raw or b"".join(own_b) != raw:
            return 0, 0, "", []
        ends = [dict(zip(np.cumsum([len(x) for x in own]).tolist(), ids, strict=True)) for own, ids in ((own_a, a), (own_b, b))]
        groups, links, now = [], [], ([], [])
        for end in sorted({*ends[0], *ends[1]}):
            for side in (0, 1):
                if end in ends[side]:
                    now[side].append(ends[side][end])
            if end in ends[0] and end in ends[1]:
                groups.append("|".join(",".join(map(str, side)) for side in now))
                links.append((now[0][-1], now[1][-1]))
                now = ([], [])
        return len(a), len(b), ";".join(groups), links


def expected(rows):
    """The contract's rows of (doc_id, text)."""
    plain = Plain()
    found = [(doc_id, *plain(text or "")) for doc_id, text in rows]
    counts = Counter(link for *_, links in found for link in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return sorted(
        (str(doc_id), n_a, n_b, len(links), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if n_a else "")
        for doc_id, n_a, n_b, groups, links in found
    )


def got(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in as_dicts(df))


def test_query_equals_brute_force(spark, small_rows):
    assert got(entry.op11_tokenizer_alignment(spark, SMALL)) == expected([(r["doc_id"], r["text"]) for r in small_rows])


def test_odd_and_empty_tables(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    assert got(alignment.align_documents(odd, *PATHS)) == expected([tuple(r) for r in rows])
    assert alignment.align_documents(empty, *PATHS).count() == 0


def test_spaces_marks_and_foreign_pieces(spark):
    """White space of all kinds, the tokenizers' own marks, and names of special tokens are plain text; a mark that B reads as a space leaves no tokens."""
    rng = random.Random(3)
    texts = ["", " ", "a ", " a", "a  b", "a \n b", "\ta\t", "<|endoftext|> hi </s>", "▁a b", "x <0x41> y", "a\r\n b", "\x00 a", "I'm  we'll", "a　 b", "x" * 5000, "\U0001f600 x"]
    texts += ["".join(rng.choices("ab1'. \n\té漢😀▁s　,", weights=[5] * 5 + [8] + [1] * 9, k=rng.randint(1, 30))) for _ in range(400)]
    rows = list(enumerate(texts))
    assert got(alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), *PATHS)) == expected(rows)


def test_components_are_the_minimal_groups():
    rng = random.Random(1)
    for _ in range(200):
        size = rng.randint(1, 40)
        ends = [sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size}) for _ in range(2)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        parts = [next(i for i, c in enumerate(cuts) if e <= c) for side in ends for e in side]
        roots = alignment.components(*map(np.array, ends)).tolist()
        assert len({*zip(parts, roots, strict=True)}) == len(set(parts)) == len(set(roots))


def test_forgotten_words_change_nothing(monkeypatch):
    texts = [f"word{i} and word{i % 7}, so" for i in range(300)]
    whole = alignment.Aligner(*PATHS)(texts)
    monkeypatch.setattr(alignment, "CACHE_WORDS", 20)
    small = alignment.Aligner(*PATHS)
    strings = []
    for i in range(0, 300, 25):
        strings += small(texts[i : i + 25])[1]
        small.forget()
        assert len(small.known) <= 20
    assert strings == whole[1]


def test_pair_table(spark):
    rows = spark.createDataFrame([(1, "the cat the dog"), (2, "the")], "doc_id long, text string")
    table = as_dicts(alignment.pair_counts(rows, *PATHS))
    assert max(r["links"] for r in table) == 3 and all(r["best"] for r in table)
    shown = as_dicts(alignment.align_documents(rows, *PATHS, with_groups=True).orderBy("doc_id"))
    assert shown[1]["groups"] == shown[0]["groups"].split(";")[0] and shown[1]["count_sum"] == 3


@pytest.mark.parametrize("ends", [([3], [1, 2, 3]), ([1, 3], [2, 3])])
def test_one_component(ends):
    assert set(alignment.components(*map(np.array, ends)).tolist()) == {0}
