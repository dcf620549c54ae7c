import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hearthline.llm import components, simhash
from hearthline.llm.entry import op5_simhash
from tests.llm.conftest import MEDIUM, SMALL, as_dicts, union_find


def spec(text):
    """The contract, shingle by shingle and bit by bit."""
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, seed=42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def brute(rows):
    fps = [spec(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    root = union_find(links, range(len(rows)))
    ids = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            ids[root[n]] = min(i, ids.get(root[n], i))
    return [(i, f"{fps[n]:016x}", ids.get(root[n])) for n, (i, _) in enumerate(rows)], root


key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)


def test_whole_table(spark, small_rows):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in op5_simhash(spark, SMALL).collect()]
    assert sorted(got, key=key) == sorted(brute([(r["doc_id"], r["text"]) for r in small_rows])[0], key=key)


@pytest.mark.parametrize("most", [simhash.LIST_PAIRS, 3, 1])
def test_links_against_all_pairs(spark, monkeypatch, most):
    """Chains and clusters of near fingerprints; short lists are paired, long ones starred."""
    monkeypatch.setattr(simhash, "LIST_PAIRS", most)
    rng = random.Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= 1 << b
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = union_find([(a, b) for n, a in enumerate(fps) for b in fps[:n] if (a ^ b).bit_count() <= 2], fps)
    edges = simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    pairs = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    assert union_find(pairs, fps) == want


def test_components_of_long_paths(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300) if i % 60 != 59] + [(1000, 1000), (7, 7), (2000, 3), (3, 2000)]
    rng.shuffle(edges)
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]], nodes)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = [(r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in simhash.components(odd).collect()]
    want, root = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    kept = as_dicts(kept)
    assert len(kept) == len(set(root.values())) and {r["_h"] for r in kept} == {1}
    first = {g: min((rows[n][0] is None, rows[n][0] or 0) for n in root if root[n] == g)[1] for g in set(root.values())}
    assert sorted(r["doc_id"] or 0 for r in kept) == sorted(first.values())
    assert simhash.components(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_word_splitting():
    for text in ("a b", "A\tb\x0bC\x0cd", "x y z", "\x1c\x1d a", "é É İ", " lead and trail \r\n", "one"):
        assert simhash.fingerprint(text.encode()) == spec(text)
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \t") == 0


def near_brute(texts, width=5, similarity=0.8):
    """All pairs of texts whose sets of shingles are at least so similar, by counting shared shingles."""
    sets, lists = [], defaultdict(list)
    for n, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else {()})
        for s in sets[-1]:
            lists[s].append(n)
    shared = Counter((b, a) for own in lists.values() for i, a in enumerate(own) for b in own[:i])
    return [(a, b) for (a, b), n in shared.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n)]


def near_recall(spark, texts):
    """Share of the non-identical near pairs that end in one component; and whether only linked rows share one."""
    got = {r["doc_id"]: r["root"] for r in simhash.near_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    pairs = near_brute(texts)
    want = union_find(pairs, range(len(texts)))
    named = defaultdict(set)
    for n, root in got.items():
        named[root].add(want[n])
    assert all(len(x) == 1 for x in named.values())  # nothing is linked that brute force keeps apart
    other = [(a, b) for a, b in pairs if texts[a] != texts[b]]
    return sum(got[a] == got[b] for a, b in other), len(other)


def test_near_copies_against_all_pairs(spark):
    """Recall against brute force on sf0.01's texts: fingerprints within 2 bits met none of its near copies."""
    met, of = near_recall(spark, [r["text"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()])
    assert of > 10 and met >= 0.95 * of


@pytest.mark.parametrize("most", [simhash.NEAR_PAIRS, 2])
def test_near_copies_that_are_made(spark, monkeypatch, most):
    """Pairs of similarity 0.8 to 1, a large group of near copies, and texts too far apart."""
    monkeypatch.setattr(simhash, "NEAR_PAIRS", most)
    rng = random.Random(11)
    word, texts = lambda: f"w{rng.randrange(5000)}", []

    def edited(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = word()
        return " ".join(words)

    for n in range(150):
        words = [word() for _ in range(200)]
        texts += [" ".join(words), edited(words, n % 8)]
    words = [word() for _ in range(200)]
    texts += [edited(words, rng.randrange(1, 4)) for _ in range(150)]
    met, of = near_recall(spark, texts)
    assert of > 1000 and met >= 0.98 * of


@pytest.mark.parametrize(("n", "least"), [(500, 1.0)])
def test_sparse_groups_of_one_template(spark, n, least):
    """Many texts of one template with 3 to 5 of 200 words replaced: most pairs lie below the limit, so a lost one is seldom made good by another."""
    rng = random.Random(21)
    words, texts = [f"w{rng.randrange(5000)}" for _ in range(200)], []
    for _ in range(n):
        own = list(words)
        for i in rng.sample(range(200), rng.randrange(3, 6)):
            own[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    met, of = near_recall(spark, texts)
    assert of > n / 4 and met >= least * of


def test_leftovers_of_a_template_are_few(spark, monkeypatch):
    """0 to 8 of 150 words of a template are replaced, now and then by the same words: all pairs of similarity 0.8 are joined, though far fewer than all pairs are compared."""
    rng = random.Random(31)
    words, texts, n = [f"w{rng.randrange(5000)}" for _ in range(150)], [], 600
    edits = [(i, f"y{i}") for i in rng.sample(range(150), 40)]
    for _ in range(n):
        own = list(words)
        for i in rng.sample(range(150), rng.randrange(9)):
            own[i] = f"x{rng.randrange(10**6)}"
        for i, word in rng.sample(edits, rng.choice([0, 0, 3, 6])):
            own[i] = word
        texts.append(" ".join(own))
    made, write = {}, simhash.materialize

    def counted(df, name, *by):
        made[name] = (out := write(df, name, *by)).count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    met, of = near_recall(spark, texts)
    assert of > n and met == of
    assert made["near-leftovers"] < 8 * n


def test_rows_that_differ_in_other_columns_alone(spark):
    """Of repeated ids and texts the least row stays, however the table is dealt."""
    rows = [(1, "a text of some words here", lang, source, n) for n, (lang, source) in enumerate([("no", "b"), ("en", "z"), ("en", "a"), (None, "a")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 4):
        assert [tuple(r)[2:4] for r in simhash.drop_near_duplicates(df.repartition(parts, "n_chars"), width=5, similarity=0.8).collect()] == [(None, "a")]


def test_near_odd_rows(odd, empty):
    kept = simhash.drop_near_duplicates(odd, width=5, similarity=0.8)
    assert kept.columns == odd.columns
    # Null, empty and blank texts are one component; the cat's sentence is another.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, -7), (False, 0), (False, 2), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert simhash.drop_near_duplicates(empty, width=5, similarity=0.8).count() == 0


def test_other_distances_raise(spark):
    for distance in (0, 1, 3, 4, 9):
        with pytest.raises(ValueError):
            simhash.links(spark.createDataFrame([(1,), (8,)], "fp long"), distance)


def test_postings_and_tallies(spark):
    """Each fingerprint lies in 15 intersections of its rarest lists; tallies count equal positional bytes; no pair of 6 is lost."""
    rng = random.Random(5)
    # Four hot bytes, so that order by rarity matters.
    fps = sorted({int.from_bytes(bytes(rng.choice([7, rng.randrange(256)]) if i < 4 else rng.randrange(3) for i in range(8)), "little") for _ in range(300)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    byte = lambda x, i: x >> 8 * i & 255
    size = Counter((i, byte(x, i)) for x in fps for i in range(8))
    lists = simhash.postings(spark.createDataFrame([(signed(x),) for x in fps], "fp long"))
    own = defaultdict(set)
    for r in lists.collect():
        own[r["fp"] % (1 << 64)].add((r["mask"], r["bytes"] % (1 << 64)))
    for x in fps:
        rare = sorted(range(8), key=lambda i: (size[i, byte(x, i)], i))[:6]
        assert len(own[x]) == 15
        for mask, bytes_ in own[x]:
            at = [i for i in range(8) if mask >> i & 1]
            assert len(at) == 4 and set(at) <= set(rare) and bytes_ == sum(byte(x, i) << 8 * i for i in at)
    tally = {(r["u"] % (1 << 64), r["v"] % (1 << 64)): r["tally"] for r in simhash.candidate_pairs(lists).collect()}
    tally = {tuple(sorted(p)): n for p, n in tally.items()}
    equal = {(a, b): sum(byte(a, i) == byte(b, i) for i in range(8)) for n, b in enumerate(fps) for a in fps[:n]}
    assert all(equal[p] == n for p, n in tally.items())
    assert all(p in tally for p, n in equal.items() if n >= 6) and any(n >= 6 for n in equal.values())


def test_positional_bytes_agree_as_often_as_sets(spark):
    """The share of equal min-wise bytes is the similarity; near_tally counts them."""
    rng = random.Random(9)
    for share in (0.0, 0.5, 0.8, 0.95):
        a = {rng.getrandbits(64) for _ in range(400)}
        both = int(2 * 400 * share / (1 + share))
        b = set(rng.sample(sorted(a), both)) | {rng.getrandbits(64) for _ in range(400 - both)}
        x, y = (simhash.positional_bytes(np.array(sorted(s), np.uint64)) for s in (a, b))
        real = len(a & b) / len(a | b)
        assert abs((x == y).mean() - real) < 0.2
        row = [tuple(int(v) for v in z.view("<i8")) for z in (x, y)]
        df = spark.createDataFrame(row, ", ".join(f"{c} long" for c in simhash._SIG)).withColumn("node", F.monotonically_increasing_id())
        pair = df.agg(F.array_sort(F.collect_list(F.struct("node", *simhash._SIG))).alias("p")).select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))
        assert pair.select(simhash.near_tally("a", "b")).first()[0] == (x == y).sum()
