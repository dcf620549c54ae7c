"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes; fingerprints within 2 bits share at
least 6 of them, the count that a pair must reach. The index has a posting list
for each (position, byte). Each fingerprint orders its eight lists from rare to
common: a pair that shares 6 of 8 shares at least 4 of its 6 rarest, so the two
commonest are never read, and the lists are read as intersections of four
(15 a fingerprint, N/2^32 entries each where bytes are even; a single list
holds N/256 and its pairs grow with the square of N). The positions in which a
pair meets are tallied over all intersections, completed by the positions of
the common lists, and pairs below 6 go; the rest are verified by Hamming
distance. Equal fingerprints are one entry.

In an intersection of more than LIST_PAIRS fingerprints pairs would grow with
its square. There, each fingerprint is entered under itself and its 32 one-bit
neighbours outside the four bytes; fingerprints within 2 bits share such an
entry, and those that share one are within 2 bits, so a star over each entry
links exactly what the pairs would. This holds for 2 bits only, so links()
takes no other distance.

Defined results: null text is empty; no word gives fingerprint zero, linked
like any other; repeated rows share a component; a null doc_id is no
component's name unless a component has no other; texts of any length are read
whole; columns other than doc_id and text are ignored or kept as they are,
whatever their names; an empty table gives an empty result.

Near copies by similarity (near_components): at a Jaccard similarity of 0.8 some
15 % of a SimHash's bits differ, so two texts share a positional byte with
probability 0.27 and three of them, the least that keeps lists short, with
0.02: the index would miss them, or drown in long lists as the corpus grows.
There the fingerprint's POSITIONS bytes are min-wise (each is the low byte of
the least of the shingles' hashes under one of as many mixers), so that a byte
is shared with the probability of the similarity itself. Index, tally and
verification stay: lists are intersections of BAND positional bytes, pairs that
meet are tallied over all positions, those below LEAST go, and the others are
linked only if the exact Jaccard similarity of their sets of shingles reaches
the limit. A pair of similarity 0.8 meets with probability 0.9998 and passes
the tally with 0.9998. Texts without a word are one set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, free_names, materialize, slices, text_or_empty, whole_row
from .components import connected_components

#: Rarest of the eight lists that a fingerprint is looked up in, and how many of them are intersected: 6 of 8 leave 4 of any 6.
KEPT, LISTS = 6, 4
#: For each mask of positions, the bits of their bytes, as a signed long.
_COVER = [int.from_bytes(bytes(255 * (m >> i & 1) for i in range(8)), "little", signed=True) for m in range(256)]
#: Lists up to this length are paired; longer ones are linked through stars, exactly.
LIST_PAIRS = 64
_SLICE = 1 << 18
#: Positional bytes of a min-wise fingerprint, and how many of them make a list: each byte lies in one of 16 bands.
POSITIONS, BAND = 64, 4
#: Equal positions of 64 that a pair needs: 51 (sd 3.2) are equal at a similarity of 0.8.
LEAST = 40
#: Of a list up to this length all pairs are candidates at once; of a longer one first each entry's with one that the list draws, then all pairs that these leave in different components.
NEAR_PAIRS = 16
_SIG = [f"s{i}" for i in range(POSITIONS // 8)]
#: Columns and types of an entry's difference from the centre of its group.
_APART = "main bigint node bigint root bigint centre bigint centre_root bigint size bigint centre_size bigint apart array<bigint>"
_MIX = np.random.default_rng(8).integers(0, 1 << 63, (2, POSITIONS), np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64 bits, unsigned: each set if it is set in over half the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), _SLICE):
        part = b"".join([digest(line[s:e], seed) for s, e in zip(starts[i : i + _SLICE].tolist(), ends[i : i + _SLICE].tolist(), strict=True)])
        total += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, th (a hash of the text, to find the row again) and fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            fp = np.array([fingerprint(t, width, seed) for t in as_bytes(b.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    text = text_or_empty(docs)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "doc_id bigint, th bigint, fp bigint")


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the eight positional bytes are equal."""
    return F.bit_count(_equal_positions(a, b))


def _equal_positions(a: Column, b: Column) -> Column:
    differ = a.bitwiseXOR(b)
    return sum(F.when(F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) == 0, 1 << i).otherwise(0) for i in range(8))


def _byte(i: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)).cast("int")


def postings(distinct: DataFrame) -> DataFrame:
    """fp under each intersection (list) of four of its six rarest (position, byte) lists.

    list holds the four positions, as a mask, above the four bytes, each in its own position.
    """
    flat = distinct.select(F.explode(F.array(*(F.lit(256 * i) + _byte(i) for i in range(8)))).alias("token"))
    sizes = [0] * 2048
    for r in flat.groupBy("token").count().collect():  # eight positions of 256 bytes
        sizes[r["token"]] = r["count"]
    size_of = F.lit(sizes)
    ranked = F.array_sort(F.array(*(F.struct(F.element_at(size_of, F.lit(256 * i + 1) + _byte(i)).alias("n"), F.lit(i).alias("i"), F.lit(1 << i).alias("bit")) for i in range(8))))
    rare = distinct.select("fp", F.transform(F.slice(ranked, 1, KEPT), lambda t: t["bit"]).alias("rare"))
    masks = F.array(*(sum(F.get("rare", F.lit(i)) for i in four) for four in combinations(range(KEPT), LISTS)))
    return rare.select("fp", F.explode(masks).alias("mask")).select("fp", "mask", F.get(F.lit(_COVER), F.col("mask")).bitwiseAND(F.col("fp")).alias("bytes"))


def candidate_pairs(lists: DataFrame) -> DataFrame:
    """u < v that meet in these lists, with the tally of their equal positions."""
    one = lists.select("mask", "bytes", F.col("fp").alias("u"))
    met = one.join(lists.select("mask", "bytes", F.col("fp").alias("v")), ["mask", "bytes"]).where("u < v")
    met = met.groupBy("u", "v").agg(F.bit_or("mask").alias("met"))
    return met.select("u", "v", F.bit_count(F.col("met").bitwiseOR(_equal_positions(F.col("u"), F.col("v")))).alias("tally"))


def links(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints within 2 bits."""
    if distance != 2:
        raise ValueError("the index is complete and its stars exact for a distance of 2 only")
    lists = postings(distinct)
    long_ = lists.groupBy("mask", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    lists = materialize(lists.join(long_, ["mask", "bytes"]), "postings")

    pairs = candidate_pairs(lists.where(F.col("n") <= LIST_PAIRS)).where(F.col("tally") >= 8 - distance)
    pairs = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")

    bit = lambda b: 1 << b if b < 63 else -(1 << 63)
    flips = F.filter(F.lit([0, *map(bit, range(64))]), lambda x: x.bitwiseAND(F.get(F.lit(_COVER), F.col("mask"))) == 0)
    entries = lists.where(F.col("n") > LIST_PAIRS).select("mask", "fp", F.explode(flips).alias("flip")).select("mask", F.col("fp").bitwiseXOR(F.col("flip")).alias("entry"), "fp")
    least = entries.groupBy("mask", "entry").agg(F.min("fp").alias("v"))
    stars = entries.join(least, ["mask", "entry"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars.distinct())


def shingles(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """The text's set of shingles as sorted 64-bit hashes; a text of fewer words is one shingle, one without words none."""
    words = text.lower().split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(line, seed)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.unique(np.fromiter((digest(line[s:e], seed) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def positional_bytes(own: np.ndarray) -> np.ndarray:
    """POSITIONS bytes: of each mixed order of the shingles' hashes, the low byte of the least one."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 4096):
        z = (own[i : i + 4096, None] ^ _MIX[0]) * _MIX[1]
        z ^= z >> np.uint64(29)
        least = np.minimum(least, (z * _MIX[0]).min(axis=0))
    return ((least ^ (least >> np.uint64(32))) * _MIX[1] >> np.uint64(56)).astype(np.uint8)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th, node (a digest of the set of shingles) and s0 to s7, its positional bytes (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            sets = [shingles(t, width) for t in as_bytes(b.column(2))]
            node = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            sig = np.array([positional_bytes(x) for x in sets], np.uint8).reshape(len(sets), POSITIONS).view("<i8")
            empty = np.array([not len(x) for x in sets], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), *(pa.array(sig[:, i], mask=empty) for i in range(len(_SIG)))], ["doc_id", "th", "node", *_SIG])

    text = text_or_empty(docs)
    schema = "doc_id bigint, th bigint, node bigint, " + ", ".join(f"{c} bigint" for c in _SIG)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, schema)


def near_tally(a: str, b: str) -> Column:
    """Equal positions of two entries."""
    return sum(shared_bytes(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in _SIG)


def near_candidates(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """u < v and tally of pairs that meet in a list of BAND positional bytes and share LEAST positions: all of a short list, of a long one each entry with one that the list draws. And the long lists (key, x)."""
    half = lambda i: F.shiftrightunsigned(_SIG[i // 2], 32 * (i % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
    # A list's number and bytes in one long.
    keys = F.explode(F.array(*(F.lit(i << 32).bitwiseOR(half(i)) for i in range(POSITIONS // BAND))))
    lists = distinct.where("s0 is not null").select(F.struct("node", *_SIG).alias("x"), keys.alias("key"))
    sizes = lists.groupBy("key").agg(F.count("*").alias("n"), F.min_by("x", F.xxhash64("x.node", "key")).alias("centre")).where("n > 1")
    shared = materialize(lists.join(sizes, "key"), "near-postings")
    short, long_ = shared.where(F.col("n") <= NEAR_PAIRS), shared.where(F.col("n") > NEAR_PAIRS)
    pairs = short.select("key", F.col("x").alias("a")).join(short.select("key", F.col("x").alias("b")), "key").select("a", "b").where("a.node < b.node")
    met = pairs.unionByName(long_.where("x.node <> centre.node").select(F.col("x").alias("a"), F.col("centre").alias("b")))
    return _tallied(met), long_.select("key", "x")


def _tallied(met: DataFrame) -> DataFrame:
    pairs = met.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"), near_tally("a", "b").alias("tally"))
    return pairs.where(F.col("tally") >= LEAST).groupBy("u", "v").agg(F.max("tally").alias("tally"))


def near_leftovers(long_: DataFrame, roots: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """u < v and tally of the pairs of long lists that lie in different components and may reach the similarity.

    Lists of one largest component are a group, and a group has a centre c, the entry of the longest lists. Two sets differ
    as their differences from c do: |x ^ y| = dx + dy - 2 |Dx & Dy|, so with b = (1 - similarity) / (1 + similarity) and
    slack s = d - b |x| a pair reaches the similarity if and only if |Dx & Dy| >= (sx + sy) / 2. An entry with s <= b |c|
    reaches it with c itself. Of any other pair the larger slack is above b |c|, so the two share a difference, and the first
    one they share, from rare to common, is among the first few of each. What all of a group share is in no difference, and
    what many share comes last, so a group of near copies costs its differences, not its pairs. No pair is left out.
    """
    named = long_.select("key", "x.node").join(roots.select("node", "root"), "node", "left")
    named = materialize(named.select("key", "node", F.coalesce("root", "node").alias("root")), "near-named")
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("c"))
    apart = sizes.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("parts"), F.sum("c").alias("n")).where("parts > 1")
    members = named.join(apart, "key").groupBy("main", "node", "root").agg(F.sum("n").alias("weight"))
    members = materialize(members, "near-members")
    centres = members.groupBy("main").agg(F.max(F.struct("weight", "node", "root")).alias("k")).select("main", F.col("k.node").alias("centre"), F.col("k.root").alias("centre_root"))
    b, eps = (1 - similarity) / (1 + similarity), 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, centre = None, None
        for part in slices(slices(batches, 5), 6):
            size, centre_size, apart_ = [], [], []
            for c, x, y in zip(part.column(3).to_pylist(), as_bytes(part.column(5)), as_bytes(part.column(6)), strict=True):
                if c != last:
                    last, centre = c, shingles(y, width)
                own = shingles(x, width)
                size.append(len(own))
                centre_size.append(len(centre))
                apart_.append(np.setxor1d(own, centre, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(5)), pa.array(size, pa.int64()), pa.array(centre_size, pa.int64()), pa.array(apart_, pa.list_(pa.int64()))], _APART.split()[::2])

    # A large group's centre is dealt over tasks.
    dealt = centres.join(texts.select(F.col("node").alias("centre"), F.col("text").alias("centre_text")), "centre").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(15))))
    whole = members.join(texts, "node").withColumn("deal", F.pmod("node", F.lit(16)).cast("int")).join(dealt, ["main", "deal"])
    rows = whole.select("main", "node", "root", "centre", "centre_root", "text", "centre_text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(_APART.split()[::2], _APART.split()[1::2], strict=True)))
    d = F.size("apart")
    rows = materialize(rows.select("*", d.alias("d"), (d - b * F.col("size")).alias("s"), (b * F.col("centre_size")).alias("limit")), "near-apart")

    direct = rows.where((F.col("s") <= F.col("limit") + eps) & (F.col("root") != F.col("centre_root")))
    direct = direct.select(F.col("node").alias("a"), F.col("centre").alias("b"), (F.col("limit") - F.col("s")).alias("spare"))
    entries = rows.select("main", "node", "root", "d", "s", "limit", F.explode("apart").alias("e"))
    common = entries.groupBy("main", "e").agg(F.count("*").alias("n")).where("n > 1")  # what one entry alone has comes first in its order and is shared with none
    shared = entries.join(common, ["main", "e"])
    own = Window.partitionBy("main", "node").orderBy("n", "e")
    # rest: an entry's elements from this one on.
    ranked = shared.withColumn("rest", F.count("*").over(Window.partitionBy("main", "node")) - F.row_number().over(own) + 1)
    ranked = materialize(ranked, "near-differences")
    least = (F.greatest("s", "limit") + F.col("s")) / 2
    some = lambda m: F.col("rest") >= F.greatest(F.lit(1), F.ceil(m - eps))
    side = lambda df, n: df.select("main", "e", *(F.col(c).alias(f"{c}_{n}") for c in ("node", "root", "s", "rest")))
    low, high = side(ranked.where(some(least)), "a"), side(ranked.where((F.col("s") > F.col("limit")) & some((F.col("s") - F.col("limit")) / (1 + b))), "b")
    spare = F.least("rest_a", "rest_b") - (F.col("s_a") + F.col("s_b")) / 2
    meet = (low["main"] == high["main"]) & (low["e"] == high["e"]) & (F.col("root_a") != F.col("root_b")) & (F.struct("s_a", "node_a") < F.struct("s_b", "node_b")) & (spare >= -eps)
    met = low.join(high, meet).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), spare.alias("spare")).unionByName(direct)
    return met.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.max("spare").cast("int").alias("tally"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(slices(batches, 2), 3):
            keep = [jaccard(shingles(x, width), shingles(y, width)) >= similarity for x, y in zip(as_bytes(b.column(2)), as_bytes(b.column(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], ["u", "v"])

    side = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}"))
    return pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v").select("u", "v", "text_u", "text_v").mapInArrow(run, "u bigint, v bigint")


def near_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, rounds: int = 1) -> DataFrame:
    """doc_id, th, root and component_id: rows are linked if their sets of shingles have at least this Jaccard similarity.

    Candidates of the index are checked likeliest first: in each of some rounds a node's likeliest partner outside its
    component, then all that still lie in different components. So copies of one text, however many, are checked against
    few others. What long lists then still hold in different components is checked the same way, and nothing is left.
    """
    rows = materialize(sketches(docs, width), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    distinct = rows.groupBy("node").agg(*(F.min(c).alias(c) for c in _SIG), first.alias("k"))
    pairs, long_ = near_candidates(distinct)
    pairs = materialize(pairs, "candidates")
    ends = F.explode(F.array(F.col("u"), F.col("v")))
    needed = pairs.select(ends.alias("node")).unionByName(long_.select("x.node")).distinct()
    wanted = distinct.join(needed, "node", "left_semi").select("node", F.col("k.doc_id").alias("id"), F.col("k.th").alias("th"))
    text = text_or_empty(docs)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    texts = own.join(wanted, (own["th"] == wanted["th"]) & own["doc_id"].eqNullSafe(wanted["id"])).groupBy("node").agg(F.min("text").alias("text"))
    texts = materialize(texts, "near-texts")

    def linked(open_: DataFrame, edges: DataFrame | None) -> DataFrame:
        """edges and those among the open pairs that connect components."""
        for r in range(rounds + 1):
            if r < rounds:
                best = open_.select(ends.alias("node"), "u", "v", "tally").groupBy("node").agg(F.max(F.struct("tally", "u", "v")).alias("most"))
                checked = materialize(best.select("most.u", "most.v").distinct(), "near-checked")
            else:
                checked = open_
            found = materialize(verified(checked, texts, width, similarity), "near-edges")
            edges = found if edges is None else edges.unionByName(found)
            if r < rounds:
                roots = materialize(connected_components(edges), "near-roots")
                at = lambda n, roots=roots: roots.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}"))
                left = open_.join(checked, ["u", "v"], "left_anti").join(at("u"), "u", "left").join(at("v"), "v", "left")
                open_ = materialize(left.where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v")).select("u", "v", "tally"), "near-open")
        return edges

    edges = linked(pairs, None)
    roots = materialize(connected_components(edges), "near-roots")
    # Pairs that were checked already and aren't alike enough needn't be checked again.
    left = near_leftovers(long_, roots, texts, width, similarity).join(pairs, ["u", "v"], "left_anti")
    edges = linked(materialize(left, "near-leftovers"), edges)
    return _named(rows.select("doc_id", "th", "node"), edges, "node").select("doc_id", "th", "root", "component_id")


def _named(rows: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    distinct = rows.groupBy(node).agg(F.min("doc_id").alias("id"))
    roots = connected_components(edges).select(F.col("node").alias(node), "root")
    named = distinct.join(roots, node, "left").select(node, "id", F.coalesce("root", node).alias("root"))
    name = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(materialize(named.join(name, "root").select(node, "root", "component_id"), "components"), node)


def components(docs: DataFrame) -> DataFrame:
    """doc_id, th, fp and component_id of each row; written tables in the shared folder carry the steps."""
    rows = materialize(fingerprints(docs), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("id"))
    roots = connected_components(links(distinct))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    name = named.groupBy("root").agg(F.min("id").alias("component_id"))
    named = materialize(named.join(name, "root").select("fp", "root", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", "th", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 3, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: the one of smallest doc_id (null last), then text hash; repeated rows once.

    Components by fingerprints of 3-word shingles within 2 bits, or by similarity of shingles of `width` words if one is given.
    """
    rows = components(docs) if similarity is None else materialize(near_components(docs, width, similarity), "near-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    h, id_, th = free_names(docs, "_h", "_id", "_th")
    keep = rows.groupBy("root").agg(first.alias("k")).select(F.col("k.doc_id").alias(id_), F.col("k.th").alias(th))
    keep = materialize(keep, "kept")
    text = text_or_empty(docs)
    keyed = docs.withColumn(h, F.xxhash64(text))
    out = keyed.join(keep, (keyed[h] == keep[th]) & keyed["doc_id"].cast("long").eqNullSafe(keep[id_]), "left_semi")
    if rows.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        one = out.groupBy("doc_id", h).agg(F.min(whole_row(docs)).alias(id_))  # of rows that differ in other columns alone the least
        out = one.select(*(F.col(id_)[c].alias(c) for c in docs.columns))
    return out.select(*(f"`{c}`" for c in docs.columns))
