"""The pipeline against a brute-force version: each stage, on all that the one before kept."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from hearthline.llm import langid, packing, quality
from tests.llm.conftest import SMALL, as_dicts, union_find
from tests.llm.test_mixing import brute_targets, words
from tests.llm.test_simhash import near_brute

ids = lambda rows: Counter(r["doc_id"] for r in rows)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage, every output written and read again."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/out"
        stage(spark, docs, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after, before.collect(), after.collect()) for name, before, after in out}


def test_names_and_columns(stages):
    assert list(stages) == ["quality_classifier", "language_id", "simhash_near_dedup", "mix_sources", "pack"]
    for name, (before, after, _, _) in stages.items():
        assert name == "pack" or before.columns == after.columns


def test_quality(spark, stages):
    before, _, rows, kept = stages["quality_classifier"]
    keep = {r["doc_id"] for r in quality.classify(before, spark.read.parquet(f"{SMALL}/labels.parquet")).collect() if r["keep"]}
    assert ids(kept) == Counter(r["doc_id"] for r in rows if r["doc_id"] in keep) and 0 < len(kept) < len(rows)


def test_clean_documents_stay(spark, stages):
    """Documents labelled good stay, all but a few."""
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    _, _, rows, kept = stages["quality_classifier"]
    before, after = (sum(r["doc_id"] in good for r in x) for x in (rows, kept))
    assert after >= 0.95 * before
    _, _, rows, kept = stages["language_id"]
    assert len(kept) >= 0.95 * len(rows)


def test_language(stages):
    before, _, rows, kept = stages["language_id"]
    keep = {r["doc_id"] for r in langid.identify(before).collect() if r["lang_pred"] != "und" and r["score"] >= 0.5}
    assert ids(kept) == Counter(r["doc_id"] for r in rows if r["doc_id"] in keep)


def test_mix(stages):
    _, _, rows, mixed = stages["mix_sources"]
    size, took, longest = defaultdict(int), defaultdict(int), 0
    for r in rows:
        size[r["source"]] += words(r["text"])
        longest = max(longest, words(r["text"]))
    for r in mixed:
        took[r["source"]] += words(r["text"])
    names = sorted(size, key=lambda s: (s is None, s or ""))
    for s, aim in zip(names, brute_targets([size[s] for s in names]), strict=True):
        assert abs(took[s] - aim) <= longest
    assert max(ids(mixed).values()) <= 2 and {tuple(r) for r in mixed} <= {tuple(r) for r in rows}


def test_pack(stages):
    _, _, rows, pieces = stages["pack"]
    plain, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for r in rows:
        own, start = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for length in packing.piece_lengths(len(own), 4096):
            want[r["doc_id"], start, length, zlib.crc32(own[start : start + length].tobytes())] += 1
            start += length
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in pieces)


def test_run_is_the_stages(spark, stages):
    key = lambda rows: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(corpus_pipeline.run(spark, SMALL).collect()) == key(stages["pack"][3])


def test_odd_rows(spark, odd, empty, tmp_path):
    """Each stage takes nulls, empty and long texts, repeats, more columns, and empty tables."""
    spark.createDataFrame([(2, 1), (5, 1), (6, 0), (1, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "pack" or out.columns == docs.columns
            as_dicts(out)


def test_dedup_by_similarity(stages):
    """One document stays of each group linked by a Jaccard similarity of 5-word shingles of at least 0.8."""
    _, _, rows, kept = stages["simhash_near_dedup"]
    root = union_find(near_brute([r["text"] for r in rows]), range(len(rows)))
    least = defaultdict(list)
    for n, r in enumerate(rows):
        least[root[n]].append(r["doc_id"])
    assert sorted(ids(kept).elements()) == sorted(map(min, least.values())) and len(kept) < len(rows)
