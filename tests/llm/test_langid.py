import itertools
import zlib

import numpy as np
import pytest

from hearthline.llm import langid
from hearthline.llm.entry import op6_language_id
from tests.llm.conftest import MEDIUM, as_dicts


def test_whole_table_and_held_out_accuracy(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    got = as_dicts(op6_language_id(spark, MEDIUM))
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    right = total = 0
    for r in got:
        own = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in own["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        if r["held_out"] and letters and own["lang"]:
            right, total = right + (r["lang_pred"] == own["lang"]), total + 1
    assert total > 100 and right / total >= 0.97


def test_label_source_and_id_are_no_inputs(spark, small):
    model = langid.fit(small)
    predict = langid.predictor(model, with_spans=False)
    rows = small.where("text is not null").select("text", predict("text").alias("p")).collect()
    again = small.where("text is not null").selectExpr("text", "'xx' as lang", "'q' as source", "doc_id + 1 as doc_id").select("text", predict("text").alias("p")).collect()
    assert sorted((r["text"], r["p"]["lang_pred"]) for r in rows) == sorted((r["text"], r["p"]["lang_pred"]) for r in again)


def test_spans_of_mixed_text(spark):
    en = "the men and the women of this town have always been there with their children when they were needed "
    de = "der Mann und die Frau haben nicht immer auf das Haus gewartet, weil sie noch einen anderen Weg kannten "
    ru = "он не знал что это было когда они пришли домой после работы и увидели её там "
    rows = [(i, t * 3, k) for i, (t, k) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, held_out=9)
    assert model.languages == ["de", "en", "ru"]
    mixed = spark.createDataFrame([(en + de + ru,)], "text string").select(langid.predictor(model)("text").alias("p")).first()["p"]
    assert [s["lang"] for s in mixed["spans"]] == ["en", "de", "ru"]
    assert sum(s["words"] for s in mixed["spans"]) == sum(len(t.split()) for t in (en, de, ru))
    words = langid.split_words([ru.encode()])
    assert not model.writes[words.script][:, :2].any()  # script leaves one candidate


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    counts = np.array([5, 0, 1, 6, 3])
    scores = rng.normal(0, 2, (counts.sum(), 3)).astype(np.float32)
    label = langid.viterbi(scores, counts, 1.5)
    begin = np.cumsum(counts) - counts
    for b, n in zip(begin, counts):
        worth = lambda path: sum(scores[b + t, s] for t, s in enumerate(path)) - 1.5 * sum(x != y for x, y in itertools.pairwise(path))  # noqa: B023, E731
        best = max(map(worth, itertools.product(range(3), repeat=n)))
        assert worth(label[b : b + n].tolist()) == pytest.approx(best, abs=1e-4)


def test_odd_rows(spark, odd, empty):
    got = as_dicts(langid.identify(odd))
    texts = odd.collect()
    assert len(got) == len(texts)
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in got) == sum(not any(c.isalpha() for c in r["text"] or "") for r in texts)
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and {r["_lang"] for r in kept.collect()} == {1}
    assert langid.identify(empty).count() == 0 and langid.keep_identified(empty).count() == 0
    unknown = spark.createDataFrame([(1, "words without a label", None)], "doc_id long, text string, lang string")
    assert as_dicts(langid.identify(unknown))[0]["lang_pred"] == "und"
