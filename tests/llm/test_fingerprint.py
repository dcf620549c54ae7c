import hashlib
import re
import unicodedata

from pyspark.sql import functions as F

from hearthline.llm import fingerprint
from hearthline.llm.entry import op8_fingerprint
from tests.llm.conftest import SMALL, as_dicts


def canon(text):
    nfkc = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"\s+", " ", nfkc(nfkc(text).casefold())).strip(" ")


def check(got, docs):
    """docs: distinct ids. Edits, digests and likenesses against a plain loop."""
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is not None, d[0] or 0))
    got = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs)
    classes = {}
    for n, (i, t) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(canon(t) == canon(edited)) and r["near_next"] == float(canon(t) == canon(after))
        classes.setdefault(canon(t), set()).add(r["fingerprint"])
        classes.setdefault(canon(edited), set()).add(r["edited_fingerprint"])
    assert all(len(v) == 1 for v in classes.values()) and len(set().union(*classes.values())) == len(classes)


def test_whole_table(spark, small_rows):
    check(as_dicts(op8_fingerprint(spark, SMALL)), [(r["doc_id"], r["text"]) for r in small_rows])


def test_odd_rows(odd, empty):
    rows = odd.dropDuplicates(["doc_id"])
    check(as_dicts(fingerprint.fingerprint_documents(rows)), [(r["doc_id"], r["text"]) for r in rows.collect()])
    assert fingerprint.fingerprint_documents(odd).count() == odd.count()
    assert fingerprint.fingerprint_documents(empty).count() == 0


def test_one_row(spark):
    (r,) = as_dicts(fingerprint.fingerprint_documents(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")))
    assert r["edited"] == "abcabc" and r["near_next"] == 1.0


def test_canonical_form(spark):
    texts = ["Straße", "STRASSE", "ﬁn", "fin", "é", "é", "a \t\n b", " A  B ", "ＡＢ", "ab", "İ", "ς Σ", "\U0001d49c x", "", "   "]
    got = [r["c"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fingerprint.canonical(F.col("t")).alias("c")).collect()]
    assert got == [canon(t) for t in texts]


def test_colliding_buckets_are_split(spark, monkeypatch):
    """With a hash that collides for all texts the byte comparison still tells them apart."""
    monkeypatch.setattr(fingerprint, "wide_hash", lambda c: F.lit("0" * 32))
    docs = [(i, t) for i, t in enumerate(["aaaa", "AAAA", "bbbb", "cc", "bbbb "])]
    got = {r["doc_id"]: r["fingerprint"] for r in as_dicts(fingerprint.fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert got[0] == got[1] and got[2] == got[4] and len({got[0], got[2], got[3]}) == 3
