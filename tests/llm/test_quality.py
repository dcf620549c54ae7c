import numpy as np
import pytest

from hearthline.llm import quality
from tests.llm.conftest import MEDIUM, as_dicts


def test_posteriors_by_hand(spark, small):
    """Host and path posteriors follow from the documents' own scores, each document left out of its own."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = as_dicts(quality.classify(small.drop("text").join(small.select("doc_id", "text"), "doc_id"), labels))
    assert len(rows) == small.count()
    groups = {}
    for r in rows:
        groups.setdefault((r["source"], r["lang"]), []).append(r["doc_score"])
    mean = np.mean([r["doc_score"] for r in rows])
    hosts = {h: sum((v for (a, _), v in groups.items() if a == h), []) for h, _ in groups}

    def strength(pairs):  # (share, around, n)
        s, a, n = np.array(pairs).T
        spread, noise, within = (n * (s - a) ** 2).sum() / n.sum(), (a * (1 - a)).sum() / n.sum(), (n * a * (1 - a)).sum() / n.sum()
        return min(max(within / max(spread - noise, 1e-9) - 1, 1), 1e6)

    host_k = strength([(np.mean(v), mean, len(v)) for v in hosts.values()])
    full = {h: (sum(v) + host_k * mean) / (len(v) + host_k) for h, v in hosts.items()}
    path_k = strength([(np.mean(v), full[h], len(v)) for (h, _), v in groups.items()])
    odds = lambda p: np.log(p / (1 - p))
    for r in rows:
        h, g, own = hosts[r["source"]], groups[r["source"], r["lang"]], r["doc_score"]
        host = (sum(h) - own + host_k * mean) / (len(h) - 1 + host_k)
        path = (sum(g) - own + path_k * host) / (len(g) - 1 + path_k)
        assert r["host_posterior"] == pytest.approx(host, abs=1e-9)
        assert r["path_posterior"] == pytest.approx(path, abs=1e-9)
        score = 1 / (1 + np.exp(-(odds(own) + odds(path) - odds(mean))))
        assert r["quality_score"] == pytest.approx(score, abs=1e-6)
        assert r["keep"] == (r["quality_score"] >= 0.5)


def test_sparse_sites_shrink_more(spark):
    """A site with one bad document lies nearer the global share than one with many."""
    good = "The house by the lake was quiet, and nobody had lived there since the old man moved to town last spring."
    bad = "$$$ BUY!!! BUY!!! >>> 000 !!! $$$ 999 @@@ ### !!!"
    rows = [(i, f"{good} {i}", "en", f"s{i % 7}", 0) for i in range(140)] + [(200 + i, f"{bad} {i}", "en", "many", 0) for i in range(60)] + [(300, bad, "en", "one", 0), (301, bad, "en", "one", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in [*range(100), *range(200, 250)]], "doc_id long, quality int")
    got = {r["source"]: r for r in as_dicts(quality.classify(docs, labels))}
    assert got["many"]["host_posterior"] < got["one"]["host_posterior"] < got["s1"]["host_posterior"]
    assert not got["many"]["keep"] and got["s1"]["keep"]


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1 and quality is not null").collect()}
    got = [(r["quality_score"], known[r["doc_id"]]) for r in quality.classify(docs, labels.where("doc_id % 2 = 0")).collect() if r["doc_id"] in known]
    hit = np.mean([(s >= 0.5) == bool(y) for s, y in got])
    share = np.mean([y for _, y in got])
    assert hit > max(share, 1 - share) and hit >= 0.85


@pytest.mark.parametrize("kind", ["none", "one class", "both"])
def test_odd_rows(spark, odd, kind):
    labels = {"none": [], "one class": [(2, 1), (None, 1), (3, None)], "both": [(2, 1), (5, 1), (6, 0), (1, 0), (None, 0), (99, 1)]}[kind]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = as_dicts(quality.classify(odd, table))
    assert len(rows) == odd.count() and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert rows[0]["_row"] == rows[0]["_host"] == 1
    kept = quality.keep_good(odd, table)
    assert kept.columns == odd.columns and kept.where("keep and score = 1.0").count() == kept.count()
    if kind != "both":
        assert kept.count() == odd.count()  # every document gets the share of the only class, or 1


def test_empty(spark, empty):
    assert quality.classify(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
