"""Quality classification with hierarchical empirical Bayes over sites.

A logistic model on style features of the whole text gives each document its
own evidence. Hosts and paths are groups of documents: a host's good share is
a Beta posterior around the global share, a path's one around its host's, and
the strength of both priors comes from the spread of the groups themselves
(method of moments), so sparse sites shrink towards what stands above them.
A document's own evidence is left out of its site's. The score adds the
document's log odds to those by which its path differs from the global share.

Here a document's host is its source and its path is host and language.

Defined results: null text is empty; a null host or path is a group of its
own; a score at the threshold is kept; texts of any length are read whole;
columns of the names it adds are replaced, others kept; with labels of one class only, or none, every document gets their share
(none: 1); repeated rows count as evidence once each; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize, slices, text_or_empty, whole_row

#: The classifier is fitted on at most so many labelled rows, those of smallest hash.
SAMPLE_ROWS = 20_000
#: Columns that classify() adds; columns of these names are replaced.
TAKEN = ("doc_score", "host_posterior", "path_posterior", "quality_score", "keep")
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
N_FEATURES = 9 + len(_MARKS)


def features(text: bytes) -> np.ndarray:
    """Style of a whole text: length, repetition, and shares of kinds of bytes (as square roots)."""
    words, lines = text.split(), text.split(b"\n")
    n, size = max(1, len(words)), max(1, len(text))
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / size
    out = np.empty(N_FEATURES)
    out[0], out[1] = np.log1p(len(words)), np.log1p(sum(map(len, words)) / n)
    out[2] = sum(map(eq, words, words[1:])) / n
    out[3] = np.log(len(set(words)) + 1) - np.log(n + 1)
    out[4] = 1 - len(set(lines)) / len(lines)
    out[5:9] = kinds[65:91].sum(), kinds[48:58].sum(), kinds[128:].sum(), kinds[:32].sum()
    out[9:] = kinds[_MARKS]
    out[5:] = np.sqrt(out[5:])
    return out


class Logistic:
    """L2-regularised logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1.0):
        self.rate = float(y.mean()) if len(y) else 1.0
        self.weights = None
        if len(set(y.tolist())) < 2:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.hstack([self._standard(x), np.ones((len(x), 1))])
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
        ridge[-1] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.rate)
        odds = self._standard(x) @ self.weights[:-1] + self.weights[-1]
        return np.clip(1 / (1 + np.exp(-np.clip(odds, -30, 30))), 1e-4, 1 - 1e-4)


def fit_classifier(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Logistic:
    sample = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("_y"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded, so it can be broadcast

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            x = np.array([features(t) for t in as_bytes(b.column(1))]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    text = text_or_empty(docs).alias("text")
    got = docs.select("doc_id", text).join(F.broadcast(sample), "doc_id").select(F.col("_y").alias("y"), "text").mapInArrow(measure, "y int, x array<double>").toPandas()
    got = got.sort_values("y", kind="stable")
    return Logistic(np.array(got["x"].tolist()).reshape(-1, N_FEATURES), got["y"].to_numpy(float))


def _evidence(model: Logistic):
    @F.pandas_udf("double")
    def good(text: pd.Series) -> pd.Series:
        return pd.Series(model(np.array([features((t or "").encode()) for t in text]).reshape(-1, N_FEATURES)))

    return good


def _strength(share: Column, around: Column, n: Column) -> Column:
    """Prior strength by moments: the spread of group shares beyond what samples of their sizes have."""
    spread = F.sum(n * (share - around) ** 2) / F.sum(n)
    noise = F.sum(around * (1 - around)) / F.sum(n)
    within = F.sum(n * around * (1 - around)) / F.sum(n)
    found = within / F.greatest(spread - noise, F.lit(1e-9)) - 1
    return F.coalesce(F.least(F.greatest(found, F.lit(1.0)), F.lit(1e6)), F.lit(1e6))


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """docs with doc_score, host_posterior, path_posterior, quality_score and keep."""
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in TAKEN))
    good = _evidence(fit_classifier(docs, labels))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    scored = docs.select(whole_row(docs).alias("_row"), key(host).alias("_host"), key(path).alias("_path"), good(text_or_empty(docs)).alias("doc_score"))

    paths = materialize(scored.groupBy("_host", "_path").agg(F.sum("doc_score").alias("_s"), F.count("*").alias("_n")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("_s").alias("_hs"), F.sum("_n").alias("_hn"))
    total = paths.agg((F.sum("_s") / F.sum("_n")).alias("m")).first()["m"]
    mean = F.lit(float(total if total is not None else 1.0))
    host_k = float(hosts.agg(_strength(F.col("_hs") / F.col("_hn"), mean, F.col("_hn")).alias("k")).first()["k"])
    both = paths.join(hosts, "_host").withColumn("_h", (F.col("_hs") + host_k * mean) / (F.col("_hn") + host_k))
    path_k = float(both.agg(_strength(F.col("_s") / F.col("_n"), F.col("_h"), F.col("_n")).alias("k")).first()["k"])
    sites = materialize(both.select("_host", "_path", "_s", "_n", "_hs", "_hn"), "sites")  # its size on disk decides how it is joined

    own = F.col("doc_score")
    out = scored.join(sites, ["_host", "_path"])
    out = out.withColumn("host_posterior", (F.col("_hs") - own + host_k * mean) / (F.col("_hn") - 1 + host_k))
    out = out.withColumn("path_posterior", (F.col("_s") - own + path_k * F.col("host_posterior")) / (F.col("_n") - 1 + path_k))
    out = out.withColumn("quality_score", 1 / (1 + F.exp(-(_odds(own) + _odds(F.col("path_posterior")) - _odds(mean)))))
    return out.withColumn("keep", F.col("quality_score") >= threshold).select("_row.*", *TAKEN)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that classify() keeps, with the columns of docs."""
    aside = {c: f"_in_{c}" for c in docs.columns if c in TAKEN}
    judged = classify(docs.withColumnsRenamed(aside), labels, **options)
    return judged.where("keep").select(*(F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns))
