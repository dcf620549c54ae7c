from collections import defaultdict

import pytest
from pyspark.sql import Row

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def union_find(links, nodes):
    """Smallest reachable node of each node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    groups = defaultdict(list)
    for n in nodes:
        groups[root(n)].append(n)
    return {n: min(g) for g in groups.values() for n in g}


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def small_rows(small):
    return small.collect()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, an empty and a very long text, repeated rows, ties, and columns that clash with what operators add."""
    long_text = " ".join(f"word{i % 997} der Hund, und {i}" for i in range(40_000))
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, "The cat sat on the mat and the dog ran to the house", "en", "a", 1),
        (3, "The cat sat on the mat and the dog ran to the house", "en", "a", 1), (3, "The cat sat on the mat and the dog ran to the house", "en", "a", 1),
        (4, long_text, "de", None, 2), (5, "Der Hund und die Katze sind in dem Haus und nicht auf der Wiese", "de", "b", 3), (6, "12 34 !!", None, "b", 4),
        (None, "die Katze und der Hund", "de", "b", 5), (None, None, None, None, None), (-7, "Été à la mer, l'eau et le vent", "fr", "\U0001f600", 6), (8, " \t\n ", "fr", "c", 7),
    ]
    extra = ", shard int, slot int, keep boolean, score double, _h int, _id int, _row int, _host int, _lang int, _copies int, rank int, component_id int, _p int, bucket int"
    return spark.createDataFrame([(*r, *[1, 1, True, 1.0], *[1] * 10) for r in rows], DOCS + extra)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def as_dicts(df) -> list[dict]:
    return [r.asDict() if isinstance(r, Row) else r for r in df.collect()]
