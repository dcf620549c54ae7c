"""Every registered query outside the training-data package against its SQL twin, on the whole smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from hearthline.plans import accounts, catalog, listings  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, decimal.Decimal | float | int) and not isinstance(v, bool):
        return "NaN" if math.isnan(v) else round(float(v), 9)
    return v


def sorted_rows(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_twin(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    want = tables.execute(catalog.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got, want = sorted_rows(df.collect(), df.columns), sorted_rows(want.fetchall(), names)
    assert got == want and got


def test_queries_take_tables_of_nulls_and_none(spark, tmp_path):
    """No query fails on empty tables; those over texts answer for documents without one, too."""
    for t in TABLES:
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.sql("select 7L doc_id, cast(null as string) text, cast(null as string) lang, cast(null as string) source, 0L n_chars").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    for name, query in catalog.QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        if name in ("issue_scan", "sliding_best", "look_ahead", "page_blocks"):
            assert {r["doc_id"] for r in rows} == {7}, name
