"""Every named query against its DuckDB oracle on the smallest tables."""

import datetime
import decimal

import pytest

from quarry.plans import derived_sources, fixtures, matching_queries, review_queries, upkeep_queries  # noqa: F401  add their queries
from quarry.plans.catalogue import ORACLES, QUERIES, flagship

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool | str):
        return str(v)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert flagship(spark, DATA).count() > 0 and entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
