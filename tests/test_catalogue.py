"""Every catalogue query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from tessera.plans import catalogue, parsed, reported  # noqa: F401  the last two add their queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if v is None or v != v:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    return round(v, 9) if isinstance(v, float) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(repr(tuple(plain(x) for x in r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(catalogue.ORACLE_SQL[name]).df())


def test_every_query_is_named_once():
    assert len(catalogue.QUERIES) >= 105 and set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
