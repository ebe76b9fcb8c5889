"""Queries of the subpackage that have SQL give the same rows in DuckDB."""

import duckdb
import pytest

from helixframe.llm import queries


def rows(found):
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    expected = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({queries.SQL[name]})").fetchall()
    got = rows(df.select(*columns).collect())
    assert len(got) > 0
    assert got == rows(expected)
