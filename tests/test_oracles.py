"""Every registered query with SQL gives the same rows in DuckDB."""

import duckdb
import pytest

from helixframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(found):
    return sorted((tuple(r) for r in found), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    expected = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({registry.SQL[name]})").fetchall()
    got = rows(df.select(*[df[c] for c in columns]).collect())
    assert len(got) > 0
    assert got == rows(expected)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
