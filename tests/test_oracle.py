"""Every query that has SQL gives the same rows in DuckDB, over the smallest tables; the others run."""

import math

import duckdb
import pytest

from irengine.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"voting_spam", "kmeans_segments", "kmeans_embeddings", "sbd_model"}  # model fits; tested on small inputs elsewhere


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.columns, map(tuple, df.collect())) == canonical(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL) - SLOW))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id"]
    assert set(e.oracle_sql()) <= set(e.queries())
