"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from orbitframe.plans import oracles, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(shown(r[c]) for c in names) for r in df.collect()), key=str)
    if name not in oracles.ORACLES:
        assert got
        return
    result = duck.execute(oracles.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = sorted((tuple(shown(r[columns.index(c)]) for c in names) for r in result.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def same_as_sql(spark, con, name, folder):
    names = sorted(c[0] for c in con.execute(oracles.ORACLES[name]).description)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({oracles.ORACLES[name]})").fetchall()
    got = queries.QUERIES[name](spark, str(folder)).select(*names).collect()
    return want, sorted((tuple(map(shown, r)) for r in got), key=str) == sorted((tuple(map(shown, r)) for r in want), key=str)


@pytest.mark.parametrize("name", ["p06_pansharpen", "p07_pansharpen_resized"])
def test_pansharpen_of_halves_and_of_areas_that_lack_revisits(spark, tmp_path, name):
    """The first area's quotients lie on halves of the last digit; the second lacks revisits 3 and 4, the third all four."""
    con = duckdb.connect()
    vectors = ", ".join(f"({i}, {v}::FLOAT)" for i, v in ((0, 0.0858), (1, 0.1872), (2, 0.1432), (3, 0.0399), (8, 0.01), (9, 0.03), (20, 0.5)))
    con.execute(f"CREATE VIEW embeddings AS SELECT vec_id::BIGINT AS vec_id, list_resize([v], 64, v) AS embedding FROM (VALUES {vectors}) t(vec_id, v)")
    con.execute(f"COPY (FROM embeddings) TO '{tmp_path}/embeddings.parquet'")
    want, same = same_as_sql(spark, con, name, tmp_path)
    assert len({r[0] for r in want}) == 3 and same
