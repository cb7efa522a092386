"""Every registered corpus query at the smallest scale: against its SQL where there is one, else a row for each input row."""

import duckdb
import pytest
from test_oracles import DATA, TABLES, shown

from orbitframe.llm import queries

#: Queries that give one row for each row of documents.
ONE_FOR_ONE = {"op4_quality_crf", "op7_toxicity", "op8_simhash", "op10_secrets", "op13_lm_scores"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"pipeline"}))
def test_corpus_query(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(shown(r[c]) for c in names) for r in df.collect()), key=str)
    if name in ONE_FOR_ONE:
        assert len(got) == duck.execute("SELECT count(*) FROM documents").fetchone()[0]
    if name not in queries.ORACLES:
        assert got
        return
    result = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    assert got == sorted((tuple(shown(r[columns.index(c)]) for c in names) for r in result.fetchall()), key=str)
