"""Every query of the subpackage with an SQL twin against DuckDB, columns and values."""

import duckdb
import pytest

from moraine.llm import queries

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name, data):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    want = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    as_rows = lambda rows: sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    assert as_rows(tuple(r[c] for c in cols) for r in got.collect()) == as_rows(tuple(r[i] for i in at) for r in want.fetchall())


def test_twins_are_queries():
    assert set(queries.ORACLES) <= set(queries.QUERIES)
