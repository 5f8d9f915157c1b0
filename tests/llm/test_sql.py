"""The corpus queries that have a SQL form, against it, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tracegrid.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not there")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    relation = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(relation.columns)
    shown = lambda rows, names: sorted((tuple(r[names.index(n)] for n in sorted(names)) for r in rows), key=repr)
    assert shown([tuple(r) for r in df.collect()], df.columns) == shown(relation.fetchall(), relation.columns)
