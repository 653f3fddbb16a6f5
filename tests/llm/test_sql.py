import duckdb
import pytest

from lamella.llm import queries
from lamella.llm.sql import ORACLES


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, found.fetchall()))
