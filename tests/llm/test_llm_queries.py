import glob
from pathlib import Path

import duckdb
import pytest

from corpusloom.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    df = llm.queries()[name](spark, data)
    want = con.sql(llm.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(df.columns) == order
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())
