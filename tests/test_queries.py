"""Every query with SQL, against DuckDB over the same tables, and the independence of the core from the llm subpackage."""

import glob
import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.core.oracle_sql()))
def test_query_equals_its_sql(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    want = duck.sql(entry.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(df.columns) == order
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_search_makes_no_row_for_each_hit(spark, monkeypatch):
    def no_hits(*_, **__):
        raise AssertionError("a row a query, term and chunk grows with queries times chunks")

    monkeypatch.setattr(entry.core.retrieval, "hits", no_hits)
    rows = entry.queries()["ret_search"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.query_id for r in rows}) > 1 and {r["rank"] for r in rows} == set(range(1, 11))


def test_every_core_query_has_sql():
    assert set(entry.core.queries()) == set(entry.core.oracle_sql()) and len(entry.core.queries()) >= 110


def test_core_does_not_import_the_llm_subpackage():
    code = "import sys, importlib\nfrom pathlib import Path\nfor p in Path('corpusloom').rglob('*.py'):\n    if 'llm' not in p.parts:\n        importlib.import_module('.'.join(p.with_suffix('').parts).removesuffix('.__init__'))\nassert not any(n.startswith('corpusloom.llm') for n in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
