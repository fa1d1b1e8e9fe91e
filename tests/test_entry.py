import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from plumbline.plans import queries as engine

SF = "/root/testdata/sf0.001"


def cell(v):
    return repr(round(v, 6) if isinstance(v, float) and math.isfinite(v) else v)


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(engine.SQL[name])
    df = engine.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    got = df.select(*want.columns).collect()
    assert sorted(tuple(map(cell, r)) for r in got) == sorted(tuple(map(cell, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.SQL)))
def test_queries_without_sql_give_rows(spark, name):
    assert engine.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["method_a", "method_b", "score", "exact"]
    assert set(engine.QUERIES) <= set(entry.queries()) and set(engine.SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    root = Path(entry.__file__).parent
    code = "import sys; sys.modules['plumbline.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(engine.QUERIES)), str(len(engine.SQL))], out.stderr


def test_nothing_else_imports_the_training_data_operators():
    root = Path(entry.__file__).parent / "plumbline"
    for p in root.rglob("*.py"):
        assert "llm" in p.parts or "plumbline.llm" not in p.read_text(), p
