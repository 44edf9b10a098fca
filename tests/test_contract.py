"""Every query runs, and equals its SQL, on the smallest test tables; without the llm folder all the rest still imports."""

import glob
import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from inkwell.plans import reference, training

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def value(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v != v:
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) and not math.isinf(v) else str(v)


@pytest.mark.parametrize("name", sorted({**reference.QUERIES, **training.QUERIES}))
def test_query(spark, data, name):
    import duckdb

    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted(tuple(value(v) for v in r) for r in df.select(*columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert rows == sorted(tuple(value(r[k]) for k in at) for r in rel.fetchall())


def test_imports_without_the_llm_folder():
    code = "import sys; sys.modules['inkwell.llm'] = None\nimport __spark_entry__ as e\nassert 'wc_global' in e.queries() and 'p4_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_nothing_else_imports_llm():
    for base, _, names in os.walk(os.path.join(ROOT, "inkwell")):
        for n in names:
            if n.endswith(".py") and os.sep + "llm" not in base:
                assert "inkwell.llm" not in open(os.path.join(base, n), encoding="utf-8").read(), n


def test_entry(spark):
    assert entry.entry(spark).columns == ["word", "count"]
