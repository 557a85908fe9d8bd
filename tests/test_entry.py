"""The registry, and each query against its SQL on the smallest data."""

import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillgrid.plans import catalogue, formulas

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def plain(v):
    import datetime
    import decimal

    if v is None:
        return ""
    if isinstance(v, (bool, datetime.date)):
        return str(v)[:19]
    return repr(float(v)) if isinstance(v, (int, float, decimal.Decimal)) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(formulas.QUERIES))
def test_same_as_sql(spark, con, name):
    rel = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in rel.description]
    want = sorted(tuple(map(plain, r)) for r in rel.fetchall())
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_partitioning_does_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append([sorted(map(tuple, catalogue.QUERIES[q](spark, SF).collect())) for q in ("pivot_flag_status", "subtotal_runs_orders", "rank_eq_desc", "vlookup_approx", "decimate_800")])
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_without_llm(tmp_path):
    """The registry imports, and keeps its other queries, where the llm folders are gone."""
    for part in ("__spark_entry__.py", "quillgrid"):
        subprocess.run(["cp", "-r", str(ROOT / part), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quillgrid/llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) == len(catalogue.QUERIES) and out[1] == "False"
