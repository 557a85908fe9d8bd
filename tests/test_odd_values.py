"""Queries against their SQL on values that the smallest tables lack."""

import duckdb

from quillgrid.plans import catalogue, formulas  # noqa: F401


def test_logarithms_of_what_is_not_positive(spark, tmp_path):
    spark.createDataFrame([(1, 0.0), (2, -2.5), (3, 10.0), (4, -0.0)], "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted(tuple(map(repr, r)) for r in con.execute(catalogue.ORACLE_SQL["abs_int_exp_log"]).fetchall())
    got = sorted(tuple(map(repr, r)) for r in catalogue.QUERIES["abs_int_exp_log"](spark, str(tmp_path)).collect())
    assert got == want and got[0][4] == "-inf" and got[1][4] == "nan"
