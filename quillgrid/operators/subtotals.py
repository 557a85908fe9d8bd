"""Subtotals after each run of equal keys along the view order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import cells
from . import positional


def subtotals(df: DataFrame, key: str, value: str, row: str = "_row", places: int | None = None) -> DataFrame:
    """A row for each run: run (from 1), key, first_row, last_row, rows, n (numbers), total, least, greatest, mean."""
    x = cells.numbers(F.col(value), cells.kinds(df)[value])
    exact = x.cast(f"decimal(38,{places})") if places is not None else x
    parts = [F.count("*").alias("rows"), F.count(x).alias("n"), F.sum(exact).alias("total"), F.min(x).alias("least"), F.max(x).alias("greatest")]
    out = positional.runs(df, row, key, parts, {"rows": "sum", "n": "sum", "total": "sum", "least": "min", "greatest": "max"})
    return out.withColumn("total", F.col("total").cast("double")).withColumn("mean", F.try_divide("total", "n"))


def interleaved(df: DataFrame, key: str, value: str, function: str = "Sum", row: str = "_row", places: int | None = None) -> DataFrame:
    """The rows (row, key, value) with a row after each run, labelled ``<key> <function>``; order by (row, is_subtotal)."""
    column = {"Sum": "total", "Count": "rows", "Average": "mean", "Min": "least", "Max": "greatest"}[function]
    runs = subtotals(df, key, value, row, places)
    plain = df.select(F.col(row).alias("at"), F.lit(0).alias("is_subtotal"), F.col(key).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
    made = runs.select(F.col("last_row").alias("at"), F.lit(1).alias("is_subtotal"), F.concat_ws(" ", F.col(key).cast("string"), F.lit(function)).alias("label"), F.col(column).cast("double").alias("value"))
    return plain.unionByName(made)
