"""Aggregations that charts draw, bounded by the canvas rather than the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import cells

CATEGORY_LIMIT = 40


def padded(low: float, high: float) -> tuple[float, float]:
    """A range of more than a point."""
    if high > low:
        return low, high
    pad = abs(low) * 0.5 or 1.0
    return low - pad, high + pad


def _limits(df: DataFrame, *columns: str) -> list[tuple[float, float]]:
    row = df.agg(*[f(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))) for c in columns for f in (F.min, F.max)]).first()
    return [padded(row[2 * k] or 0.0, row[2 * k + 1] or 0.0) for k in range(len(columns))]


def _bin(c: str, low: float, high: float, n: int):
    return F.least(F.floor((F.col(c).cast("double") - F.lit(low)) / F.lit(high - low) * n), F.lit(n - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin, lower, upper, n: all bins, empty ones too; the greatest value is in the last."""
    spark = df.sparkSession
    ((low, high),) = _limits(df, column)
    counts = df.where(F.col(column).isNotNull()).groupBy(_bin(column, low, high, bins).alias("bin")).agg(F.count("*").alias("n"))
    step = (high - low) / bins
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counts), "bin", "left").select("bin", (F.lit(low) + F.col("bin") * step).alias("lower"), (F.lit(low) + (F.col("bin") + 1) * step).alias("upper"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def density(df: DataFrame, x: str, y: str, width: int = 100, height: int = 70) -> DataFrame:
    """Occupied cells of a grid: ix, iy, n."""
    (x0, x1), (y0, y1) = _limits(df, x, y)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(_bin(x, x0, x1, width).alias("ix"), _bin(y, y0, y1, height).alias("iy")).agg(F.count("*").alias("n"))


def decimate(df: DataFrame, value: str, row: str = "_row", buckets: int = 800, rows: int | None = None) -> DataFrame:
    """For each bucket of consecutive rows the first least and first greatest point: bucket, at, value. A spike stays visible."""
    n = rows if rows is not None else (df.agg(F.max(row)).first()[0] or 0) + 1
    wide = max(1, math.ceil(n / buckets))
    point = F.struct(F.col(row).alias("at"), F.col(value).cast("double").alias("value"))
    real = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ends = real.groupBy(F.floor(F.col(row) / wide).alias("bucket")).agg(F.min_by(point, F.struct(F.col(value), F.col(row))).alias("a"), F.min_by(point, F.struct(-F.col(value), F.col(row))).alias("b"))
    both = F.array_distinct(F.array("a", "b"))
    return ends.select("bucket", F.explode(both).alias("p")).select("bucket", "p.at", "p.value")


def category(df: DataFrame, label: str, value: str | None, function: str = "Sum", limit: int = CATEGORY_LIMIT) -> DataFrame:
    """label, value by category, greatest first, then label. The mean divides by all rows of the category."""
    x = F.col(value).cast("double") if value else F.lit(1.0)
    out = {"Sum": F.coalesce(F.sum(x), F.lit(0.0)), "Count": F.count(F.lit(1)).cast("double"), "Mean": F.coalesce(F.sum(x), F.lit(0.0)) / F.count(F.lit(1)), "Min": F.coalesce(F.min(x), F.lit(0.0)), "Max": F.coalesce(F.max(x), F.lit(0.0))}[function]
    return df.groupBy(F.col(label).alias("label")).agg(out.alias("value")).orderBy(F.col("value").desc(), F.col("label").asc()).limit(limit)


def selection_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row over the selected cells: cells, numbers, total, least, greatest, mean. Booleans are 1 and 0; text is no number."""
    kind = cells.kinds(df)

    def number(c: str) -> Column:
        k, x = cells.kind_of(kind[c]), F.col(c)
        x = F.when(x["tag"].isin(cells.NUMBER, cells.BOOL), x["num"]) if k == "mixed" else x.cast("int").cast("double") if k == "bool" else cells.numbers(x, kind[c])
        return F.when(~F.isnan(x), x)

    xs = F.array(*[number(c) for c in columns])
    filled = F.array(*[F.col(c).isNotNull() for c in columns])
    one = df.select(F.size(F.filter(filled, lambda b: b)).alias("c"), F.filter(xs, lambda x: x.isNotNull()).alias("x"))
    per = one.select("c", F.size("x").alias("n"), F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("s"), F.array_min("x").alias("lo"), F.array_max("x").alias("hi"))
    return per.agg(F.sum("c").cast("long").alias("cells"), F.sum("n").cast("long").alias("numbers"), F.sum("s").alias("total"), F.min("lo").alias("least"), F.max("hi").alias("greatest")).withColumn("mean", F.try_divide("total", "numbers"))


def ticks(low: float, high: float, most: int = 8) -> list[float]:
    """Round numbers (1, 2 or 5 times a power of ten apart) that cover the range."""
    low, high = padded(low, high)
    rough = (high - low) / max(1, most)
    power = 10 ** math.floor(math.log10(rough))
    step = next(power * k for k in (1, 2, 5, 10) if power * k >= rough * (1 - 1e-12))
    first = math.ceil(low / step - 1e-9)
    return [round(k * step, 12) for k in range(first, math.floor(high / step + 1e-9) + 1)]


def log_ticks(low: float, high: float) -> list[float]:
    return [10.0**k for k in range(math.floor(math.log10(max(low, 1e-300))), math.ceil(math.log10(max(high, 1e-300))) + 1)]
