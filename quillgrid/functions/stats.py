"""Aggregates of formulas over number columns (others already NULL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cells import DIV0, NA, NUM


def exact_sum(x: Column, places: int | None = None) -> Column:
    """Sum that doesn't depend on the order; ``places``: the values' decimals, for sums free of binary error."""
    if places is None:
        return F.sum(x)
    return F.sum(x.cast(f"decimal(38,{places})")).cast("double")


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def low(x: Column) -> Column:
    """Least number; none: 0; NaN is passed over."""
    return F.coalesce(F.min(finite(x)), F.lit(0.0))


def high(x: Column) -> Column:
    return F.coalesce(F.max(finite(x)), F.lit(0.0))


#: Name to (aggregate, error of an empty range, least count below which the error is DIV0).
SPREADS = {"STDEV.P": (F.stddev_pop, NUM, 0), "STDEV.S": (F.stddev_samp, NUM, 2), "VAR.P": (F.var_pop, NUM, 0), "VAR.S": (F.var_samp, NUM, 2)}


def spread(name: str, x: Column) -> tuple[Column, Column]:
    f, empty, least = SPREADS[name]
    n = F.count(x)
    return F.when(n >= max(1, least), f(x)), F.when(n == 0, empty).when(n < least, DIV0)


def average(x: Column) -> tuple[Column, Column]:
    return F.avg(x), F.when(F.count(x) == 0, DIV0)


def quantiles(df: DataFrame, x: str, ks: dict[str, float], by: list[str] = ()) -> DataFrame:
    """``by`` and, for each name, the exact quantile (0 to 1) of the numbers in ``x``, between neighbours in proportion.

    Distinct values are counted and cut into blocks of the value range; only the blocks that hold a sought rank are
    sorted, so no buffer holds a group's values. A group without numbers has no row; without ``by`` there is one row.
    """
    from ..operators.positional import with_blocks

    real = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(*by, F.col(x).cast("double").alias("_v"))
    counted = with_blocks(real, F.col("_v")).groupBy(*by, "_block", "_v").agg(F.count("*").alias("_n"))
    blocks = counted.groupBy(*by, "_block").agg(F.sum("_n").alias("_size"))
    group = Window.partitionBy(*by)
    blocks = blocks.withColumn("_before", F.sum("_size").over(group.orderBy("_block")) - F.col("_size")).withColumn("_all", F.sum("_size").over(group))
    ranks = {name: (F.floor((F.col("_all") - 1) * F.lit(k)), F.ceil((F.col("_all") - 1) * F.lit(k))) for name, k in ks.items()}
    holds = lambda low, size: reduce(lambda a, b: a | b, [(low <= r) & (r < low + size) for pair in ranks.values() for r in pair])
    sought = counted.join(blocks.where(holds(F.col("_before"), F.col("_size"))), [*by, "_block"])
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_block").orderBy("_v"))
    placed = sought.withColumn("_upto", upto).withColumn("_low", F.col("_upto") - F.col("_n"))
    at = lambda r: F.max(F.when((F.col("_low") <= r) & (r < F.col("_upto")), F.col("_v")))
    found = placed.groupBy(*by).agg(F.max("_all").alias("_all"), *[at(r).alias(f"_{side}_{name}") for name, pair in ranks.items() for side, r in zip("ab", pair, strict=True)])
    part = lambda k: (F.col("_all") - 1) * F.lit(k) - F.floor((F.col("_all") - 1) * F.lit(k))
    return found.select(*by, *[(F.col(f"_a_{name}") + part(k) * (F.col(f"_b_{name}") - F.col(f"_a_{name}"))).alias(name) for name, k in ks.items()])


def kth(df: DataFrame, x: Column, k: int, largest: bool = True) -> DataFrame:
    """One row (value) with the k-th largest or smallest; no row if there are fewer. Plans as a distributed top-k."""
    order = F.col("value").desc() if largest else F.col("value").asc()
    top = df.select(x.alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value")).orderBy(order).limit(k)
    value = F.min("value") if largest else F.max("value")
    return top.agg(value.alias("value"), F.count("*").alias("n")).where(F.col("n") == k).select("value")


def mode(df: DataFrame, x: Column, row: Column, by: list[str] = ()) -> DataFrame:
    """``by`` columns and ``mode``: the commonest value, of equals the one seen first; NA (a NULL mode) if nothing repeats."""
    counted = df.select(*by, x.alias("value"), row.alias("at")).where("value is not null").groupBy(*by, "value").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    best = counted.groupBy(*by).agg(F.max_by("value", F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"))
    return best.select(*by, F.when(F.col("n") > 1, F.col("mode")).alias("mode"), F.when(F.col("n") <= 1, NA).alias("error"))


def rank_eq(df: DataFrame, column: str, descending: bool = True, out: str = "rank") -> DataFrame:
    """``df`` with the rank of each number: how many are strictly better, plus 1.

    Counts by distinct value are range-sorted and summed in two steps, so no task sees all rows.
    """
    from ..operators.positional import running_total

    key = F.col("value").desc() if descending else F.col("value").asc()
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranks = running_total(counts, [key], "n", "upto").select("value", (F.col("upto") - F.col("n") + 1).alias(out))
    return df.join(ranks, F.col(column) == F.col("value"), "left").drop("value")
