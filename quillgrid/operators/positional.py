"""Operators on row order that no single task has to see whole: positions, running totals, moving windows, runs.

Rows are cut into blocks that follow the order; each block is summed, the blocks' offsets are added up on one
small row a block, and the rest happens inside blocks in parallel.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCKS = 64


def with_blocks(df: DataFrame, key: Column, out: str = "_block", blocks: int | None = None) -> DataFrame:
    """``df`` with a block number that rises with the number ``key``; equal keys share a block, NULLs are in block 0."""
    n = blocks or max(BLOCKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.agg(F.percentile_approx(key.cast("double"), [k / n for k in range(1, n)], 10_000)).first()[0]
    cuts = sorted({c for c in cuts or [] if c == c})
    return df.withColumn(out, F.coalesce(_below(cuts, key.cast("double")), F.lit(0)))


def _below(cuts: list[float], x: Column) -> Column:
    """How many of the sorted cuts are below ``x``: a look at every step-th cut, then at the cuts of one step."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    every = F.array(*[F.lit(c) for c in cuts])
    coarse = F.size(F.filter(F.array(*[F.lit(c) for c in cuts[step - 1 :: step]]), lambda c: c < x))
    return coarse * step + F.size(F.filter(F.slice(every, coarse * step + 1, F.lit(step)), lambda c: c < x))


#: Rows of a block where places are known.
BLOCK_ROWS = 1 << 17


def running_totals(df: DataFrame, row: str, sums: dict[str, str], size: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with running sums (name -> column) along ``row``, places from 0 without gaps. Blocks are cut by place alone."""
    blocked = df.withColumn("_block", F.floor(F.col(row) / F.lit(size)))
    totals = blocked.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_block", *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums])
    w = Window.partitionBy("_block").orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    inside = blocked.withColumns({f"_in_{name}": F.sum(c).over(w) for name, c in sums.items()})
    joined = inside.join(offsets, "_block")
    return joined.select(*df.columns, *[(F.col(f"_in_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums])


def running_total(df: DataFrame, order: list[Column], value: str, out: str, descending: bool | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with each, in the order.

    The first order column must be numeric and decides the blocks; rows that tie in all of them are summed in
    any order among themselves.
    """
    first, down = _plain(order[0], descending)
    blocked = with_blocks(df, first)
    block = -F.col("_block") if down else F.col("_block")
    sums = blocked.groupBy(block.alias("_at")).agg(F.sum(value).alias("_sum"))
    offsets = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_at", "_before")
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = blocked.withColumn("_in", inside).withColumn("_at", block).join(F.broadcast(offsets), "_at")
    return joined.withColumn(out, F.col("_in") + F.col("_before")).drop("_at", "_in", "_before", "_block")


def _plain(order: Column, descending: bool | None) -> tuple[Column, bool]:
    """The column under an ``asc``/``desc`` and its direction, read off its name."""
    text = order._jc.toString() if hasattr(order, "_jc") else str(order)
    down = descending if descending is not None else " DESC" in text
    name = text.split(" ASC")[0].split(" DESC")[0].strip().strip("`")
    return F.col(f"`{name}`"), down


def numbered(df: DataFrame, order: list[Column], out: str = "_row") -> DataFrame:
    """``df`` with its place in the order, from 0."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).withColumn(out, F.col(out) - 1).drop("_one")


def moving(df: DataFrame, row: str, columns: dict[str, tuple[str, str, int, int]], size: int = 1 << 18) -> DataFrame:
    """Windows over neighbours by place. ``row``: places from 0 without gaps; ``columns``: name -> (function, column, from, to).

    A function is a name such as ``avg``, or ``value`` for the one cell at ``from``. Each block gets copies of
    the rows just outside it that its windows reach.
    """
    back = max([0, *(-a for _, _, a, _ in columns.values())])
    ahead = max([0, *(b for _, _, _, b in columns.values())])
    r = F.col(row)
    spots = F.array_distinct(F.transform(F.array(r - ahead, r, r + back), lambda x: F.floor(F.greatest(x, F.lit(0)) / F.lit(size))))
    spread = df.withColumn("_block", F.explode(F.sequence(F.array_min(spots), F.array_max(spots))))
    w = Window.partitionBy("_block").orderBy(row)
    for name, (function, column, a, b) in columns.items():
        over = w.rowsBetween(a, b)
        if function == "median":
            near = F.sort_array(F.collect_list(column).over(over))
            spread = spread.withColumn(name, near)
            n = F.size(name)
            value = F.when(n > 0, (F.get(name, F.floor((n - 1) / 2).cast("int")) + F.get(name, F.floor(n / 2).cast("int"))) / 2)
        else:
            value = F.first(column).over(w.rowsBetween(a, a)) if function == "value" else getattr(F, function)(column).over(over)
        spread = spread.withColumn(name, value)
    return spread.where(F.col("_block") == F.floor(r / F.lit(size))).drop("_block")


def runs(df: DataFrame, row: str, key: str, aggregates: list[Column], merges: dict[str, str]) -> DataFrame:
    """One row for each run of equal ``key`` along ``row``: run, key, first_row, last_row, and the merged aggregates.

    ``aggregates`` are partial ones with aliases, ``merges`` says how parts of a run that spans blocks combine
    (``sum``, ``min``, ``max``). Each block is cut into runs by itself; only each block's parts at its edges
    can belong together, and these are merged over the small table of parts.
    """
    blocked = with_blocks(df, F.col(row))
    w = Window.partitionBy("_block").orderBy(row)
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.lag(key).over(w).eqNullSafe(F.col(key))).cast("int"))
    parts = blocked.withColumn("_new", new).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = parts.groupBy("_block", "_part").agg(F.first(key).alias(key), F.min(row).alias("first_row"), F.max(row).alias("last_row"), *aggregates)
    # Edges: the first part of a block goes on from the last part of the block before, if the keys agree. Parts
    # inside a block are settled, so only two rows a block take part in the serial step.
    ends = parts.groupBy("_block").agg(F.min_by(key, "_part").alias("head"), F.max_by(key, "_part").alias("tail"), F.max("_part").alias("n"))
    order = Window.orderBy("_block")
    ends = ends.withColumn("joins", F.lag("tail").over(order).eqNullSafe(F.col("head")) & F.lag("_block").over(order).isNotNull())
    ends = ends.withColumn("before", F.coalesce(F.sum(F.col("n") - F.col("joins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = parts.join(F.broadcast(ends.select("_block", "joins", "before")), "_block").withColumn("run", F.col("before") + F.col("_part") - F.col("joins").cast("int"))
    merged = [getattr(F, how)(name).alias(name) for name, how in merges.items()]
    return at.groupBy("run").agg(F.first(key).alias(key), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), *merged)
