"""Consolidation of blocks by their row and column labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"Sum": F.sum, "Count": F.count, "Average": F.avg, "Min": F.min, "Max": F.max}


def long_form(blocks: dict[str, tuple[DataFrame, str, list[str]]], row: str = "_row") -> DataFrame:
    """Blocks (source -> frame, label column, value columns) as rows source, source_at, rk, ck, row_at, col_at, value. Of rows that share a label the last counts."""
    out = None
    for k, (source, (df, label, columns)) in enumerate(blocks.items()):
        one = df.groupBy(F.col(label).cast("string").alias("rk")).agg(F.max_by(F.struct(*[F.col(c).cast("double").alias(c) for c in columns]), row).alias("v"), F.min(row).alias("row_at"))
        entry = [F.struct(F.lit(c).alias("ck"), F.lit(j).alias("col_at"), F.col("v")[c].alias("value")) for j, c in enumerate(columns)]
        one = one.select(F.lit(source).alias("source"), F.lit(k).alias("source_at"), "rk", "row_at", F.explode(F.array(*entry)).alias("e")).select("source", "source_at", "rk", "row_at", "e.ck", "e.col_at", "e.value")
        out = one if out is None else out.unionByName(one)
    return out


def consolidate(cells: DataFrame, sources: list[str], function: str = "Sum") -> DataFrame:
    """From the long form, a row for each pair of labels that some source holds: rk, ck, value, contributors, missing (sources without it), row_order, col_order.

    Labels keep the order in which they are first seen. A pair is listed when its row and column labels occur
    anywhere; one that no source has a number for has a NULL value, never 0.
    """
    rows = cells.groupBy("rk").agg(F.min(F.struct("source_at", "row_at")).alias("row_order"))
    columns = cells.groupBy("ck").agg(F.min(F.struct("source_at", "col_at")).alias("col_order"))
    found = cells.where("value is not null").groupBy("rk", "ck").agg(FUNCTIONS[function]("value").cast("double").alias("value"), F.collect_set("source").alias("_there"))
    # The grid of labels is the result itself (a row a label pair), not a blow-up of the input rows.
    grid = rows.join(F.broadcast(columns), F.lit(True))
    every = F.array(*[F.lit(s) for s in sources])
    there = F.coalesce("_there", F.array().cast("array<string>"))
    out = grid.join(found, ["rk", "ck"], "left")
    return out.select("rk", "ck", "value", F.size(there).cast("long").alias("contributors"), F.array_join(F.array_sort(F.array_except(every, there)), ",").alias("missing"), "row_order", "col_order")
