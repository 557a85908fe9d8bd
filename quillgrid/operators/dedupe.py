"""Remove Duplicates, and distinct rows in order of first appearance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import cells


def remove_duplicates(df: DataFrame, keys: list[str] | None = None, row: str = "_row") -> DataFrame:
    """The first row, by ``row``, of each combination of keys (all columns but ``row`` by default); case counts.

    A grouped minimum, combined before the shuffle, so copies cost little however many there are.
    """
    keys = keys or [c for c in df.columns if c != row]
    rest = [c for c in df.columns if c not in keys and c != row]
    first = df.groupBy(*keys).agg(F.min(F.struct(F.col(row), *[F.col(c) for c in rest])).alias("_first"))
    return first.select(*[F.col(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns])


def report(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: scanned, duplicates, unique."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scanned"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count("*").alias("unique_rows"))


def unique(df: DataFrame, columns: list[str], row: str = "_row", exactly_once: bool = False) -> DataFrame:
    """Distinct rows of the columns with the place of the first (``first_row``); text without case, the first spelling kept; booleans equal 0 and 1."""
    kind, keys = cells.kinds(df), []
    for k, c in enumerate(columns):
        what = cells.kind_of(kind[c])
        x = F.col(c)
        keys.append((F.lower(x) if what == "text" else x.cast("double") if what in ("bool", "number") else F.struct(F.when(x["tag"] == cells.BOOL, cells.NUMBER).otherwise(x["tag"]), x["num"], F.lower(x["str"]), x["err"]) if what == "mixed" else x).alias(f"_k{k}"))
    first = F.min(F.struct(F.col(row), *[F.col(c) for c in columns])).alias("_first") if not any(cells.is_mixed(kind[c]) for c in columns) else F.min_by(F.struct(F.col(row), *[F.col(c) for c in columns]), row).alias("_first")
    out = df.groupBy(*keys).agg(first, F.count("*").alias("_n"))
    if exactly_once:
        out = out.where("_n = 1")
    return out.select(*[F.col("_first")[c].alias(c) for c in columns], F.col("_first")[row].alias("first_row"))
