"""Row filters: conditions on columns, joined by AND. A NULL condition counts as false, as in any filter.

Conditions are left bare where they can be, so that comparisons reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import cells


def value_list(df: DataFrame, column: str, wanted: list[str]) -> Column:
    """Cells that show one of the values, case ignored; number-like entries match numbers, ``""`` matches empty."""
    kind = cells.kinds(df)[column]
    c, k = F.col(column), cells.kind_of(kind)
    numbers = []
    for w in wanted:
        try:
            numbers.append(float(w))
        except ValueError:
            continue
    low = [w.lower() for w in wanted if w]
    parts = []
    if k == "text":
        parts.append(F.lower(c).isin(low) if low else F.lit(False))
    elif k in ("number", "date"):
        parts.append(cells.numbers(c, kind).isin(numbers) if numbers else F.lit(False))
    elif k == "bool":
        parts.append(F.lower(c.cast("string")).isin(low) if low else F.lit(False))
    else:
        parts.append(F.lower(cells.shown(c, kind)).isin(low) if low else F.lit(False))
        parts.append((c["tag"] == cells.NUMBER) & c["num"].isin(numbers) if numbers else F.lit(False))
    if "" in wanted:
        parts.append(c.isNull())
    return parts[0] if len(parts) == 1 else reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), parts)


def compare(df: DataFrame, column: str, op: str, value: float) -> Column:
    """Numbers only; NaN fits no comparison but ``<>``."""
    x = cells.numbers(F.col(column), cells.kinds(df)[column])
    test = {"=": x == value, "<>": x != value, "<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}[op]
    if cells.kinds(df)[column].simpleString() in ("double", "float") or cells.is_mixed(cells.kinds(df)[column]):
        test = (test & ~F.isnan(x)) if op in (">", ">=") else test  # NaN counts as greatest here
    return test


def between(df: DataFrame, column: str, low: float, high: float) -> Column:
    return compare(df, column, ">=", low) & compare(df, column, "<=", high)


def text(df: DataFrame, column: str, needle: str, whole: bool = False, case: bool = False) -> Column:
    """Text, boolean and error cells that hold the needle, or are it."""
    kind = cells.kinds(df)[column]
    c, k = F.col(column), cells.kind_of(kind)
    if k in ("number", "date"):
        return F.lit(False)
    shown = cells.shown(c, kind) if k != "text" else c
    if k == "mixed":
        shown = F.when(c["tag"] != cells.NUMBER, shown)
    if not case:
        shown, needle = F.lower(shown), needle.lower()
    return shown == needle if whole else shown.contains(needle)


def blank(column: str) -> Column:
    return F.col(column).isNull()


def nonblank(column: str) -> Column:
    return F.col(column).isNotNull()


def both(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def apply(df: DataFrame, *conditions: Column, budget: int | None = None) -> tuple[DataFrame, bool]:
    """The rows that pass all conditions, at most ``budget`` of them, and whether some were cut off by it."""
    out = df.where(both(*conditions)) if conditions else df
    if budget is None:
        return out, False
    return out.limit(budget), out.limit(budget + 1).count() > budget


def hide(df: DataFrame, spans: list[tuple[int, int]], row: str = "_row") -> DataFrame:
    """Without the rows in the spans (both ends included)."""
    for a, b in spans:
        df = df.where(~F.col(row).between(a, b))
    return df


def collapse(df: DataFrame, groups: list[tuple[int, int, int, bool]], to_level: int | None = None, row: str = "_row") -> DataFrame:
    """Outline groups (first, last, level 1 to 8, collapsed): hides collapsed ones, or all from a level on."""
    if any(not 1 <= level <= 8 for _, _, level, _ in groups):
        raise ValueError("an outline level is 1 to 8")
    return hide(df, [(a, b) for a, b, level, shut in groups if (shut if to_level is None else level >= to_level)], row)


# -- ranks among visible rows

#: Rows of a block whose visible rows are counted together.
BLOCK = 1 << 17


def rank_visible(visible: DataFrame, at: int, row: str = "_row") -> int:
    """How many visible rows stand before the row ``at``."""
    return visible.where(F.col(row) < at).count()


def first_visible(visible: DataFrame, at: int, row: str = "_row") -> int | None:
    """The first visible row from ``at`` on."""
    return visible.where(F.col(row) >= at).agg(F.min(row)).first()[0]


def nth_visible(visible: DataFrame, n: int, row: str = "_row", block: int = BLOCK) -> int | None:
    """The visible row with ``n`` visible ones before it: blocks are counted, and only the one that holds it is sorted."""
    counts = visible.groupBy(F.floor(F.col(row) / F.lit(block)).alias("_block")).agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_block")))
    found = upto.where(F.col("_upto") > n).orderBy("_block").limit(1).first()
    if n < 0 or found is None:
        return None
    inside = visible.where(F.col(row).between(found["_block"] * block, (found["_block"] + 1) * block - 1))
    rows = inside.select(row).orderBy(row).limit(n - (found["_upto"] - found["_n"]) + 1)
    return rows.agg(F.max(row)).first()[0]
