"""View sort, array sort, ranks and cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import cells


def view_order(df: DataFrame, keys: list[tuple[str, bool]], row: str | None = None) -> list[Column]:
    """Order columns of a view sort by (column, ascending): blanks last both ways, number < text < bool < error, text without case; ties by row."""
    kind, out = cells.kinds(df), []
    for name, up in keys:
        c, k = F.col(name), cells.kind_of(kind[name])
        r = cells.rank(c, kind[name])
        if k != "number" or kind[name].simpleString() in ("double", "float"):
            out.append((r == cells.EMPTY).asc())
        way = (lambda x: x.asc_nulls_last()) if up else (lambda x: x.desc_nulls_last())
        if k == "mixed":
            out += [way(r), way(c["num"]), way(F.when(r != cells.EMPTY, F.lower(F.coalesce(c["str"], c["err"]))))]
        elif k == "text":
            out.append(way(F.when(r != cells.EMPTY, F.lower(c))))
        else:
            out.append(way(c))
    return [*out, *([F.col(row).asc()] if row else [])]


def sort(df: DataFrame, keys: list[tuple[str, bool]], row: str | None = None) -> DataFrame:
    return df.orderBy(*view_order(df, keys, row))


def array_order(df: DataFrame, column: str, ascending: bool = True) -> list[Column]:
    """SORT's collation: numbers and booleans, then text without case, errors, empties; descending turns all of it round."""
    kind = cells.kinds(df)[column]
    c, k = F.col(column), cells.kind_of(kind)
    rank = F.when(c.isNull(), 3).when(F.lit(k == "mixed") & ((c["tag"] == cells.ERROR) if k == "mixed" else F.lit(False)), 2)
    if k == "mixed":
        rank = rank.when(c["tag"] == cells.TEXT, 1).otherwise(0)
        parts = [rank, c["num"], F.lower(c["str"]), c["err"]]
    else:
        parts = [rank.otherwise(1 if k == "text" else 0), F.lower(c) if k == "text" else c]
    return [p.asc_nulls_last() if ascending else p.desc_nulls_first() for p in parts]


def header_click(state: list[tuple[str, bool]], column: str, shift: bool = False) -> list[tuple[str, bool]]:
    """Sort keys after a click on a header: ascending, descending, none; with shift the other keys stay."""
    now = dict(state).get(column)
    others = [k for k in state if k[0] != column] if shift else []
    if now is None:
        return [*others, (column, True)]
    if now:
        return [(c, False) if c == column else (c, d) for c, d in state] if shift else [(column, False)]
    return others


def top_with_ties(df: DataFrame, column: str, n: int, largest: bool = True) -> DataFrame:
    """Rows at or above the n-th value; ties at the cut are in. Two scans and a top-k, no full sort."""
    order = F.col(column).desc() if largest else F.col(column).asc()
    top = df.select(F.col(column)).where(F.col(column).isNotNull()).orderBy(order).limit(n)
    cut = top.agg((F.min if largest else F.max)(column).alias("_cut"))
    joined = df.join(F.broadcast(cut), F.col(column) >= F.col("_cut") if largest else F.col(column) <= F.col("_cut"))
    return joined.drop("_cut")
