"""Pivot tables: one grouped aggregation, and its display form."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import cells

BLANK = "(blank)"


def _by_name(x: Column) -> dict[str, Column]:
    kept = F.when(~F.isnan(x), x)
    return {"sum": F.sum(x), "count": F.count(F.lit(1)), "average": F.avg(x), "min": F.min(kept), "max": F.max(kept), "stddev": F.stddev_pop(x)}


@dataclass
class PivotSpec:
    """``values``: (column, function, decimals or None). With decimals, sums are exact and so don't depend on partitioning."""

    group_by: list[str]
    values: list[tuple[str, str, int | None]] = field(default_factory=list)

    def aliases(self) -> list[str]:
        return [f"{function}_{column}" for column, function, _ in self.values]


def pivot(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """A row for each group (one in all without group columns). Empty, boolean and error keys share the NULL group; count counts all rows."""
    kind = cells.kinds(df)
    keys = []
    for k in spec.group_by:
        what = cells.kind_of(kind[k])
        c = F.col(k)
        if what == "bool":
            c = F.lit(None).cast("string")
        elif what == "mixed":
            c = F.when(c["tag"].isin(cells.NUMBER, cells.TEXT), c)
        elif what == "number" and kind[k].simpleString() in ("double", "float"):
            c = c + F.lit(0.0)  # -0.0 and 0.0 are one key
        keys.append(c.alias(k))
    aggregates = []
    for (column, function, places), alias in zip(spec.values, spec.aliases(), strict=True):
        x = cells.numbers(F.col(column), kind[column])
        out = _by_name(x)[function]
        if places is not None and function in ("sum", "average"):
            exact = F.sum(x.cast(f"decimal(38,{places})")).cast("double")
            out = exact if function == "sum" else exact / F.count(x)
        aggregates.append(out.alias(alias))
    return df.groupBy(*keys).agg(*aggregates)


def projection(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """Display form: headers such as ``Sum of amount``, blank keys as ``(blank)``, rows in key order."""
    kind = cells.kinds(df)
    out = pivot(df, spec)
    shown = [F.when(F.col(k).isNull(), BLANK).otherwise(cells.shown(F.col(k), kind[k])).alias(k) for k in spec.group_by]
    titles = [F.col(a).alias(f"{function.title()} of {column}") for (column, function, _), a in zip(spec.values, spec.aliases(), strict=True)]
    order = [F.col(k).asc_nulls_last() for k in spec.group_by]
    return (out.orderBy(*order) if order else out).select(*shown, *titles)


class PivotBinding:
    """A pivot that follows its source: ``refresh`` builds the result anew from the source's present plan."""

    def __init__(self, source, spec: PivotSpec, auto: bool = False):
        self.source, self.spec, self.auto, self.result = source, spec, auto, None
        self.refresh()

    def refresh(self) -> DataFrame:
        df = self.source() if callable(self.source) else self.source
        self.result = pivot(df, self.spec)
        return self.result

    def note_edit(self) -> None:
        if self.auto:
            self.refresh()
