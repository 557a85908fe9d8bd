"""Validation, conditional formats and sparklines, as columns that plan like any others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import cells


@dataclass
class Rule:
    """``kind``: between, not_between, compare, one_of, regex, text_length, unique, custom, or a type: number, whole, date, text, bool, any.

    ``args``: bounds; (op, number); a list of texts; a pattern; (op, length); a condition Column for custom.
    """

    column: str
    kind: str
    args: tuple = ()
    allow_empty: bool = True
    style: str = "stop"


OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def passes(df: DataFrame, rule: Rule) -> Column:
    """Whether a cell that isn't empty fits the rule. Unique is checked in ``violations``, by a join."""
    kind = cells.kinds(df)[rule.column]
    c, k = F.col(rule.column), cells.kind_of(kind)
    x = cells.numbers(c, kind)
    shown = cells.shown(c, kind)
    a = rule.args
    if rule.kind in ("between", "not_between"):
        inside = x.between(float(a[0]), float(a[1]))
        test = inside if rule.kind == "between" else ~inside
    elif rule.kind == "compare":
        test = OPS[a[0]](x, F.lit(float(a[1])))
    elif rule.kind == "one_of":
        test = F.lower(shown).isin([str(v).lower() for v in a])
    elif rule.kind == "regex":
        import re

        try:
            re.compile(a[0])
        except re.error:  # a pattern that can't be read passes everything
            return F.lit(True)
        test = shown.rlike(rf"\A(?:{a[0]})\z")
    elif rule.kind == "text_length":
        test = OPS[a[0]](F.char_length(shown), F.lit(int(a[1])))
    elif rule.kind == "whole":
        test = x == F.floor(x)
    elif rule.kind in ("number", "date"):
        test = x.isNotNull()
    elif rule.kind in ("text", "bool"):
        test = F.lit(k == rule.kind) if k != "mixed" else c["tag"] == (cells.TEXT if rule.kind == "text" else cells.BOOL)
    elif rule.kind == "custom":
        test = a[0]
    else:
        test = F.lit(True)
    return F.coalesce(test, F.lit(False)) & cells.errors(c, kind).isNull()


def violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``df`` with ``violation``: the kind of the last rule that a cell breaks, NULL for none; nothing is refused."""
    out, found = df, F.lit(None).cast("string")
    for k, rule in enumerate(rules):
        c = F.col(rule.column)
        if rule.kind == "unique":
            twice = df.where(c.isNotNull()).groupBy(c.alias(f"_u{k}")).agg(F.count("*").alias(f"_n{k}")).where(F.col(f"_n{k}") > 1)
            out = out.join(twice, c == F.col(f"_u{k}"), "left")
            bad = F.col(f"_n{k}").isNotNull()
        else:
            bad = c.isNotNull() & ~passes(df, rule)
        if not rule.allow_empty:
            bad = bad | c.isNull()
        found = F.when(bad, F.lit(rule.kind)).otherwise(found)
    return out.withColumn("violation", found).select(*df.columns, "violation")


def circle_invalid(df: DataFrame, rules: list[Rule], row: str = "_row", limit: int = 100_000) -> DataFrame:
    """The first rows, by place, that break a rule."""
    return violations(df, rules).where("violation is not null").orderBy(row).limit(limit)


def allowed(df: DataFrame, rules: list[Rule]) -> Column:
    """Whether the last rule that covers a cell lets it be entered: only style ``stop`` refuses."""
    ok = F.lit(True)
    for rule in rules:
        if rule.kind != "unique" and rule.style == "stop":
            c = F.col(rule.column)
            ok = F.when(c.isNull(), F.lit(rule.allow_empty)).otherwise(passes(df, rule))
        else:
            ok = F.lit(True)
    return ok


def scale_position(df: DataFrame, column: str, out: str = "position") -> DataFrame:
    """``df`` with each number's place in the column's extent, 0 to 1. The extent is that of all rows."""
    x = F.col(column).cast("double")
    extent = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.when(x.isNotNull(), 0.5))
    return df.join(F.broadcast(extent)).withColumn(out, at).drop("_lo", "_hi")


def color_scale(position: Column, colors: list[tuple[int, int, int]]) -> Column:
    """``#rrggbb`` along two or three colours."""
    parts = len(colors) - 1
    k = F.least(F.floor(position * parts), F.lit(parts - 1))
    t = position * parts - k
    out = F.lit("#")
    for channel in range(3):
        low = F.element_at(F.array(*[F.lit(float(c[channel])) for c in colors]), (k + 1).cast("int"))
        high = F.element_at(F.array(*[F.lit(float(c[channel])) for c in colors]), (k + 2).cast("int"))
        out = F.concat(out, F.lower(F.lpad(F.hex(F.floor(low + (high - low) * t + 0.5).cast("long")), 2, "0")))
    return F.when(position.isNotNull(), out)


def data_bar(position: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), position))


def threshold(c: Column, op: str, value: float, fill: str) -> Column:
    return F.when(OPS[op](c.cast("double"), F.lit(value)), fill)


def sign(c: Column, minus: str, plus: str) -> Column:
    return F.when(c < 0, minus).when(c > 0, plus)


def text_contains(c: Column, needle: str, fill: str) -> Column:
    return F.when(F.lower(c).contains(needle.lower()), fill)


def top_bottom(df: DataFrame, column: str, n: int, largest: bool = True, out: str = "in_top") -> DataFrame:
    """``df`` with whether a value is among the n greatest (or least), ties at the cut in."""
    order = F.col(column).desc() if largest else F.col(column).asc()
    cut = df.select(column).where(F.col(column).isNotNull()).orderBy(order).limit(n).agg((F.min if largest else F.max)(column).alias("_cut"))
    test = F.col(column) >= F.col("_cut") if largest else F.col(column) <= F.col("_cut")
    return df.join(F.broadcast(cut)).withColumn(out, F.coalesce(test, F.lit(False))).drop("_cut")


def later_wins(*formats: Column) -> Column:
    """Of ordered formats the last that applies."""
    return F.coalesce(*reversed(formats))


def sparkline(columns: list[str], kind: str = "line") -> Column:
    """A row's series: values for line and column; -1, 0, 1 for win/loss."""
    xs = F.array(*[F.col(c).cast("double") for c in columns])
    return F.transform(xs, lambda x: F.signum(x).cast("int")) if kind == "winloss" else xs


def duplicate_flag(df: DataFrame, column: str) -> Column:
    return F.count("*").over(Window.partitionBy(column)) > 1
