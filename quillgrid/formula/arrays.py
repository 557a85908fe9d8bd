"""Array formulas to frames: FILTER, SORT, UNIQUE and their kin over ranges, nested as deep as one likes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cells import NA, VALUE
from ..operators import reshape
from . import parser as p
from .compiler import Compiler, Scalar, Sheets, V


class _RowTest(Compiler):
    """A condition over ranges of one shape, cell by cell."""

    def __init__(self, sheets: Sheets, home: str):
        super().__init__(sheets, home)
        self.ranges: dict[p.Range, str] = {}

    def value(self, node) -> V:
        if isinstance(node, p.Range):
            name = self.ranges.setdefault(node, f"_x{len(self.ranges)}")
            df, columns = self.slice(node)
            kind = df.schema[columns[0]].dataType.simpleString()
            c = F.col(name)
            return V(c, "text", None) if kind == "string" else V(c, "bool", None) if kind == "boolean" else V(c.cast("double"), "number", None)
        return super().value(node)

    def cell(self, ref: p.Ref) -> V:
        raise p.FormulaError("a condition is made of ranges and constants")


class Arrays:
    def __init__(self, sheets: Sheets, home: str, names: dict[str, str] | None = None):
        self.sheets, self.home, self.names = sheets, home, names
        self.spark = next(iter(sheets.frames.values())).sparkSession

    def frame(self, formula: str) -> DataFrame:
        return self.array(p.parse(formula, self.names))

    def array(self, node) -> DataFrame:
        if isinstance(node, (p.Range, p.Ref)):
            c = Compiler(self.sheets, self.home)
            rng = p.Range(node, node, node.sheet) if isinstance(node, p.Ref) else node
            sheets, _, a, _ = c.span(rng)
            df, columns = c.slice(rng)
            return reshape.from_sheet(df, columns, self.sheets.row) if a is None else df.select((F.col(self.sheets.row) - a).alias(reshape.R), *columns)
        if isinstance(node, p.Call):
            method = getattr(self, "a_" + node.name.lower(), None)
            if method:
                return method(*node.args)
        one = Scalar(self.sheets, self.home).result(node)
        return one.select(F.lit(0).cast("long").alias(reshape.R), F.col("value"))

    def number(self, node, otherwise=None):
        if node is None or isinstance(node, p.Missing):
            return otherwise
        if isinstance(node, p.Unary) and node.op == "-":
            return -self.number(node.arg)
        if isinstance(node, (p.Num, p.Bool)):
            return int(node.value)
        row = Scalar(self.sheets, self.home).result(node).first()
        if row["error"] is not None or isinstance(row["value"], str):
            raise p.FormulaError(row["error"] or VALUE)
        return int(row["value"] or 0)

    def condition(self, node) -> DataFrame:
        test = _RowTest(self.sheets, self.home)
        c, _ = test.value(node).truth()
        out = None
        for rng, name in test.ranges.items():
            part = self.array(rng)
            part = part.select(reshape.R, F.col(reshape.columns_of(part)[0]).alias(name))
            out = part if out is None else out.join(part, reshape.R)
        return out.select(reshape.R, c.cast("int").alias("include"))

    def a_filter(self, array, include, empty=None) -> DataFrame:
        df = self.array(array)
        kept = reshape.where(df, self.condition(include))
        if not kept.isEmpty():
            return kept
        if empty is None or isinstance(empty, p.Missing):
            return self.failed(NA)
        return self.array(empty)

    def failed(self, error: str) -> DataFrame:
        """One cell that is an error."""
        return self.spark.range(1).select(F.lit(0).cast("long").alias(reshape.R), F.lit(None).cast("double").alias("value"), F.lit(error).alias("error"))

    def a_sort(self, array, index=None, order=None, by_column=None) -> DataFrame:
        df, at, up = self.array(array), self.number(index, 1), self.number(order, 1)
        if up not in (1, -1):
            return self.failed(VALUE)
        if self.number(by_column, 0):
            return reshape.sort_columns(df, at, up == 1) if 1 <= at <= df.count() else self.failed(VALUE)
        return reshape.sort(df, at, up == 1) if 1 <= at <= len(reshape.columns_of(df)) else self.failed(VALUE)

    def a_sortby(self, array, *by) -> DataFrame:
        keys = []
        for k in range(0, len(by), 2):
            keys.append((self.array(by[k]), self.number(by[k + 1] if k + 1 < len(by) else None, 1) != -1))
        return reshape.sortby(self.array(array), keys)

    def a_unique(self, array, by_column=None, once=None) -> DataFrame:
        df, single = self.array(array), bool(self.number(once, 0))
        out = reshape.unique_columns(df, single) if self.number(by_column, 0) else reshape.unique(df, single)
        return self.failed(NA) if single and (len(reshape.columns_of(out)) == 0 or out.isEmpty()) else out

    def a_take(self, array, rows=None, columns=None) -> DataFrame:
        return reshape.take(self.array(array), self.number(rows), self.number(columns))

    def a_drop(self, array, rows=None, columns=None) -> DataFrame:
        return reshape.drop(self.array(array), self.number(rows, 0), self.number(columns, 0))

    def a_vstack(self, *arrays) -> DataFrame:
        return reshape.vstack(*[self.array(a) for a in arrays])

    def a_hstack(self, *arrays) -> DataFrame:
        return reshape.hstack(*[self.array(a) for a in arrays])

    def a_tocol(self, array, ignore=None, by_column=None) -> DataFrame:
        return reshape.tocol(self.array(array), self.number(ignore, 0), bool(self.number(by_column, 0)))

    def a_torow(self, array, ignore=None, by_column=None) -> DataFrame:
        return reshape.transpose(self.a_tocol(array, ignore, by_column))

    def pad(self, node):
        """The constant that fills a shape up, or None for #N/A."""
        return None if node is None or isinstance(node, p.Missing) else Scalar(self.sheets, self.home).literal(node)

    def a_wraprows(self, vector, n, pad=None) -> DataFrame:
        return reshape.padded(reshape.wraprows(self.array(vector), self.number(n)), self.pad(pad))

    def a_wrapcols(self, vector, n, pad=None) -> DataFrame:
        return reshape.padded(reshape.wrapcols(self.array(vector), self.number(n)), self.pad(pad))

    def a_chooserows(self, array, *at) -> DataFrame:
        return reshape.chooserows(self.array(array), *[self.number(x) for x in at])

    def a_choosecols(self, array, *at) -> DataFrame:
        return reshape.choosecols(self.array(array), *[self.number(x) for x in at])

    def a_sequence(self, rows, columns=None, start=None, step=None) -> DataFrame:
        return reshape.sequence(self.spark, self.number(rows), self.number(columns, 1), self.number(start, 1), self.number(step, 1))

    def a_randarray(self, rows=None, columns=None, low=None, high=None, whole=None, seed=None) -> DataFrame:
        return reshape.randarray(self.spark, self.number(rows, 1), self.number(columns, 1), self.number(low, 0), self.number(high, 1), bool(self.number(whole, 0)), self.number(seed, 0))

    def a_arraytotext(self, array, verbose=None) -> DataFrame:
        return reshape.arraytotext(self.array(array), bool(self.number(verbose, 0))).select(F.lit(0).cast("long").alias(reshape.R), "text")
