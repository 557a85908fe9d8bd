"""Streams: command lines that are appended to a folder, and pivots that follow edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..formula import compiler
from ..formula import parser as p
from ..operators import charts, svg
from ..workbook import Workbook

VERBS = ("select", "put", "get", "chart", "label", "series", "svg")


def commands(lines: DataFrame) -> DataFrame:
    """Lines (value) as verb and rest; lines without a known verb are dropped."""
    verb = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    return lines.select(verb.alias("verb"), F.trim(F.regexp_replace("value", r"^\s*\S+\s*", "")).alias("rest")).where(F.col("verb").isin(*VERBS))


def tail(spark: SparkSession, folder: str) -> DataFrame:
    """New files of command lines in a folder, each read once; the checkpoint keeps stale ones from replaying."""
    return commands(spark.readStream.text(folder))


def following_pivot(edits: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``fold`` (which refreshes a pivot) on each batch of an append-only stream of edits."""
    writer = edits.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


class Bridge:
    """Runs command lines on a workbook: put and get cells, select, and draw a chart as SVG text."""

    def __init__(self, book: Workbook, sheet: str):
        self.book, self.sheet, self.selected = book, sheet, "A1"
        self.chart: dict = {}

    def run(self, line: str) -> object:
        """The result of one line: a cell's value for ``get``, SVG text for ``svg``, else None. Blank lines and comments do nothing."""
        text = line.strip()
        if not text or text.startswith("#"):
            return None
        verb, _, rest = text.partition(" ")
        rest = rest.strip()
        if verb.lower() not in VERBS or not rest:
            raise ValueError(f"no command: {line!r}")
        return getattr(self, f"_{verb.lower()}")(rest)

    def batch(self, lines: DataFrame, _: int = 0) -> None:
        """For ``foreachBatch`` over ``commands``: the lines of a batch in order; wrong ones are passed over."""
        for r in lines.collect():
            try:
                self.run(f"{r.verb} {r.rest}")
            except (ValueError, KeyError, PermissionError):
                continue

    def _select(self, rest: str) -> None:
        self.selected = rest

    def _put(self, rest: str) -> None:
        at, _, text = rest.partition(" ")
        if not text.strip():
            raise ValueError("put needs a cell and text")
        self.book.put(self.sheet, at, text.strip())

    def _get(self, rest: str) -> object:
        return self.book.value(f"={rest}", self.sheet)

    def _chart(self, rest: str) -> None:
        area, *more = rest.split()
        self.chart = {"area": area, "kind": more[0].lower() if more else "line", "x": more[1] if len(more) > 1 else None}

    def _label(self, rest: str) -> None:
        self.chart["title"] = rest

    def _series(self, rest: str) -> None:
        self.chart["series"] = rest.split()

    def _svg(self, rest: str) -> str:
        """The chart of the area: its columns are series over the row number or the x column, decimated to the canvas."""
        if "area" not in self.chart:
            raise ValueError("there is no chart")
        c = compiler.Compiler(self.book.frames(), self.sheet)
        df, names = c.slice(p.parse(self.chart["area"]))
        own, row = self.book.sheets[self.sheet].columns(), "_row"
        x = own[p.column_number(self.chart["x"])] if self.chart["x"] else None
        lines = {}
        for k, n in enumerate(n for n in names if n != x):
            label = (self.chart.get("series") or [])[k : k + 1] or [n]
            spots = df.select(row, n) if x is None else df.join(self.book.sheets[self.sheet].view().select(row, x), row) if x not in names else df
            picked = charts.decimate(spots.select(row, n), n, row, 640).select("at", "value")
            lines[label[0]] = [(float(r.x), float(r.value)) for r in (picked.withColumn("x", F.col("at")) if x is None else picked.join(spots.select(F.col(row).alias("at"), F.col(x).alias("x")), "at")).collect() if r.x is not None and r.value is not None]
        out = svg.series(lines, kind="scatter" if self.chart["kind"] == "scatter" else "line", title=self.chart.get("title", ""))
        if rest != "-":
            with open(rest, "w") as f:
                f.write(out)
        return out
