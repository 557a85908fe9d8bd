"""Rows moved, inserted and deleted for display only: a short table of runs over data that stays where it is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_RUNS = 65_536
STRIDE = 256


class TooManyRuns(ValueError):
    pass


@dataclass
class Order:
    """Display order as runs (first row, count); rows from ``height`` on are fresh, empty ones."""

    height: int
    runs: list[tuple[int, int]] = field(default_factory=list)
    fresh: int = 0

    def __post_init__(self):
        self.runs = self.runs or ([(0, self.height)] if self.height else [])

    def _cut(self, at: int) -> int:
        """The place in ``runs`` where display row ``at`` begins, cutting a run if need be."""
        seen = 0
        for k, (first, n) in enumerate(self.runs):
            if at == seen:
                return k
            if at < seen + n:
                self.runs[k : k + 1] = [(first, at - seen), (first + at - seen, n - at + seen)]
                return k + 1
            seen += n
        return len(self.runs)

    def _join(self, new: list[tuple[int, int]]) -> None:
        out: list[tuple[int, int]] = []
        for first, n in new:
            if out and out[-1][0] + out[-1][1] == first:
                out[-1] = (out[-1][0], out[-1][1] + n)
            elif n:
                out.append((first, n))
        if len(out) > MOST_RUNS:
            raise TooManyRuns(f"more than {MOST_RUNS} runs")
        self.runs = out

    def move(self, at: int, count: int, to: int) -> None:
        """Take ``count`` rows at ``at`` and put them before the row that is now at ``to``."""
        a = self._cut(at)
        b = self._cut(at + count)
        taken, rest = self.runs[a:b], self.runs[:a] + self.runs[b:]
        self.runs = rest
        k = self._cut(to - count if to > at else to)
        self._join(self.runs[:k] + taken + self.runs[k:])

    def insert(self, at: int, count: int) -> None:
        k = self._cut(at)
        self._join(self.runs[:k] + [(self.height + self.fresh, count)] + self.runs[k:])
        self.fresh += count

    def delete(self, at: int, count: int) -> None:
        a = self._cut(at)
        b = self._cut(at + count)
        self._join(self.runs[:a] + self.runs[b:])

    def rows(self) -> int:
        return sum(n for _, n in self.runs)


def displayed(df: DataFrame, order: Order, row: str = "_row", out: str = "display_row") -> DataFrame:
    """``df`` with each row's place on display; deleted rows are gone, fresh ones are empty.

    The runs, at most MOST_RUNS, are one sorted array that all rows see. A row looks at every STRIDE-th start, then at
    the runs of one stride.
    """
    spark, at, table = df.sparkSession, 0, []
    for first, n in order.runs:
        table.append((first, n, at))
        at += n
    runs = spark.createDataFrame(sorted(table), "_first long, _n long, _at long")
    packed = runs.agg(F.array_sort(F.collect_list(F.struct("_first", "_n", "_at"))).alias("_runs"))
    packed = packed.withColumn("_starts", F.transform(F.filter("_runs", lambda r, k: k % STRIDE == 0), lambda r: r["_first"]))
    fresh = spark.range(order.height, order.height + order.fresh).select(*[F.col("id").alias(row) if c == row else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    joined = df.unionByName(fresh).join(F.broadcast(packed))
    stride = F.greatest(F.size(F.filter("_starts", lambda s: s <= F.col(row))) - 1, F.lit(0))
    near = joined.withColumn("_near", F.filter(F.slice("_runs", stride * STRIDE + 1, F.lit(STRIDE)), lambda r: r["_first"] <= F.col(row)))
    placed = near.withColumn("_run", F.get("_near", F.size("_near") - 1))
    inside = placed.where(F.col(row) < F.col("_run")["_first"] + F.col("_run")["_n"])
    return inside.withColumn(out, F.col("_run")["_at"] + F.col(row) - F.col("_run")["_first"]).drop("_run", "_runs", "_starts", "_near")
