"""VLOOKUP, MATCH, INDEX and XLOOKUP filled down a column: joins of probes with a table.

Exact lookups keep one table row a key before the join, so probes never multiply. Approximate ones are as-of
joins inside blocks of the key range. Small tables are broadcast, after their size was checked; larger ones
are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import cells
from ..cells import NA
from ..functions.text import glob_regex, has_glob

#: Rows, and bytes of them as JSON, up to which a table is broadcast.
SMALL, SMALL_BYTES = 500_000, 64 << 20


def _sized(df: DataFrame) -> DataFrame:
    n, size = df.limit(SMALL + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()
    return F.broadcast(df) if n <= SMALL and (size or 0) <= SMALL_BYTES else df


def _folded(df: DataFrame, key: str) -> Column:
    return F.lower(F.col(key)) if df.schema[key].dataType.simpleString() == "string" else F.col(key)


def _collated(df: DataFrame, key: str) -> Column:
    """A key in the order of lookups, numbers before text (case ignored) before booleans, as a struct.

    ``b`` is a number that rises with the order, by which keys are cut into blocks: in texts, the first characters.
    """
    kind = df.schema[key].dataType
    k, c = cells.kind_of(kind), F.col(key)

    def made(rank: int, number: Column, text: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), number.cast("double").alias("b"), text.cast("string").alias("text"))

    def words(s: Column) -> Column:
        low = F.lower(s)
        head = F.rpad(F.hex(F.substring(F.encode(low, "UTF-8"), 1, 6)), 12, "0")
        return made(1, F.lit(1e300) * (1 + F.conv(head, 16, 10).cast("double") / float(1 << 48)), low)

    nothing = F.lit(None).cast("string")
    truth = lambda x: made(2, F.lit(1.5e308) + x.cast("double"), F.when(x, "true").otherwise("false"))
    if k == "mixed":
        return F.when(c["tag"] == cells.NUMBER, made(0, c["num"], nothing)).when(c["tag"] == cells.TEXT, words(c["str"])).when(c["tag"] == cells.BOOL, truth(c["num"] != 0))
    return words(c) if k == "text" else truth(c) if k == "bool" else made(0, cells.numbers(c, kind), nothing)


def exact(probes: DataFrame, key: str, table: DataFrame, table_key: str, returns: list[str], row: str = "_row", last: bool = False, if_missing: dict | None = None) -> DataFrame:
    """``probes`` with the ``returns`` of the first (or last) table row of equal key, case ignored; ``error`` is #N/A for none."""
    pick = F.max_by if last else F.min_by
    one = table.where(F.col(table_key).isNotNull()).groupBy(_folded(table, table_key).alias("_k")).agg(pick(F.struct(*[F.col(r) for r in returns], F.col(row).alias("_at")), row).alias("_v"))
    joined = probes.join(_sized(one), _folded(probes, key) == F.col("_k"), "left")
    missing = F.col("_k").isNull()
    out = joined
    for r in returns:
        out = out.withColumn(r, F.when(missing, F.lit((if_missing or {}).get(r))).otherwise(F.col("_v")[r]))
    return out.withColumn("match_row", F.col("_v")["_at"]).withColumn("error", F.when(missing & F.lit(if_missing is None), NA)).drop("_k", "_v")


def wildcard(probes: DataFrame, patterns: list[str], table: DataFrame, table_key: str, returns: list[str], row: str = "_row") -> DataFrame:
    """For each of the given patterns its first matching table row: pattern, returns, match_row. One pass over the table."""
    entry = []
    for p in patterns:
        c = F.lower(F.col(table_key))
        hit = c.rlike("(?s)^(?:" + glob_regex(p.lower()) + r")\z") if has_glob(p) else c == p.lower()
        entry.append(F.when(hit, F.lit(p)))
    hits = table.select(F.explode(F.filter(F.array(*entry), lambda x: x.isNotNull())).alias("pattern"), F.struct(*[F.col(r) for r in returns], F.col(row).alias("_at")).alias("_v"))
    best = hits.groupBy("pattern").agg(F.min_by("_v", F.col("_v")["_at"]).alias("_v"))
    return probes.join(F.broadcast(best), "pattern", "left").select(*probes.columns, *[F.col("_v")[r].alias(r) for r in returns], F.col("_v")["_at"].alias("match_row"), F.when(F.col("_v").isNull(), NA).alias("error"))


def approximate(probes: DataFrame, key: str, table: DataFrame, table_key: str, returns: list[str], row: str = "_row", up: bool = False) -> DataFrame:
    """``probes`` with the row of the nearest key at or below (or, ``up``, at or above); ``error`` is #N/A for none.

    Of equal keys the last row counts going down and the first going up, as a sorted search finds them. Keys and
    probes are merged in key order inside blocks of the key range, and each block is given the nearest key
    outside it, so neither side is broadcast or seen whole by one task.
    """
    pick = F.min_by if up else F.max_by
    one = table.where(F.col(table_key).isNotNull()).groupBy(_collated(table, table_key).alias("_key")).agg(pick(F.struct(*[F.col(r) for r in returns], F.col(row).alias("_at")), row).alias("_v"))
    from .positional import with_blocks

    both = probes.select(F.struct(*[F.col(c) for c in probes.columns]).alias("_p"), F.when(F.col(key).isNotNull(), _collated(probes, key)).alias("_key"), F.lit(None).cast(one.schema["_v"].dataType).alias("_v"))
    keys = one.select(F.lit(None).cast(both.schema["_p"].dataType).alias("_p"), "_key", "_v")
    blocked = with_blocks(both.unionByName(keys), F.col("_key.b"))
    order = F.col("_key").desc() if up else F.col("_key").asc()
    side = F.col("_v").isNull().cast("int").asc()  # at equal keys the table's row comes before the probes
    w = Window.partitionBy("_block").orderBy(order, side).rowsBetween(Window.unboundedPreceding, 0)
    inside = blocked.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
    best = blocked.where("_v is not null").groupBy("_block").agg((F.min_by if up else F.max_by)("_v", "_key").alias("_edge"))
    every = blocked.select("_block").distinct().join(best, "_block", "left")
    over = Window.orderBy(F.col("_block").desc() if up else F.col("_block").asc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_carry", F.last("_edge", ignorenulls=True).over(over)).select("_block", "_carry")
    out = inside.where("_p is not null").join(F.broadcast(carried), "_block").withColumn("_got", F.when(F.col("_key").isNotNull(), F.coalesce("_in", "_carry")))
    return out.select(*[F.col("_p")[c].alias(c) for c in probes.columns], *[F.col("_got")[r].alias(r) for r in returns], F.col("_got")["_at"].alias("match_row"), F.when(F.col("_got").isNull(), NA).alias("error"))


def index(table: DataFrame, positions: DataFrame, at: str, column: str, row: str = "_row") -> DataFrame:
    """``positions`` with the cell of ``column`` at place ``at`` (from 1); ``error`` is #REF! past the edge."""
    one = table.select((F.col(row) + 1).alias("_at"), F.col(column).alias("value"), F.lit(True).alias("_there"))
    joined = positions.join(one, F.col(at) == F.col("_at"), "left")
    return joined.withColumn("error", F.when(F.col("_there").isNull(), "#REF!")).drop("_at", "_there")
