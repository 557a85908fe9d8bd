"""Sharding by minimax contiguous partition.

Equal texts form an atomic group. The groups stand in the order of their digests; the smallest shard capacity
for which a greedy pass over the group sizes needs no more than ``n`` shards is found by binary search, and the
order is cut there. Up to MOST_ENDS group ends are searched on the driver. More stay distributed: each step of the
greedy pass is an aggregate over them, for CAPACITIES capacities at once. Either way the outcome is exact and the
number of steps has a bound, whatever the sizes of the groups.

Cases: a null text counts as an empty one (size 1, checksum 0); rows with equal text stay together, repeated
rows included; ties in the order are broken by id, nulls first. An empty table gives an empty result. With one
group larger than an equal share, that group sets the capacity, and trailing shards can be small or empty.
Extra columns are ignored by ``assign`` and kept by ``with_shard``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered, scratch

#: As many group ends as the driver may hold at once; more of them stay where they are.
MOST_ENDS = 100_000
#: Capacities that a round of the search tries at once.
CAPACITIES = 32


def greedy(ends: np.ndarray, capacity: int, n: int) -> list[int]:
    """The ends of at most ``n`` shards, each as full as the capacity allows."""
    cuts, at = [], 0
    for _ in range(n):
        k = int(np.searchsorted(ends, at + capacity, "right")) - 1
        at = max(at, int(ends[k]) if k >= 0 else 0)
        cuts.append(at)
    return cuts


def smallest(ends: np.ndarray, lo: int, total: int, n: int) -> int:
    """The smallest capacity from ``lo`` on that reaches ``total`` with ``n`` shards."""
    hi = max(lo, total)
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(ends, mid, n)[-1] == total:
            hi = mid
        else:
            lo = mid + 1
    return hi


def passes(groups: DataFrame, capacities: list[int], total: int, n: int) -> list[list[int]]:
    """The greedy cuts of each capacity, one aggregate over the groups for each step of all capacities."""
    cuts: list[list[int]] = [[] for _ in capacities]
    for _ in range(n):
        going = [k for k, c in enumerate(cuts) if not c or c[-1] < total]
        if not going:
            break
        limits = [(cuts[k][-1] if cuts[k] else 0) + capacities[k] for k in going]
        found = groups.agg(*[F.max(F.when(F.col("upto") <= F.lit(x), F.col("upto"))).alias(f"c{j}") for j, x in enumerate(limits)]).first()
        for k, end in zip(going, found, strict=True):
            cuts[k].append(max(cuts[k][-1] if cuts[k] else 0, end or 0))
    return [c + [c[-1]] * (n - len(c)) for c in cuts]


def cut_points(groups: DataFrame, n: int, most: int = MOST_ENDS) -> list[int]:
    """The ends (values of ``upto``) of the ``n`` shards. ``groups``: ``upto``, the running size with the group; ``size``."""
    count, total, largest = groups.agg(F.count("*"), F.max("upto"), F.max("size")).first()
    if not count:
        return []
    lo = max(-(-total // n), largest)
    if count <= most:
        ends = np.sort(np.array([r[0] for r in groups.select("upto").collect()], np.int64))
        return greedy(ends, smallest(ends, lo, total, n), n)
    # Each shard but the last is filled to more than the capacity less the largest group, so this much is enough.
    hi, best = min(total, -(-total // n) + largest), None
    while best is None or lo < hi:
        step = max(1, -(-(hi - lo) // CAPACITIES))
        tried = [*range(lo, hi, step), hi] if best is None else list(range(lo, hi, step))
        for capacity, cuts in zip(tried, passes(groups, tried, total, n), strict=True):
            if cuts[-1] == total:
                hi, best = capacity, cuts
                break
            lo = capacity + 1
    return best


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def plan(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[tuple[bytes, int]]]:
    """The rows in order (id, size, text_crc32, digest, position), and for each cut the last digest before it and the position after it."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    placed = ordered.numbered(rows, [F.col("digest"), F.col("id").asc_nulls_first()], "size", "shards")
    groups = scratch.keep(placed.groupBy("digest").agg(F.max(F.col("before") + F.col("size")).alias("upto"), F.sum("size").alias("size"), (F.max("position") + 1).alias("next")), "groups")
    cuts = sorted(set(cut_points(groups, n)))
    found = groups.where(F.col("upto").isin(cuts)).select("digest", "next").collect() if cuts else []
    return placed, sorted((bytes(r[0]), r[1]) for r in found)


def shard_of(cuts: list[tuple[bytes, int]], key: Column) -> Column:
    """The shard of a digest: how many cuts lie before it."""
    at = F.lit(0)
    for last, _ in cuts[:-1]:
        at = at + (key > F.lit(bytearray(last))).cast("int")
    return at.cast("int")


def assign(docs: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, size (bytes plus 1), text_crc32, law, shard, slot (from 0, without gaps), grown_shard (null for this law)."""
    placed, cuts = plan(docs, n, id_col, text_col)
    first = F.element_at(F.array(*[F.lit(k).cast("long") for k in [0, *(k for _, k in cuts[:-1])]]), F.col("shard") + 1)
    return placed.withColumn("shard", shard_of(cuts, F.col("digest"))).select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_shard(docs: DataFrame, n: int = 16, id_col: str = "doc_id", text_col: str = "text", out: str = "shard") -> DataFrame:
    """All rows and columns with their shard in ``out`` (a column of that name is replaced), without a join: the cuts are digests."""
    _, cuts = plan(docs, n, id_col, text_col)
    return docs.withColumn(out, shard_of(cuts, digest(text_col)))


def write_shards(docs: DataFrame, path: str, n: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows as Parquet under ``path``, a folder ``shard=<k>`` for each shard."""
    with_shard(docs, n, id_col, text_col).write.partitionBy("shard").parquet(path)
