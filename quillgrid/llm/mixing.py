"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled by a seeded hash. The ``e``-th copy of a document gets the virtual
finish time (words of its source up to and with it, earlier passes included) / target. All copies are sorted
by finish time over the whole cluster and cut where the budget is used up. A source's share is capped at
``repeats`` times its size, and the excess goes to the others by weight.

Cases: a null text has size 0; documents of size 0 and sources without words take 0 and have target 0. A null
source is a source of its own, last in the order. Repeated rows are each a document; ties in the shuffle are
broken by id and size, and rows that tie there too are alike, so reruns agree. An empty table gives an empty
result. Extra columns are ignored by ``mix`` and kept by ``take``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered, scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
REPEATS = 3
SEED = 20240229
#: Sources up to this number are broadcast; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    """Number of words that white space ends; null: 0."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "w")
    return F.length(F.translate(spaced, " \t\n\x0b\x0c\r", "")).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """``sources`` (source, source_size, source_before) with ``rank`` by code point, nulls last, and ``target``.

    The weights repeat along the ranks. The targets share the sum of all sizes: target = min(cap, level * weight),
    where the level is raised until they sum to it.
    """
    ranked = ordered.numbered(sources, [F.col("source").asc_nulls_last()], "source_size", "sources").drop("before").withColumnRenamed("position", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats))
    level, total = 0.0, None
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, free, size = ranked.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum("source_size")).first()
        total = float(size or 0)
        if not free or (total - capped) / free <= level:
            break
        level = (total - capped) / free
    return ranked.withColumn("target", F.least(F.col("cap"), F.lit(level) * F.col("weight"))).drop("weight", "cap")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """One row per document: id, size, source_size, target (of its source), taken (words, repeats counted), source, and copies."""
    text = docs[text_col]
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), n_words(text).alias("size"), F.xxhash64(F.lit(seed), docs[id_col], text).alias("key"))
    placed = ordered.numbered(rows, [F.col("source").asc_nulls_last(), F.col("key"), F.col("id"), F.col("size")], "size", "mix")
    sources = scratch.keep(targets(placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("source_before")), weights, repeats), "targets")
    count, budget = sources.agg(F.count("*"), F.sum("source_size")).first()
    small = F.broadcast(sources) if count <= BROADCAST_SOURCES else sources
    queued = placed.join(small.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    served = F.col("before") - F.col("source_before") + F.col("size")

    def finish(e: Column) -> Column:
        return (e * F.col("source_size") + served).cast("double") / F.col("target")

    def place(e: Column) -> Column:
        return F.struct(finish(e).alias("finish"), F.col("rank"), F.col("position"), e.alias("copy"))

    copies = queued.where("size > 0 and target > 0").select("size", "rank", F.col("position").alias("at"), "source_size", "source_before", "before", "target", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"))
    copies = copies.select("size", "rank", "at", "copy", finish(F.col("copy")).alias("finish"))
    sorted_copies = ordered.numbered(copies, [F.col("finish"), F.col("rank"), F.col("at"), F.col("copy")], "size", "queue")
    cut = sorted_copies.where(F.col("before") < F.lit(budget or 0)).agg(F.max(F.struct("finish", "rank", "at", "copy")).alias("cut")).first()["cut"]
    if cut is None:
        taken = F.lit(0)
    else:
        last = F.struct(F.lit(cut["finish"]), F.lit(cut["rank"]).cast("long"), F.lit(cut["at"]).cast("long"), F.lit(cut["copy"]))
        taken = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((place(F.lit(e)) <= last).cast("int") for e in range(repeats))).otherwise(0)
    return queued.select(F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"), (taken * F.col("size")).cast("long").alias("taken"), F.col("source").alias(source_col), taken.cast("int").alias("copies"), F.col("key").alias("shuffle_key"))


def take(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The rows as often as the mix takes them, with all their columns.

    Rows find their number of copies by id and shuffle key; rows alike in both are alike in source and text, so
    which of them gets which number doesn't show: each gets the group's total, shared out.
    """
    plan = mix(docs, id_col, source_col, text_col, weights, repeats, seed)
    key = F.xxhash64(F.lit(seed), docs[id_col], docs[text_col])
    plan = plan.select(F.col("shuffle_key").alias("k"), F.col(id_col).alias("i"), F.col(source_col).alias("s"), "copies")
    totals = plan.groupBy("k", "i", "s").agg(F.sum("copies").alias("total"), F.count("*").alias("n")).where("total > 0")
    if totals.where("n > 1").limit(1).count():
        # Repeated rows: of a group of n rows that share total copies, each carries total / n, the first ones one more.
        w = Window.partitionBy("k", "i", "s").orderBy(F.lit(1))
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("rk"), docs[id_col].alias("ri"), docs[source_col].alias("rs"))
        joined = rows.join(totals, (F.col("rk") == F.col("k")) & F.col("ri").eqNullSafe(F.col("i")) & F.col("rs").eqNullSafe(F.col("s")))
        counted = joined.withColumn("copies", F.floor(F.col("total") / F.col("n")) + (F.row_number().over(w) <= F.col("total") % F.col("n")).cast("int"))
        wide = counted.where("copies > 0")
    else:
        rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("rk"), docs[id_col].alias("ri"), docs[source_col].alias("rs"))
        wide = rows.join(totals.withColumnRenamed("total", "copies"), (F.col("rk") == F.col("k")) & F.col("ri").eqNullSafe(F.col("i")) & F.col("rs").eqNullSafe(F.col("s")))
    return wide.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
