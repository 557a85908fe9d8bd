"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary documents, are counted over all training rows. An expression
counts once for each distinct text, so neither repeats inside a text nor copies of it pass for evidence. Both
models back off to unigrams of their class, and these to one shared distribution by continuation counts. A
count's discount is at least DISCOUNT, and at least (2 - share) times what the shared counts let expect in that class
(almost twice that for a rare class) plus DOUBT standard deviations: only what goes beyond is a class's own, the rest is passed to the shared back-off.
It is larger than a Kneser-Ney discount from counts of counts, which leaves each class the mass of all it happens to
hold; the README has the figures. For single words it must go beyond both in texts and in distinct contexts, which
near copies don't multiply.
The back-off weight of a context is also shared (the class with more mass of its own sets it), so a rare
expression gets the same probability from both. A document's log-likelihood ratio, normalised by
its length, goes through a logistic curve fitted on a part of the training rows that the counts leave out.

All words and all bigrams in LEAST_PAIRS texts take part, whatever the size of the corpus: the tables stay
distributed, and documents meet them in a join. Expressions without mass of their own in a class are scored by
back-off, which is the same for both, so only the others (the evidence) are joined. A bitmap of fixed size tells
most other expressions apart before the join.

Rows are split by crc32(id as text) mod 5: remainder 0 is held out and never trained on, 1 to 3 are counted,
4 calibrates (at most CALIBRATION_ROWS of it, the first by a hash of the id). Only the text is scored. A text in
several of these rows is one training row, of the smallest of its folds.

Cases: null and empty texts, and texts without a word, have ratio 0 and get the curve's score at 0. A row with
a null id counts as id "". A null label is no label; a document labelled twice is toxic if any label says so.
Repeated documents score alike; there are no ties. Without labels of both kinds every score is 0. An empty
table gives an empty result. Texts are scored whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textblock as tb

FOLDS, HELD_OUT, CALIBRATE = 5, 0, 4
#: Texts that a pair of words is in at least, at every size.
LEAST_PAIRS = 2
#: Size of the bitmap that says which expressions can be evidence. It only spares rows of a join.
BITS = 1 << 26
#: Ratios are summed in whole parts, so that the order doesn't matter.
UNIT = 1 << 32
CALIBRATION_ROWS = 50_000
#: Labels up to this number are broadcast to the documents; beyond it both are shuffled.
BROADCAST_LABELS = 2_000_000
DISCOUNT, DOUBT = 0.75, 2.0
#: Expressions that a task counts at once.
GATHER = 2_000_000


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")


@dataclass
class Model:
    """What scoring looks up. ``evidence``: a kept table of (key, delta); ``bits``: of fixed size, says which keys it may hold."""

    evidence: DataFrame
    bits: np.ndarray
    curve: tuple[float, ...] = (0.0,)


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A key for two words in this order."""
    return tb.mixed(tb.mixed(first) + second)


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys can be in the table. True for all that are, and for a few others."""
    at = keys & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def features(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Inputs of the curve: the ratio per word, and per root of the number of words, which long texts dilute less."""
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), total / n, total / np.sqrt(n)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights by Newton's method, on scaled inputs."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def discounted(count: Column, share: Column, total: Column) -> Column:
    """What is left of a class's count; ``share`` of the shared count ``total`` is what it is expected to be."""
    expected = share * total
    return F.greatest(count - F.greatest(F.lit(DISCOUNT), (2 - share) * expected + DOUBT * F.sqrt(expected + 1)), F.lit(0.0))


def count_expressions(train: DataFrame, words: bool) -> DataFrame:
    """In how many toxic and ordinary rows of (toxic, text) each word (``second``; ``first`` is null) or each pair of words is."""

    def counted(first: np.ndarray, second: np.ndarray, keys: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
        at, which = np.unique(keys, return_index=True, return_inverse=True)[1:]
        total = np.bincount(which, minlength=len(at))
        bad = np.bincount(which, weights=toxic, minlength=len(at)).astype(np.int64)
        pair = [] if words else [pa.array(first[at].view(np.int64))]
        return pa.RecordBatch.from_arrays([*pair, pa.array(second[at].view(np.int64)), pa.array(bad), pa.array(total - bad)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = batch.column(0).to_numpy(zero_copy_only=False)
            parts, size = [], 0
            for block in tb.blocks(batch.column(1), lower=True):
                starts, ends, firsts = block.words(tb.WORDLIKE)
                h, owner = block.hashes(starts, ends), tb.owners(firsts)
                if words:
                    first, second, keys = h, h, h
                else:
                    same = owner[1:] == owner[:-1]
                    first, second, owner = h[:-1][same], h[1:][same], owner[1:][same]
                    keys = paired(first, second)
                at = np.unique(tb.mixed(keys ^ tb.mixed(owner.astype(np.uint64))), return_index=True)[1]
                parts.append((first[at], second[at], keys[at], flags[block.lo : block.hi][owner[at]]))
                size += len(at)
                if size >= GATHER:
                    yield counted(*map(np.concatenate, zip(*parts, strict=True)))
                    parts, size = [], 0
            if parts:
                yield counted(*map(np.concatenate, zip(*parts, strict=True)))

    by = ["second"] if words else ["first", "second"]
    names = [*by, "toxic", "ordinary"]
    out = train.select("toxic", "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))
    return out.groupBy(*by).agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


CLASSES = ("toxic", "ordinary")


def word_model(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """second; p_toxic and p_ordinary: its probability in each class; own: whether a class has mass of its own for it."""
    after = pairs.groupBy("second").agg(F.count("*").alias("types"), *[F.sum((F.col(c) > 0).cast("long")).alias(f"after_{c}") for c in CLASSES])
    size, types, *sums = [int(x or 0) for x in words.agg(F.count("*"), F.lit(pairs.count()), *[F.sum(c) for c in CLASSES]).first()]
    sums = [max(x, 1) for x in sums]
    df = words.join(after, "second", "left").fillna(0)
    for c, x in zip(CLASSES, sums, strict=True):
        share = F.lit(x / sum(sums))
        in_texts = discounted(F.col(c), share, F.col("toxic") + F.col("ordinary"))
        in_contexts = discounted(F.col(f"after_{c}"), share, F.col("after_toxic") + F.col("after_ordinary"))
        df = df.withColumn(f"own_{c}", F.least(in_texts, in_contexts) / F.lit(x))
    df = scratch.keep(df.select("second", "types", *[f"own_{c}" for c in CLASSES]), "word-model")
    rest = 1 - max(x or 0 for x in df.agg(*[F.sum(f"own_{c}") for c in CLASSES]).first())
    shared = rest * (F.col("types") + 1) / F.lit(types + size + 1)
    return df.select("second", *[(F.col(f"own_{c}") + shared).alias(f"p_{c}") for c in CLASSES], (F.col("own_toxic") + F.col("own_ordinary") > 0).alias("own"))


def log_ratio(toxic: Column, ordinary: Column) -> Column:
    return F.log(toxic) - F.log(ordinary)


def pair_model(pairs: DataFrame, single: DataFrame) -> DataFrame:
    """first, second, delta: what a pair adds to its second word's ratio; pairs without mass of their own add nothing."""
    seen = pairs.groupBy("first").agg(*[F.sum(c).alias(f"seen_{c}") for c in CLASSES])
    # No count up to DOUBT is more than its discount.
    df = pairs.where((F.col("toxic") + F.col("ordinary") >= LEAST_PAIRS) & (F.greatest(*CLASSES) > DOUBT)).join(seen, "first")
    at_least = {c: F.greatest(F.col(f"seen_{c}"), F.lit(0.5)) for c in CLASSES}
    for c in CLASSES:
        share = at_least[c] / (at_least["toxic"] + at_least["ordinary"])
        df = df.withColumn(f"left_{c}", discounted(F.col(c), share, F.col("toxic") + F.col("ordinary")) / F.greatest(F.col(f"seen_{c}"), F.lit(1)))
    df = scratch.keep(df.where(F.col("left_toxic") + F.col("left_ordinary") > 0).select("first", "second", *[f"left_{c}" for c in CLASSES]), "pair-model")
    weight = df.groupBy("first").agg(F.greatest(1 - F.greatest(*[F.sum(f"left_{c}") for c in CLASSES]), F.lit(1e-6)).alias("weight"))
    df = df.join(weight, "first").join(single, "second")
    prob = [F.col(f"left_{c}") + F.col("weight") * F.col(f"p_{c}") for c in CLASSES]
    return df.select("first", "second", (log_ratio(*prob) - log_ratio(F.col("p_toxic"), F.col("p_ordinary"))).alias("delta"))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, second = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(paired(first, second).view(np.int64)), batch.column(2)], ["key", "delta"])


def fit_counts(train: DataFrame) -> Model:
    """The two models, from rows of (toxic 0/1, text)."""
    words = scratch.keep(count_expressions(train, True), "word-counts")
    pairs = scratch.keep(count_expressions(train, False), "pair-counts")
    single = word_model(words, pairs)
    of_words = single.where("own").select(F.col("second").alias("key"), log_ratio(F.col("p_toxic"), F.col("p_ordinary")).alias("delta"))
    of_pairs = pair_model(pairs, single).mapInArrow(_keyed, "key bigint, delta double")
    evidence = scratch.keep(of_words.unionByName(of_pairs).select("key", F.round(F.col("delta") * F.lit(float(UNIT))).cast("long").alias("delta")), "evidence")
    at = F.col("key").bitwiseAND(F.lit(BITS - 1))
    bits = np.zeros(BITS // 8, np.uint8)
    for k, part in evidence.groupBy(F.shiftright(at, 15).alias("k")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767)))).collect():
        bits[4096 * k : 4096 * (k + 1)] = np.frombuffer(bytes(part), np.uint8)
    return Model(evidence, bits)


def totals(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """The ``carry`` columns, ``total`` and ``n_words``. Rows' distinct expressions meet the evidence in a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model.bits)
    narrow = docs.select(*carry, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema[:-1]) + ", __row bigint, n_words bigint, __keys array<bigint>, __times array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in tb.blocks(batch.column(len(carry)), lower=True):
                n = block.hi - block.lo
                starts, ends, firsts = block.words(tb.WORDLIKE)
                h, owner = block.hashes(starts, ends), tb.owners(firsts)
                same = owner[1:] == owner[:-1]
                keys, owner = np.concatenate([h, paired(h[:-1], h[1:])[same]]), np.concatenate([owner, owner[1:][same]])
                there = maybe(shared.value, keys)
                keys, owner = keys[there], owner[there]
                order = np.lexsort((keys, owner))
                keys, owner = keys[order], owner[order]
                new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1]))) if len(keys) else np.zeros(0, np.int64)
                offsets = pa.array(np.append(0, np.cumsum(np.bincount(owner[new], minlength=n))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64) if x.dtype != np.uint64 else x.view(np.int64))) for x in (keys[new], np.diff(np.append(new, len(keys))))]
                own = [batch.column(k).slice(block.lo, n) for k in range(len(carry))]
                n_words = np.diff(firsts) if len(starts) else np.zeros(n)
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(row, row + n)), pa.array(n_words.astype(np.int64)), *lists], [*carry, "__row", "n_words", "__keys", "__times"])
                row += n

    found = scratch.keep(narrow.mapInArrow(run, schema), "expressions")
    each = found.select("__row", F.explode(F.arrays_zip("__keys", "__times")).alias("e")).select("__row", F.col("e.__keys").alias("key"), F.col("e.__times").alias("times"))
    sums = each.join(model.evidence, "key").groupBy("__row").agg(F.sum(F.col("times") * F.col("delta")).alias("sum"))
    return found.join(sums, "__row", "left").select(*carry, (F.coalesce("sum", F.lit(0)) / F.lit(float(UNIT))).alias("total"), "n_words")


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Counts and curve from the labelled rows that aren't held out."""
    marks = labels.select(labels[id_col].alias("label_id"), labels[label_col].cast("int").alias("toxic")).where("label_id is not null and toxic is not null").groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(fold(F.col("label_id")) != HELD_OUT)
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), fold(docs[id_col]).alias("fold")).where(F.col("fold") != HELD_OUT)
    known = rows.join(marks, F.col("id") == F.col("label_id"))
    # Copies count once, in the smallest of their folds; a text is toxic if any copy is.
    texts = known.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("id").alias("id"), F.min("fold").alias("fold"), F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    known = scratch.keep(texts.drop("digest"), "labelled")
    model = fit_counts(known.where(F.col("fold") != CALIBRATE))
    scored = totals(known.where(F.col("fold") == CALIBRATE), model, ["id", "toxic"])
    got = scored.orderBy(F.xxhash64("id")).limit(calibration_rows).select("toxic", "total", "n_words").toArrow()
    y = got["toxic"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        model.curve = tuple(float(x) for x in logistic(features(got["total"].to_numpy(), got["n_words"].to_numpy()), y))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, held_out, score, predicted (score >= 0.5), n_words and ratio_per_word."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = totals(rows, model, ["id"])
    if len(model.curve) > 1:
        n = F.greatest("n_words", F.lit(1))
        at = model.curve[0] + model.curve[1] * (F.col("total") / n) + model.curve[2] * (F.col("total") / F.sqrt(n))
        out = out.withColumn("score", 1 / (1 + F.exp(-F.least(F.greatest(at, F.lit(-30.0)), F.lit(30.0)))))
    else:
        out = out.withColumn("score", F.lit(0.0))
    return out.select(F.col("id").alias(id_col), (fold(F.col("id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", (F.col("total") / F.greatest(F.col("n_words"), F.lit(1))).alias("ratio_per_word"))
