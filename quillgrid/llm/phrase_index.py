"""Benchmark decontamination over a distributed positional inverted index.

The training texts are cut into segments, runs of whole texts; each segment has a postings list (sorted word
positions) for each of its terms, all of them, and the segments lie as rows of a stored table. A query is a window of consecutive
benchmark words: in each segment the postings of its rarest term, moved back by the term's offset, are the
candidates, and they are intersected with the offset-adjusted lists of the other terms, rarest first. With
``slop`` 0 that gives exact phrases; a greater slop lets each term stand so many words off its place.

The benchmark is sent to the executors in blocks of about BENCH_BYTES of text, one after another, each searched
against the whole stored index, so neither the driver nor a broadcast holds more than a block of it.

Cases: null and empty texts, of documents or items, have no words: they match nothing. An item of fewer words
than a window is one window. Repeated documents each get a row; items that repeat an id count once. An item
whose id is null marks words as hit but isn't listed. There are no ties. Empty tables give no rows, or rows
without matches. Texts of any length are indexed whole. Extra columns are ignored or, by ``remove``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from . import textblock as tb

WINDOW = 10
BENCH_BYTES = 16 << 20


class Segment:
    """Postings of one run of texts. ``terms`` sorted; term ``k`` stands at ``positions[starts[k]:starts[k + 1]]``; text ``i`` has words ``firsts[i]:firsts[i + 1]``."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, positions: np.ndarray, firsts: np.ndarray):
        self.terms, self.starts, self.positions, self.firsts = terms, starts, positions, firsts

    @classmethod
    def of(cls, block: tb.Block) -> Segment:
        """From a lower-cased block."""
        starts, ends, firsts = block.words(tb.WORDLIKE)
        hashes = block.hashes(starts, ends)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        new = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        return cls(ordered[new], np.append(new, len(ordered)).astype(np.int64), order.astype(np.int32), firsts.astype(np.int64))

    def row(self) -> list[bytes]:
        return [self.terms.astype("<u8").tobytes(), self.starts.astype("<i4").tobytes(), self.positions.astype("<i4").tobytes(), self.firsts.astype("<i4").tobytes()]

    @classmethod
    def read(cls, terms: bytes, starts: bytes, positions: bytes, firsts: bytes) -> Segment:
        return cls(np.frombuffer(terms, "<u8"), np.frombuffer(starts, "<i4").astype(np.int64), np.frombuffer(positions, "<i4"), np.frombuffer(firsts, "<i4").astype(np.int64))


class Windows:
    """The distinct windows of a block of items, and the items that hold each."""

    def __init__(self, ids: list[str | None], texts: list[str | None], length: int = WINDOW):
        owner, rows = [], []
        for block in tb.blocks(pa.array(texts, pa.large_string()), lower=True):
            starts, ends, firsts = block.words(tb.WORDLIKE)
            hashes = block.hashes(starts, ends)
            for k in range(block.hi - block.lo):
                words = hashes[firsts[k] : firsts[k + 1]]
                if len(words):
                    n = max(1, len(words) - length + 1)
                    out = np.zeros((n, length + 1), np.uint64)
                    size = min(length, len(words))
                    for j in range(size):
                        out[:, j] = words[j : j + n]
                    out[:, length] = size
                    rows.append(out)
                    owner.append(np.full(n, block.lo + k))
        table = np.concatenate(rows) if rows else np.zeros((0, length + 1), np.uint64)
        distinct, which = np.unique(table, axis=0, return_inverse=True)
        self.length, self.size = length, distinct[:, length].astype(np.int64)
        real = np.arange(length) < self.size[:, None]
        self.vocabulary = np.unique(distinct[:, :length][real])
        self.term = np.where(real, np.searchsorted(self.vocabulary, distinct[:, :length]), -1)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner)]), axis=1) if rows else np.zeros((2, 0), np.int64)
        self.item_of, self.item_from = pairs[1], np.searchsorted(pairs[0], np.arange(len(distinct) + 1))
        self.ids = ids


def search(segment: Segment, windows: Windows, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start position) of each match in the segment."""
    none = np.zeros(0, np.int64)
    if not len(segment.terms) or not len(windows.size):
        return none, none
    at = np.searchsorted(segment.terms, windows.vocabulary)
    at[at == len(segment.terms)] = 0
    found = segment.terms[at] == windows.vocabulary
    df = np.where(found, segment.starts[at + 1] - segment.starts[at], 0)
    counts = np.where(windows.term >= 0, df[windows.term], np.iinfo(np.int64).max)
    live = np.flatnonzero(counts.min(axis=1) > 0)
    if not len(live):
        return none, none
    order = np.argsort(counts[live], axis=1, kind="stable")
    term = np.take_along_axis(windows.term[live], order, axis=1)
    n = counts[live, order[:, 0]]
    who = np.repeat(np.arange(len(live)), n)
    first = segment.starts[at[term[:, 0]]]
    step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    start = segment.positions[first[who] + step].astype(np.int64) - order[who, 0]
    keys = np.repeat(np.arange(len(segment.terms)) << 32, np.diff(segment.starts)) + segment.positions
    for s in range(1, windows.length):
        t = term[who, s]
        target = (at[t] << 32) + start + order[who, s]
        k = np.searchsorted(keys, target - slop)
        k[k == len(keys)] = 0
        ok = (t < 0) | ((keys[k] >= target - slop) & (keys[k] <= target + slop) & (keys[k] >> 32 == at[t]))
        who, start = who[ok], start[ok]
        if not len(who):
            return none, none
    window = live[who]
    text = np.searchsorted(segment.firsts, start, "right") - 1
    inside = (start >= 0) & (start + windows.size[window] <= segment.firsts[np.clip(text + 1, 0, len(segment.firsts) - 1)])
    return window[inside], start[inside]


def matches(segment: Segment, windows: Windows, slop: int = 0) -> tuple[np.ndarray, dict[int, list[str]], dict[int, list[tuple[int, int]]]]:
    """Per text of the segment: n_hit, and for texts with matches the item ids and the hit spans, in words of the text."""
    n = len(segment.firsts) - 1
    window, start = search(segment, windows, slop)
    steps = np.zeros(int(segment.firsts[-1]) + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, start + windows.size[window], -1)
    inside = np.cumsum(steps[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(inside)])
    hits = sums[segment.firsts[1:]] - sums[segment.firsts[:-1]]
    items: dict[int, set[str]] = {}
    for w, t in {*zip(window.tolist(), (np.searchsorted(segment.firsts, start, "right") - 1).tolist(), strict=True)}:
        own = windows.item_of[windows.item_from[w] : windows.item_from[w + 1]]
        items.setdefault(t, set()).update(x for x in (windows.ids[i] for i in own) if x is not None)
    spans = {}
    for t in np.flatnonzero(hits).tolist():
        part = inside[segment.firsts[t] : segment.firsts[t + 1]].astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], part, [0]])))
        spans[t] = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    return hits, {t: sorted(x) for t, x in items.items()}, spans


def bench_blocks(bench: DataFrame, id_col: str = "item_id", text_col: str = "text", length: int = WINDOW) -> Iterator[Windows]:
    """The items' windows, in blocks of about BENCH_BYTES of text; items are dealt by a hash of their text."""
    items = bench.select(bench[id_col].cast("string").alias("id"), bench[text_col].alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BENCH_BYTES)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        yield Windows([r[0] for r in rows], [r[1] for r in rows], length)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: a row for each segment, with the ids of its texts."""
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = batch.column(0)
            for block in tb.blocks(batch.column(1), lower=True):
                row = Segment.of(block).row()
                own = ids.slice(block.lo, block.hi - block.lo)
                listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k]), listed, *(pa.array([x], pa.binary()) for x in row)], ["segment", "ids", "terms", "starts", "positions", "firsts"])
                k += 1

    return scratch.keep(narrow.mapInArrow(run, f"segment bigint, ids array<{kind}>, terms binary, starts binary, positions binary, firsts binary"), "postings")


def search_index(index: DataFrame, windows: Windows, slop: int = 0) -> DataFrame:
    """A row for each text of the index: segment, number in it, id, n_words, n_hit, items (ids as strings), spans (first word, end)."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column(1)[r].values
                segment = Segment.read(*(batch.column(c)[r].as_py() for c in range(2, 6)))
                hits, items, spans = matches(segment, shared.value, slop)
                n = len(hits)
                columns = [pa.array(np.full(n, batch.column(0)[r].as_py())), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(np.diff(segment.firsts)), pa.array(hits.astype(np.int64))]
                columns += [pa.array([items.get(t, []) for t in range(n)], pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in spans.get(t, [])] for t in range(n)], span)]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "number", "id", "n_words", "n_hit", "items", "spans"])

    return index.mapInArrow(run, f"segment bigint, number int, id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>")


def covered_words(spans: Column) -> Column:
    """How many words lie in at least one of the spans."""
    begin = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["upto"], x["end"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["upto"], x["start"]))).alias("n"))
    return F.aggregate(F.sort_array(spans), begin, step, lambda s: s["n"])


def find_contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = WINDOW, slop: int = 0) -> DataFrame:
    """A row for each document: id, n_words, n_hit, items (sorted ids, as strings) and spans of hit words."""
    index = build_index(docs, id_col, text_col)
    windows = bench_blocks(bench, item_col, item_text_col, length)
    found = search_index(index, next(windows, None) or Windows([], [], length), slop)
    for more in windows:
        # Of all blocks but the last, only matches are carried on, from a written table.
        matched = scratch.keep(found.where("n_hit > 0").select("segment", "number", "items", "spans"), "matches")
        both = search_index(index, more, slop).join(matched.withColumnsRenamed({"items": "more_items", "spans": "more_spans"}), ["segment", "number"], "left")
        none = lambda c: F.coalesce(F.col(f"more_{c}"), F.array().cast(index_kinds[c]))
        index_kinds = {f.name: f.dataType for f in found.schema}
        found = both.withColumn("items", F.array_sort(F.array_union("items", none("items")))).withColumn("spans", F.concat("spans", none("spans"))).withColumn("n_hit", covered_words(F.col("spans"))).drop("more_items", "more_spans")
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "spans")


def remove(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = WINDOW, slop: int = 0) -> DataFrame:
    """The rows without a match, with all their columns: rows find their match in the index by their text's digest."""
    digest = F.unhex(F.sha2(docs[text_col], 256))
    found = find_contamination(docs.select(digest.alias("id"), docs[text_col].alias("text")), bench, "id", "text", item_col, item_text_col, length, slop)
    bad = scratch.keep(found.where("n_hit > 0").select(F.col("id").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, digest == F.col("__bad"), "left_anti")
