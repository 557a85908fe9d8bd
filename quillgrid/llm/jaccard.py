"""n-gram Jaccard join: links of documents by their shingle sets, exact, through a forest of signature trees.

One tree over all documents can't prune: near its root every bitmap is full, so all pairs of nodes would be
visited. Here each tree stands over a block, and the blocks are made so that no link is lost:

1. Equal texts become one class, so copies cost nothing.
2. All shingles of all classes are counted in a table of cells (about 8 shingles a cell, cells dealt over the
   cluster). Cells that are much fuller than chance makes them mark frequent shingles. Each set is put in one
   global order, frequent shingles last.
3. Two sets whose Jaccard index reaches the threshold share a shingle among the first
   ``n - ceil(threshold * n) + 1`` of each in that order (the prefix). Prefix entries are dealt by shingle. All
   sets that share an entry and whose sizes allow a link are tied to one of them, the leader.
4. A block is a leader and all that is tied to it: each pair that shares a prefix entry is in some block. In
   a block, the dual traversal of a signature tree prunes node pairs, and what is left is verified exactly.
5. Links join classes into components, over the cluster.

A block of more than BLOCK_SETS sets or BLOCK_BYTES of text is cut into chunks, each of which gets a few pivots
of the whole block. When components are known, the sets outside the block's largest component meet all
chunks. Pairs inside one component need no test, so the cut loses nothing.

Cases: a null or empty text, or one without words, has an empty set and is linked with nothing; its component
is its own id. A text of fewer words than a shingle has its whole word sequence as its one shingle. Repeated
rows are copies. Ties: a component is named by its smallest id; ids that are null are passed over, and a
component whose ids are all null is named null. An empty table gives an empty result. Long texts are taken
whole. Extra columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, scratch
from . import signature_tree as tree
from . import textblock as tb

SHINGLE, PERCENT = 5, 75
CELL_LOAD = 8
#: A cell with this number of shingles or more is frequent; raised until at most MOST_FREQUENT cells are.
FREQUENT, MOST_FREQUENT = 40, 2_000_000
BUCKET_POSTINGS = 1_000_000
BLOCK_SETS, BLOCK_BYTES = 4096, 64 << 20
PIVOTS = 32
#: Ties up to this number are broadcast to the texts; beyond it both are shuffled.
BROADCAST_TIES = 500_000
#: Tokens gathered before they are dealt out.
GATHER = 2_000_000
#: Stands before all ids where a class has no id.
NO_ID = 1 << 62


def shingles(block: tb.Block, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each distinct shingle, sorted by owner and hash. The block is lower-cased."""
    starts, ends, firsts = block.words()
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = tb.owners(firsts)
    rolls = tb.rolling(block.hashes(starts, ends))
    at = np.arange(len(starts))
    past = firsts[1:][owner]
    short = (past - firsts[owner] < width) & (at == firsts[owner])
    at = at[(at + width <= past) | short]
    keys = tb.window(rolls, at, np.minimum(at + width, past[at]))
    owner = owner[at]
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[fresh], keys[fresh]


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def with_sizes(classes: DataFrame, width: int) -> DataFrame:
    """``classes`` (node, digest, text) with ``n_shingles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.bincount(shingles(b, width)[0], minlength=b.hi - b.lo) for b in tb.blocks(batch.column(2), lower=True)]
            if sizes:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(sizes).astype(np.int64))], ["node", "digest", "text", "n_shingles"])

    return classes.mapInArrow(run, "node bigint, digest binary, text string, n_shingles bigint")


def make_classes(rows: DataFrame, width: int) -> DataFrame:
    """One row for each distinct text of (id, text), written: node, digest, text, n_shingles."""
    grouped = rows.select("id", "text", digest(F.col("text")).alias("digest")).groupBy("digest").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    node = F.coalesce(F.col("id").cast("long"), F.lit(NO_ID) + F.abs(F.xxhash64("digest") % F.lit(1 << 60)))
    return scratch.keep(with_sizes(grouped.select(node.alias("node"), "digest", F.coalesce("text", F.lit("")).alias("text")), width), "classes")


def power_of_two(x: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, x)))))


def frequent_cells(classes: DataFrame, width: int, n_shingles: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits of a cell number, sorted numbers of frequent cells, their ranks: 1 to 63, rising with the count)."""
    buckets = power_of_two(n_shingles / CELL_LOAD / 65_536)
    shift = np.uint64(48 - int(np.log2(buckets)))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            cells = np.sort(np.concatenate(parts) >> shift)
            bounds = np.searchsorted(cells, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(16))
            low, rows = (cells & np.uint64(0xFF)).astype(np.uint8), []
            for k in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[k], bounds[k + 1])
                highs = np.bincount(((cells[part] >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64), minlength=256)
                rows.append((k, highs.astype("<u4").tobytes() + low[part].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "cells"])

        parts, size = [], 0
        for batch in batches:
            for block in tb.blocks(batch.column(0), lower=True):
                parts.append(shingles(block, width)[1])
                size += len(parts[-1])
                if size >= GATHER:
                    yield out(parts)
                    parts, size = [], 0
        if size:
            yield out(parts)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                highs = np.frombuffer(body, "<u4", 256).astype(np.int64)
                cells = np.repeat(np.arange(256) << 8, highs) | np.frombuffer(body, np.uint8, offset=1024)
                tables.setdefault(k, np.zeros(65_536, np.int32))
                tables[k] += np.bincount(cells, minlength=65_536).astype(np.int32)
        for k, table in tables.items():
            full = np.flatnonzero(table >= FREQUENT)
            yield pa.RecordBatch.from_arrays([pa.array(full + (k << 16)), pa.array(table[full].astype(np.int64))], ["cell", "count"])

    blobs = classes.select("text").mapInArrow(dealt, "bucket bigint, cells binary")
    cells = scratch.keep(blobs.repartition("bucket").mapInArrow(summed, "cell bigint, count bigint"), "cells")
    least, total = FREQUENT, cells.count()
    while total > MOST_FREQUENT:
        least *= 2
        total = cells.where(F.col("count") >= least).count()
    table = cells.where(F.col("count") >= least).orderBy("cell").toArrow()
    rank = np.minimum(63, 2 * np.log2(table["count"].to_numpy().astype(float)))
    return 16 + int(np.log2(buckets)), table["cell"].to_numpy().astype(np.uint64), rank.astype(np.uint64)


def ranked(keys: np.ndarray, cell_bits: int, cells: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Shingles renamed so that their natural order is the global order: frequent ones last, else by hash."""
    if not len(cells):
        return tb.mixed(keys) >> np.uint64(6)
    own = keys >> np.uint64(64 - cell_bits)
    at = np.searchsorted(cells, own)
    at[at == len(cells)] = 0
    level = np.where(cells[at] == own, ranks[at], np.uint64(0))
    return level << np.uint64(58) | tb.mixed(keys) >> np.uint64(6)


def ties(classes: DataFrame, width: int, percent: int, n_shingles: int, frequent: tuple[int, np.ndarray, np.ndarray]) -> DataFrame:
    """Distinct (leader, member) nodes, written. Each pair that can reach the threshold has a leader in common."""
    shared = classes.sparkSession.sparkContext.broadcast(frequent)
    least = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = power_of_two(max(least, n_shingles * (100 - percent) / 100 / BUCKET_POSTINGS))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple]) -> pa.RecordBatch:
            nodes, sizes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            base = np.cumsum([0, *(len(p[0]) for p in parts)])
            owner = np.concatenate([p[2] + b for p, b in zip(parts, base[:-1], strict=True)])
            token, index = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
            token = tb.mixed(token)
            bucket = (token & np.uint64(buckets - 1)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                at = order[bounds[k] : bounds[k + 1]]
                docs, which = np.unique(owner[at], return_inverse=True)
                head = np.array([len(docs), len(at)], "<i8").tobytes() + nodes[docs].astype("<i8").tobytes() + sizes[docs].astype("<i4").tobytes()
                rows.append((k, head + (token[at] >> np.uint64(32)).astype("<u4").tobytes() + which.astype("<u2").tobytes() + index[at].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "postings"])

        parts, size, docs = [], 0, 0
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for block in tb.blocks(batch.column(1), lower=True, limit=tb.BLOCK):
                n = block.hi - block.lo
                if parts and docs + n > 65_535:
                    yield out(parts)
                    parts, size, docs = [], 0, 0
                owner, keys = shingles(block, width)
                token = ranked(keys, *shared.value)
                order = np.lexsort((token, owner))
                token = token[order]
                sizes = np.bincount(owner, minlength=n)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                prefix = sizes - -(-percent * sizes // 100) + 1
                indexed = sizes - -(-2 * percent * sizes // (100 + percent)) + 1
                keep = place < prefix[owner]
                parts.append((nodes[block.lo : block.hi], sizes, owner[keep], token[keep], (place < indexed[owner])[keep]))
                size, docs = size + int(keep.sum()), docs + n
                if size >= GATHER or docs > 65_535 - 4096:
                    yield out(parts)
                    parts, size, docs = [], 0, 0
        if size:
            yield out(parts)

    def tied(postings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        nodes, sizes, tokens, indexed = [], [], [], []
        for body in postings:
            d, p = np.frombuffer(body, "<i8", 2).tolist()
            own = np.frombuffer(body, "<i8", d, 16)
            own_sizes = np.frombuffer(body, "<i4", d, 16 + 8 * d)
            at = 16 + 12 * d
            which = np.frombuffer(body, "<u2", p, at + 4 * p)
            nodes.append(own[which])
            sizes.append(own_sizes[which])
            tokens.append(np.frombuffer(body, "<u4", p, at))
            indexed.append(np.frombuffer(body, bool, p, at + 6 * p))
        node, size, token, indexed = (np.concatenate(x) for x in (nodes, sizes, tokens, indexed))
        order = np.argsort(token, kind="stable")
        same = token[order][1:] == token[order][:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at = order[several]
        at = at[np.lexsort((size[at], token[at]))]
        # A run of one token ends, too, where the next larger set is too large for all before it.
        new = np.ones(len(at), bool)
        new[1:] = (token[at][1:] != token[at][:-1]) | (percent * size[at][1:].astype(np.int64) > 100 * size[at][:-1].astype(np.int64))
        run = np.cumsum(new) - 1
        n = int(run[-1]) + 1 if len(run) else 0
        good = (np.bincount(run, minlength=n) > 1) & (np.bincount(run, indexed[at], minlength=n) > 0)
        keep = good[run] if n else np.zeros(0, bool)
        at, run = at[keep], run[keep]
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        leader = np.repeat(np.minimum.reduceat(node[at], first), np.diff(np.append(first, len(at))))
        both = np.unique(np.stack([leader, node[at]], axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: dict[int, list[bytes]] = {}
        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wait.setdefault(k, []).append(body)
        while wait:
            leader, member = tied(wait.popitem()[1])
            yield pa.RecordBatch.from_arrays([pa.array(leader), pa.array(member)], ["leader", "member"])

    blobs = classes.where("n_shingles > 0").select("node", "text").mapInArrow(dealt, "bucket bigint, postings binary")
    found = blobs.repartition(max(least, buckets), "bucket").mapInArrow(met, "leader bigint, member bigint")
    return scratch.keep(found.distinct(), "ties")


def block_links(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) within the blocks of rows (block, node, known, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, nodes, sets, known = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                found = tree.links(sets, percent, np.array(known))
                if found:
                    pairs = np.array(nodes)[np.array(found)]
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            blocks, own, marks = (batch.column(c).to_pylist() for c in range(3))
            for part in tb.blocks(batch.column(3), lower=True):
                owner, keys = shingles(part, width)
                cuts = np.searchsorted(owner, np.arange(part.hi - part.lo + 1))
                for k in range(part.hi - part.lo):
                    row = part.lo + k
                    if blocks[row] != block:
                        yield from done()
                        block, nodes, sets, known = blocks[row], [], [], []
                    nodes.append(own[row])
                    known.append(marks[row])
                    sets.append(keys[cuts[k] : cuts[k + 1]].copy())
        yield from done()

    dealt = rows.repartition("block").sortWithinPartitions("block", "node")
    return dealt.select("block", "node", "known", "text").mapInArrow(run, "a bigint, b bigint")


def find_links(classes: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(node, root) of all classes that are linked with another and aren't their component's smallest node."""
    n = classes.agg(F.sum("n_shingles")).first()[0] or 0
    tie = ties(classes, width, percent, n, frequent_cells(classes, width, n))
    texts = classes.select("node", "text", F.octet_length("text").cast("long").alias("bytes"))
    few = tie.count() <= BROADCAST_TIES
    both = texts.join(F.broadcast(tie) if few else tie, F.col("node") == F.col("member"))
    sizes = both.groupBy("leader").agg(F.count("*").alias("sets"), F.sum("bytes").alias("total"))
    chunks = F.greatest(F.ceil(F.col("sets") / F.lit(BLOCK_SETS)), F.ceil(F.col("total") / F.lit(BLOCK_BYTES)))
    large = scratch.keep(sizes.withColumn("chunks", chunks.cast("long")).where("chunks > 1").select("leader", "chunks"), "large-blocks")
    any_large = large.count() > 0
    if not any_large:
        rows = both.select(F.col("leader").alias("block"), "node", F.col("node").alias("known"), "text")
        return components.components(block_links(rows, width, percent))
    cut = both.join(F.broadcast(large) if few else large, "leader", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks"))
    pivot = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("chunks") * BLOCK_SETS) < PIVOTS
    home = F.when(pivot | (F.col("node") == F.col("leader")), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(chunk))
    rows = cut.select("leader", "node", "text", F.explode(home).alias("chunk"))
    first = scratch.keep(block_links(rows.select(F.xxhash64("leader", "chunk").alias("block"), "node", F.col("node").alias("known"), "text"), width, percent), "links")
    joined = components.components(first)
    # Second round, for cut blocks: sets outside the largest component meet all chunks.
    members = tie.join(large, "leader").join(joined.withColumnRenamed("node", "member"), "member", "left").select("leader", "member", "chunks", F.coalesce("root", "member").alias("known"))
    largest = members.groupBy("leader", "known").count().groupBy("leader").agg(F.max_by("known", F.struct("count", "known")).alias("main"))
    members = scratch.keep(members.join(largest, "leader").withColumn("rest", F.col("known") != F.col("main")), "members")
    rests = members.where("rest").groupBy("leader").agg(F.ceil(F.count("*") / F.lit(BLOCK_SETS)).cast("long").alias("rests"))
    again = members.join(rests, "leader").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks"))).withColumn("own", F.pmod(F.xxhash64(F.lit(2), "member"), F.col("rests")))
    wide = lambda x: F.sequence(F.lit(0).cast("long"), F.col(x) - 1)
    meets = again.select("leader", "member", "known", F.explode(wide("rests")).alias("i"), F.col("chunk").alias("j")).unionByName(again.where("rest").select("leader", "member", "known", F.col("own").alias("i"), F.explode(wide("chunks")).alias("j"))).distinct()
    rows = texts.join(meets, F.col("node") == F.col("member")).select(F.xxhash64("leader", "i", "j").alias("block"), "node", "known", "text")
    second = scratch.keep(block_links(rows, width, percent), "links")
    return components.components(first.unionByName(second))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row for each row: id, n_shingles, component_id (the smallest id that links lead to, its own included)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    classes = make_classes(rows, width)
    roots = find_links(classes, width, percent)
    named = classes.select("digest", "node", "n_shingles").join(roots, "node", "left").select("digest", "n_shingles", F.coalesce("root", "node").alias("component"))
    out = rows.select("id", digest(F.col("text")).alias("digest")).join(named, "digest")
    name = F.when(F.col("n_shingles") == 0, F.col("id")).when(F.col("component") < NO_ID, F.col("component"))
    return out.select(F.col("id").alias(id_col), "n_shingles", name.cast("long").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id. Rows with an empty set all stay."""
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), every)
    classes = make_classes(rows.select("id", "text"), width)
    gone = find_links(classes, width, percent).select("node")
    stay = classes.where("n_shingles > 0").join(gone, "node", "left_anti").select("digest")
    with_digest = rows.select("id", digest(F.col("text")).alias("digest"), "row")
    # Copies are folded before the shuffle, so a text with many of them isn't dealt to one task row by row.
    firsts = with_digest.groupBy("digest").agg(F.min_by("row", F.coalesce("id", F.lit(NO_ID))).alias("row")).join(stay, "digest", "left_semi")
    empty = classes.where("n_shingles = 0").select("digest")
    return firsts.select("row.*").unionByName(with_digest.join(empty, "digest", "left_semi").select("row.*"))
