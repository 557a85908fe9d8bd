"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each node, inner or leaf, gets log-odds of being main text from trees over its subtree's density, its tag and
attribute tokens, its depth and its siblings. Decoding is hierarchical: a node is wholly main text, wholly
not, or mixed and left to its children, whichever gives the greatest total; so no choice contradicts one
above or below it. The model is trained on the driver, once, on TRAINING_PAGES generated pages (a bounded
number, whatever the size of the table), and sent to the executors; it is some kilobytes.

Cases: a null or empty page, or one without text, gives an empty text and 0 characters. Broken markup is
repaired as browsers do, in outline. Repeated rows are extracted alike; there are no ties. An empty table
gives an empty result. Pages of any length are read whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, dom, training_pages

TRAINING_PAGES = 700
#: What a node pays for being mixed, in log-odds, and the most that one node's log-odds count.
MIXED, CLIP = 0.25, 5.0
#: Nodes whose features are held at once.
CHUNK_NODES = 20_000


def marked(node: dom.Node, own: dict[int, int | None]) -> int | None:
    """1 or 0 by the nearest mark at or above; marks below override it. None where the subtree is of both kinds."""
    up = own.get(id(node.parent)) if node.parent else None
    own[id(node)] = int(node.mark) if node.mark is not None else up
    return own[id(node)]


def training_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page in pages:
        nodes = dom.nodes_of(dom.parse(page))
        own: dict[int, int | None] = {}
        for n in nodes:
            marked(n, own)
        kinds: dict[int, set] = {}
        for n in reversed(nodes):
            kinds[id(n)] = {own[id(n)] or 0} if n.tag == "text" else set().union(*(kinds[id(b)] for b in n.below))
        for n, row in zip(nodes, dom.features_of(nodes), strict=True):
            if len(kinds[id(n)]) == 1:
                x.append(row)
                y.append(next(iter(kinds[id(n)])))
    return np.array(x), np.array(y, float)


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES) -> boosting.Trees:
    return boosting.fit(*training_rows(training_pages.make_pages(pages)))


def decode(nodes: list[dom.Node], odds: np.ndarray) -> list[str]:
    """The texts of the leaves that the best consistent choice takes for main text, in page order."""
    odds = np.clip(odds, -CLIP, CLIP).tolist()
    best: dict[int, tuple[float, float, float]] = {}
    for n, s in zip(reversed(nodes), reversed(odds), strict=True):
        below = [best[id(b)] for b in n.below]
        mixed = sum(max(b) for b in below) - MIXED if below else -1e18
        best[id(n)] = (s + sum(b[0] for b in below), -s + sum(b[1] for b in below), mixed)
    taken, chosen = [], {}
    for n in nodes:
        up = chosen.get(id(n.parent), 2) if n.parent else 2
        if up == 2:
            b = best[id(n)]
            up = b.index(max(b))
        chosen[id(n)] = up
        if n.tag == "text" and up == 0:
            taken.append(n.text)
    return taken


def extract_texts(pages: list[str | None], model: boosting.Trees) -> Iterator[str]:
    """The main text of each page: its blocks, parted by an empty line."""
    wait: list[list[dom.Node]] = []
    rows: list[list[float]] = []

    def done() -> Iterator[str]:
        odds = model.log_odds(np.array(rows)) if rows else np.zeros(0)
        at = 0
        for nodes in wait:
            yield "\n\n".join(decode(nodes, odds[at : at + len(nodes)])) if nodes else ""
            at += len(nodes)

    for page in pages:
        nodes = dom.nodes_of(dom.parse(page or ""))
        wait.append(nodes)
        rows += dom.features_of(nodes)
        if len(rows) >= CHUNK_NODES:
            yield from done()
            wait, rows = [], []
    yield from done()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", training: int = TRAINING_PAGES) -> DataFrame:
    """A row for each page: id, url, text, n_chars (code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(trained(training))
    narrow = pages.select(pages[id_col].alias("a"), pages[url_col].alias("b"), pages[html_col].alias("c"))
    a, b = (narrow.schema[k].dataType.simpleString() for k in ("a", "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = list(extract_texts(part.column(2).to_pylist(), shared.value))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["a", "b", "text"])

    out = narrow.mapInArrow(run, f"a {a}, b {b}, text string")
    return out.select(F.col("a").alias(id_col), F.col("b").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
