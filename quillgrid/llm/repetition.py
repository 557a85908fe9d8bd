"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths find, inside each text, the n-grams and lines that occur twice or
more; a text is rejected when too large a share of its characters lies inside them.

Cases: a null or empty text, or one of white space only, has no words; it fails the base rule (fewer words
than ``min_words``) and all its counts are 0. Repeated rows are judged each on its own and alike; there are
no ties. An empty table gives an empty table. Columns other than the text are passed through or ignored, so
their names and nulls don't matter. A text of any length is judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textblock as tb

#: n-gram lengths in words, and the share in percent of a text's word characters that may lie inside repeated ones.
NGRAM_LIMITS = {5: 40, 6: 38, 7: 36, 8: 34, 9: 32, 10: 30}
#: The share in percent of word characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 30
MIN_WORDS = 20
BASE_WINDOW, BASE_LIMIT = 8, 30
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "worst_ngram_percent")


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(again, keys)
    at[at == len(again)] = 0
    return again[at] == keys


def later(keys: np.ndarray) -> np.ndarray:
    """Which keys are equal to an earlier one."""
    out = np.ones(len(keys), bool)
    out[np.unique(keys, return_index=True)[1]] = False
    return out


def covered(n_words: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in one of the windows."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + length, -1)
    return np.cumsum(steps[:-1]) > 0


def measure(block: tb.Block) -> dict[str, np.ndarray]:
    """Per text: MEASURES and, as ``ngram_percent_<n>``, the covered share for each n-gram length."""
    n = block.hi - block.lo
    starts, ends, firsts = block.words()
    owner = tb.owners(firsts)
    point = (block.data & 0xC0) != 0x80
    points = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(point, out=points[1:])
    chars = points[ends] - points[starts]
    out = {"n_words": np.diff(firsts), "word_chars": tb.sums_by(owner, chars, n)}
    out["n_symbols"] = block.per_text(np.isin(block.data, np.frombuffer(SYMBOLS, np.uint8)))
    total = np.maximum(out["word_chars"], 1)

    # Lines that hold a word.
    edge = np.zeros(len(block.data) + 1, bool)
    edge[block.offsets] = True
    edge[1:][block.data == 10] = True
    line_starts = np.flatnonzero(edge[:-1])
    line_ends = np.append(line_starts[1:], len(block.data))[: len(line_starts)]
    if len(line_starts):
        line_ends = np.where(block.data[line_ends - 1] == 10, line_ends - 1, line_ends)
    first_word = np.searchsorted(starts, line_starts)
    past_word = np.searchsorted(starts, line_ends)
    full = past_word > first_word
    line_starts, line_ends, first_word, past_word = line_starts[full], line_ends[full], first_word[full], past_word[full]
    line_owner = np.searchsorted(block.offsets, line_starts, "right") - 1
    again = later(tb.mixed(block.hashes(line_starts, line_ends) ^ tb.mixed(line_owner.astype(np.uint64)))) if len(line_starts) else np.zeros(0, bool)
    out["n_dup_lines"] = tb.sums_by(line_owner, again, n)
    sums = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=sums[1:])
    out["dup_line_chars"] = tb.sums_by(line_owner, np.where(again, sums[past_word] - sums[first_word], 0), n)

    # n-grams, shortest first: a repeated long one starts where a repeated short one does.
    rolls = tb.rolling(block.hashes(starts, ends))
    salt = tb.mixed(owner.astype(np.uint64))
    past = firsts[1:][owner]
    at = np.arange(len(starts))
    worst = np.zeros(n)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    for length in sorted(NGRAM_LIMITS | {BASE_WINDOW: 0}):
        at = at[at + length <= past[at]]
        if len(at):
            at = at[repeated(tb.mixed(tb.window(rolls, at, at + length) ^ salt[at]))]
        inside = covered(len(starts), at, length)
        share = 100 * tb.sums_by(owner, chars * inside, n) / total
        out[f"ngram_percent_{length}"] = share
        if length == BASE_WINDOW:
            out["n_repeat_words"] = tb.sums_by(owner, inside, n)
        if length in NGRAM_LIMITS:
            worst = np.maximum(worst, share - NGRAM_LIMITS[length])
    out["worst_ngram_percent"] = worst
    return out


def judge(m: dict[str, np.ndarray], min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Which texts fail the base rule, and which are kept."""
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > BASE_LIMIT * m["n_words"])
    over_lines = 100 * m["dup_line_chars"] > LINE_LIMIT * m["word_chars"]
    return failed, ~failed & ~over_lines & (m["worst_ngram_percent"] <= 0)


def _judged(batch: pa.RecordBatch, text: str, min_words: int) -> Iterator[tuple[tb.Block, dict, np.ndarray, np.ndarray]]:
    for block in tb.blocks(batch.column(text)):
        m = measure(block)
        yield block, m, *judge(m, min_words)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Each row's id, its base counts, ``dup_line_chars``, the coverage of each n-gram length, ``base_failed`` and ``kept``."""
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    grams = sorted(NGRAM_LIMITS)
    longs = [*MEASURES[:-1]]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{k} bigint" for k in longs) + ", " + ", ".join(f"ngram_percent_{n} double" for n in grams) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, m, failed, kept in _judged(batch, "text", min_words):
                columns = [batch.column("id").slice(block.lo, block.hi - block.lo)]
                columns += [pa.array(m[k].astype(np.int64)) for k in longs] + [pa.array(m[f"ngram_percent_{n}"]) for n in grams]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(kept)], [id_col, *longs, *(f"ngram_percent_{n}" for n in grams), "base_failed", "kept"])

    return narrow.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [judge(measure(block), min_words)[1] for block in tb.blocks(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
