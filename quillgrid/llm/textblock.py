"""Words and hashes of many texts at once, in numpy.

A block is a run of whole texts in one byte array. Work is done on all words of a block together, so a
block of many short texts costs as little as one long text. Blocks hold about BLOCK bytes; only a single
text that is longer than that makes a larger one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

#: Bytes of a word where words end at ASCII white space: all but 0x09-0x0D and 0x20.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of a word of letters and digits: 0-9, A-Z, a-z and all of 0x80 and above.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[0x30:0x3A] = WORDLIKE[0x41:0x5B] = WORDLIKE[0x61:0x7B] = WORDLIKE[0x80:] = True

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Stretches of more bytes are hashed one by one.
LONG = 256
#: Masks of the first k bytes of a little-endian 64-bit number.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def powers(n: int, back: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse."""
    have = _POWERS[back]
    if len(have) < n:
        size = max(n, BLOCK + 4096)
        have = np.full(size, _BACK if back else _BASE, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * BLOCK:
            _POWERS[back] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which each input bit sways each output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums that ``window`` takes hashes of any stretch from."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * powers(len(values)), out=sums[1:])
    return sums


def window(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], from the sums that ``rolling`` gives.

    For stretches of a few words, whose values are hashes themselves: a polynomial modulo 2**64 is no hash of long
    stretches of few different values.
    """
    raw = (sums[end] - sums[start]) * powers(len(sums), back=True)[start]
    return mixed(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Block:
    """Whole texts ``lo`` to ``hi`` of a batch: ``data`` bytes, text ``i`` at ``offsets[i]:offsets[i + 1]``."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def words(self, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bytes, ends, and each text's first word (one more entry than texts). No word spans two texts."""
        inside = table[self.data]
        if not inside.any():
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self.offsets), np.int64)
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte stretches, eight bytes at a time, each step mixed; of long stretches a part of BLAKE2b."""
        left = ends - starts
        out = mixed(left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        for k in np.flatnonzero(left > LONG).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self.data[starts[k] : ends[k]], digest_size=8).digest(), "little")
        live = np.flatnonzero((left > 0) & (left <= LONG))
        at, left, x = starts[live], left[live], out[live]
        while len(live):
            x = mixed(x ^ (eights[at] & MASKS[np.minimum(left, 8)]))
            out[live] = x
            more = left > 8
            live, at, left, x = live[more], at[more] + 8, left[more] - 8, x[more]
        return out

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each text."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def blocks(texts: pa.Array, lower: bool = False, limit: int = BLOCK) -> Iterator[Block]:
    """The texts in order, in blocks; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, body = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, lo + 65_536, n)
        part = data[offsets[lo] : offsets[hi]]
        yield Block(lo, hi, LOWER[part] if lower else part, offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def owners(firsts: np.ndarray) -> np.ndarray:
    """For firsts of n + 1 entries, the text that each word belongs to."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def sums_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of small integers by owner."""
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64)
