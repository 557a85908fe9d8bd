"""Links within a block of sets, by dual traversal of a signature tree.

Sets that look alike stand side by side; FAN neighbours make a node, FAN nodes a node above, up to one root. A
node holds the OR of its sets' token bitmaps and the range of their sizes. A pair of nodes is given up when
even the greatest overlap that the bitmaps leave open is too small for the smallest sizes, or when the sizes
are too far apart, or when all below both is one component already. What is left at the leaves is verified
on the tokens themselves.
"""

from __future__ import annotations

import numpy as np

BITS = 4096
FAN = 8
#: Node pairs that are tested at once.
WAVE = 4096


class Groups:
    """Union by smallest index."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = int(self.up[k])
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def all(self) -> np.ndarray:
        while True:
            further = self.up[self.up]
            if (further == self.up).all():
                return self.up
            self.up = further


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common entries of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    common = overlap(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITS // 8), np.uint8)
    for lo in range(0, len(sets), 1024):
        part = sets[lo : lo + 1024]
        flags = np.zeros((len(part), BITS), bool)
        flags[np.repeat(np.arange(len(part)), [len(s) for s in part]), (np.concatenate(part) >> np.uint64(17)) % np.uint64(BITS)] = True
        out[lo : lo + 1024] = np.packbits(flags, axis=1)
    return out.view(np.uint64)


def neighbours(sets: list[np.ndarray]) -> np.ndarray:
    """An order in which like sets tend to be close: by least tokens under four hashes."""
    keys = []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        keys.append(np.array([((s ^ np.uint64(salt)) * np.uint64(salt | 1)).min() for s in sets]))
    return np.lexsort((*keys, np.array([s[0] for s in sets])))


def links(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links enough to join all that are alike, directly or through others. ``sets``: sorted, not empty. ``known``: equal for sets that are joined already."""
    n, found = len(sets), []
    groups = Groups(n)
    if known is not None:
        first: dict[int, int] = {}
        for k, c in enumerate(known.tolist()):
            groups.join(first.setdefault(c, k), k)

    def test(a: int, b: int) -> None:
        if groups.find(a) != groups.find(b) and alike(sets[a], sets[b], percent):
            groups.join(a, b)
            found.append((a, b))

    order = neighbours(sets)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        test(a, b)
    ordered = [sets[k] for k in order]
    size = np.array([len(s) for s in ordered])
    bits = bitmaps(ordered)
    slack = size - np.bitwise_count(bits).sum(axis=1)
    levels = [(bits, size, size, slack)]
    while len(levels[-1][0]) > 1:
        bits, low, high, slack = levels[-1]
        at = np.arange(0, len(bits), FAN)
        levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))
    root = np.zeros(1, np.int64)
    stack = [(len(levels) - 1, root, root)]
    uniform: list[np.ndarray] = []
    changed = True
    while stack:
        level, a, b = stack.pop()
        if len(a) > WAVE:
            stack.append((level, a[WAVE:], b[WAVE:]))
            a, b = a[:WAVE], b[:WAVE]
        if changed:  # -1 where a node's sets aren't one component
            own = groups.all()[order]
            uniform = [own]
            while len(uniform[-1]) > 1:
                at = np.arange(0, len(uniform[-1]), FAN)
                low, high = np.minimum.reduceat(uniform[-1], at), np.maximum.reduceat(uniform[-1], at)
                uniform.append(np.where((low == high) & (low >= 0), low, -1))
            changed = False
        bits, low, high, slack = levels[level]
        one = uniform[level]
        live = ~((one[a] >= 0) & (one[a] == one[b])) & (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        a, b = a[live], b[live]
        most = np.bitwise_count(bits[a] & bits[b]).sum(axis=1) + np.minimum(slack[a], slack[b])
        live = (100 + percent) * most >= percent * (low[a] + low[b])
        a, b = a[live], b[live]
        if not level:
            for x, y in zip(order[a].tolist(), order[b].tolist(), strict=True):
                before = len(found)
                if x != y:
                    test(x, y)
                changed |= len(found) > before
            continue
        below = len(levels[level - 1][0])
        step = np.arange(FAN)
        left = (a[:, None, None] * FAN + step[None, :, None] + 0 * step[None, None, :]).ravel()
        right = (b[:, None, None] * FAN + step[None, None, :] + 0 * step[None, :, None]).ravel()
        real = (left < below) & (right < below) & (left <= right)
        if level == 1:
            real &= left < right
        stack.append((level - 1, left[real], right[real]))
    return found
