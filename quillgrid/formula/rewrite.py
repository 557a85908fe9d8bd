"""Formula text under structural edits and filling: references are moved in the text, the rest stays as typed."""

from __future__ import annotations

import re
from collections.abc import Callable

from .parser import column_letters, column_number

PIECE = re.compile(r"""("(?:[^"]|"")*")|((?:'(?:[^']|'')+'|[A-Za-z_][\w.]*)!)?(\$?)([A-Za-z]{1,3})(\$?)([1-9]\d*)(?::(\$?)([A-Za-z]{1,3})(\$?)([1-9]\d*))?(?![\w(.])""")


def _each(formula: str, change: Callable[[str | None, list[tuple[bool, int, bool, int]]], list[tuple[bool, int, bool, int]] | None]) -> str:
    def one(m: re.Match) -> str:
        if m[1] or (m.start() and re.match(r"[\w.$]", formula[m.start() - 1])):
            return m[0]
        ends = [(bool(m[3]), column_number(m[4]), bool(m[5]), int(m[6]) - 1)]
        if m[8]:
            ends.append((bool(m[7]), column_number(m[8]), bool(m[9]), int(m[10]) - 1))
        sheet = m[2][:-1].strip("'").replace("''", "'") if m[2] else None
        new = change(sheet, ends)
        if new is None:
            return "#REF!"
        return (m[2] or "") + ":".join(f"{'$' * pc}{column_letters(c)}{'$' * pr}{r + 1}" for pc, c, pr, r in new)

    return PIECE.sub(one, formula)


def filled(formula: str, down: int, right: int) -> str:
    """As it reads after a fill: relative parts move, pinned ones stay; off the sheet is #REF!."""

    def change(_, ends):
        new = [(pc, c if pc else c + right, pr, r if pr else r + down) for pc, c, pr, r in ends]
        return None if any(c < 0 or r < 0 for _, c, _, r in new) else new

    return _each(formula, change)


def _moved(at: int, count: int, delete: bool) -> Callable[[int], int | None]:
    if not delete:
        return lambda k: k + count if k >= at else k
    return lambda k: k - count if k >= at + count else None if k >= at else k


def edited(formula: str, home: str, sheet: str, axis: str, at: int, count: int, delete: bool = False) -> str:
    """After ``count`` rows or columns were put in (or taken out) at place ``at`` of ``sheet``; pins don't hold against that.

    A range is moved as a whole: one that loses an end shrinks to what is left of it; one wholly gone is #REF!.
    """
    move = _moved(at, count, delete)

    def change(own, ends):
        if (own or home).lower() != sheet.lower():
            return ends
        places = [e[3] if axis == "row" else e[1] for e in ends]
        new = [move(k) for k in places]
        if len(ends) == 2 and delete:
            low, high = (0, 1) if places[0] <= places[1] else (1, 0)
            if new[low] is None:
                new[low] = at
            if new[high] is None:
                new[high] = at - 1
            if new[low] > new[high]:
                return None
        if any(k is None for k in new):
            return None
        return [(pc, c, pr, k) if axis == "row" else (pc, k, pr, r) for (pc, c, pr, r), k in zip(ends, new, strict=True)]

    return _each(formula, change)


def permuted(formula: str, home: str, sheet: str, to: dict[int, int]) -> str:
    """After the columns of ``sheet`` changed places. A range follows where its columns stay side by side, else it keeps its place."""

    def change(own, ends):
        if (own or home).lower() != sheet.lower():
            return ends
        if len(ends) == 1:
            (pc, c, pr, r), = ends
            return [(pc, to.get(c, c), pr, r)]
        low, high = sorted(e[1] for e in ends)
        new = sorted(to.get(c, c) for c in range(low, high + 1))
        if new[-1] - new[0] != high - low:
            return ends
        return [(pc, new[0] if c == low else new[-1], pr, r) for pc, c, pr, r in ends]

    return _each(formula, change)


def cut_to(formula: str, home: str, sheet: str, box: tuple[int, int, int, int], down: int, right: int) -> str:
    """After the cells of ``box`` (rows, columns, ends included) were cut and put elsewhere: references wholly inside follow."""

    def change(own, ends):
        inside = all(box[0] <= r <= box[1] and box[2] <= c <= box[3] for _, c, _, r in ends)
        if (own or home).lower() != sheet.lower() or not inside:
            return ends
        return [(pc, c + right, pr, r + down) for pc, c, pr, r in ends]

    return _each(formula, change)


def renamed(formula: str, old: str, new: str) -> str:
    """After a sheet was renamed."""
    quoted = new if re.fullmatch(r"[A-Za-z_][\w.]*", new) else "'" + new.replace("'", "''") + "'"
    pattern = re.compile(r"(\"(?:[^\"]|\"\")*\")|(?<![\w.'])(?:'" + re.escape(old.replace("'", "''")) + r"'|" + re.escape(old) + r")!", re.I)
    return pattern.sub(lambda m: m[1] or quoted + "!", formula)


def deleted_sheet(formula: str, gone: str) -> str:
    """After a sheet was deleted: references to it are #REF!."""
    return _each(formula, lambda own, ends: None if own and own.lower() == gone.lower() else ends)


def cycle_anchor(reference: str) -> str:
    """A1 -> $A$1 -> A$1 -> $A1 -> A1."""
    m = re.fullmatch(r"(\$?)([A-Za-z]+)(\$?)(\d+)", reference)
    if not m:
        return reference
    order = [("", ""), ("$", "$"), ("", "$"), ("$", "")]
    a, b = order[(order.index((m[1], m[3])) + 1) % 4]
    return f"{a}{m[2]}{b}{m[4]}"
