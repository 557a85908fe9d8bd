"""Text functions of formulas over Columns. Positions count characters from 1."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The most bytes that REPT gives.
REPT_LIMIT = 32_767


def left(s: Column, n: Column) -> Column:
    return F.substring(s, F.lit(1), n.cast("int"))


def right(s: Column, n: Column) -> Column:
    n = n.cast("int")
    return F.when(n <= 0, "").otherwise(F.substring(s, F.greatest(F.char_length(s) - n + 1, F.lit(1)), n))


def mid(s: Column, start: Column, n: Column) -> Column:
    return F.substring(s, start.cast("int"), n.cast("int"))


def proper(s: Column) -> Column:
    """A letter after anything but a letter in upper case, all others in lower case."""
    runs = F.regexp_extract_all(s, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.char_length(r))))), "")


def trim(s: Column) -> Column:
    """Spaces only: none at the ends, one between words."""
    return F.regexp_replace(F.regexp_replace(s, "^ +| +$", ""), " +", " ")


def clean(s: Column) -> Column:
    return F.regexp_replace(s, r"[\x00-\x1F]", "")


def substitute(s: Column, old: Column, new: Column, nth: int | None = None) -> Column:
    """All instances, or only the ``nth``; case counts; an empty ``old`` changes nothing."""
    if nth is None:
        return F.when(old == "", s).otherwise(F.replace(s, old, new))
    parts = F.split(s, F.concat(F.lit("\\Q"), F.replace(old, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    joined = F.concat(F.array_join(F.slice(parts, 1, nth), "\u0000"), new, F.array_join(F.slice(parts, F.lit(nth + 1), F.size(parts)), "\u0000"))
    return F.when((old == "") | (F.size(parts) <= nth), s).otherwise(F.replace(joined, F.lit("\u0000"), old))


def replace_at(s: Column, start: Column, n: Column, new: Column) -> Column:
    start, n = start.cast("int"), n.cast("int")
    return F.concat(F.substring(s, F.lit(1), start - 1), new, F.substring(s, start + n, F.char_length(s)))


def find(needle: Column, s: Column, start: Column | int = 1) -> Column:
    """Place of the first instance from ``start`` on, case counts; NULL for none."""
    at = F.position(needle, s, F.lit(start) if isinstance(start, int) else start.cast("int"))
    return F.when(at > 0, at)


def glob_regex(pattern: str) -> str:
    """A regular expression for ``*``, ``?`` and ``~`` as escape."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "~" and k + 1 < len(pattern) and pattern[k + 1] in "*?~":
            k += 1
            out += re.escape(pattern[k])
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        k += 1
    return out


def has_glob(pattern: str) -> bool:
    return re.search(r"(?<!~)[*?]|~[*?~]", pattern) is not None


def glob_pattern(needle: Column) -> Column:
    """``glob_regex`` of a column."""
    # Escaped wildcards and escapes are set aside under private characters while the rest is translated.
    out = needle
    for k, c in enumerate("*?~"):
        out = F.replace(out, F.lit("~" + c), F.lit(chr(0xE000 + k)))
    out = F.regexp_replace(out, r"([\\.\[\]{}()+^$|#&-])", r"\\$1")
    out = F.replace(F.replace(out, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit("."))
    for k, c in enumerate((r"\*", r"\?", "~")):
        out = F.replace(out, F.lit(chr(0xE000 + k)), F.lit(c))
    return out


def search(needle: str | Column, s: Column, start: int | Column = 1) -> Column:
    """Place of the first match from ``start`` on, case ignored, with wildcards; NULL for none."""
    pattern = F.lit("(?is)" + glob_regex(needle)) if isinstance(needle, str) else F.concat(F.lit("(?is)"), glob_pattern(needle))
    first = F.lit(start) if isinstance(start, int) else F.floor(start).cast("int")
    at = F.regexp_instr(F.substring(s, F.greatest(first, F.lit(1)), F.char_length(s)), pattern)
    return F.when((at > 0) & (first >= 1), at + (first - 1))


def value(s: Column) -> Column:
    """Number in a text with currency signs, grouping, a percent sign or brackets for minus; NULL if it isn't one."""
    t = F.regexp_replace(s, r"[\s$, ]", "")
    minus = t.rlike(r"^\(.*\)$")
    t = F.regexp_replace(t, r"^\((.*)\)$", "$1")
    percent = t.endswith("%")
    x = F.when(~t.rlike("[dDfFxX]"), F.regexp_replace(t, "%$", "").try_cast("double"))
    return x / F.when(percent, 100.0).otherwise(1.0) * F.when(minus, -1.0).otherwise(1.0)


def textjoin(delimiter: str, parts: list[Column], skip_empty: bool = True) -> Column:
    if skip_empty:
        return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), delimiter)
    return F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), delimiter)
