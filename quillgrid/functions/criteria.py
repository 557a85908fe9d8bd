"""The criteria of COUNTIF and its kin, as a condition on a column.

``<> >= <= > < =`` and an operand, else equality. A numeric operand compares numbers, TRUE and FALSE compare
booleans, other text compares text without case; equality knows ``*``, ``?`` and ``~``. Errors never match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import cells
from .text import glob_regex, has_glob

_OPS = re.compile(r"(<>|>=|<=|>|<|=)?(.*)", re.S)


def parse(criterion: object) -> tuple[str, object]:
    """Operator and operand: a float, a bool, or text."""
    if isinstance(criterion, bool):
        return "=", criterion
    if isinstance(criterion, (int, float)):
        return "=", float(criterion)
    op, operand = _OPS.fullmatch(str(criterion)).groups()
    text = operand.strip()
    if text.upper() in ("TRUE", "FALSE"):
        return op or "=", text.upper() == "TRUE"
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return op or "=", float(text)
    return op or "=", operand


def matches(c: Column, kind: T.DataType, criterion: object) -> Column:
    """Never NULL: cells that don't fit are false."""
    op, want = parse(criterion)
    k = cells.kind_of(kind)
    false = F.lit(False)
    empty = c.isNull()
    number = cells.numbers(c, kind) if k in ("number", "date", "mixed") else F.lit(None).cast("double")
    if k == "text":
        text, truth = c, F.lit(None).cast("boolean")
    elif k == "bool":
        text, truth = F.lit(None).cast("string"), c
    elif k == "mixed":
        text, truth = F.when(c["tag"] == cells.TEXT, c["str"]), F.when(c["tag"] == cells.BOOL, c["num"] != 0)
    else:
        text, truth = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    failed = cells.errors(c, kind).isNotNull()
    if isinstance(want, bool):
        equal = F.coalesce(truth == want, false)
        return equal if op == "=" else ~equal & ~failed if op == "<>" else false
    if isinstance(want, float):
        order = {"=": number == want, "<": number < want, "<=": number <= want, ">": number > want, ">=": number >= want}
        if op == "<>":
            return ~F.coalesce(number == want, false) & ~failed
        return F.coalesce(order[op] & ~F.isnan(number), false)
    folded, low = F.lower(text), want.lower()
    if op in ("=", "<>"):
        if want == "":
            equal = empty | F.coalesce(text == "", false)
        elif has_glob(want):
            equal = F.coalesce(folded.rlike("(?s)^(?:" + glob_regex(low) + r")\z"), false)
        else:
            equal = F.coalesce(folded == low, false)
        return equal if op == "=" else ~equal & ~failed
    order = {"<": folded < low, "<=": folded <= low, ">": folded > low, ">=": folded >= low}[op]
    below = number.isNotNull() if op in ("<", "<=") else false
    return F.coalesce(order, false) | F.coalesce(below, false)


# -- criteria that a column holds

NUMERIC = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def wanted(c: Column, kind: str) -> Column:
    """A criterion in one spelling: ``n:`` and a number, ``b:`` and a boolean, ``t:`` and a text in lower case, or ``o:`` and what needs parsing."""
    number = lambda x: F.concat(F.lit("n:"), F.when(x == 0, 0.0).otherwise(x).cast("string"))
    if kind != "text":
        return number(c)
    bare = F.lower(F.regexp_replace(c, "^=", ""))
    special = F.regexp_replace(c, "^=", "").rlike("^[<>=]|[*?~]") | (bare == "")
    return F.when(special, F.concat(F.lit("o:"), F.lower(c))).when(bare.rlike(NUMERIC), number(bare.try_cast("double"))).when(F.trim(bare).isin("true", "false"), F.concat(F.lit("b:"), F.trim(bare))).otherwise(F.concat(F.lit("t:"), bare))


def is_equality(spelling: Column) -> Column:
    return ~spelling.startswith("o:")


def equal_key(c: Column, kind: T.DataType) -> Column:
    """The spelling of the criterion that a cell equals; NULL for empty cells and errors."""
    k = cells.kind_of(kind)
    number = lambda x: F.concat(F.lit("n:"), F.when(x == 0, 0.0).otherwise(x).cast("string"))
    truth = lambda x: F.concat(F.lit("b:"), x.cast("string"))
    if k == "mixed":
        return F.when(c["tag"] == cells.NUMBER, number(c["num"])).when(c["tag"] == cells.BOOL, truth(c["num"] != 0)).when(c["tag"] == cells.TEXT, F.concat(F.lit("t:"), F.lower(c["str"])))
    return truth(c) if k == "bool" else F.concat(F.lit("t:"), F.lower(c)) if k == "text" else number(cells.numbers(c, kind))


def spelled(spelling: str) -> object:
    """The criterion behind a spelling, as ``matches`` takes it."""
    kind, body = spelling[:2], spelling[2:]
    return float(body) if kind == "n:" else body == "true" if kind == "b:" else body
