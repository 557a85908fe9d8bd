"""Number formats of TEXT: one format code, parsed on the driver, as a Column expression.

Sections for positive, negative, zero and text; ``[>=100]`` conditions; colours are dropped; ``0 # ?`` digits,
grouping and scaling commas, percent, scientific, literals, ``@``; date tokens and elapsed hours.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..cells import from_serial
from .math import round_half_away

COLOUR = re.compile(r"\[(?:black|blue|cyan|green|magenta|red|white|yellow|color ?\d+)\]", re.I)
CONDITION = re.compile(r"\[(<>|<=|>=|<|>|=)(-?\d+(?:\.\d+)?)\]")
PIECE = re.compile(r'"([^"]*)"|\\(.)|_(.)|\*(.)|([#0?.,]+)|([eE][+-]0+)|(%)|(.)', re.S)
DATE = re.compile(r'"[^"]*"|\\.|\[h+\]|\[m+\]|\[s+\]|y+|m+|d+|h+|s+|AM/PM|A/P|.', re.I | re.S)


def sections(code: str) -> list[str]:
    return re.findall(r'((?:"[^"]*"|\\.|\[[^\]]*\]|[^;])*)(?:;|\Z)', code)[: code.count(";") + 1]


def is_date(code: str) -> bool:
    bare = re.sub(r'"[^"]*"|\\.', "", COLOUR.sub("", code))
    return re.search(r"[ymdhs]", bare, re.I) is not None and not re.search(r"[0#?]", bare)


def date_text(x: Column, code: str) -> Column:
    day, seconds = from_serial(x), F.round((x - F.floor(x)) * 86400).cast("int")
    total = F.round(x * 86400).cast("long")
    hour, minute, second = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    half = re.search("AM/PM|A/P", code, re.I) is not None
    shown_hour = F.when(F.lit(half), F.when(hour % 12 == 0, 12).otherwise(hour % 12)).otherwise(hour)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0") if n > 1 else c.cast("string")
    parts, tokens = [], DATE.findall(code)
    near = [t for t in tokens if re.fullmatch(r"\[?[hms]+\]?|y+|d+", t, re.I)]
    seen_hour = False
    for k, t in enumerate(tokens):
        low = t.lower()
        after = next((u.lower() for u in tokens[k + 1 :] if u in near), "")
        if low[0] == '"':
            parts.append(F.lit(t[1:-1]))
        elif low[0] == "\\":
            parts.append(F.lit(t[1:]))
        elif low.startswith("[h"):
            parts.append(pad(F.floor(total / 3600), len(low) - 2))
            seen_hour = True
        elif low.startswith("[m"):
            parts.append(pad(F.floor(total / 60), len(low) - 2))
        elif low.startswith("[s"):
            parts.append(pad(total, len(low) - 2))
        elif low[0] == "y":
            parts.append(F.year(day).cast("string") if len(low) > 2 else F.lpad((F.year(day) % 100).cast("string"), 2, "0"))
        elif low in ("am/pm", "a/p"):
            names = ("AM", "PM") if low == "am/pm" else ("A", "P")
            parts.append(F.when(hour < 12, names[0]).otherwise(names[1]))
        elif low[0] == "m" and set(low) == {"m"} and (seen_hour or after.startswith("s")):
            parts.append(pad(minute, len(low)))
            seen_hour = False
        elif low[0] == "m" and set(low) == {"m"}:
            parts.append(pad(F.month(day), len(low)) if len(low) < 3 else F.date_format(day, "MMM" if len(low) == 3 else "MMMM") if len(low) < 5 else F.substring(F.date_format(day, "MMMM"), 1, 1))
        elif low[0] == "d" and set(low) == {"d"}:
            parts.append(pad(F.dayofmonth(day), len(low)) if len(low) < 3 else F.date_format(day, "E" if len(low) == 3 else "EEEE"))
        elif low[0] == "h" and set(low) == {"h"}:
            parts.append(pad(shown_hour, len(low)))
            seen_hour = True
        elif low[0] == "s" and set(low) == {"s"}:
            parts.append(pad(second, len(low)))
        else:
            parts.append(F.lit(t))
    return F.concat(*parts) if parts else F.lit("")


#: Fraction codes aren't modelled; their numbers are shown plain.
FRACTION = re.compile(r"[0#?]\s*/\s*[0-9#?]")


def number_text(x: Column, code: str) -> Column:
    """A number (not negative where the section is for negatives) by one section."""
    if FRACTION.search(re.sub(r'"[^"]*"|\\.', "", code)):
        from ..cells import number_text as plain

        return plain(x)
    pieces = [m.groups() for m in PIECE.finditer(code)]
    digits = "".join(p[4] or "" for p in pieces)
    if not digits and not any(p[5] for p in pieces):
        return F.concat(*[F.lit(p[0] or p[1] or (" " if p[2] else "") or p[6] or p[7] or "") for p in pieces]) if pieces else F.lit("")
    whole, _, part = digits.partition(".")
    scale = len(whole) - len(whole.rstrip(",")) if not part else len(digits) - len(digits.rstrip(","))
    grouped = "," in whole.rstrip(",")
    whole, part = whole.replace(",", ""), part.replace(",", "").replace(".", "")
    x = x / float(1000**scale) if scale else x
    x = x * float(100 ** sum(1 for p in pieces if p[6])) if any(p[6] for p in pieces) else x
    power = next((p[5] for p in pieces if p[5]), None)
    exponent = None
    if power:
        exponent = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
        x = x / F.pow(F.lit(10.0), exponent)
    shown = F.format_string(f"%{',' if grouped else ''}.{len(part)}f", round_half_away(F.abs(x), len(part)))
    needed = part.count("0")
    if len(part) > needed:
        shown = F.regexp_replace(shown, rf"(\.\d{{{needed}}}\d*?)0+$", "$1")
        shown = F.regexp_replace(shown, r"\.$", "")
    if "." in digits and not part:
        shown = F.concat(shown, F.lit("."))
    least = whole.count("0")
    head = F.regexp_extract(shown, r"^[^.]*", 0)
    tail = F.substring(shown, F.char_length(head) + 1, F.char_length(shown))
    if least == 0:
        head = F.when(head == "0", "").otherwise(head)
    elif least > 1:
        head = F.when(F.char_length(head) < least, F.lpad(head, least, "0")).otherwise(head)
    sign = F.when(x < 0, "-").otherwise("")
    body = F.concat(head, tail)
    out, placed = [], False
    for quoted, escaped, gap, _, run, e, percent, other in pieces:
        if run:
            if not placed:
                out.append(body)
            placed = True
        elif e:
            mark = F.when(exponent < 0, "-").otherwise("+" if "+" in e else "")
            out.append(F.concat(F.lit(e[0]), mark, F.lpad(F.abs(exponent).cast("string"), len(e) - 2, "0")))
        else:
            out.append(F.lit(quoted or escaped or (" " if gap else "") or percent or other or ""))
    return F.concat(sign, *out)


def text(x: Column, code: str) -> Column:
    """``TEXT(x, code)`` of a number column."""
    if code.strip().lower() in ("general", ""):
        from ..cells import number_text as plain

        return plain(x)
    parts = [COLOUR.sub("", s) for s in sections(code)]
    one = lambda v, c: date_text(v, c) if is_date(c) else number_text(v, c)
    conditions = [CONDITION.search(p) for p in parts]
    if any(conditions):
        out, rest = None, None
        ops = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        for p, m in zip(parts, conditions, strict=True):
            shown = one(x, CONDITION.sub("", p))
            if m:
                test = ops[m[1]](x, F.lit(float(m[2])))
                out = F.when(test, shown) if out is None else out.when(test, shown)
            elif rest is None:
                rest = shown
        return out.otherwise(rest if rest is not None else F.lit("########"))
    if len(parts) == 1:
        return one(x, parts[0])
    minus = one(F.abs(x), parts[1])
    zero = one(x, parts[2]) if len(parts) > 2 and parts[2] else one(x, parts[0])
    return F.when(x < 0, minus).when(x == 0, zero).otherwise(one(x, parts[0]))
