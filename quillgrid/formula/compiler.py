"""Trees to Spark plans.

A scalar formula becomes a one-row frame (value, error): its ranges are aggregated in one pass over each
sheet. A formula filled down becomes columns of its sheet: relative cells are columns, shifted cells and moving
ranges are windows over row blocks, ranges pinned at their start are running totals, and lookups or criteria
that depend on the row are joins. Every part is a value and an error column; the left error wins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import cells
from ..cells import DIV0, NA, NUM, REF, VALUE
from ..functions import criteria, dates, math, numfmt, stats, text
from ..operators import lookups, positional
from . import parser as p


@dataclass
class V:
    """A value: ``kind`` number, text, bool, or blank; NULL is an empty cell."""

    col: Column
    kind: str
    err: Column | None = None

    def number(self) -> V:
        if self.kind == "number":
            return self if self.err is not None else V(self.col, "number")
        if self.kind == "bool":
            return V(self.col.cast("int").cast("double"), "number", self.err)
        if self.kind == "blank":
            return V(F.lit(0.0), "number", self.err)
        x = self.col.try_cast("double")
        return V(x, "number", first_error(self.err, F.when(self.col.isNotNull() & x.isNull(), VALUE)))

    def filled(self) -> Column:
        return F.coalesce(self.number().col, F.lit(0.0))

    def text(self) -> Column:
        if self.kind == "text":
            return F.coalesce(self.col, F.lit(""))
        if self.kind == "bool":
            return F.when(self.col, "TRUE").when(~self.col, "FALSE").otherwise("")
        return F.coalesce(cells.number_text(self.col), F.lit("")) if self.kind == "number" else F.lit("")

    def truth(self) -> tuple[Column, Column | None]:
        if self.kind == "bool":
            return F.coalesce(self.col, F.lit(False)), self.err
        if self.kind == "text":
            return F.lit(False), first_error(self.err, F.when(self.col.isNotNull(), VALUE))
        return (F.coalesce(self.col, F.lit(0.0)) != 0) if self.kind == "number" else F.lit(False), self.err


def first_error(*errors: Column | None) -> Column | None:
    real = [e for e in errors if e is not None]
    return None if not real else real[0] if len(real) == 1 else F.coalesce(*real)


def clean(v: V) -> V:
    """The value is NULL wherever there is an error."""
    return v if v.err is None else V(F.when(v.err.isNull(), v.col), v.kind, v.err)


class Sheets:
    """Named frames in tab order. Columns stand for A, B, ... in the frame's order, without the row column."""

    def __init__(self, frames: dict[str, DataFrame], row: str = "_row"):
        self.frames, self.row = dict(frames), row

    def columns(self, sheet: str) -> list[str]:
        return [c for c in self.frames[sheet].columns if c != self.row]

    def run(self, first: str, last: str) -> list[str]:
        names = list(self.frames)
        if first not in names or last not in names:
            return []
        a, b = sorted((names.index(first), names.index(last)))
        return names[a : b + 1]


MOST_INDIRECT = 16
MOST_HOLIDAYS = 3_000_000
#: Criteria other than plain equality that a column of criteria may hold, each distinct one once.
MOST_CRITERIA = 1_000
AGGREGATES = {"SUM", "COUNT", "AVERAGE", "MIN", "MAX", "MEDIAN", "STDEV.P", "STDEV.S", "VAR.P", "VAR.S", "PERCENTILE.INC", "PERCENTILE", "QUARTILE.INC", "QUARTILE", "LARGE", "SMALL", "MODE", "MODE.SNGL", "RANK", "RANK.EQ", "STDEV", "VAR", "STDEVP", "VARP"}
CRITERIA = {"SUMIF", "COUNTIF", "AVERAGEIF", "SUMIFS", "COUNTIFS", "AVERAGEIFS"}
LOOKUPS = {"VLOOKUP", "HLOOKUP", "MATCH", "INDEX", "XLOOKUP"}
ALIASES = {"PERCENTILE": "PERCENTILE.INC", "QUARTILE": "QUARTILE.INC", "MODE": "MODE.SNGL", "RANK": "RANK.EQ", "STDEV": "STDEV.S", "VAR": "VAR.S", "STDEVP": "STDEV.P", "VARP": "VAR.P"}


class Compiler:
    """Common to both forms: operators and scalar functions. The forms add cells, ranges and what reads them."""

    def __init__(self, sheets: Sheets, home: str):
        self.sheets, self.home, self.home_of_cells = sheets, home, home

    # -- trees

    def settled(self, node) -> V:
        """The value of a whole formula; a bad reference, or the error of an argument worked out beforehand, is its value."""
        try:
            return clean(self.value(node))
        except KeyError as e:
            return V(F.lit(None).cast("double"), "number", F.lit(e.args[0] if e.args and e.args[0] in cells.ERRORS else REF))

    def value(self, node) -> V:
        if isinstance(node, p.Num):
            return V(F.lit(node.value), "number")
        if isinstance(node, p.Str):
            return V(F.lit(node.value), "text")
        if isinstance(node, p.Bool):
            return V(F.lit(node.value), "bool")
        if isinstance(node, p.Missing):
            return V(F.lit(None).cast("double"), "blank")
        if isinstance(node, p.Err):
            return V(F.lit(None).cast("double"), "number", F.lit(node.value))
        if isinstance(node, (p.Name, p.Lambda)):
            return V(F.lit(None).cast("double"), "number", F.lit(VALUE))
        if isinstance(node, p.Unary):
            return self.unary(node)
        if isinstance(node, p.Binary):
            return self.binary(node)
        if isinstance(node, p.Call):
            return self.call(node.name, node.args)
        if isinstance(node, p.Ref):
            return self.cell(node)
        return self.cell(node.first) if node.first == node.last else V(F.lit(None).cast("double"), "number", F.lit(VALUE))

    def unary(self, node: p.Unary) -> V:
        if node.op == "@":
            return self.value(node.arg.first if isinstance(node.arg, p.Range) else node.arg)
        v = self.value(node.arg).number()
        return V(-v.filled() if node.op == "-" else v.filled() / 100, "number", v.err)

    def binary(self, node: p.Binary) -> V:
        a, b = self.value(node.left), self.value(node.right)
        if node.op == "&":
            return V(F.concat(a.text(), b.text()), "text", first_error(a.err, b.err))
        if node.op in ("=", "<>", "<", "<=", ">", ">="):
            return V(self.compared(node.op, a, b), "bool", first_error(a.err, b.err))
        a, b = a.number(), b.number()
        x, y, err = a.filled(), b.filled(), None
        if node.op == "/":
            out, err = math.divide(x, y)
        elif node.op == "^":
            out, err = math.power(x, y)
        else:
            out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[node.op]()
        return V(out, "number", first_error(a.err, b.err, err))

    def compared(self, op: str, a: V, b: V) -> Column:
        """Numbers below text below booleans; text without case; an empty cell is 0, "" or FALSE as its partner asks."""
        ranks = {"number": 0, "blank": 0, "text": 1, "bool": 2}
        if "blank" in (a.kind, b.kind):
            a, b = (V({"number": F.lit(0.0), "text": F.lit(""), "bool": F.lit(False), "blank": F.lit(0.0)}[o.kind], o.kind if o.kind != "blank" else "number") if v.kind == "blank" else v for v, o in ((a, b), (b, a)))
        if a.kind == b.kind:
            get = {"number": V.filled, "text": lambda v: F.lower(v.text()), "bool": lambda v: F.coalesce(v.col, F.lit(False))}[a.kind]
            x, y = get(a), get(b)
        else:
            x, y = F.lit(ranks[a.kind]), F.lit(ranks[b.kind])
        return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    # -- calls

    def call(self, name: str, args: tuple) -> V:
        name = ALIASES.get(name, name)
        if name in AGGREGATES:
            return self.aggregate(name, args)
        if name in CRITERIA:
            return self.conditional(name, args)
        if name in LOOKUPS:
            return self.lookup(name, args)
        method = getattr(self, "f_" + name.lower().replace(".", "_"), None)
        if method:
            return method(*args)
        known = SIMPLE.get(name)
        if known is None:
            return V(F.lit(None).cast("double"), "number", F.lit(cells.NAME))
        least, most, kinds, made = known
        if not least <= len(args) <= most:
            return V(F.lit(None).cast("double"), "number", F.lit(VALUE))
        values, errors = [], []
        for k, a in enumerate(args):
            v = self.value(a)
            want = kinds[min(k, len(kinds) - 1)]
            if want == "n":
                v = v.number()
                values.append(v.filled())
            elif want == "d":
                v = v.number()
                values.append(cells.from_serial(v.filled()))
            else:
                values.append(v.text())
            errors.append(v.err)
        out = made(*values)
        kind = "number"
        if isinstance(out, V):
            return clean(V(out.col, out.kind, first_error(*errors, out.err)))
        if isinstance(out, tuple):
            out, err = out
            errors.append(err)
        return clean(V(out, kind, first_error(*errors)))

    def f_if(self, test, yes, no=None) -> V:
        c, err = self.value(test).truth()
        a, b = self.value(yes), self.value(no) if no is not None else V(F.lit(False), "bool")
        a, b = (V(F.lit(0.0), "number") if v.kind == "blank" else v for v in (a, b))
        if a.kind != b.kind:
            a, b = self.same_kind(a, b)
        picked = F.when(c, F.lit(None) if a.err is None else a.err).otherwise(F.lit(None) if b.err is None else b.err)
        return V(F.when(c, a.col).otherwise(b.col), a.kind, first_error(err, picked if a.err is not None or b.err is not None else None))

    def same_kind(self, a: V, b: V) -> tuple[V, V]:
        """Two values in one column: a pure error fits any kind; number and bool meet as numbers, else all is text."""
        if {a.kind, b.kind} == {"number", "bool"}:
            return a.number(), b.number()
        return V(a.text(), "text", a.err), V(b.text(), "text", b.err)

    def f_and(self, *args) -> V:
        return self.joined_truth(args, lambda x, y: x & y)

    def f_or(self, *args) -> V:
        return self.joined_truth(args, lambda x, y: x | y)

    def joined_truth(self, args, how) -> V:
        truths = [self.value(a).truth() for a in args]
        return V(reduce(how, [t for t, _ in truths]), "bool", first_error(*[e for _, e in truths]))

    def f_not(self, arg) -> V:
        t, err = self.value(arg).truth()
        return V(~t, "bool", err)

    def rescued(self, arg, other, which: Column | None, v: V) -> V:
        o = self.value(other)
        if v.err is None:
            return v
        bad = v.err.isNotNull() if which is None else F.coalesce(which, F.lit(False))
        if v.kind != o.kind and o.kind != "blank":
            v, o = self.same_kind(v, o)
        fallback = F.lit(None) if o.kind == "blank" else o.col
        err = F.when(bad, F.lit(None).cast("string") if o.err is None else o.err).otherwise(v.err)
        return V(F.when(bad, fallback).otherwise(v.col), v.kind, err if which is not None or o.err is not None else None)

    def f_iferror(self, arg, other) -> V:
        return self.rescued(arg, other, None, self.value(arg))

    def f_ifna(self, arg, other) -> V:
        v = self.value(arg)
        return self.rescued(arg, other, None if v.err is None else v.err == NA, v)

    def f_na(self) -> V:
        return V(F.lit(None).cast("double"), "number", F.lit(NA))

    def tested(self, arg, on_value: str | None, on_error) -> V:
        v = self.value(arg)
        failed = F.lit(False) if v.err is None else F.coalesce(on_error(v.err), F.lit(False))
        any_error = F.lit(False) if v.err is None else v.err.isNotNull()
        if on_value is None:
            return V(failed, "bool")
        held = F.lit(v.kind == on_value) & v.col.isNotNull() & ~any_error
        return V(held, "bool")

    def f_isblank(self, arg) -> V:
        v = self.value(arg)
        return V(v.col.isNull() & (v.err.isNull() if v.err is not None else F.lit(True)), "bool")

    def f_isnumber(self, arg) -> V:
        return self.tested(arg, "number", lambda e: e.isNotNull())

    def f_istext(self, arg) -> V:
        return self.tested(arg, "text", lambda e: e.isNotNull())

    def f_iserror(self, arg) -> V:
        return self.tested(arg, None, lambda e: e.isNotNull())

    def f_iserr(self, arg) -> V:
        return self.tested(arg, None, lambda e: e.isNotNull() & (e != NA))

    def f_isna(self, arg) -> V:
        return self.tested(arg, None, lambda e: e == NA)

    def f_error_type(self, arg) -> V:
        v = self.value(arg)
        if v.err is None:
            return self.f_na()
        t = math.error_type(v.err)
        return V(t.cast("double"), "number", F.when(t.isNull(), NA))

    def f_choose(self, at, *args) -> V:
        k = self.value(at).number()
        vs = [self.value(a) for a in args]
        if len({v.kind for v in vs}) > 1:
            vs = [V(v.text(), "text", v.err) for v in vs]
        out, err = F.when(F.lit(False), vs[0].col), F.when(F.lit(False), F.lit(VALUE))
        for n, v in enumerate(vs, 1):
            out = out.when(F.floor(k.filled()) == n, v.col)
            if v.err is not None:
                err = err.when(F.floor(k.filled()) == n, v.err)
        outside = F.when(~F.floor(k.filled()).between(1, len(vs)), VALUE)
        return V(out, vs[0].kind, first_error(k.err, outside, err))

    def f_text(self, arg, code) -> V:
        v = self.value(arg)
        if v.kind == "text":
            return v
        n = v.number()
        return V(numfmt.text(n.filled(), self.literal(code)), "text", n.err)

    def f_substitute(self, s, old, new, nth=None) -> V:
        vs = [self.value(a) for a in (s, old, new)]
        n = int(self.literal(nth)) if nth is not None else None
        return V(text.substitute(*[v.text() for v in vs], n), "text", first_error(*[v.err for v in vs], F.lit(VALUE) if n is not None and n < 1 else None))

    def f_search(self, needle, s, start=None) -> V:
        v = self.value(s)
        first = self.value(start).number() if start is not None else V(F.lit(1.0), "number")
        n = self.value(needle)
        at = text.search(needle.value if isinstance(needle, p.Str) else n.text(), v.text(), first.filled())
        return V(at.cast("double"), "number", first_error(n.err, v.err, first.err, F.when(at.isNull(), VALUE)))

    def f_textjoin(self, delimiter, skip, *args) -> V:
        vs = self.texts(args)
        out = text.textjoin(str(self.literal(delimiter)), [v.col for v in vs], bool(self.literal(skip))) if vs else F.lit("")
        return V(out, "text", first_error(*[v.err for v in vs], F.when(F.char_length(out) > text.REPT_LIMIT, VALUE)))

    def f_concat(self, *args) -> V:
        vs = self.texts(args)
        out = F.concat(*[v.col for v in vs]) if vs else F.lit("")
        return V(out, "text", first_error(*[v.err for v in vs], F.when(F.char_length(out) > text.REPT_LIMIT, VALUE)))

    def f_concatenate(self, *args) -> V:
        if any(isinstance(a, p.Range) and a.first != a.last for a in args):
            return V(F.lit(None).cast("string"), "text", F.lit(VALUE))
        return self.f_concat(*args)

    def f_datedif(self, a, b, unit) -> V:
        x, y = self.value(a).number(), self.value(b).number()
        try:
            out = dates.datedif(cells.from_serial(x.filled()), cells.from_serial(y.filled()), str(self.literal(unit)))
        except KeyError:
            return V(F.lit(None).cast("double"), "number", F.lit(NUM))
        return V(out.cast("double"), "number", first_error(x.err, y.err, F.when(out.isNull(), NUM)))

    def f_weekday(self, d, kind=None) -> V:
        v, k = self.value(d).number(), int(self.literal(kind)) if kind is not None else 1
        if k not in (1, 2, 3):
            return V(F.lit(None).cast("double"), "number", F.lit(NUM))
        return V(dates.weekday(cells.from_serial(v.filled()), k).cast("double"), "number", v.err)

    def f_networkdays(self, a, b, holidays=None) -> V:
        x, y = self.value(a).number(), self.value(b).number()
        days = self.holidays(holidays) if holidays is not None else []
        return V(dates.networkdays(cells.from_serial(x.filled()), cells.from_serial(y.filled()), days).cast("double"), "number", first_error(x.err, y.err))

    def holidays(self, node) -> list[str]:
        """The distinct days of a range or value; every day from 1900 to 9999 fits into fewer than MOST_HOLIDAYS."""
        if isinstance(node, p.Ref):
            node = p.Range(node, node, node.sheet)
        if not isinstance(node, p.Range):
            row = Scalar(self.sheets, self.home_of_cells).result(node).select(cells.from_serial(F.col("value").cast("double")).cast("string")).first()
            return [row[0]] if row[0] else []
        if not self.fixed(node):
            raise p.FormulaError("holidays must not depend on the row")
        df, columns = self.slice(node)
        kind = cells.kinds(df)
        each = df.select(F.explode(F.array(*[cells.numbers(F.col(c), kind[c]) for c in columns])).alias("x")).where("x is not null")
        return [r[0] for r in each.select(cells.from_serial(F.col("x")).cast("string").alias("d")).distinct().limit(MOST_HOLIDAYS).collect()]

    def f_indirect(self, where, style=None) -> V:
        """The cell that a text names, worked out when the plan is made; at most MOST_INDIRECT deep."""
        self.indirect = getattr(self, "indirect", 0) + 1
        if self.indirect > MOST_INDIRECT:
            return V(F.lit(None).cast("double"), "number", F.lit(REF))
        frames = {k: f for k, f in self.sheets.frames.items() if k != "\0probe"}
        named = where.value if isinstance(where, p.Str) else Scalar(Sheets(frames, self.sheets.row), self.home_of_cells).result(where).first()["value"]
        try:
            node = p.parse(str(named))
        except p.FormulaError:
            node = None
        if isinstance(node, p.Range) and node.first == node.last:
            node = node.first
        if not isinstance(node, p.Ref) or (node.sheet and node.sheet not in self.sheets.frames):
            return V(F.lit(None).cast("double"), "number", F.lit(REF))
        out = self.cell(p.Ref(node.col, node.row, True, True, node.sheet))
        self.indirect -= 1
        return out

    def f_today(self) -> V:
        return V(cells.serial(F.current_date()), "number")

    def f_now(self) -> V:
        return V(cells.serial(F.current_timestamp().cast("timestamp_ntz")), "number")

    def literal(self, node):
        """The Python value of an argument that must be known when the plan is made: a constant, or a formula over
        fixed cells, which costs a small job of its own. Its error is raised as a KeyError, as a bad reference is."""
        if isinstance(node, (p.Num, p.Str, p.Bool)):
            return node.value
        if isinstance(node, p.Unary) and node.op == "-" and isinstance(node.arg, p.Num):
            return -node.arg.value
        if not all(self.fixed(r) for r in p.references(node)):
            raise p.FormulaError("this argument must not depend on the row")
        frames = {k: f for k, f in self.sheets.frames.items() if k != "\0probe"}
        row = Scalar(Sheets(frames, self.sheets.row), self.home_of_cells).result(node).first()
        if row["error"] is not None:
            raise KeyError(row["error"])
        return 0.0 if row["value"] is None else row["value"]

    def fixed(self, ref) -> bool:
        """Whether a reference means the same cells for each row."""
        return True

    def texts(self, args: tuple) -> list[V]:
        """The texts of arguments; a range is walked column by column."""
        out = []
        for a in args:
            if isinstance(a, p.Range) and a.first != a.last:
                out += self.walked(a)
            else:
                v = self.value(a)
                out.append(V(v.text(), "text", v.err))
        return out

    def walked(self, rng: p.Range) -> list[V]:
        """One value, whose column is an array of texts, or one for each cell."""
        df, columns = self.slice(rng)
        kind = cells.kinds(df)
        entry = F.array(*[F.struct(F.lit(j).alias("c"), F.col(self.sheets.row).alias("r"), cells.shown(F.col(c), kind[c]).alias("s"), cells.errors(F.col(c), kind[c]).alias("e")) for j, c in enumerate(columns)])
        flat = df.select(F.explode(entry).alias("v"))
        # A text of more characters than a cell may hold is an error, so no more cells with text than that are gathered.
        size = flat.agg(F.sum(F.char_length("v.s")).alias("n"), F.min_by("v.e", F.when(F.col("v.e").isNotNull(), F.struct("v.c", "v.r"))).alias("e")).first()
        if size["e"] is not None or (size["n"] or 0) > text.REPT_LIMIT:
            raise KeyError(size["e"] or VALUE)
        low, high = self.span(rng)[2:]
        if low is None:
            low, high = (x or 0 for x in df.agg(F.min(self.sheets.row), F.max(self.sheets.row)).first())
        got = {(r["c"], r["r"]): r["s"] for r in flat.where(F.col("v.s") != "").select("v.*").collect()}
        if len(columns) * (high - low + 1) > text.REPT_LIMIT:  # so many cells can't all count: the empty ones are left out
            return [V(F.lit(got[k]), "text") for k in sorted(got)]
        return [V(F.lit(got.get((c, r), "")), "text") for c in range(len(columns)) for r in range(low, high + 1)]

    def cell(self, ref: p.Ref) -> V:
        raise NotImplementedError

    def aggregate(self, name: str, args: tuple) -> V:
        raise NotImplementedError

    def conditional(self, name: str, args: tuple) -> V:
        raise NotImplementedError

    def lookup(self, name: str, args: tuple) -> V:
        raise NotImplementedError

    # -- ranges of a sheet

    def span(self, rng) -> tuple[list[str], list[str], int | None, int | None]:
        """(sheets, columns, first row, last row) of a cell or range."""
        if isinstance(rng, p.Ref):
            rng = p.Range(rng, rng, rng.sheet)
        sheets = self.sheets.run(rng.sheet, rng.last_sheet) if rng.last_sheet else [rng.sheet or self.home_of_cells]
        if not sheets or any(s not in self.sheets.frames for s in sheets):
            raise KeyError(REF)
        columns = self.sheets.columns(sheets[0])[min(rng.first.col, rng.last.col) : max(rng.first.col, rng.last.col) + 1]
        rows = (None, None) if rng.whole else (min(rng.first.row, rng.last.row), max(rng.first.row, rng.last.row))
        return sheets, columns, *rows

    def slice(self, rng) -> tuple[DataFrame, list[str]]:
        sheets, columns, a, b = self.span(rng)
        parts = []
        for s in sheets:
            df = self.sheets.frames[s]
            own = self.sheets.columns(s)
            first = self.sheets.columns(sheets[0])
            df = df.select(self.sheets.row, *[F.col(own[first.index(c)]).alias(c) for c in columns])
            parts.append(df if a is None else df.where(F.col(self.sheets.row).between(a, b)))
        return reduce(DataFrame.unionByName, parts), columns


def _needs(test: Column, err: str, out: Column, kind: str = "number") -> V:
    return V(out, kind, F.when(~test, err))


def _text(out: Column, *bad: Column) -> V:
    return V(out, "text", F.when(reduce(lambda a, b: a | b, bad), VALUE) if bad else None)


#: name -> (least arguments, most, their kinds: n number, t text, d date; the function).
SIMPLE = {
    "ABS": (1, 1, "n", F.abs),
    "INT": (1, 1, "n", lambda x: F.floor(x).cast("double")),
    "EXP": (1, 1, "n", F.exp),
    "SQRT": (1, 1, "n", math.sqrt),
    "LN": (1, 1, "n", math.ln),
    "LOG10": (1, 1, "n", math.log10),
    "ROUND": (1, 2, "n", lambda x, d=0: math.round_half_away(x, d)),
    "FLOOR": (1, 2, "n", lambda x, s=None: math.floor_step(x, s if s is not None else F.lit(1.0))),
    "CEILING": (1, 2, "n", lambda x, s=None: math.ceiling_step(x, s if s is not None else F.lit(1.0))),
    "LEN": (1, 1, "t", lambda s: F.char_length(s).cast("double")),
    "LEFT": (1, 2, "tn", lambda s, n=None: _text(text.left(s, n if n is not None else F.lit(1)), (n if n is not None else F.lit(1)) < 0)),
    "RIGHT": (1, 2, "tn", lambda s, n=None: _text(text.right(s, n if n is not None else F.lit(1)), (n if n is not None else F.lit(1)) < 0)),
    "MID": (3, 3, "tn", lambda s, a, n: _text(text.mid(s, a, n), a < 1, n < 0)),
    "UPPER": (1, 1, "t", lambda s: _text(F.upper(s))),
    "LOWER": (1, 1, "t", lambda s: _text(F.lower(s))),
    "PROPER": (1, 1, "t", lambda s: _text(text.proper(s))),
    "TRIM": (1, 1, "t", lambda s: _text(text.trim(s))),
    "CLEAN": (1, 1, "t", lambda s: _text(text.clean(s))),
    "REPT": (2, 2, "tn", lambda s, n: _text(F.when(F.octet_length(s) * n <= text.REPT_LIMIT, F.repeat(s, n.cast("int"))), n < 0, F.octet_length(s) * n > text.REPT_LIMIT)),
    "REPLACE": (4, 4, "tnnt", lambda s, a, n, t: _text(text.replace_at(s, a, n, t), a < 1, n < 0)),
    "FIND": (2, 3, "ttn", lambda f, s, a=None: (text.find(f, s, a if a is not None else 1).cast("double"), F.when(text.find(f, s, a if a is not None else 1).isNull(), VALUE))),
    "VALUE": (1, 1, "t", lambda s: (text.value(s), F.when(text.value(s).isNull(), VALUE))),
    "DATE": (3, 3, "n", lambda y, m, d: (cells.serial(dates.make(y, m, d)), F.when(dates.make(y, m, d) < F.lit("1900-01-01").cast("date"), NUM))),
    "YEAR": (1, 1, "d", lambda d: F.year(d).cast("double")),
    "MONTH": (1, 1, "d", lambda d: F.month(d).cast("double")),
    "DAY": (1, 1, "d", lambda d: F.dayofmonth(d).cast("double")),
    "HOUR": (1, 1, "n", lambda x: (F.floor(F.round((x - F.floor(x)) * 86400) / 3600) % 24).cast("double")),
    "MINUTE": (1, 1, "n", lambda x: (F.floor(F.round((x - F.floor(x)) * 86400) / 60) % 60).cast("double")),
    "SECOND": (1, 1, "n", lambda x: (F.round((x - F.floor(x)) * 86400) % 60).cast("double")),
    "EDATE": (2, 2, "dn", lambda d, n: cells.serial(dates.edate(d, n))),
    "EOMONTH": (2, 2, "dn", lambda d, n: cells.serial(dates.eomonth(d, n))),
    "DAYS": (2, 2, "n", lambda a, b: F.floor(a) - F.floor(b)),
}


class Scalar(Compiler):
    """A formula over fixed cells and ranges, as a one-row frame."""

    def __init__(self, sheets: Sheets, home: str):
        super().__init__(sheets, home)
        self.frames: list[DataFrame] = []
        self.pending: dict[str, list[Column]] = {}
        self.n = 0

    def add(self, sheet: str, aggregate: Column) -> Column:
        """An aggregate over a sheet; all of one sheet share a pass."""
        self.n += 1
        self.pending.setdefault(sheet, []).append(aggregate.alias(f"_a{self.n}"))
        return F.col(f"_a{self.n}")

    def add_frame(self, df: DataFrame) -> Column:
        """The value of a frame of one row and column, or NULL if it has none."""
        self.n += 1
        self.frames.append(df.agg(F.first(df.columns[0]).alias(f"_a{self.n}")))
        return F.col(f"_a{self.n}")

    def result(self, node) -> DataFrame:
        return self.results([node]).select(F.col("v0").alias("value"), F.col("e0").alias("error"))

    def results(self, nodes: list) -> DataFrame:
        """Several formulas in one row: v0, e0, v1, e1, ...; what they take from one sheet is one pass over it."""
        vs = [self.settled(node) for node in nodes]
        spark = next(iter(self.sheets.frames.values())).sparkSession
        frames = [self.sheets.frames[s].agg(*columns) for s, columns in self.pending.items()] + self.frames
        one = reduce(lambda a, b: a.crossJoin(b), frames) if frames else spark.range(1)  # each has one row
        parts = [(v.col.alias(f"v{k}"), (F.lit(None).cast("string") if v.err is None else v.err).alias(f"e{k}")) for k, v in enumerate(vs)]
        return one.select(*[c for pair in parts for c in pair])

    def cell(self, ref: p.Ref) -> V:
        (sheet,), columns, row, _ = self.span(ref)
        if not columns:
            return V(F.lit(None).cast("double"), "blank")
        df, c = self.sheets.frames[sheet], columns[0]
        kind = cells.kinds(df)[c]
        k = cells.kind_of(kind)
        here = F.col(self.sheets.row) == row
        if k == "mixed":
            return V(self.add(sheet, F.max(F.when(here, F.col(c)["num"]))), "number", self.add(sheet, F.max(F.when(here, cells.errors(F.col(c), kind)))))
        x = cells.serial(F.col(c)) if k == "date" else F.col(c).cast("double") if k == "number" else F.col(c)
        return V(self.add(sheet, F.max(F.when(here, x))), {"date": "number"}.get(k, k))

    def numbers(self, args: tuple) -> tuple[DataFrame, Column | None]:
        """All numbers of the arguments as a frame (x, place), and the first error."""
        parts, errors = [], []
        for a in args:
            if isinstance(a, (p.Ref, p.Range)):
                df, columns = self.slice(a)
                kind = cells.kinds(df)
                entry = F.array(*[F.struct(cells.numbers(F.col(c), kind[c]).alias("x"), cells.errors(F.col(c), kind[c]).alias("e"), F.struct(F.lit(j).alias("c"), F.col(self.sheets.row).alias("r")).alias("place")) for j, c in enumerate(columns)])
                parts.append(df.select(F.explode(entry).alias("v")).select("v.*"))
            else:
                v = self.value(a).number()
                errors.append(v.err)
                one = Scalar(self.sheets, self.home).result(a)
                parts.append(one.select(F.col("value").try_cast("double").alias("x"), F.col("error").alias("e"), F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("r")).alias("place")))
        return reduce(DataFrame.unionByName, parts), None

    def aggregate(self, name: str, args: tuple) -> V:
        parameter = None
        if name in ("PERCENTILE.INC", "QUARTILE.INC", "LARGE", "SMALL"):
            *args, parameter = args
            parameter = float(self.literal(parameter))
        if name == "RANK.EQ":
            probe, rng, *order = args
            df, _ = self.numbers((rng,))
            v = self.value(probe).number()
            one = Scalar(self.sheets, self.home).result(probe).select(F.col("value").alias("_probe"))
            up = bool(order) and self.literal(order[0]) != 0
            counted = df.crossJoin(F.broadcast(one)).agg(F.sum(((F.col("x") < F.col("_probe")) if up else (F.col("x") > F.col("_probe"))).cast("int")).alias("better"), F.max((F.col("x") == F.col("_probe")).cast("int")).alias("there"))
            out = self.add_frame(counted.select(F.when(F.col("there") == 1, F.col("better") + 1)))
            return V(out.cast("double"), "number", first_error(v.err, F.when(out.isNull(), NA)))
        single = self.one_column(args)
        if single and name not in ("LARGE", "SMALL", "MODE.SNGL", "MEDIAN", "PERCENTILE.INC", "QUARTILE.INC"):
            sheet, x, e = single
            got, err = self.folded(name, x, parameter)
            bad = self.add(sheet, F.min_by(e, F.when(e.isNotNull(), F.col(self.sheets.row)))) if e is not None else None
            return V(self.add(sheet, got).cast("double"), "number", first_error(bad, self.add(sheet, err) if err is not None else None))
        df, _ = self.numbers(args)
        bad = self.add_frame(df.agg(F.min_by("e", F.when(F.col("e").isNotNull(), F.col("place"))).alias("e")))
        if name in ("LARGE", "SMALL"):
            k = int(parameter)
            out = self.add_frame(stats.kth(df, F.col("x"), k, name == "LARGE")) if k >= 1 else F.lit(None).cast("double")
            return V(out, "number", first_error(bad, F.when(out.isNull(), NUM)))
        if name == "MODE.SNGL":
            out = self.add_frame(self.mode_of(df))
            return V(out, "number", first_error(bad, F.when(out.isNull(), NA)))
        if name in ("MEDIAN", "PERCENTILE.INC", "QUARTILE.INC"):
            k = 0.5 if name == "MEDIAN" else parameter if name == "PERCENTILE.INC" else int(parameter) / 4
            if not 0 <= k <= 1:
                return V(F.lit(None).cast("double"), "number", first_error(bad, F.lit(NUM)))
            out = self.add_frame(stats.quantiles(df, "x", {"q": k}).select("q"))
            return V(out, "number", first_error(bad, F.when(out.isNull(), NUM)))
        got, err = self.folded(name, F.col("x"), parameter)
        return V(self.add_frame(df.agg(got.alias("v"))).cast("double"), "number", first_error(bad, self.add_frame(df.agg(err.alias("v"))) if err is not None else None))

    def mode_of(self, df: DataFrame) -> DataFrame:
        counted = df.where("x is not null").groupBy("x").agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1")
        return counted.orderBy(F.col("n").desc(), F.col("first").asc()).limit(1).select("x")

    def one_column(self, args: tuple) -> tuple[str, Column, Column | None] | None:
        """For a single range of one column: the sheet and its numbers and errors inside the range."""
        if len(args) != 1 or not isinstance(args[0], (p.Ref, p.Range)):
            return None
        sheets, columns, a, b = self.span(args[0])
        if len(sheets) != 1 or len(columns) != 1:
            return None
        kind = cells.kinds(self.sheets.frames[sheets[0]])[columns[0]]
        c = F.col(columns[0])
        x, e = cells.numbers(c, kind), cells.errors(c, kind) if cells.is_mixed(kind) else None
        if a is not None:
            inside = F.col(self.sheets.row).between(a, b)
            x, e = F.when(inside, x), F.when(inside, e) if e is not None else None
        return sheets[0], x, e

    def folded(self, name: str, x: Column, parameter: float | None) -> tuple[Column, Column | None]:
        if name == "SUM":
            return F.coalesce(F.sum(x), F.lit(0.0)), None
        if name == "COUNT":
            return F.count(x), None
        if name == "AVERAGE":
            return stats.average(x)
        if name in ("MIN", "MAX"):
            return (stats.low if name == "MIN" else stats.high)(x), None
        return stats.spread(name, x)

    def conditional(self, name: str, args: tuple) -> V:
        base = name.removesuffix("S") if name.endswith("IFS") else name
        if name.endswith("IFS"):
            target, pairs = (None, args) if name == "COUNTIFS" else (args[0], args[1:])
        else:
            target, pairs = (args[2] if len(args) > 2 else args[0]) if name != "COUNTIF" else None, args[:2]
        ranges, wanted = pairs[::2], pairs[1::2]
        sheets, columns, a, b = self.span(ranges[0])
        if len(sheets) != 1:
            return V(F.lit(None).cast("double"), "number", F.lit(VALUE))
        df = self.sheets.frames[sheets[0]]
        kind, test = cells.kinds(df), F.lit(True)
        for rng, want in zip(ranges, wanted, strict=True):
            own_sheets, own, a2, b2 = self.span(rng)
            if own_sheets != sheets or len(own) != 1 or (a2, b2) != (a, b):
                return V(F.lit(None).cast("double"), "number", F.lit(VALUE))
            test &= criteria.matches(F.col(own[0]), kind[own[0]], self.literal(want))
        if name.endswith("IFS") and target is not None and self.span(target)[2:] != (a, b):
            return V(F.lit(None).cast("double"), "number", F.lit(VALUE))
        if a is not None:
            test &= F.col(self.sheets.row).between(a, b)
        if target is None:
            return V(self.add(sheets[0], F.count(F.when(test, 1))).cast("double"), "number")
        _, own, _, _ = self.span(target)
        x = F.when(test, cells.numbers(F.col(own[0]), kind[own[0]]))
        e = F.when(test, cells.errors(F.col(own[0]), kind[own[0]]))
        bad = self.add(sheets[0], F.min_by(e, F.when(e.isNotNull(), F.col(self.sheets.row)))) if cells.is_mixed(kind[own[0]]) else None
        if base == "SUMIF":
            return V(self.add(sheets[0], F.coalesce(F.sum(x), F.lit(0.0))), "number", bad)
        out = self.add(sheets[0], F.avg(x))
        return V(out, "number", first_error(bad, F.when(out.isNull(), DIV0)))

    def lookup(self, name: str, args: tuple) -> V:
        """Over a one-row frame of the probe, by the joins that fill down uses."""
        spark = next(iter(self.sheets.frames.values())).sparkSession
        one = spark.range(1).select(F.col("id").alias(self.sheets.row))
        inner = Filled(Sheets({**self.sheets.frames, "\0probe": one}, self.sheets.row), "\0probe", 0)
        inner.home_of_cells = self.home
        v = clean(inner.lookup(name, args))
        err = F.lit(None).cast("string") if v.err is None else v.err
        made = inner.df.select(v.col.alias("v"), err.alias("e"))
        return V(self.add_frame(made.select("v")), v.kind, self.add_frame(made.select("e")))


class Filled(Compiler):
    """A formula written at a row and filled down its sheet, as columns of the sheet."""

    def __init__(self, sheets: Sheets, home: str, anchor: int = 0):
        super().__init__(sheets, home)
        self.df, self.anchor, self.n = sheets.frames[home], anchor, 0

    def fresh(self) -> str:
        self.n += 1
        return f"_f{self.n}"

    def result(self, node, out: str) -> DataFrame:
        v = self.settled(node)
        kept = self.sheets.frames[self.home].columns
        err = F.lit(None).cast("string") if v.err is None else v.err
        return self.df.select(*kept, v.col.alias(out), err.alias(f"{out}_error"))

    def constant(self, node) -> V:
        """A part that is the same for each row: one aggregate, sent to all rows."""
        v_name, e_name = self.fresh(), self.fresh()
        frames = {k: f for k, f in self.sheets.frames.items() if k != "\0probe"}
        made = Scalar(Sheets(frames, self.sheets.row), self.home_of_cells).result(node)
        kind = {"double": "number", "string": "text", "boolean": "bool"}.get(made.schema["value"].dataType.simpleString(), "number")
        self.df = self.df.crossJoin(F.broadcast(made.select(F.col("value").alias(v_name), F.col("error").alias(e_name))))
        return V(F.col(v_name), kind, F.col(e_name))

    def typed(self, c: Column, kind) -> V:
        k = cells.kind_of(kind)
        if k == "mixed":
            return V(c["num"], "number", cells.errors(c, kind))
        return V(cells.serial(c), "number") if k == "date" else V(c.cast("double"), "number") if k == "number" else V(c, k)

    def cell(self, ref: p.Ref) -> V:
        if ref.pin_row or (ref.sheet and ref.sheet != self.home) or self.home == "\0probe":
            return self.constant(ref)
        columns = self.sheets.columns(self.home)
        if ref.col >= len(columns):
            return V(F.lit(None).cast("double"), "blank")
        name, offset = columns[ref.col], ref.row - self.anchor
        kind = cells.kinds(self.sheets.frames[self.home])[name]
        if offset == 0:
            return self.typed(F.col(f"`{name}`"), kind)
        out = self.fresh()
        self.df = positional.moving(self.df, self.sheets.row, {out: ("value", name, offset, offset)})
        return self.typed(F.col(out), kind)

    def aggregate(self, name: str, args: tuple) -> V:
        if name == "RANK.EQ" and isinstance(args[0], p.Ref) and not args[0].pin_row:
            columns = self.sheets.columns(self.home)
            column, out = columns[args[0].col], self.fresh()
            up = len(args) > 2 and self.literal(args[2]) != 0
            self.df = stats.rank_eq(self.df, column, not up, out)
            return V(F.col(out).cast("double"), "number", F.when(F.col(out).isNull(), NA))
        refs = [r for a in args for r in p.references(a)]
        if len(args) == 1 and isinstance(args[0], p.Range) and self.moves(args[0]):
            return self.window(name, args[0])
        if all(self.fixed(r) for r in refs):
            return self.constant(p.Call(name, args))
        if name in ("SUM", "MIN", "MAX", "COUNT", "AVERAGE") and all(not isinstance(a, p.Range) or a.first.row == a.last.row for a in args):
            vs = []
            for a in args:
                if isinstance(a, p.Range):
                    vs += [self.cell(p.Ref(c, a.first.row, a.first.pin_col, a.first.pin_row, a.sheet)) for c in range(a.first.col, a.last.col + 1)]
                else:
                    vs.append(self.value(a).number())
            xs = F.filter(F.array(*[v.number().col if v.kind == "number" else F.lit(None).cast("double") for v in vs]), lambda x: x.isNotNull())
            total, n = F.aggregate(xs, F.lit(0.0), lambda a, b: a + b), F.size(xs)
            err = first_error(*[v.err for v in vs])
            if name == "AVERAGE":
                return V(F.try_divide(total, n), "number", first_error(err, F.when(n == 0, DIV0)))
            out = {"SUM": total, "COUNT": n.cast("double"), "MIN": F.coalesce(F.array_min(xs), F.lit(0.0)), "MAX": F.coalesce(F.array_max(xs), F.lit(0.0))}[name]
            return V(out, "number", err)
        raise p.FormulaError(f"{name} can't be filled down over these ranges")

    def walked(self, rng: p.Range) -> list[V]:
        if self.fixed(rng):
            return super().walked(rng)
        if rng.first.row != rng.last.row:
            raise p.FormulaError("a range of several rows that moves with the row has no text form")
        vs = [self.cell(p.Ref(c, rng.first.row, rng.first.pin_col, rng.first.pin_row, rng.sheet)) for c in range(rng.first.col, rng.last.col + 1)]
        return [V(v.text(), "text", v.err) for v in vs]

    def fixed(self, r) -> bool:
        if isinstance(r, p.Ref):
            return r.pin_row or bool(r.sheet and r.sheet != self.home)
        return r.whole or (r.first.pin_row and r.last.pin_row) or bool(r.sheet and r.sheet != self.home)

    def moves(self, r: p.Range) -> bool:
        return not self.fixed(r) and r.first.col == r.last.col and r.first.row != r.last.row or (not self.fixed(r) and r.first.col == r.last.col and r.first.pin_row != r.last.pin_row)

    def window(self, name: str, r: p.Range) -> V:
        column = self.sheets.columns(self.home)[r.first.col]
        kind = cells.kinds(self.sheets.frames[self.home])[column]
        x = self.fresh()
        self.df = self.df.withColumn(x, cells.numbers(F.col(f"`{column}`"), kind))
        if r.first.pin_row and not r.last.pin_row:  # from a fixed row to this one: a running total
            if name not in ("SUM", "COUNT", "AVERAGE"):
                raise p.FormulaError(f"{name} has no running form")
            inside = F.col(self.sheets.row) >= r.first.row
            total, count = self.fresh(), self.fresh()
            zeros, ones = self.fresh(), self.fresh()
            self.df = self.df.withColumn(zeros, F.when(inside, F.coalesce(F.col(x), F.lit(0.0))).otherwise(0.0)).withColumn(ones, F.when(inside & F.col(x).isNotNull(), 1).otherwise(0))
            self.df = positional.running_totals(self.df, self.sheets.row, {total: zeros, count: ones})
            if name == "AVERAGE":
                return V(F.try_divide(F.col(total), F.col(count)), "number", F.when(F.col(count) == 0, DIV0))
            return V(F.col(total if name == "SUM" else count).cast("double"), "number")
        a, b = r.first.row - self.anchor, r.last.row - self.anchor
        function = {"SUM": "sum", "COUNT": "count", "AVERAGE": "avg", "MIN": "min", "MAX": "max", "STDEV.S": "stddev_samp", "STDEV.P": "stddev_pop", "VAR.S": "var_samp", "VAR.P": "var_pop", "MEDIAN": "median"}.get(name)
        if function is None:
            raise p.FormulaError(f"{name} has no moving form")
        out = self.fresh()
        self.df = positional.moving(self.df, self.sheets.row, {out: (function, x, a, b)})
        if name in ("SUM", "MIN", "MAX"):
            return V(F.coalesce(F.col(out), F.lit(0.0)), "number")
        if name == "COUNT":
            return V(F.col(out).cast("double"), "number")
        return V(F.col(out), "number", F.when(F.col(out).isNull(), DIV0))

    def conditional(self, name: str, args: tuple) -> V:
        """Criteria that are cells of the row: one grouped pass over the range, joined to the rows by the criteria."""
        if name.endswith("IFS"):
            target, pairs = (None, args) if name == "COUNTIFS" else (args[0], args[1:])
        else:
            target, pairs = (args[2] if len(args) > 2 else args[0]) if name != "COUNTIF" else None, args[:2]
        ranges, wanted = pairs[::2], pairs[1::2]
        if all(self.fixed(r) for w in wanted for r in p.references(w)):
            return self.constant(p.Call(name, args))
        sheets, _, a, b = self.span(ranges[0])
        source = self.sheets.frames[sheets[0]]
        kind = cells.kinds(source)
        if a is not None:
            source = source.where(F.col(self.sheets.row).between(a, b))
        columns, probes, errors = [], [], []
        for rng, want in zip(ranges, wanted, strict=True):
            (_, (column,), _, _) = self.span(rng)
            if all(self.fixed(r) for r in p.references(want)):
                source = source.where(criteria.matches(F.col(column), kind[column], self.literal(want)))
                continue
            v = self.value(want)
            columns.append(column)
            errors.append(v.err)
            probes.append(criteria.wanted(v.text() if v.kind == "text" else v.filled() if v.kind == "number" else v.number().filled(), v.kind))
        own = None if target is None else self.span(target)[1][0]
        x = F.lit(1.0) if own is None else cells.numbers(F.col(own), kind[own])
        e = F.lit(None).cast("string") if own is None else cells.errors(F.col(own), kind[own])
        folded = [F.sum(x).alias("total"), F.count(x).alias("n"), F.min_by(e, F.when(e.isNotNull(), F.col(self.sheets.row))).alias("bad")]
        names = [self.fresh() for _ in columns]
        got, there = self.fresh(), self.fresh()
        self.df = self.df.withColumns(dict(zip(names, probes, strict=True)))
        # Plain equality, in any number, meets the grouped source in a join.
        keys = [criteria.equal_key(F.col(c), kind[c]).alias(n) for c, n in zip(columns, names, strict=True)]
        plain = source.groupBy(*keys).agg(*folded).select(*names, F.struct("total", "n", "bad").alias(got))
        # Others are parsed, each distinct combination once, and all are summed in one pass over the source.
        simple = reduce(lambda s, t: s & t, [criteria.is_equality(F.col(n)) for n in names])
        others = self.df.where(~simple).select(*names).distinct().limit(MOST_CRITERIA + 1).collect()
        if len(others) > MOST_CRITERIA:
            raise p.FormulaError(f"more than {MOST_CRITERIA} distinct criteria with operators or wildcards")
        if others:
            tests = [reduce(lambda s, t: s & t, [criteria.matches(F.col(c), kind[c], criteria.spelled(w)) for c, w in zip(columns, row, strict=True)]) for row in others]
            sums = [F.struct(*[F.lit(w).alias(n) for n, w in zip(names, row, strict=True)], F.struct(F.sum(F.when(t, x)).alias("total"), F.count(F.when(t, x)).alias("n"), F.min_by(F.when(t, e), F.when(t & e.isNotNull(), F.col(self.sheets.row))).alias("bad")).alias(got)) for row, t in zip(others, tests, strict=True)]
            plain = plain.where(reduce(lambda s, t: s & t, [F.col(n).isNotNull() for n in names])).unionByName(source.agg(F.array(*sums).alias("v")).select(F.explode("v").alias("v")).select("v.*"))
        self.df = self.df.join(plain.withColumn(there, F.lit(1)), names, "left")
        n, total = F.coalesce(F.col(got)["n"], F.lit(0)), F.col(got)["total"]
        err = first_error(*errors, None if name.startswith("COUNT") else F.col(got)["bad"])
        if name.startswith("COUNT"):
            return V(n.cast("double"), "number", err)
        if name.startswith("SUM"):
            return V(F.coalesce(total, F.lit(0.0)), "number", err)
        return V(F.try_divide(total, n), "number", first_error(err, F.when(n == 0, DIV0)))

    def lookup(self, name: str, args: tuple) -> V:
        if name == "INDEX":
            return self.indexed(*args)
        probe = self.value(args[0])
        key = self.fresh()
        self.df = self.df.withColumn(key, probe.col)
        before = list(self.df.columns)
        pattern = args[0].value if isinstance(args[0], p.Str) and text.has_glob(args[0].value) else None
        exact, up, last, fallback = True, False, False, None
        if name == "VLOOKUP":
            table, columns = self.slice(args[1])
            at = int(self.literal(args[2]))
            if at < 1 or at > len(columns):
                return V(F.lit(None).cast("double"), "number", F.lit(VALUE if at < 1 else REF))
            look, back = columns[0], columns[at - 1]
            exact = len(args) > 3 and self.literal(args[3]) in (0, False)
        elif name == "MATCH":
            table, columns = self.slice(args[1])
            if len(columns) != 1:
                return V(F.lit(None).cast("double"), "number", F.lit(NA))
            look, back = columns[0], self.sheets.row
            how = self.literal(args[2]) if len(args) > 2 else 1
            exact, up = how == 0, how == -1
        elif name == "XLOOKUP":
            table, columns = self.slice(args[1])
            given, returns = self.slice(args[2])
            look, back = columns[0], returns[0]
            if back != look:
                table = table.join(given, self.sheets.row) if self.span(args[1])[2] is not None else self.sheets.frames[self.span(args[1])[0][0]]
            how = self.literal(args[4]) if len(args) > 4 else 0
            exact, up = how in (0, 2), how == 1
            pattern = pattern if how == 2 else None
            last = len(args) > 5 and self.literal(args[5]) in (-1, -2)
            fallback = args[3] if len(args) > 3 and not isinstance(args[3], p.Missing) else None
        else:  # HLOOKUP: the first row and the row asked for, turned into a table of columns
            at = int(self.literal(args[2]))
            _, columns, first, final = self.span(args[1])
            if at < 1 or (final is not None and at > final - first + 1):
                return V(F.lit(None).cast("double"), "number", F.lit(VALUE if at < 1 else REF))
            table, look, back = self.across(args[1], at), "_head", "_cell"
            exact = len(args) > 3 and self.literal(args[3]) in (0, False)
        kind = cells.kinds(table)[back]
        table = table.select(F.col(self.sheets.row).alias("_at"), F.col(look).alias("_look"), F.col(back).alias("_back"))
        if pattern is not None:
            self.df = lookups.wildcard(self.df.withColumn("pattern", F.lit(pattern)), [pattern], table, "_look", ["_back"], "_at").drop("pattern")
        elif exact:
            self.df = lookups.exact(self.df, key, table, "_look", ["_back"], "_at", last)
        else:
            self.df = lookups.approximate(self.df, key, table, "_look", ["_back"], "_at", up)
        got, err = self.fresh(), self.fresh()
        self.df = self.df.select(*before, F.col("_back").alias(got), F.col("error").alias(err))
        if name == "MATCH":
            offset = self.span(args[1])[2] or 0
            out = V((F.col(got) - offset + 1).cast("double"), "number", first_error(probe.err, F.col(err)))
        else:
            out = self.typed(F.col(got), kind)
            out = V(out.col, out.kind, first_error(probe.err, F.col(err), out.err))
        return self.rescued(None, fallback, out.err == NA, out) if fallback is not None else out

    def across(self, rng, at: int) -> DataFrame:
        """A range's first row and its row ``at`` (from 1) as columns of a frame, a row for each column of the range."""
        df, columns = self.slice(rng)
        kind, first = cells.kinds(df), self.span(rng)[2] or 0
        plain = all(cells.kind_of(kind[c]) == "number" for c in columns)
        cell = lambda c: F.col(c).cast("double") if plain else F.when(F.col(c).isNotNull(), cells.shown(F.col(c), kind[c]))
        entry = F.array(*[F.struct(F.lit(j).cast("long").alias("j"), cell(c).alias("v")) for j, c in enumerate(columns)])
        flat = df.where(F.col(self.sheets.row).isin(first, first + at - 1)).select(F.col(self.sheets.row).alias("r"), F.explode(entry).alias("e")).select("r", "e.j", "e.v")
        own = lambda k: F.max(F.when(F.col("r") == first + k, F.col("v")))
        return flat.groupBy(F.col("j").alias(self.sheets.row)).agg(own(0).alias("_head"), own(at - 1).alias("_cell"))

    def indexed(self, rng, row, column=None) -> V:
        table, columns = self.slice(rng)
        at = int(self.literal(column)) if column is not None else 1
        if at < 0 or at > len(columns):
            return V(F.lit(None).cast("double"), "number", F.lit(VALUE if at < 0 else REF))
        v = self.value(row).number()
        first, last = self.span(rng)[2] or 0, self.span(rng)[3]
        single = last is not None and first == last
        if column is None and single and len(columns) > 1:  # over one row, the number counts columns
            return self.indexed(rng, p.Num(1.0), row)
        whole = (at == 0 or column is None) and len(columns) > 1
        key, got, there = self.fresh(), self.fresh(), self.fresh()
        name = columns[max(at, 1) - 1]
        one = table.select((F.col(self.sheets.row) - first + 1).cast("double").alias(key), F.col(name).alias(got), F.lit(True).alias(there))
        at_row = F.floor(v.filled())
        self.df = self.df.join(one, F.when(at_row == 0, 1.0).otherwise(at_row) == F.col(key), "left")
        out = self.typed(F.col(got), cells.kinds(table)[name])
        # A whole axis is a value only if it is one cell.
        bad = F.when(at_row < 0, VALUE).when((at_row == 0) & F.lit(not single), VALUE).when(F.col(there).isNull(), REF)
        bad = F.when(F.lit(whole) & F.col(there).isNotNull(), VALUE).otherwise(bad)
        return V(out.col, out.kind, first_error(v.err, bad, out.err))


def evaluate(formula: str, sheets: Sheets, home: str, names: dict[str, str] | None = None) -> DataFrame:
    """A scalar formula's one row: value, error."""
    return Scalar(sheets, home).result(p.parse(formula, names))


def fill_down(formula: str, sheets: Sheets, home: str, out: str, anchor: int = 0, names: dict[str, str] | None = None) -> DataFrame:
    """The home sheet with the formula, as written at row ``anchor`` (from 0), in column ``out`` and its errors in ``<out>_error``."""
    return Filled(sheets, home, anchor).result(p.parse(formula, names), out)
