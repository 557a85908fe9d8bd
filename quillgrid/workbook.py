"""Workbooks: sheets over frames, edits as a sparse overlay, names, formulas and what follows from an edit."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells
from .formula import arrays, compiler, graph, rewrite
from .formula import parser as p

ROW = "_row"
UNDO_STEPS = 500
#: Cells that a copy may hold.
MOST_CELLS = 100_000
ALLOWANCES = {"rows", "columns", "merges"}
#: Formulas that one job works out at most.
AT_ONCE = 50
#: Fixed values of goal seek: steps, tolerance, and where it counts as diverged.
SEEK_STEPS, SEEK_TOLERANCE, SEEK_LIMIT = 100, 1e-6, 1e12


def with_row(df: DataFrame, key: str | None = None) -> DataFrame:
    """``df`` with ``_row`` from 0: by a unique numeric key, else by the order of the source's files and rows."""
    from .operators.positional import numbered

    if key:
        return numbered(df, [F.col(key)], ROW)
    return df.withColumn("_at", F.monotonically_increasing_id()).transform(lambda d: numbered(d, [F.col("_at")], ROW)).drop("_at")


@dataclass
class Edit:
    """A typed cell: a literal value, or a formula with its last result."""

    value: object = None
    formula: str | None = None
    error: str | None = None


def typed(text: str) -> Edit:
    """What typing means: ``=`` a formula, then a number, TRUE/FALSE, text; blank clears."""
    t = text.strip()
    if text.startswith("="):
        return Edit(formula=text)
    if not t:
        return Edit()
    try:
        return Edit(float(t))
    except ValueError:
        return Edit(t.upper() == "TRUE") if t.upper() in ("TRUE", "FALSE") else Edit(text)


@dataclass
class Sheet:
    name: str
    base: DataFrame
    edits: dict[tuple[int, int], Edit] = field(default_factory=dict)
    spills: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)
    merges: list[tuple[int, int, int, int]] = field(default_factory=list)
    locked: bool = False
    unlocked: list[tuple[int, int, int, int]] = field(default_factory=list)
    allow: set[str] = field(default_factory=set)
    names: dict[str, str] = field(default_factory=dict)

    def columns(self) -> list[str]:
        return [c for c in self.base.columns if c != ROW]

    def view(self) -> DataFrame:
        """The base with the edits over it: one broadcast join on the edited rows, none without edits."""
        if not self.edits:
            return self.base
        spark, base = self.base.sparkSession, self._widened()
        names, kind = [c for c in base.columns if c != ROW], cells.kinds(base)
        by_column: dict[int, list] = {}
        for (r, c), e in self.edits.items():
            if c < len(names):
                by_column.setdefault(c, []).append((r, e))
        out = base
        for c, entries in by_column.items():
            name = names[c]
            k = cells.kind_of(kind[name])
            fits = {"number": (int, float), "text": str, "bool": bool}.get(k, (int, float))
            rows = [(r, e.value if isinstance(e.value, fits) and not (k == "number" and isinstance(e.value, bool)) else None) for r, e in entries]
            mixed = any(e.value is not None and v is None for (_, v), (_, e) in zip(rows, entries, strict=True)) or any(e.error for _, e in entries)
            if mixed:  # an entry of another kind makes the column a mixed one
                made = [(r, self._cell(e)) for r, e in entries]
                over = spark.createDataFrame(made, f"_r long, _v {cells.MIXED.simpleString()}")
                plain = cells.to_mixed(F.col(f"`{name}`"), kind[name])
            else:
                sql = {"number": "double", "text": "string", "bool": "boolean"}.get(k, "double")
                over = spark.createDataFrame([(r, float(v) if sql == "double" and v is not None else v) for r, v in rows], f"_r long, _v {sql}")
                plain = F.col(f"`{name}`").cast(sql) if k != "date" else cells.serial(F.col(f"`{name}`"))
            out = out.join(F.broadcast(over.withColumn("_there", F.lit(True))), F.col(ROW) == F.col("_r"), "left")
            out = out.withColumn(name, F.when(F.col("_there"), F.col("_v")).otherwise(plain)).select(*base.columns)
        return out

    def _widened(self) -> DataFrame:
        """The base with empty columns as far as edits reach, of the kind that their edits are."""
        own, out = self.columns(), self.base
        taken = {c.lower() for c in own}
        for c in range(len(own), max((c for _, c in self.edits), default=-1) + 1):
            values = [e.value for (_, k), e in self.edits.items() if k == c and e.value is not None]
            sql = "string" if values and all(isinstance(v, str) for v in values) else "boolean" if values and all(isinstance(v, bool) for v in values) else "double"
            name = p.column_letters(c)
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            out = out.withColumn(name, F.lit(None).cast(sql))
        return out

    @staticmethod
    def _cell(e: Edit):
        if e.error:
            return (cells.ERROR, None, None, e.error)
        if e.value is None:
            return None
        if isinstance(e.value, bool):
            return (cells.BOOL, float(e.value), None, None)
        return (cells.NUMBER, float(e.value), None, None) if isinstance(e.value, (int, float)) else (cells.TEXT, None, str(e.value), None)


@dataclass
class Snapshot:
    """The sheets and names before or after a structural step. Frames are plans, so a snapshot holds no rows."""

    sheets: dict[str, Sheet]
    names: dict[str, str]


class Workbook:
    def __init__(self, frames: dict[str, DataFrame]):
        self.sheets = {k: Sheet(k, f if ROW in f.columns else with_row(f)) for k, f in frames.items()}
        self.names: dict[str, str] = {}
        self.graph = graph.Graph()
        self.pivots: list = []
        self.done: list[dict[tuple[str, int, int], tuple[Edit | None, Edit | None]] | tuple[Snapshot, Snapshot]] = []
        self.undone: list = []

    # -- formulas

    def frames(self) -> compiler.Sheets:
        return compiler.Sheets({k: s.view() for k, s in self.sheets.items()}, ROW)

    def evaluate(self, formula: str, home: str) -> DataFrame:
        return compiler.evaluate(formula, self.frames(), home, self.names_for(home))

    def value(self, formula: str, home: str):
        """The value, or the error's spelling."""
        r = self.evaluate(formula, home).first()
        return r["error"] or r["value"]

    def fill_down(self, formula: str, home: str, out: str, anchor: int = 0) -> DataFrame:
        return compiler.fill_down(formula, self.frames(), home, out, anchor, self.names_for(home))

    def array(self, formula: str, home: str) -> DataFrame:
        return arrays.Arrays(self.frames(), home, self.names_for(home)).frame(formula)

    # -- edits

    def put(self, sheet: str, at: str, text: str) -> list[graph.Cell]:
        """Type into a cell; formulas that depend on it are worked out again, in order. Returns the cells that changed."""
        ref = p.cell(at)
        return self.put_many({(sheet, ref.row, ref.col): typed(text)})

    def put_many(self, edits: dict[graph.Cell, Edit]) -> list[graph.Cell]:
        """A batch is one step of undo."""
        for c in edits:
            if not self.may_edit(*c):
                raise PermissionError(f"sheet {c[0]} is protected")
        before = {c: self.sheets[c[0]].edits.get((c[1], c[2])) for c in edits}
        self._set(edits)
        self.done = [*self.done, {c: (before[c], e) for c, e in edits.items()}][-UNDO_STEPS:]
        self.undone = []
        return self._recalculate(list(edits))

    def _set(self, edits: dict[graph.Cell, Edit | None]) -> None:
        for (s, r, c), e in edits.items():
            if e is None:
                self.sheets[s].edits.pop((r, c), None)
            else:
                self.sheets[s].edits[r, c] = e
            if e is not None and e.formula:
                self.graph.set((s, r, c), graph.boxes(e.formula, s, self.names_for(s), list(self.sheets)))
            else:
                self.graph.remove((s, r, c))

    def _recalculate(self, changed: list[graph.Cell], also: list[graph.Cell] = ()) -> list[graph.Cell]:
        """Work out what depends on the changed cells, and first the formulas ``also`` themselves."""
        order, cyclic = self.graph.order(changed)
        order = [*[c for c in also if c not in order and c not in cyclic], *order]
        for s, r, c in cyclic:
            e = self.sheets[s].edits[r, c]
            e.value, e.error = None, cells.CIRC
        batch: list[graph.Cell] = []
        waiting: set[graph.Cell] = set()
        for cell in order:
            if batch and (cell in waiting or cell[0] != batch[0][0] or len(batch) == AT_ONCE):
                self._evaluate(batch)
                batch, waiting = [], set()
            batch.append(cell)
            waiting.update(self.graph.dependents(cell))
        if batch:
            self._evaluate(batch)
        for pivot in self.pivots:
            pivot.note_edit()
        return [*changed, *[c for c in order if c not in changed]]

    def _evaluate(self, batch: list[graph.Cell]) -> None:
        """Formulas of one sheet that don't depend on one another, in one job."""
        edits = [self.sheets[s].edits[r, c] for s, r, c in batch]
        got = compiler.Scalar(self.frames(), batch[0][0]).results([p.parse(e.formula, self.names_for(batch[0][0])) for e in edits]).first()
        for k, e in enumerate(edits):
            e.value, e.error = got[2 * k], got[2 * k + 1]

    def undo(self) -> bool:
        return self._step(self.done, self.undone, 0)

    def redo(self) -> bool:
        return self._step(self.undone, self.done, 1)

    def _step(self, here: list, there: list, side: int) -> bool:
        """Take the last step of one list back (side 0) or on (side 1), and put it on the other list."""
        if not here:
            return False
        step = here.pop()
        there.append(step)
        if isinstance(step, tuple):
            self._restore(step[side])
        else:
            self._set({c: both[side] for c, both in step.items()})
            self._recalculate(list(step))
        return True

    def trace(self, sheet: str, at: str) -> tuple[list[graph.Box], list[graph.Cell]]:
        """Direct precedents and dependents of a cell."""
        ref = p.cell(at)
        cell = (sheet, ref.row, ref.col)
        return self.graph.precedents(cell), self.graph.dependents(cell)

    # -- spills and merges

    def spill(self, sheet: str, at: str, formula: str) -> str | tuple[int, int]:
        """Register an array's rectangle under its host: its size, or #SPILL! where something is in the way."""
        ref, s = p.cell(at), self.sheets[sheet]
        frame = self.array(formula, sheet)
        height, width = frame.count(), len(frame.columns) - 1
        box = (ref.row, ref.row + height - 1, ref.col, ref.col + width - 1)
        blocked = any(box[0] <= r <= box[1] and box[2] <= c <= box[3] and (r, c) != (ref.row, ref.col) and (e.value is not None or e.formula) for (r, c), e in s.edits.items())
        blocked |= any(not (m[1] < box[0] or m[0] > box[1] or m[3] < box[2] or m[2] > box[3]) for m in s.merges)
        if blocked:
            s.edits[ref.row, ref.col] = Edit(formula=formula, error=cells.SPILL)
            return cells.SPILL
        s.spills[ref.row, ref.col] = (height, width)
        s.edits[ref.row, ref.col] = Edit(formula=formula)
        return height, width

    def merge(self, sheet: str, area: str) -> None:
        """The first cell holds the value; an overlap is refused."""
        if self.sheets[sheet].locked and "merges" not in self.sheets[sheet].allow:
            raise PermissionError(f"sheet {sheet} is protected")
        rng = p.parse(area)
        box = (rng.first.row, rng.last.row, rng.first.col, rng.last.col)
        if any(not (m[1] < box[0] or m[0] > box[1] or m[3] < box[2] or m[2] > box[3]) for m in self.sheets[sheet].merges):
            raise ValueError("merges overlap")
        self.sheets[sheet].merges.append(box)

    # -- names and sheets

    def define(self, name: str, formula: str, sheet: str | None = None) -> None:
        """A name for a formula, in the whole workbook or on one sheet, where it goes before the workbook's."""
        if not re.fullmatch(r"[A-Za-z_\\][\w.]*", name) or p.CELL.fullmatch(name) or name.upper() in ("TRUE", "FALSE", "R", "C"):
            raise ValueError(f"not a name: {name}")
        (self.names if sheet is None else self.sheets[sheet].names)[name.upper()] = formula
        self._renamed()

    def names_for(self, sheet: str) -> dict[str, str]:
        """The names that a formula on the sheet sees."""
        return {**self.names, **self.sheets[sheet].names} if sheet in self.sheets else self.names

    def rename_name(self, old: str, new: str, sheet: str | None = None) -> None:
        """Formulas that use the name follow; a sheet's own name is left where another sheet means the workbook's."""
        scope = self.names if sheet is None else self.sheets[sheet].names
        formula = scope.pop(old.upper())
        try:
            self.define(new, formula, sheet)
        except ValueError:
            scope[old.upper()] = formula
            raise
        word = re.compile(r'("(?:[^"]|"")*")|(?<![\w.!$])' + re.escape(old) + r"(?![\w.(!])", re.I)
        change = lambda f: word.sub(lambda m: m[1] or new, f)
        own = lambda home: home == sheet if sheet is not None else old.upper() not in self.sheets[home].names if home in self.sheets else True
        self._rewrite(lambda f, home: change(f) if own(home) else f)

    def delete_name(self, name: str, sheet: str | None = None) -> list[graph.Cell]:
        """Formulas that use it are worked out again: they are #NAME? or, where a sheet's name went, take the workbook's. Returns them."""
        del (self.names if sheet is None else self.sheets[sheet].names)[name.upper()]
        word = re.compile(r"(?<![\w.!$])" + re.escape(name) + r"(?![\w.(!])", re.I)
        self._renamed()
        used = [(k, r, c) for k, s in self.sheets.items() for (r, c), e in s.edits.items() if e.formula and word.search(re.sub(r'"(?:[^"]|"")*"', "", e.formula))]
        return self._recalculate(used, used)

    def _renamed(self) -> None:
        self._rewrite(lambda f, home: f)

    # -- protection

    def protect(self, sheet: str, open_areas: list[str] = (), allow: set[str] = frozenset()) -> None:
        """Lock a sheet but for some areas. ``allow``: of ``rows``, ``columns``, ``merges`` what may still be changed."""
        if unknown := set(allow) - ALLOWANCES:
            raise ValueError(f"no such allowances: {sorted(unknown)}")
        s = self.sheets[sheet]
        areas = [p.parse(a) for a in open_areas]
        s.locked, s.allow = True, set(allow)
        s.unlocked = [(a.first.row, a.last.row, a.first.col, a.last.col) if isinstance(a, p.Range) else (a.row, a.row, a.col, a.col) for a in areas]

    def unprotect(self, sheet: str) -> None:
        s = self.sheets[sheet]
        s.locked, s.unlocked, s.allow = False, [], set()

    def may_edit(self, sheet: str, row: int, col: int) -> bool:
        s = self.sheets[sheet]
        return not s.locked or any(a <= row <= b and c <= col <= d for a, b, c, d in s.unlocked)

    def add_sheet(self, name: str, df: DataFrame) -> None:
        if name.lower() in (s.lower() for s in self.sheets):
            raise ValueError(f"there is a sheet {name}")
        self.sheets[name] = Sheet(name, df if ROW in df.columns else with_row(df))

    def rename_sheet(self, old: str, new: str) -> None:
        self.sheets = {new if k == old else k: s for k, s in self.sheets.items()}
        self.sheets[new].name = new
        self._rewrite(lambda f, home: rewrite.renamed(f, old, new), {old: new})

    def delete_sheet(self, name: str) -> None:
        del self.sheets[name]
        for cell in [c for c in self.graph.needs if c[0] == name]:
            self.graph.remove(cell)
        self._rewrite(lambda f, home: rewrite.deleted_sheet(f, name))

    def reorder(self, names: list[str]) -> None:
        self.sheets = {n: self.sheets[n] for n in names}

    def _rewrite(self, change, moved: dict[str, str] | None = None) -> None:
        self.graph = graph.Graph()
        self.names = {k: change(f, "") for k, f in self.names.items()}
        for k, s in self.sheets.items():
            s.names = {n: change(f, k) for n, f in s.names.items()}
        for k, s in self.sheets.items():
            for (r, c), e in s.edits.items():
                if e.formula:
                    e.formula = change(e.formula, k)
                    self.graph.set((k, r, c), graph.boxes(e.formula, k, self.names_for(k), list(self.sheets)))

    # -- structure

    def _snapshot(self) -> Snapshot:
        sheets = {k: replace(s, edits={c: replace(e) for c, e in s.edits.items()}, spills=dict(s.spills), merges=list(s.merges), names=dict(s.names)) for k, s in self.sheets.items()}
        return Snapshot(sheets, dict(self.names))

    def _restore(self, at: Snapshot) -> None:
        self.sheets = {k: replace(s, edits={c: replace(e) for c, e in s.edits.items()}, spills=dict(s.spills), merges=list(s.merges), names=dict(s.names)) for k, s in at.sheets.items()}
        self.names = dict(at.names)
        self._rewrite(lambda f, home: f)

    def _structural(self, sheet: str, change, allowance: str | None = None) -> None:
        """One step of undo: ``change`` works on the sheet, and undo puts the state before it back."""
        if self.sheets[sheet].locked and allowance not in self.sheets[sheet].allow:
            raise PermissionError(f"sheet {sheet} is protected")
        before = self._snapshot()
        change(self.sheets[sheet])
        self.done = [*self.done, (before, self._snapshot())][-UNDO_STEPS:]
        self.undone = []

    def _shift(self, s: Sheet, axis: str, at: int, count: int, delete: bool) -> None:
        """Edits, merges, spills and formulas after rows or columns came or went. What lay on them wholly is gone; a merge that loses a part shrinks."""
        k = 0 if axis == "row" else 1
        place = lambda x: x - count if delete and x >= at + count else x + count if not delete and x >= at else x
        gone = lambda x: delete and at <= x < at + count
        moved = lambda cell: tuple(place(x) if j == k else x for j, x in enumerate(cell))
        s.edits = {moved(c): e for c, e in s.edits.items() if not gone(c[k])}
        s.spills = {moved(c): size for c, size in s.spills.items() if not gone(c[k])}
        merges = []
        for box in s.merges:
            low, high = box[2 * k], box[2 * k + 1]
            new = (min(at, low) if gone(low) else place(low), at - 1 if gone(high) else place(high))
            if new[0] <= new[1]:
                whole = (*new, *box[2:]) if k == 0 else (*box[:2], *new)
                if whole[0] < whole[1] or whole[2] < whole[3]:
                    merges.append(whole)
        s.merges = merges
        self._rewrite(lambda f, home: rewrite.edited(f, home or s.name, s.name, axis, at, count, delete))

    def insert_rows(self, sheet: str, at: int, count: int = 1) -> None:
        """Empty rows at a place; edits, formulas, merges and spills move with their rows."""

        def change(s: Sheet) -> None:
            kept = s.base.withColumn(ROW, F.when(F.col(ROW) >= at, F.col(ROW) + count).otherwise(F.col(ROW)))
            blank = s.base.sparkSession.range(at, at + count).select(*[F.col("id").alias(ROW) if c == ROW else F.lit(None).cast(s.base.schema[c].dataType).alias(c) for c in s.base.columns])
            s.base = kept.unionByName(blank)
            self._shift(s, "row", at, count, False)

        self._structural(sheet, change, "rows")

    def delete_rows(self, sheet: str, at: int, count: int = 1) -> None:
        def change(s: Sheet) -> None:
            s.base = s.base.where(~F.col(ROW).between(at, at + count - 1)).withColumn(ROW, F.when(F.col(ROW) >= at + count, F.col(ROW) - count).otherwise(F.col(ROW)))
            self._shift(s, "row", at, count, True)

        self._structural(sheet, change, "rows")

    def insert_columns(self, sheet: str, at: int, names: list[str]) -> None:
        """Empty text columns at a place; edits, formulas, merges and spills move with their columns."""

        def change(s: Sheet) -> None:
            own = s.columns()
            if set(names) & set(own):
                raise ValueError("there are columns of these names")
            fresh = [F.lit(None).cast("string").alias(n) for n in names]
            s.base = s.base.select(ROW, *[F.col(f"`{c}`") for c in own[:at]], *fresh, *[F.col(f"`{c}`") for c in own[at:]])
            self._shift(s, "column", at, len(names), False)

        self._structural(sheet, change, "columns")

    def delete_columns(self, sheet: str, at: int, count: int = 1) -> None:
        def change(s: Sheet) -> None:
            own = s.columns()
            s.base = s.base.select(ROW, *[F.col(f"`{c}`") for c in own[:at] + own[at + count :]])
            self._shift(s, "column", at, count, True)

        self._structural(sheet, change, "columns")

    def move_columns(self, sheet: str, order: list[str]) -> None:
        """The columns in another order; edits, formulas, spills and merges of one column go with them."""

        def change(s: Sheet) -> None:
            own = s.columns()
            if sorted(order) != sorted(own):
                raise ValueError("the same columns, in another order, are asked for")
            to = {k: order.index(c) for k, c in enumerate(own)}
            if any(m[2] != m[3] and [to[c] for c in range(m[2], m[3] + 1) if c in to] != [to[m[2]] + k for k in range(m[3] - m[2] + 1)] for m in s.merges if m[2] in to):
                raise ValueError("a merge would be torn apart")
            s.base = s.base.select(*([ROW] if ROW in s.base.columns else []), *[F.col(f"`{c}`") for c in order])
            s.edits = {(r, to.get(c, c)): e for (r, c), e in s.edits.items()}
            s.spills = {(r, to.get(c, c)): size for (r, c), size in s.spills.items()}
            s.merges = [(a, b, to.get(c, c), to.get(c, c) + d - c) for a, b, c, d in s.merges]
            self._rewrite(lambda f, home: rewrite.permuted(f, home or sheet, sheet, to))

        self._structural(sheet, change, "columns")

    def copy_block(self, sheet: str, area: str, to: str, cut: bool = False) -> None:
        """Copy (or cut) the cells of an area, at most MOST_CELLS, to another place of the sheet.

        Copied formulas move their relative references; cut ones keep theirs, and formulas that name cut cells follow.
        """
        rng, first = p.parse(area), p.cell(to)
        rng = rng if isinstance(rng, p.Range) else p.Range(rng, rng)
        rows, columns = range(rng.first.row, rng.last.row + 1), range(rng.first.col, rng.last.col + 1)
        if len(rows) * len(columns) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} cells")
        down, right = first.row - rng.first.row, first.col - rng.first.col

        def change(s: Sheet) -> None:
            names, kind, view = s.columns(), cells.kinds(s.base), s.view()
            shown = {r[ROW]: r for r in view.where(F.col(ROW).between(rows[0], rows[-1])).select(ROW, *[F.col(f"`{names[c]}`") if cells.kind_of(cells.kinds(view)[names[c]]) != "date" else cells.serial(F.col(f"`{names[c]}`")).alias(names[c]) for c in columns if c < len(names)]).collect()}
            put: dict[tuple[int, int], Edit] = {}
            for r in rows:
                for c in columns:
                    own = s.edits.get((r, c))
                    if own and own.formula:
                        put[r + down, c + right] = Edit(formula=own.formula if cut else rewrite.filled(own.formula, down, right))
                        continue
                    v = shown[r][names[c]] if c < len(names) and r in shown else own.value if own else None
                    if isinstance(v, tuple):
                        v = {cells.NUMBER: v["num"], cells.TEXT: v["str"], cells.BOOL: v["num"] == 1}.get(v["tag"])
                    put[r + down, c + right] = Edit(float(v) if isinstance(v, int) and not isinstance(v, bool) else v)
            if cut:
                s.edits.update({(r, c): Edit() for r in rows for c in columns})
            s.edits.update(put)
            if cut:
                self._rewrite(lambda f, home: rewrite.cut_to(f, home or sheet, sheet, (rows[0], rows[-1], columns[0], columns[-1]), down, right))
            else:
                self._rewrite(lambda f, home: f)
            self._recalculate([(sheet, r, c) for r, c in {*put, *((r, c) for r in rows for c in columns)}])

        self._structural(sheet, change)

    # -- goal seek

    def goal_seek(self, formula: str, sheet: str, target: float, changing: str) -> tuple[float, float, bool]:
        """(input, result, found): the number in ``changing`` that brings the formula to the target, by the secant method.

        Ranges of the sheet that don't depend on the cell are aggregated once: the formula's tree is folded to
        numbers first, and the steps run on the driver.
        """
        ref = p.cell(changing)
        tree = p.parse(formula, self.names)
        if not any(isinstance(r, p.Ref) and (r.row, r.col) == (ref.row, ref.col) for r in p.references(tree)):
            raise ValueError("the formula doesn't depend on that cell")
        if (e := self.sheets[sheet].edits.get((ref.row, ref.col))) and e.formula:
            raise ValueError("that cell holds a formula")

        def fold(node):
            if isinstance(node, p.Ref) and (node.row, node.col) == (ref.row, ref.col):
                return node
            if not any(isinstance(r, p.Ref) and (r.row, r.col) == (ref.row, ref.col) for r in p.references(node)):
                if isinstance(node, (p.Num, p.Str, p.Bool)):
                    return node
                got = compiler.Scalar(self.frames(), sheet).result(node).first()
                return p.Err(got["error"]) if got["error"] else p.Num(float(got["value"] or 0)) if not isinstance(got["value"], str) else p.Str(got["value"])
            if isinstance(node, p.Binary):
                return p.Binary(node.op, fold(node.left), fold(node.right))
            if isinstance(node, p.Unary):
                return p.Unary(node.op, fold(node.arg))
            if isinstance(node, p.Call):
                return p.Call(node.name, tuple(fold(a) for a in node.args))
            return node

        folded = fold(tree)
        spark = self.sheets[sheet].base.sparkSession

        def at(x: float) -> float:
            one = spark.range(1).select(F.lit(0).cast("long").alias(ROW))

            class Probe(compiler.Scalar):
                def cell(self, r: p.Ref) -> compiler.V:
                    return compiler.V(F.lit(float(x)), "number")

            got = Probe(compiler.Sheets({sheet: one}, ROW), sheet).result(folded).first()
            return float(got["value"]) - target if got["value"] is not None else math.nan

        now = self.value(f"={changing}", sheet)
        a = float(now) if isinstance(now, (int, float)) else 0.0
        b = a + (abs(a) * 0.01 or 0.01)
        fa, fb = at(a), at(b)
        best = min(((abs(fa), a, fa), (abs(fb), b, fb)), key=lambda t: (math.isnan(t[0]), t[0]))
        for _ in range(SEEK_STEPS):
            if abs(fb) < SEEK_TOLERANCE:
                return b, fb + target, True
            if fb == fa or math.isnan(fb) or abs(b) > SEEK_LIMIT:
                break
            a, b, fa = b, b - fb * (b - a) / (fb - fa), fb
            fb = at(b)
            if not math.isnan(fb):
                best = min(best, (abs(fb), b, fb))
        return best[1], best[2] + target, abs(best[2]) < SEEK_TOLERANCE


def series(values: list[float], n: int) -> list[float]:
    """Fill: an arithmetic series goes on, anything else is repeated."""
    if len(values) >= 2:
        step = values[1] - values[0]
        if all(math.isclose(b - a, step, rel_tol=1e-9, abs_tol=1e-12) for a, b in zip(values, values[1:], strict=False)):
            return [values[-1] + step * k for k in range(1, n + 1)]
    return [values[k % len(values)] for k in range(n)]


def paste_special(target: DataFrame, source: DataFrame, column: str, op: str, row: str = ROW) -> DataFrame:
    """``target`` with ``source`` (row, value) added to, taken from, multiplied into or divided into a column; empty counts 0, a division by 0 leaves the cell."""
    joined = target.join(source.select(F.col(row).alias("_r"), F.col("value").alias("_v")), F.col(row) == F.col("_r"), "left")
    x, y = F.coalesce(F.col(column), F.lit(0.0)), F.col("_v").cast("double")
    made = {"add": x + y, "sub": x - y, "mul": x * y, "div": F.try_divide(x, y)}[op]
    return joined.withColumn(column, F.coalesce(made, F.col(column))).select(*target.columns)
