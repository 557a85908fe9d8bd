"""Search and replace over the cells of chosen columns."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import cells


@dataclass
class Query:
    """A literal needle or a regular expression; ``whole``: the cell must be it."""

    needle: str
    case: bool = False
    whole: bool = False
    regex: bool = False

    def pattern(self) -> str:
        body = self.needle if self.regex else re.escape(self.needle)
        return ("" if self.case else "(?i)") + (rf"\A(?:{body})\z" if self.whole else body)

    def hits(self, c: Column, kind) -> Column:
        k = cells.kind_of(kind)
        if k in ("number", "date") and not self.regex:
            try:
                return F.coalesce(cells.numbers(c, kind) == float(self.needle), F.lit(False))
            except ValueError:
                return F.lit(False)
        shown = c if k == "text" else cells.shown(c, kind)
        if not self.regex and not self.whole:  # a plain substring test stays a cheap JVM call
            return F.coalesce((shown if self.case else F.lower(shown)).contains(self.needle if self.case else self.needle.lower()), F.lit(False))
        return F.coalesce(shown.rlike(self.pattern()) & c.isNotNull(), F.lit(False))


def search_cells(df: DataFrame, query: Query, columns: list[str], row: str = "_row") -> DataFrame:
    """A row for each hit: row, column, its place, and the text shown."""
    kind = cells.kinds(df)
    entry = [F.when(query.hits(F.col(c), kind[c]), F.struct(F.lit(j).alias("col_at"), F.lit(c).alias("column"), cells.shown(F.col(c), kind[c]).alias("shown"))) for j, c in enumerate(columns)]
    found = F.filter(F.array(*entry), lambda x: x.isNotNull())
    return df.select(F.col(row).alias("at"), F.explode(found).alias("hit")).select("at", "hit.col_at", "hit.column", "hit.shown")


def first_hits(hits: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The first hits in row order, and how many there are in all."""
    return hits.orderBy("at", "col_at").limit(limit), hits.count()


def filter_rows(df: DataFrame, query: Query, columns: list[str]) -> DataFrame:
    """Rows with at least one hit."""
    kind = cells.kinds(df)
    return df.where(reduce(lambda a, b: a | b, [query.hits(F.col(c), kind[c]) for c in columns]))


def step(at: int, n: int, back: bool = False) -> int:
    """Next or previous match, round the end."""
    return (at + (-1 if back else 1)) % n if n else -1


def rewritten(c: Column, query: Query, replacement: str) -> Column:
    """Text with all matches replaced; ``$1`` and the like only in regular expressions."""
    new = replacement if query.regex else re.sub(r"([\\$])", r"\\\1", replacement)
    if not query.regex and query.case and not query.whole:
        return F.replace(c, F.lit(query.needle), F.lit(replacement))
    return F.regexp_replace(c, query.pattern(), new)


def replace_all(df: DataFrame, query: Query, replacement: str, columns: list[str], row: str = "_row") -> tuple[DataFrame, DataFrame]:
    """The frame with text columns rewritten, and the edits (at, column, old, new) that change something."""
    out, entry = df, []
    for c in columns:
        new = rewritten(F.col(c), query, replacement)
        entry.append(F.when(~new.eqNullSafe(F.col(c)), F.struct(F.lit(c).alias("column"), F.col(c).alias("old"), new.alias("new"))))
        out = out.withColumn(c, new)
    edits = df.select(F.col(row).alias("at"), F.explode(F.filter(F.array(*entry), lambda x: x.isNotNull())).alias("e")).select("at", "e.column", "e.old", "e.new")
    return out, edits


def replace_one(df: DataFrame, query: Query, replacement: str, columns: list[str], at: int, column: str, row: str = "_row") -> tuple[DataFrame, DataFrame]:
    """As ``replace_all``, in one cell."""
    if column not in columns:
        raise KeyError(column)
    _, edits = replace_all(df.where(F.col(row) == at), query, replacement, [column], row)
    return df.withColumn(column, F.when(F.col(row) == at, rewritten(F.col(column), query, replacement)).otherwise(F.col(column))), edits


def replace_formulas(edits: dict, query: Query, replacement: str, protected=lambda cell: False) -> dict:
    """New formula texts of the cells whose formula matches, by cell; protected cells are passed over."""
    flags = 0 if query.case else re.IGNORECASE
    pattern = re.compile(query.pattern().removeprefix("(?i)").replace(r"\z", r"\Z"), flags)
    new = re.sub(r"\$(\d)", r"\\\1", replacement) if query.regex else replacement.replace("\\", "\\\\")
    out = {}
    for cell, e in edits.items():
        if e.formula and not protected(cell) and (text := pattern.sub(new, e.formula)) != e.formula:
            out[cell] = text
    return out


def suggestions(df: DataFrame, column: str, prefix: str, row: str = "_row", around: int = 0, scan: int = 20_000, most: int = 8) -> list[str]:
    """Autocomplete: distinct texts near a row that begin with the prefix, case ignored."""
    near = df.where(F.col(row).between(around - scan, around + scan)).select(column).where(F.lower(column).startswith(prefix.lower())).distinct()
    return [r[0] for r in near.orderBy(column).limit(most).collect()]
