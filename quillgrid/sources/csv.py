"""CSV: a look at the first bytes, typed reading, and export."""

from __future__ import annotations

import codecs
import csv as pycsv
import io
import re
import uuid
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from html import escape
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import cells

PREFIX = 131_072
PREVIEW = 100
#: The most fields of a record that a sheet takes.
MOST_FIELDS = 16_384
#: Delimiters tried, and byte order marks.
DELIMITERS = (",", ";", "\t", "|")
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


@dataclass
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    encoding: str = "utf-8"
    skip_rows: int = 0
    header: bool = True


def prefix(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, or of the first file that a pattern or folder holds, through the store's own reader."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    if found and found[0].isDirectory():
        found = [f for f in fs.listStatus(found[0].getPath()) if f.isFile() and f.getPath().getName()[0] not in "._"]
    if not found:
        raise FileNotFoundError(path)
    stream = fs.open(found[0].getPath())
    try:
        out = jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, PREFIX))
    finally:
        stream.close()
    return bytes(out)


def encoding_of(head: bytes) -> str:
    for mark, name in MARKS:
        if head.startswith(mark):
            return name
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 4:
            return "windows-1252"
    if head[1::2].count(0) > len(head) // 4:
        return "utf-16-le"
    return "utf-16-be" if head[::2].count(0) > len(head) // 4 else "utf-8"


def records(text: str, delimiter: str, quote: str) -> list[list[str]]:
    """Records that aren't blank, as far as the text can be read."""
    out, reader = [], pycsv.reader(io.StringIO(text.replace("\r\n", "\n").replace("\r", "\n")), delimiter=delimiter, quotechar=quote)
    try:
        out += (r for r in reader if r)
    except pycsv.Error:
        pass
    return out


def sniff_bytes(head: bytes) -> Dialect:
    """By the commonest number of fields: the delimiter and quote that give the most lines one width above 1."""
    encoding = encoding_of(head)
    text = head.decode(encoding, "replace").lstrip("﻿")
    cut = text.rfind("\n")
    sample = text[: cut + 1] if 0 < cut and len(head) >= PREFIX else text
    best, found = (-1.0,), Dialect(encoding=encoding)
    more = [c for c, _ in Counter(ch for ch in sample if not ch.isalnum() and ch not in " \r\n\"'.-_").most_common(3)]
    for delimiter in dict.fromkeys([*DELIMITERS, *more]):
        for quote in ('"', "'"):
            rows = records(sample, delimiter, quote)
            widths = Counter(len(r) for r in rows)
            width, n = max(widths.items(), key=lambda kv: (kv[0] > 1, kv[1]), default=(1, 0))
            quoted = sample.count(delimiter + quote)
            score = (n / max(1, len(rows)) if width > 1 else 0.0, delimiter in DELIMITERS, width, quoted)
            if score > best:
                skip = next((k for k, r in enumerate(rows) if len(r) == width), 0)
                best, found = score, Dialect(delimiter, quote, encoding, skip, True)
    rows = records(sample, found.delimiter, found.quote)[found.skip_rows :]
    found.header = looks_like_header(rows)
    return found


def looks_like_header(rows: list[list[str]]) -> bool:
    """The first row is names if it holds no number and no empty or repeated field, and something below does differ in kind or it is all text."""
    if not rows:
        return False
    number = re.compile(r"\s*[-+]?[\d.,]+%?\s*")
    first = [f.strip() for f in rows[0]]
    return not any(not f or number.fullmatch(f) for f in first) and len({f.lower() for f in first}) == len(first)


def sniff(spark: SparkSession, path: str) -> Dialect:
    return sniff_bytes(prefix(spark, path))


def preview(head: bytes, dialect: Dialect) -> list[list[str]]:
    text = head.decode(dialect.encoding, "replace").lstrip("﻿")
    return records(text, dialect.delimiter, dialect.quote)[dialect.skip_rows : dialect.skip_rows + PREVIEW]


def unique_names(names: list[str]) -> list[str]:
    """Headers without blanks or repeats."""
    out, seen = [], set()
    for k, n in enumerate(names):
        from ..formula.parser import column_letters

        base = n.strip() or column_letters(k)
        name, j = base, 2
        while name.lower() in seen:
            name, j = f"{base}_{j}", j + 1
        seen.add(name.lower())
        out.append(name)
    return out


def has_line_ends_in_quotes(spark: SparkSession, path: str, d: Dialect) -> bool:
    """Whether a line has an odd number of quotes: then some field holds a line end, and files can't be cut at any line."""
    lines = spark.read.option("encoding", d.encoding).text(path) if d.encoding == "utf-8" else spark.read.csv(path, schema="value string", sep="\u0001", quote="", encoding=d.encoding)
    odd = (F.char_length("value") - F.char_length(F.replace("value", F.lit(d.quote), F.lit("")))) % 2 == 1
    return not lines.where(odd).limit(1).isEmpty()


def read(spark: SparkSession, path: str, dialect: Dialect | None = None, max_rows: int | None = None, multiline: bool | None = None, columns: list[str] | None = None) -> DataFrame:
    """A sheet: ``_row`` and a column for each field, typed where all its cells are of one kind, else mixed.

    Files of a folder follow one another by name; each may have the header. Files are cut over the cluster unless
    a field holds a line end (found by a pass over the lines; ``multiline`` says so beforehand). No field is lost: a
    record with more fields than the first ones gets columns of its own.
    """
    d = dialect or sniff(spark, path)
    if multiline is None:
        multiline = has_line_ends_in_quotes(spark, path, d)
    rows = preview(prefix(spark, path), d)
    width = max((len(r) for r in rows), default=1)

    def raw(width: int, extra: str = "") -> DataFrame:
        schema = ", ".join(f"c{k} string" for k in range(width)) + extra
        return spark.read.csv(path, schema=schema, sep=d.delimiter, quote=d.quote, escape=d.quote, encoding=d.encoding, header=False, multiLine=multiline, mode="PERMISSIVE", columnNameOfCorruptRecord="_odd", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)

    # Records of another width come back whole; the most delimiters in one bounds the width.
    marks = F.char_length("_odd") - F.char_length(F.replace("_odd", F.lit(d.delimiter), F.lit("")))
    # All fields are asked for, as the parser checks the width of what it is asked for only.
    most = raw(width, ", _odd string").agg(F.max(marks), *[F.count(f"c{k}") for k in range(width)]).first()[0]
    wide = max(width, (most or 0) + 1)
    if wide > MOST_FIELDS:
        raise ValueError(f"a record of {wide} fields")
    found = raw(wide).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    head = [*rows[0], *[""] * (wide - len(rows[0]))] if d.header and rows else [""] * wide
    names = [*columns, *unique_names([*columns, *[""] * (wide - len(columns))])[len(columns) :]] if columns else unique_names(head)

    # The splits of the files in order, each with its rows: as many as there are splits, whatever the rows.
    splits = found.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    by_file, in_order = Window.partitionBy("_file").orderBy("_start"), Window.orderBy("_file", "_start")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("_file", "_start", "_low", before(by_file).alias("_in_file"), before(in_order).alias("_before"))
    placed = found.join(offsets, ["_file", "_start"]).withColumn("_here", F.col("_at") - F.col("_low") + F.col("_in_file")).withColumn("_all", F.col("_at") - F.col("_low") + F.col("_before"))
    first = offsets.agg(F.min("_file")).first()[0]
    same = reduce(lambda x, y: x & y, [F.coalesce(F.trim(f"c{k}"), F.lit("")) == F.lit(n.strip()) for k, n in enumerate(head)])
    lead = (F.col("_here") < d.skip_rows) | ((F.col("_here") == d.skip_rows) & ((F.col("_file") == first) | same) if d.header else F.lit(False))
    skipped = placed.where(lead).groupBy("_file").agg(F.count("*").alias("_gone")).select("_file", F.coalesce(F.sum("_gone").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("_gone"))
    # A file without lead rows has as many gone before it as the file before it.
    files = splits.select("_file").distinct().join(skipped, "_file", "left").select("_file", F.coalesce(F.last("_gone", ignorenulls=True).over(Window.orderBy("_file")), F.lit(0)).alias("_gone"))
    kept = placed.where(~lead).join(F.broadcast(files), "_file").withColumn("_row", (F.col("_all") - F.col("_gone")).cast("long"))
    kept = kept.select("_row", *[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
    if max_rows is not None:
        kept = kept.where(F.col("_row") < max_rows)
    return typed(kept, names, width)


def typed(df: DataFrame, names: list[str], sure: int | None = None) -> DataFrame:
    """Text fields as cells: one pass finds each column's kinds, and a column of one kind gets its native type.

    Of the columns past ``sure``, which a quoted delimiter may have suggested, those after the last one with a cell are left out.
    """
    mixed = df.select("_row", *[cells.field(F.col(f"`{n}`")).alias(n) for n in names])
    tags = mixed.agg(*[F.collect_set(F.col(f"`{n}`")["tag"]).alias(f"k{j}") for j, n in enumerate(names)]).first()
    out = ["_row"]
    full = [j for j in range(len(names)) if tags[j] and set(tags[j]) != {None}]
    names = names[: max([sure if sure is not None else len(names), *(j + 1 for j in full)])]
    for j, n in enumerate(names):
        c, kinds = F.col(f"`{n}`"), set(tags[j])
        if kinds <= {cells.NUMBER}:
            out.append(c["num"].alias(n))
        elif kinds == {cells.BOOL}:
            out.append((c["num"] != 0).alias(n))
        elif kinds == {cells.TEXT}:
            out.append(c["str"].alias(n))
        else:
            out.append(c.alias(n))
    return mixed.select(*out)


def export(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", row: str = "_row", single: bool = False, line_end: str = "\n") -> None:
    """As CSV in row order, quoted only where needed; ``single``: one part file.

    It is written beside ``path`` and renamed when it is whole, so a reader never sees a part of it.
    """
    kind = cells.kinds(df)
    shown = [cells.shown(F.col(f"`{c}`"), kind[c]).alias(c) for c in df.columns if c != row]
    ordered = df.orderBy(row) if row in df.columns else df
    out = ordered.select(*shown)
    if line_end not in ("\n", "\r\n", "\r"):
        raise ValueError("no line end")
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(path)
    try:
        (out.coalesce(1) if single else out).write.csv(beside.toString(), header=header, sep=delimiter, escape='"', emptyValue="", lineSep=line_end, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        if not fs.rename(beside, target):
            raise OSError(f"couldn't rename to {path}")
    finally:
        fs.delete(beside, True)


def to_tsv(rows: list[list[object]]) -> str:
    """Clipboard text: fields with tabs, line ends or quotes are quoted."""
    quoted = lambda s: '"' + s.replace('"', '""') + '"' if re.search(r'[\t\n\r"]', s) else s
    return "\n".join("\t".join(quoted("" if v is None else str(v)) for v in r) for r in rows)


def from_tsv(text: str) -> list[list[str]]:
    return [r for r in pycsv.reader(io.StringIO(text), delimiter="\t")]


class _Cells(HTMLParser):
    """Rows and cells of the first table of a page, or, without one, its lines."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.loose, self.inside, self.done = "", False, False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.rows = self.rows or [[]]
            self.rows[-1].append("")
            self.inside = True
        elif tag == "br":
            self.handle_data("\n")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.inside = False
        elif tag == "table" and self.rows:
            self.done = True
        elif tag in ("p", "div"):
            self.handle_data("\n")

    def handle_data(self, data):
        if self.inside:
            self.rows[-1][-1] += data
        elif not self.done:
            self.loose += data


def to_html(rows: list[list[object]]) -> str:
    """Clipboard HTML: a table of the cells."""
    cell = lambda v: "<td>" + escape("" if v is None else str(v)).replace("\n", "<br>") + "</td>"
    return "<table>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"


def from_html(page: str) -> list[list[str]]:
    """The cells of clipboard HTML: of its first table, else its lines as rows of one cell."""
    found = _Cells()
    found.feed(page)
    found.close()
    if found.rows:
        return [[c.strip(" \t\r\n\xa0") for c in r] for r in found.rows]
    return [[x.strip()] for x in found.loose.split("\n") if x.strip()]
