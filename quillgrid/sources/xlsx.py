"""xlsx workbooks, read and written with the standard library, behind checks against hostile archives."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import cells
from ..formula.parser import column_letters, column_number

#: Fixed values of the format and of the checks.
MOST_ROWS, MOST_COLUMNS = 1_048_576, 16_384
MOST_RATIO, MOST_ENTRIES, MOST_ENTRY, MOST_TOTAL = 200, 10_000, 1 << 31, 1 << 33
SMALL_ENTRY = 1 << 20
NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class HostileFile(ValueError):
    pass


def inspect(body: bytes) -> zipfile.ZipFile:
    """The archive, if nothing about it is suspect: sizes, ratios, entry names, repeats, document type declarations."""
    try:
        z = zipfile.ZipFile(io.BytesIO(body))
    except zipfile.BadZipFile as e:
        raise HostileFile(f"not a readable archive: {e}") from e
    entries, total, seen = z.infolist(), 0, set()
    if len(entries) > MOST_ENTRIES:
        raise HostileFile("too many entries")
    for e in entries:
        parts = e.filename.replace("\\", "/").split("/")
        if e.filename.startswith(("/", "\\")) or ".." in parts or ":" in parts[0] or "\0" in e.filename:
            raise HostileFile(f"entry outside the archive: {e.filename!r}")
        if e.filename.lower() in seen:
            raise HostileFile(f"entry twice: {e.filename!r}")
        seen.add(e.filename.lower())
        total += e.file_size
        if e.file_size > MOST_ENTRY or total > MOST_TOTAL or (e.file_size > SMALL_ENTRY and e.file_size > MOST_RATIO * max(1, e.compress_size)):
            raise HostileFile(f"entry too large: {e.filename!r}")
        if e.flag_bits & 1:
            raise HostileFile("encrypted")
    return z


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        with z.open(name) as f:
            body = f.read(MOST_ENTRY + 1)
    except KeyError:
        return None
    except (zipfile.BadZipFile, zlib.error, EOFError, OSError) as e:
        raise HostileFile(f"broken entry {name}: {e}") from e
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", body):
        raise HostileFile(f"document type in {name}")
    try:
        return ElementTree.fromstring(body)
    except ElementTree.ParseError as e:
        raise HostileFile(f"broken markup in {name}: {e}") from e


def _strings(z: zipfile.ZipFile) -> list[str]:
    root = _xml(z, "xl/sharedStrings.xml")
    return [] if root is None else ["".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")) for si in root.findall("m:si", NS)]


def read_bytes(body: bytes) -> tuple[dict[str, dict[tuple[int, int], tuple[object, str | None]]], dict[str, str]]:
    """({sheet: {(row, column): (value, formula)}}, names). Errors are ``("#REF!",)``-like one-tuples."""
    z = inspect(body)
    book = _xml(z, "xl/workbook.xml")
    if book is None:
        raise HostileFile("no workbook inside")
    rels = _xml(z, "xl/_rels/workbook.xml.rels")
    targets = {r.get("Id"): r.get("Target") for r in rels} if rels is not None else {}
    strings, out = _strings(z), {}
    for s in book.findall("m:sheets/m:sheet", NS):
        target = targets.get(s.get(REL), "").lstrip("/")
        root = _xml(z, target if target.startswith("xl/") else f"xl/{target}")
        found: dict[tuple[int, int], tuple[object, str | None]] = {}
        row_at = -1
        for row in root.iter(f"{{{NS['m']}}}row") if root is not None else ():
            row_at = int(row.get("r", row_at + 2)) - 1
            col_at = -1
            for c in row.findall("m:c", NS):
                ref = c.get("r")
                col_at = column_number(re.match("[A-Z]+", ref)[0]) if ref else col_at + 1
                v, f = c.find("m:v", NS), c.find("m:f", NS)
                text, kind = (v.text if v is not None else None), c.get("t", "n")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
                elif text is None:
                    value = None
                elif kind == "s":
                    value = strings[int(text)] if int(text) < len(strings) else None
                elif kind == "b":
                    value = text == "1"
                elif kind == "e":
                    value = (text,)
                elif kind == "str":
                    value = text
                else:
                    value = float(text)
                if value is not None or f is not None:
                    found[row_at, col_at] = (value, f"={f.text}" if f is not None and f.text else None)
        out[s.get("name")] = found
    names = {n.get("name"): n.text or "" for n in book.findall("m:definedNames/m:definedName", NS)}
    return out, names


def read(spark: SparkSession, path: str, header: bool = True) -> dict[str, DataFrame]:
    """A frame for each sheet, as ``sources.csv`` types its columns; formulas give their stored values."""
    body = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    sheets, _ = read_bytes(body)
    from .csv import unique_names

    out = {}
    for name, found in sheets.items():
        height = max((r for r, _ in found), default=-1) + 1
        width = max((c for _, c in found), default=0) + 1
        heads = unique_names([str(found.get((0, c), ("", None))[0] or "") for c in range(width)]) if header else [column_letters(c) for c in range(width)]
        rows = []
        for r in range(int(header), height):
            row = [r - int(header)]
            for c in range(width):
                v = found.get((r, c), (None, None))[0]
                row.append(None if v is None else (cells.BOOL, float(v), None, None) if isinstance(v, bool) else (cells.NUMBER, v, None, None) if isinstance(v, float) else (cells.ERROR, None, None, v[0]) if isinstance(v, tuple) else (cells.TEXT, None, v, None))
            rows.append(tuple(row))
        schema = "_row long, " + ", ".join(f"`{h}` {cells.MIXED.simpleString()}" for h in heads)
        out[name] = narrowed(spark.createDataFrame(rows, schema), heads)
    return out


def narrowed(df: DataFrame, names: list[str]) -> DataFrame:
    """Mixed columns of one kind in their native type."""
    tags = df.agg(*[F.collect_set(F.col(f"`{n}`")["tag"]).alias(f"k{j}") for j, n in enumerate(names)]).first()
    out = ["_row"]
    for j, n in enumerate(names):
        c, kinds = F.col(f"`{n}`"), set(tags[j])
        out.append(c["num"].alias(n) if kinds <= {cells.NUMBER} else (c["num"] != 0).alias(n) if kinds == {cells.BOOL} else c["str"].alias(n) if kinds == {cells.TEXT} else c.alias(n))
    return df.select(*out)


def _cell(ref: str, value: object, formula: str | None) -> str:
    f = f"<f>{escape(formula.lstrip('='))}</f>" if formula else ""
    if isinstance(value, tuple):
        return f'<c r="{ref}" t="e">{f}<v>{escape(value[0])}</v></c>'
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b">{f}<v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}">{f}<v>{value!r}</v></c>'
    if value is None:
        return f'<c r="{ref}">{f}</c>' if f else ""
    body = escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(value)))
    if f:
        return f'<c r="{ref}" t="str">{f}<v>{body}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{body}</t></is></c>'


def write(path: str, sheets: dict[str, DataFrame], formulas: dict[str, dict[tuple[int, int], str]] | None = None, row: str = "_row", header: bool = True) -> None:
    """Stream the sheets into a workbook; one that doesn't fit the format is refused before anything is written."""
    for name, df in sheets.items():
        n, width = df.count() + int(header), len([c for c in df.columns if c != row])
        if n > MOST_ROWS or width > MOST_COLUMNS:
            raise ValueError(f"sheet {name}: {n} rows and {width} columns don't fit")
    main, pkg = NS["m"], "http://schemas.openxmlformats.org/package/2006"
    doc = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pkg}/relationships"><Relationship Id="rId1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        tabs = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{doc}"><sheets>{tabs}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pkg}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{doc}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, (name, df) in enumerate(sheets.items(), 1):
            names = [c for c in df.columns if c != row]
            kind = cells.kinds(df)
            own = (formulas or {}).get(name, {})
            picked = [cells.serial(F.col(f"`{c}`")).alias(c) if cells.kind_of(kind[c]) == "date" else F.col(f"`{c}`") for c in names]
            ordered = (df.orderBy(row) if row in df.columns else df).select(*picked)
            with z.open(f"xl/worksheets/sheet{k}.xml", "w", force_zip64=True) as f:
                f.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
                at = 0
                if header:
                    f.write(('<row r="1">' + "".join(_cell(f"{column_letters(c)}1", n, None) for c, n in enumerate(names)) + "</row>").encode())
                    at = 1
                for r, values in enumerate(ordered.toLocalIterator()):
                    out = []
                    for c, v in enumerate(values):
                        if cells.is_mixed(kind[names[c]]) and v is not None:
                            v = {cells.NUMBER: v["num"], cells.TEXT: v["str"], cells.BOOL: v["num"] == 1 if v["num"] is not None else None, cells.ERROR: (v["err"],)}[v["tag"]]
                        out.append(_cell(f"{column_letters(c)}{r + at + 1}", v, own.get((r, c))))
                    f.write((f'<row r="{r + at + 1}">' + "".join(out) + "</row>").encode())
                f.write(b"</sheetData></worksheet>")
