"""Cell values as Spark columns.

A column whose cells are all of one kind keeps its native type (double, boolean, string); a column of mixed
cells is ``struct<tag:tinyint,num:double,str:string,err:string>``. An empty cell is NULL in either form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER, TEXT, BOOL, ERROR, EMPTY = 0, 1, 2, 3, 4
MIXED = T.StructType([T.StructField("tag", T.ByteType()), T.StructField("num", T.DoubleType()), T.StructField("str", T.StringType()), T.StructField("err", T.StringType())])

#: Error spellings in the order of ERROR.TYPE, from 1.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#SPILL!", "#CIRC!")
NULL_E, DIV0, VALUE, REF, NAME, NUM, NA, SPILL, CIRC = ERRORS


def is_mixed(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == MIXED.names


def kind_of(kind: T.DataType) -> str:
    """'number', 'text', 'bool', 'date', or 'mixed'. Nested and binary columns have no cell form and are refused."""
    if is_mixed(kind):
        return "mixed"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    raise TypeError(f"no cell form for {kind.simpleString()}")


def mixed(tag: int, num: Column | None = None, text: Column | None = None, err: Column | None = None) -> Column:
    none = lambda x, t: (x if x is not None else F.lit(None)).cast(t)
    return F.struct(F.lit(tag).cast("tinyint").alias("tag"), none(num, "double").alias("num"), none(text, "string").alias("str"), none(err, "string").alias("err"))


def to_mixed(c: Column, kind: T.DataType) -> Column:
    """Any column in the mixed form; NULL stays NULL."""
    k = kind_of(kind)
    if k == "mixed":
        return c
    made = {"number": lambda: mixed(NUMBER, c.cast("double")), "text": lambda: mixed(TEXT, text=c), "bool": lambda: mixed(BOOL, c.cast("int").cast("double")), "date": lambda: mixed(NUMBER, serial(c))}[k]()
    return F.when(c.isNotNull(), made)


def serial(c: Column) -> Column:
    """Spreadsheet serial of a date or timestamp: days since 1899-12-30 and the part of a day; a day less before 1900-03-01."""
    at = c.cast("timestamp_ntz")
    days = F.date_diff(at.cast("date"), F.lit("1899-12-30").cast("date"))
    part = (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)).cast("double") / 86400
    return F.when(days < 61, days - 1).otherwise(days).cast("double") + part


def from_serial(c: Column) -> Column:
    """Date of a serial; 60, a day that never was, is 1900-02-28's neighbour 1900-03-01 less one."""
    whole = F.floor(c).cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), F.when(whole < 60, whole + 1).otherwise(whole))


def numbers(c: Column, kind: T.DataType) -> Column:
    """What an aggregate over a range takes: number cells, others NULL."""
    k = kind_of(kind)
    if k == "number":
        return c.cast("double")
    if k == "date":
        return serial(c)
    if k == "mixed":
        return F.when(c["tag"] == NUMBER, c["num"])
    return F.lit(None).cast("double")


def errors(c: Column, kind: T.DataType) -> Column:
    return F.when(c["tag"] == ERROR, c["err"]) if kind_of(kind) == "mixed" else F.lit(None).cast("string")


def as_number(c: Column, kind: T.DataType) -> Column:
    """A direct argument as a number: true 1, false 0, empty 0; text and errors NULL."""
    k = kind_of(kind)
    if k == "mixed":
        return F.when(c.isNull(), 0.0).when(c["tag"].isin(NUMBER, BOOL), c["num"])
    if k == "text":
        return F.when(c.isNull(), 0.0)
    return F.coalesce(serial(c) if k == "date" else c.cast("int").cast("double") if k == "bool" else c.cast("double"), F.lit(0.0))


def number_text(c: Column) -> Column:
    """Number as shown: whole below 1e15 without decimals, scientific outside [1e-4, 1e11), else up to 10 decimals."""
    x = c.cast("double")
    size = F.abs(x)
    whole = (x == F.floor(x)) & (size < 1e15)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    power = F.floor(F.log10(size)).cast("int")
    mantissa = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x / F.pow(F.lit(10.0), power)), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(x.isNull(), None).when(F.isnan(x), "NaN").when(whole, F.format_string("%d", F.when(whole, x).cast("long"))).when((size >= 1e11) | (size < 1e-4), F.concat(mantissa, F.lit("E"), power.cast("string"))).otherwise(plain)


def shown(c: Column, kind: T.DataType) -> Column:
    """Text that a cell shows; empty: ''."""
    k = kind_of(kind)
    truth = lambda x: F.when(x, "TRUE").otherwise("FALSE")
    if k == "mixed":
        text = F.when(c["tag"] == NUMBER, number_text(c["num"])).when(c["tag"] == BOOL, truth(c["num"] != 0)).when(c["tag"] == ERROR, c["err"]).otherwise(c["str"])
    elif k == "bool":
        text = F.when(c.isNotNull(), truth(c))
    elif k == "text":
        text = c
    else:
        text = number_text(serial(c) if k == "date" else c)
    return F.coalesce(text, F.lit(""))


def field(text: Column) -> Column:
    """A CSV field as a mixed cell: empty, a number if it starts like one, TRUE/FALSE in three spellings, else text."""
    t = F.regexp_replace(text, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")
    number = F.when(t.rlike(r"^[0-9+.\-]"), t.try_cast("double"))
    return F.when((t == "") | t.isNull(), None).when(number.isNotNull() & ~t.rlike("[dDfF]$"), mixed(NUMBER, number)).when(t.isin("true", "TRUE", "True"), mixed(BOOL, F.lit(1.0))).when(t.isin("false", "FALSE", "False"), mixed(BOOL, F.lit(0.0))).otherwise(mixed(TEXT, text=t))


def rank(c: Column, kind: T.DataType) -> Column:
    """Order of kinds in a view sort: number, text, bool, error; empty and white-space text last."""
    k = kind_of(kind)
    blank = lambda s: s.isNull() | s.rlike(r"^\s*$")
    if k == "mixed":
        return F.when(c.isNull() | ((c["tag"] == TEXT) & blank(c["str"])), EMPTY).otherwise(c["tag"].cast("int"))
    empty = blank(c) if k == "text" else c.isNull()
    return F.when(empty, EMPTY).otherwise({"number": NUMBER, "date": NUMBER, "text": TEXT, "bool": BOOL}[k])


def kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema}
