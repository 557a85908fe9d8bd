"""Dynamic arrays: frames with a place ``_r`` (from 0, without gaps) and columns in order.

Each function takes and gives such frames. Pads are #N/A in a column ``error`` where a shape can't be filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import cells
from . import dedupe, positional, sorting

R = "_r"


def columns_of(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != R]


def placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` with places by a numeric first order column, worked out in blocks."""
    return positional.numbered(df.drop(R) if R in df.columns else df, order, R)


def replaced(df: DataFrame) -> DataFrame:
    """Places without gaps after rows went."""
    old = "_old"
    return positional.numbered(df.withColumnRenamed(R, old), [F.col(old)], R).select(R, *columns_of(df))


def from_sheet(df: DataFrame, columns: list[str], row: str = "_row", first: int | None = None, last: int | None = None) -> DataFrame:
    out = df if first is None else df.where(F.col(row).between(first, last))
    start = 0 if first is None else first
    return out.select((F.col(row) - start).cast("long").alias(R), *columns)


def vstack(*frames: DataFrame) -> DataFrame:
    """One under another by place of columns; short rows are padded, marked in ``error``."""
    width = max(len(columns_of(f)) for f in frames)
    names = columns_of(max(frames, key=lambda f: len(columns_of(f))))
    out, base = None, F.lit(0).cast("long")
    for f in frames:
        own = columns_of(f)
        part = f.select((F.col(R) + base).alias(R), *[F.col(c).alias(n) for c, n in zip(own, names, strict=False)], *[F.lit(None).alias(n) for n in names[len(own) :]], F.when(F.lit(len(own) < width), cells.NA).alias("error"))
        out = part if out is None else out.unionByName(part)
        base = base + f.count()
    return out


def hstack(*frames: DataFrame) -> DataFrame:
    """Side by side by place; missing rows are padded, marked in ``error``."""
    out = None
    for k, f in enumerate(frames):
        part = f.select(R, *[F.col(c).alias(f"c{k}_{c}") for c in columns_of(f)], F.lit(1).alias(f"_there{k}"))
        out = part if out is None else out.join(part, R, "full_outer")
    there = [c for c in out.columns if c.startswith("_there")]
    short = F.greatest(*[F.col(c).isNull() for c in there]) if len(there) > 1 else F.lit(False)
    return out.withColumn("error", F.when(short, cells.NA)).drop(*there)


def take(df: DataFrame, rows: int | None, columns: int | None = None) -> DataFrame:
    """The first rows (or, negative, the last), and columns alike; 0 is an error."""
    if rows == 0 or columns == 0:
        raise ValueError(cells.VALUE)
    out = df
    if rows is not None:
        out = df.where(F.col(R) < rows) if rows > 0 else df.where(F.col(R) >= max(0, df.count() + rows))
        if rows < 0:
            out = out.withColumn(R, F.col(R) - max(0, df.count() + rows))
    if columns is not None:
        kept = columns_of(df)[:columns] if columns > 0 else columns_of(df)[columns:]
        out = out.select(R, *kept)
    return out


def drop(df: DataFrame, rows: int = 0, columns: int = 0) -> DataFrame:
    """Without the first rows (or, negative, the last), and columns alike."""
    out = df
    if rows > 0:
        out = df.where(F.col(R) >= rows).withColumn(R, F.col(R) - rows)
    elif rows < 0:
        out = df.where(F.col(R) < df.count() + rows)
    kept = columns_of(df)[columns:] if columns >= 0 else columns_of(df)[:columns]
    if not kept:
        raise ValueError(cells.VALUE)
    return out.select(R, *kept)


def sort(df: DataFrame, index: int = 1, ascending: bool = True) -> DataFrame:
    """Rows by one column in SORT's collation; ties keep their order. The result's places are its order."""
    column = columns_of(df)[index - 1]
    order = [*sorting.array_order(df, column, ascending), F.col(R).asc()]
    return ranked(df, order)


def sort_columns(df: DataFrame, index: int = 1, ascending: bool = True) -> DataFrame:
    """Columns by one row (from 1) in SORT's collation; ties keep their order. The row is one small frame of its own."""
    names, row = columns_of(df), df.where(F.col(R) == index - 1)
    keys = sort(transpose(row).withColumn("_name", F.element_at(F.array(*[F.lit(n) for n in names]), (F.col(R) + 1).cast("int"))), 1, ascending)
    return df.select(R, *[F.col(k["_name"]) for k in keys.orderBy(R).select("_name").collect()])


def unique_columns(df: DataFrame, exactly_once: bool = False) -> DataFrame:
    """Distinct columns in order of first appearance: pairs of columns are compared in one pass."""
    names, kind = columns_of(df), cells.kinds(df)
    fold = lambda c: F.lower(F.col(c)) if cells.kind_of(kind[c]) == "text" else F.col(c).cast("double") if cells.kind_of(kind[c]) != "mixed" else F.col(c)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :] if fold(a) is not None and (cells.kind_of(kind[a]) in ("text", "mixed")) == (cells.kind_of(kind[b]) in ("text", "mixed")) and (cells.kind_of(kind[a]) == "mixed") == (cells.kind_of(kind[b]) == "mixed")]
    row = df.agg(F.lit(1), *[F.min(fold(a).eqNullSafe(fold(b)).cast("int")) for a, b in pairs]).first()
    first = {n: n for n in names}
    for (a, b), same in zip(pairs, row[1:], strict=True):
        if same != 0 and first[b] == b:
            first[b] = first[a]
    kept = [n for n in names if first[n] == n and not (exactly_once and list(first.values()).count(n) > 1)]
    return df.select(R, *kept)


def sortby(df: DataFrame, keys: list[tuple[DataFrame, bool]]) -> DataFrame:
    """Rows by columns of other frames of the same length."""
    out, order = df, []
    for k, (other, up) in enumerate(keys):
        name = f"_by{k}"
        out = out.join(other.select(R, F.col(columns_of(other)[0]).alias(name)), R)
        order += sorting.array_order(out, name, up)
    return ranked(out, [*order, F.col(R).asc()]).select(R, *columns_of(df))


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` renumbered along any order: a range sort, counted in parts, so no task sees all rows."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order) if df.sparkSession.conf.get("spark.sql.shuffle.partitions") != "1" else df.coalesce(1).sortWithinPartitions(*order)
    # The part number and the place inside it are one long that rises along the order; ranking those longs is numeric.
    marked = dealt.withColumn("_at", F.monotonically_increasing_id())
    kept = marked.drop(R).checkpoint() if marked.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else _written(marked.drop(R))
    part = F.shiftright("_at", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_start")
    out = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.select((F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(R), *columns_of(df))


def _written(df: DataFrame) -> DataFrame:
    from ..sources.shared import keep

    return keep(df)


def unique(df: DataFrame, exactly_once: bool = False) -> DataFrame:
    """Distinct rows in order of first appearance."""
    out = dedupe.unique(df, columns_of(df), R, exactly_once)
    return placed(out, [F.col("first_row")]).select(R, *columns_of(df))


def where(df: DataFrame, include: DataFrame | Column) -> DataFrame:
    """Rows for which ``include`` (a frame of one column, or a condition) is true."""
    if isinstance(include, Column):
        return replaced(df.where(include))
    flag = columns_of(include)[0]
    joined = df.join(include.select(R, F.col(flag).alias("_in")), R)
    return replaced(joined.where(F.col("_in").cast("double") != 0).select(R, *columns_of(df)))


def tocol(df: DataFrame, ignore: int = 0, by_column: bool = False) -> DataFrame:
    """All cells in one column: row by row, or column by column; ``ignore`` 1 or 3 skips empty cells, 2 or 3 errors."""
    kind, names = cells.kinds(df), columns_of(df)
    same = len({kind[c].simpleString() for c in names}) == 1
    cell = lambda c: F.col(c) if same else cells.to_mixed(F.col(c), kind[c])
    entry = F.array(*[F.struct(F.lit(j).alias("j"), cell(c).alias("value")) for j, c in enumerate(names)])
    flat = df.select(F.col(R).alias("i"), F.explode(entry).alias("e")).select("i", "e.j", "e.value")
    if ignore in (1, 3):
        flat = flat.where("value is not null")
    if ignore in (2, 3) and cells.is_mixed(flat.schema["value"].dataType):
        flat = flat.where(F.col("value.err").isNull())
    n = df.count()
    at = F.col("j") * n + F.col("i") if by_column else F.col("i") * len(names) + F.col("j")
    out = flat.withColumn("_at", at.cast("long")).select("_at", "value")
    if ignore:
        return positional.numbered(out, [F.col("_at")], R).select(R, "value")
    return out.select(F.col("_at").alias(R), "value")


def wraprows(df: DataFrame, width: int) -> DataFrame:
    """A vector in rows of ``width``; cells past the end are NULL, and ``pad`` counts them."""
    c = columns_of(df)[0]
    row = F.floor(F.col(R) / width)
    out = df.groupBy(row.alias(R)).agg(*[F.max(F.when(F.col(R) % width == j, F.col(c))).alias(f"c{j}") for j in range(width)], (F.lit(width) - F.count("*")).cast("long").alias("pad"))
    return out


def wrapcols(df: DataFrame, height: int) -> DataFrame:
    """A vector in columns of ``height``."""
    c, n = columns_of(df)[0], df.count()
    width = -(-n // height)
    return df.groupBy((F.col(R) % height).alias(R)).agg(*[F.max(F.when(F.floor(F.col(R) / height) == j, F.col(c))).alias(f"c{j}") for j in range(width)], (F.lit(width) - F.count("*")).cast("long").alias("pad"))


def padded(df: DataFrame, pad: float | str | bool | None = None) -> DataFrame:
    """A wrapped vector with ``pad`` in the cells past its end; None leaves them empty, with #N/A in ``error``."""
    if pad is None:
        return df.withColumn("error", F.when(F.col("pad") > 0, cells.NA))
    names = [c for c in columns_of(df) if c != "pad"]
    past = lambda k: F.lit(k) >= F.lit(len(names)) - F.col("pad")
    fill = lambda c: F.lit(pad).cast(df.schema[c].dataType) if not isinstance(pad, str) else F.lit(pad)
    plain = lambda c: cells.shown(F.col(c), df.schema[c].dataType) if isinstance(pad, str) and df.schema[c].dataType.simpleString() != "string" else F.col(c)
    return df.select(R, *[F.when(past(k), fill(c)).otherwise(plain(c)).alias(c) for k, c in enumerate(names)])


def chooserows(df: DataFrame, *at: int) -> DataFrame:
    """Rows by number from 1 (negative: from the end), in the order and as often as asked."""
    n = df.count()
    places = [a - 1 if a > 0 else n + a for a in at]
    if any(not 0 <= x < n for x in places) or 0 in at:
        raise ValueError(cells.VALUE)
    wanted = df.sparkSession.createDataFrame(list(enumerate(places)), "_to long, _from long")
    return df.join(F.broadcast(wanted), F.col(R) == F.col("_from")).select(F.col("_to").alias(R), *columns_of(df))


def choosecols(df: DataFrame, *at: int) -> DataFrame:
    names = columns_of(df)
    if any(a == 0 or abs(a) > len(names) for a in at):
        raise ValueError(cells.VALUE)
    return df.select(R, *[F.col(names[a - 1 if a > 0 else a]).alias(f"c{k}") for k, a in enumerate(at)])


def sequence(spark, rows: int, columns: int = 1, start: float = 1.0, step: float = 1.0) -> DataFrame:
    return spark.range(rows).select(F.col("id").alias(R), *[(F.lit(start) + (F.col("id") * columns + j) * step).cast("double").alias(f"c{j}") for j in range(columns)])


def randarray(spark, rows: int, columns: int = 1, low: float = 0.0, high: float = 1.0, whole: bool = False, seed: int = 0) -> DataFrame:
    """Repeatable numbers: each is a hash of the seed and its place."""

    def one(j: int) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.lit(j)), F.lit(1 << 52)).cast("double") / float(1 << 52)
        return F.floor(F.lit(low) + u * (high - low + 1)).cast("double") if whole else F.lit(low) + u * (high - low)

    return spark.range(rows).select(F.col("id").alias(R), *[one(j).alias(f"c{j}") for j in range(columns)])


def arraytotext(df: DataFrame, verbose: bool = False) -> DataFrame:
    """One row: cells parted by ``, `` and rows by ``;``, and, ``verbose``, in braces."""
    kind, names = cells.kinds(df), columns_of(df)
    row = F.concat_ws(", ", *[cells.shown(F.col(c), kind[c]) for c in names])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["s"]), ";")
    return df.select(F.struct(R, row.alias("s")).alias("v")).agg((F.concat(F.lit("{"), joined, F.lit("}")) if verbose else joined).alias("text"))


def transpose(df: DataFrame) -> DataFrame:
    """Rows to columns, for frames of few rows."""
    n, names = df.count(), columns_of(df)
    entry = F.array(*[F.struct(F.lit(j).cast("long").alias(R), F.col(c).alias("v")) for j, c in enumerate(names)])
    flat = df.select(F.col(R).alias("i"), F.explode(entry).alias("e")).select("i", F.col(f"e.{R}").alias(R), "e.v")
    return flat.groupBy(R).agg(*[F.max(F.when(F.col("i") == k, F.col("v"))).alias(f"c{k}") for k in range(n)])
