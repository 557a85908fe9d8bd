"""Parquet and Arrow IPC in and out, with the sheet's types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import cells

ROW_GROUP = 65_536


def checked(df: DataFrame) -> DataFrame:
    """``df`` with numbers as doubles; a nested, binary or decimal column is refused by name."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.BinaryType, T.DecimalType)) or (isinstance(f.dataType, T.StructType) and not cells.is_mixed(f.dataType)):
            raise TypeError(f"column {f.name}: {f.dataType.simpleString()} has no cell form")
        c = F.col(f"`{f.name}`")
        out.append(c if f.name == "_row" else (c.cast("double") if isinstance(f.dataType, T.NumericType) else c).alias(f.name))
    return df.select(*out)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return checked(spark.read.parquet(path))


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC or Feather file, or a stream; its batches are read on executors, one file a task."""
    import pyarrow as pa
    import pyarrow.ipc as ipc

    def opened(body):
        try:
            return ipc.open_file(pa.BufferReader(body))
        except pa.ArrowInvalid:
            return ipc.open_stream(pa.BufferReader(body))

    files = spark.read.format("binaryFile").load(path)
    first = opened(files.select("content").first()[0]).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    schema = from_arrow_schema(first)

    def run(batches):
        for batch in batches:
            for body in batch.column(0):
                reader = opened(body.as_py())
                parts = (reader.get_batch(k) for k in range(reader.num_record_batches)) if hasattr(reader, "num_record_batches") else reader
                for part in parts:
                    flat = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in part.columns]
                    yield pa.RecordBatch.from_arrays(flat, names=part.schema.names)

    return checked(files.select("content").mapInArrow(run, schema))


def typed_for_export(df: DataFrame, dates: list[str] = (), row: str = "_row") -> DataFrame:
    """Number columns of whole values as longs, marked date columns as timestamps, mixed columns as text. One pass decides."""
    kind = cells.kinds(df)
    names = [c for c in df.columns if c != row]
    numeric = [c for c in names if cells.kind_of(kind[c]) == "number"]
    tests = [F.coalesce(F.bool_and((F.col(c) == F.floor(F.col(c))) & (F.abs(F.col(c)) < 2**53)), F.lit(True)).alias(c) for c in numeric]
    whole = df.agg(*tests).first() if tests else {}
    out = []
    for c in names:
        x = F.col(f"`{c}`")
        if c in dates:
            day = cells.from_serial(x)
            out.append((day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round((x - F.floor(x)) * 86400, 3).cast("decimal(18,6)"))).alias(c))
        elif c in numeric:
            out.append((x.cast("long") if whole[c] else x.cast("double")).alias(c))
        else:
            out.append((cells.shown(x, kind[c]) if cells.is_mixed(kind[c]) else x).alias(c))
    return (df.orderBy(row) if row in df.columns else df).select(*out)


def write_parquet(df: DataFrame, path: str, dates: list[str] = ()) -> None:
    typed_for_export(df, dates).write.option("parquet.block.row.count.limit", ROW_GROUP).parquet(path)


def write_ipc(df: DataFrame, path: str, dates: list[str] = ()) -> None:
    """One Arrow file. Executors make the batches; the driver passes their bytes on, a partition at a time."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    out = typed_for_export(df, dates)
    schema = to_arrow_schema(out.schema)

    def packed(batches):
        for batch in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["body"])

    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, schema) as writer:
        for r in out.mapInArrow(packed, "body binary").toLocalIterator():
            for batch in pa.ipc.open_stream(bytes(r.body)):
                writer.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, schema, strict=True)], schema=schema))


def compact(view: DataFrame, path: str) -> DataFrame:
    """Bake a sheet with its edits into columnar files, beside the old ones, and return it as read from there."""
    view.write.parquet(path)
    return view.sparkSession.read.parquet(path)
