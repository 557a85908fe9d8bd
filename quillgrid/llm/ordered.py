"""Global positions and running totals without a single-task window.

The rows are range-sorted, numbered and summed inside each partition in a stream, and written; then each
partition's offset, one number for each partition, is added. The offsets are as many as shuffle partitions,
which bounds what is broadcast, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch


def numbered(df: DataFrame, order: list[Column], size: str, name: str = "ordered") -> DataFrame:
    """``df`` with ``position`` (from 0 in the order) and ``before`` (the sum of ``size``, a long, over all earlier rows).

    Rows that are equal in the order come in any order among themselves; a null size counts 0. The names
    ``position`` and ``before`` must be free. An empty table stays empty.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", part int, position bigint, before bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            k = batch.num_rows
            sums = np.cumsum(pc.fill_null(batch.column(batch.schema.get_field_index(size)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            before = np.concatenate([[0], sums[:-1]])[:k] + total
            columns = [*batch.columns, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(rows, rows + k)), pa.array(before.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "part", "position", "before"])
            rows, total = rows + k, total + (int(sums[-1]) if k else 0)

    kept = scratch.keep(dealt.mapInArrow(run, schema), name)
    totals = sorted(kept.groupBy("part").agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("s")).collect())
    offsets, rows, total = [], 0, 0
    for part, k, s in totals:
        offsets.append((part, rows, total))
        rows, total = rows + k, total + s
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, part_row bigint, part_sum bigint"))
    joined = kept.join(starts, "part")
    return joined.select(*df.columns, (F.col("position") + F.col("part_row")).alias("position"), (F.col("before") + F.col("part_sum")).alias("before"))
