"""Running totals and row numbers over a whole table, without one task that sees every row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.plans.scratch import durable


def running_total(df: DataFrame, order: list[Column], value: str | None = None, name: str = "total_before") -> DataFrame:
    """Add ``name``: the sum of ``value`` (rows where None) over all rows before this one in ``order``.

    Range partitions are sorted and summed locally; one number a partition goes
    through the driver and comes back as a broadcast of that many rows.  Rows
    that tie in ``order`` are numbered in an arbitrary but recorded order.
    """
    # Rows that tie are told apart by where they are read, so that many equal ones don't meet in one partition.
    order = [*order, F.col("_tie")]
    placed = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_local", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in batches:
            size = np.ones(b.num_rows, np.int64) if value is None else b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = before + np.cumsum(size)
            if b.num_rows:
                before = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - size, pa.int64())], names=[*b.schema.names, "_local"])

    saved = durable(ranged.mapInArrow(local, schema), "running")
    step = F.count(F.lit(1)) if value is None else F.sum(value)
    base, rows = 0, []
    for part, size in sorted((r[0], r[1] or 0) for r in saved.groupBy("_part").agg(step).collect()):
        rows.append((part, base))
        base += size
    bases = df.sparkSession.createDataFrame(rows, "_part int, _base long")
    return saved.join(F.broadcast(bases), "_part").withColumn(name, F.col("_local") + F.col("_base")).drop("_part", "_local", "_base")
