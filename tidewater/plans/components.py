"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.plans.scratch import durable, temporary


#: Up to so many edges are joined by one task; more by rounds over the whole cluster.
SMALL_EDGES = 20_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(id, label)`` of all edges of one small partition, by union of sets under their least id."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    ids = sorted(root)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(i) for i in ids], pa.int64())], names=["id", "label"])


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Rows ``(id, label)`` for every id on an edge; the label is the smallest id it can reach.

    Each round is a pair of shuffles on the edges with map-side minima, written
    to the shared folder; rounds grow with the logarithm of the longest path.
    An edge table without rows gives no rows; loops and repeats change nothing.
    """
    e = durable(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct(), "edges"
    )
    if e.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES and all(f.dataType.simpleString() == "bigint" for f in e.schema.fields):
        return e.coalesce(1).mapInArrow(_joined, "id long, label long")
    with temporary(edges.sparkSession) as scope:
        before = None
        while True:
            both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            large = durable(large, "large-star")
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("x"), "m").union(low.select(F.col("u"), "m"))
            e = durable(small.toDF("u", "v").where("u <> v").distinct(), "small-star")
            now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if tuple(now) == before:
                break
            before = tuple(now)
        scope.keep(e)
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
