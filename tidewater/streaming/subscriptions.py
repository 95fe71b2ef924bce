"""Standing similarity queries and episodes over a stream of inserted records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import vectors as V
from tidewater.functions.predicates import Filter, matching


@dataclass(frozen=True)
class Subscription:
    """Records that pass the filters and score at least ``threshold`` (at most, for distances) match."""

    name: str
    query: Sequence[float]
    threshold: float = 0.0
    metric: str = "cosine"
    filters: tuple[Filter, ...] = field(default_factory=tuple)


def matches(records: DataFrame, subscriptions: Sequence[Subscription]) -> DataFrame:
    """Match events ``(subscription, id, score, ...)``: stateless, in append mode, on a stream or a table.

    Every appended row is tested; nothing is dropped when a consumer is slow.
    """
    out = None
    for s in subscriptions:
        own = matching(records, *s.filters).where(F.size("vector") == len(s.query))
        own = own.withColumn("score", F.round(V.metric(s.metric, F.col("vector"), V.literal(s.query)), 6))
        own = own.where(F.col("score") >= s.threshold if V.higher_is_better(s.metric) else F.col("score") <= s.threshold)
        own = own.select(F.lit(s.name).alias("subscription"), *own.columns)
        out = own if out is None else out.unionByName(own)
    return out


def streaming_episodes(records: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", per: Sequence[str] = ()) -> DataFrame:
    """Episodes of a stream as session windows, without a limit on their records; ``late`` bounds the state kept."""
    w = F.session_window("created_at", gap)
    # A stream's session windows need a key beside the window that the optimizer does not fold away.
    keys = list(per) or [F.pmod(F.hash("id"), F.lit(1)).alias("_all")]
    sessions = records.withWatermark("created_at", late).groupBy(*keys, w)
    return sessions.agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("first_id"), F.min("created_at").alias("start"), F.max("created_at").alias("end")).drop("_all")


def file_stream(spark, path: str, schema) -> DataFrame:
    """Records appended as Parquet files to a folder."""
    return spark.readStream.schema(schema).parquet(path)
