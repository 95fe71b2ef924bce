"""Rows named by a hash of identifier and text, so that decisions on documents travel without their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.plans.scratch import durable

#: Tables of row keys up to this many rows (about 40 bytes each) are broadcast; larger ones are joined by a shuffle.
BROADCAST_KEYS = 1 << 20


def row_key(id_col: str, *columns: str) -> Column:
    """A 64-bit hash of identifier and text or other columns; a reader of it compares the identifier too."""
    return F.xxhash64(F.col(id_col).cast("long"), *columns)


def few(keys: DataFrame) -> DataFrame:
    """``keys`` with a broadcast hint if they are few enough."""
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def keep_rows(docs: DataFrame, dropped: DataFrame, repeated: DataFrame | None, id_col: str, *columns: str) -> DataFrame:
    """``docs`` without the ``dropped`` rows and with one row for each of the ``repeated`` ones.

    Both name rows by (doc_id, place), ``place`` being the :func:`row_key` of ``columns``.
    Of rows that repeat, the least by the hash of their other columns stays;
    columns of maps are not compared.
    """
    dropped = durable(dropped.distinct(), "dropped-rows")
    own = docs.withColumn("__tw_place", row_key(id_col, *columns))
    named = lambda keys: few(keys.select(F.col("doc_id").alias("__tw_doc"), F.col("place").alias("__tw_other")))
    on = (F.col("__tw_place") == F.col("__tw_other")) & docs[id_col].cast("long").eqNullSafe(F.col("__tw_doc"))
    left = own.join(named(dropped), on, "left_anti")
    repeated = durable(repeated, "repeated-rows") if repeated is not None else None
    if repeated is not None and not repeated.isEmpty():
        fine = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        row = F.min(F.struct(F.xxhash64(*fine).alias("h"), F.struct(*fine).alias("row"))) if len(fine) == len(docs.columns) else F.min_by(F.struct(F.lit(0).alias("h"), F.struct(*docs.columns).alias("row")), F.xxhash64(*fine))
        again = left.join(named(repeated), on, "left_semi").groupBy(F.col(id_col).alias("__tw_doc"), "__tw_place").agg(row.alias("first")).select("first.row.*")
        left = left.join(named(repeated), on, "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))
    return left.select(*docs.columns)
