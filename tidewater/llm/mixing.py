"""Mixing sources to target weights.

Word counts are summed by source, a target is set for each source, and each
document is emitted floor(rate) times plus once more when a hash-seeded draw
falls below the fraction of its source's rate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.plans.ranks import running_total
from tidewater.plans.scratch import durable

#: A table of sources up to this many rows (about 100 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 20_000

#: Target words of a source are at most this many times its own words.
MAX_REPEAT = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def draw(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the identifier and seed alone: 52 bits of an MD5 digest."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cyclic_weights(totals: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add ``weight``: sources in code point order, null last, take the numbers of ``cycle`` in turn."""
    ranked = running_total(totals, [F.col("source").asc_nulls_last()], name="rank")
    numbers = F.array(*[F.lit(float(w)) for w in cycle])
    return ranked.withColumn("weight", F.element_at(numbers, (F.col("rank") % len(cycle)).cast("int") + 1)).drop("rank")


def water_fill(weighted: DataFrame, budget: int | None = None, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Add ``target`` and ``rate`` to rows ``(source, source_size, weight)``.

    The budget (default: all words) is shared by weight; sources above
    ``max_repeat`` times their size stop there and the excess is shared again
    until none is above.  Each round is one small aggregate: the words given to
    stopped sources and the weight of the others.  Empty sources get rate 0.
    """
    w = durable(weighted, "weighted")
    if budget is None:
        budget = w.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(max_repeat)
    level = None
    while True:
        # The level only rises, so a source that has stopped stays so and the loop ends.
        stopped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        full, open_weight = w.agg(F.sum(F.when(stopped, cap)), F.sum(F.when(~stopped, F.col("weight")))).first()
        now = (budget - (full or 0)) / open_weight if open_weight else float("inf")
        if now == level or not open_weight:
            break
        level = now
    level = level or 0.0
    target = F.when(F.col("weight") * F.lit(level) > cap, cap).otherwise(F.col("weight") * F.lit(level)).cast("double")
    return w.withColumn("target", target).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def plan_mix(sized: DataFrame, budget: int | None = None, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Rows ``(source, source_size, weight, target, rate)`` for documents with columns ``source`` and ``size``."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return water_fill(cyclic_weights(totals), budget, max_repeat)


def with_copies(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", seed: int = 17) -> DataFrame:
    """``docs`` with struct ``__tw_mix`` (source_size, weight, target, rate, copies).

    Sources, null among them, are matched null-safely.  Rows with one
    identifier draw alike; a null identifier draws like an empty string.
    """
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    right = plan.select(F.col("source").alias("__tw_source"), F.struct("source_size", "weight", "target", "rate").alias("__tw_plan"))
    joined = docs.join(F.broadcast(right) if small else right, docs[source_col].eqNullSafe(F.col("__tw_source")))
    rate = F.col("__tw_plan.rate")
    copies = F.floor(rate) + F.when(draw(docs[id_col], seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("__tw_mix", F.col("__tw_plan").withField("copies", copies.cast("long"))).drop("__tw_source", "__tw_plan")


def emit(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its source's rate says, columns unchanged.

    Null and empty texts count no words and follow their source's rate; an
    empty table gives no rows.
    """
    sized = durable(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sizes")
    mixed = with_copies(docs, plan_mix(sized), id_col, source_col).where(F.col("__tw_mix.copies") > 0)
    return mixed.withColumn("__tw_copy", F.explode(F.sequence(F.lit(1), F.col("__tw_mix.copies")))).select(*docs.columns)
