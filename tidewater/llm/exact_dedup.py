"""Exact deduplication by a tree merge of sorted digest runs.

A partition's digests are a run: sorted once, by digest first and the number of
the run last.  In each binomial round neighbouring runs, ``2**FAN_BITS`` of
them, exchange their digests by key and are merged; a merged run keeps, for
each verified digest, the smallest identifier and the number of rows.  The sort
order begins with the digest and goes from coarse to fine run numbers, so that
a merged run is in the next round's order already: only what arrives from
several runs is sorted, and there whole sorted blocks are merged.  A run is cut
by digest, so no task holds a whole one.  All of it is built-in DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.rows import keep_rows, row_key
from tidewater.plans.scratch import durable

#: Bits by which a round shortens the run numbers: 16 runs merge into one.
FAN_BITS = 4

KEYS = ["quick", "length", "sha"]


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One small row a document: identifier, key, run, and the digests that identify its text."""
    norm = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("place"), normalised(F.col(text_col)).alias("norm"))
    return norm.select(
        "id",
        "place",
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64("norm").alias("quick"),
        F.length("norm").alias("length"),
        F.unhex(F.sha2("norm", 256)).alias("sha"),
    )


def merge_runs(prints: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """Rows ``(quick, length, sha, keep, size)``, one for each distinct text.

    A key is verified at every level: rows merge only if the quick hash, the
    length and the SHA-256 all agree.  ``keep`` is the smallest (null flag, id,
    key, row): null identifiers come last, repeated ones go by key, then row.
    """
    last = prints.agg(F.max("run")).first()[0] or 0
    rounds = max(1, -(-int(last).bit_length() // fan_bits))
    # The number of the merged run that a run is in after each round but the last, which leaves one run.
    levels = [f"run{r}" for r in range(1, rounds)]
    first = F.struct(F.col("id").isNull().alias("void"), "id", "place", "row").alias("keep")
    numbers = [F.shiftright("run", fan_bits * r).alias(f"run{r}") for r in range(1, rounds)]
    runs = prints.select(*KEYS, *numbers, first, F.lit(1).cast("long").alias("size"))
    for done in range(rounds):
        runs = runs.groupBy(*KEYS, *reversed(levels[done:])).agg(F.min("keep").alias("keep"), F.sum("size").alias("size"))
    return runs


def judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The fingerprints of all rows with ``keep`` and ``size`` of their group."""
    prints = durable(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = durable(merge_runs(prints), "merged-runs")
    # Both sides are scans of small rows, so a hot digest's partition can be split while the join runs.
    return prints.join(groups, KEYS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after :func:`normalised`.  The row
    with the smallest identifier of equal texts is kept.  Null and empty texts
    are one group; repeated rows count, and one of them is kept; a null
    identifier comes after all others; an empty table gives no rows.  Other
    columns of ``docs`` are not read.
    """
    return judged(docs, id_col, text_col).select(
        F.col("id").alias("doc_id"),
        F.col("keep.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each distinct text, with all its columns: the one :func:`exact_dedup` keeps.

    Of rows that share identifier and text, the least by the other columns
    stays.  Only the keys of rows that go meet the texts again.
    """
    rows = durable(judged(docs, id_col, text_col).where("size > 1").select(F.col("id").cast("long").alias("doc_id"), "place", F.col("keep.id").cast("long").alias("first"), F.col("keep.place").alias("other")), "copies")
    same = (F.col("place") == F.col("other")) & F.col("doc_id").eqNullSafe(F.col("first"))
    repeated = rows.where(same).groupBy("doc_id", "place").count().where("count > 1").select("doc_id", "place")
    return keep_rows(docs, rows.where(~same).select("doc_id", "place"), repeated, id_col, text_col)
