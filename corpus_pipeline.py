"""A corpus pipeline of five stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, mixing, ngram_join, packing, quality
from tidewater.llm.queries import vocabulary
from tidewater.plans.scratch import scratch_path

#: Words that a worker's encoder remembers: fewer than on its own, as the stages before leave less memory.
CACHED_WORDS = 180_000

#: The rows depend on token ids and on distances of histograms, which SQL cannot express.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that they reject go."""
    return quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the smallest identifier stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's rate says."""
    return mixing.emit(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of token ids in sequences of at most 1024."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), "kept", 0, with_ids=False, cached=CACHED_WORDS)


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out.withColumn("ids_crc32", F.col("ids_crc32").cast("long"))
        path = scratch_path(spark, f"stage-{number}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    raise ValueError("there are no stages")
