"""Full-text search: tokens, postings and BM25."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.predicates import Filter, matching
from tidewater.plans.scratch import durable, exists

K1, B = 1.2, 0.75

# Punctuation that is trimmed from the edges of a token.
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokens(text: Column) -> Column:
    """Lower-cased words between white space, punctuation trimmed from their edges, empty ones dropped."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "(?U)\\s+")
    return F.filter(F.transform(parts, lambda t: F.btrim(t, F.lit(EDGE))), lambda t: t != "")


def content(df: DataFrame, fields: list[str]) -> Column:
    """The indexed text: the content, then the chosen text fields."""
    return F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in fields])


def postings(df: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """Rows ``(id, term, tf)``."""
    words = df.select(F.col(id_col).alias("id"), F.explode(tokens(content(df, fields))).alias("term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def _asked(spark: SparkSession, query: str) -> dict[str, int]:
    """The query's terms and how often each is asked."""
    return dict(Counter(spark.range(1).select(tokens(F.lit(query)).alias("t")).first()[0]))


def _weight(m: int, tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
    return m * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(df: DataFrame, query: str, fields: list[str], id_col: str = "id") -> DataFrame:
    """Rows ``(id, score)`` of every document with a query term; a repeated term counts again.

    One scan without an index: lengths and the query's term counts are taken
    inside each document and written once, as a few numbers a document, since
    the statistics and the scores both need them and a text is tokenised once.
    """
    times = _asked(df.sparkSession, query)
    own = df.select(F.col(id_col).alias("id"), tokens(content(df, fields)).alias("words"))
    is_term = lambda t: lambda w: w == F.lit(t)
    count = [F.size(F.filter("words", is_term(t))).alias(f"tf{i}") for i, t in enumerate(times)]
    own = durable(own.select("id", F.size("words").alias("dl"), *count), "term-counts").where("dl > 0")
    stats = own.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(times))))
    score, some = F.lit(0.0), F.lit(False)
    for i, m in enumerate(times.values()):
        tf = F.col(f"tf{i}")
        score += F.when(tf > 0, _weight(m, tf, F.col(f"df{i}"), F.col("dl"), F.col("n"), F.col("avgdl"))).otherwise(0.0)
        some |= tf > 0
    # The statistics are one row.
    return own.where(some).crossJoin(F.broadcast(stats)).select("id", F.round(score, 6).alias("score"))


class TextIndex:
    """Postings on disk, sorted by term, with documents added, replaced and removed as segments.

    ``postings`` (term, id, tf, dl, segment), ``dead`` (id, segment): postings of
    an id from segments before that one no longer count, and ``changes`` (segment,
    documents, words), whose sums are the statistics.  A search reads the asked
    terms' row groups, not the texts.
    """

    def __init__(self, spark: SparkSession, folder: str, fields: list[str]):
        if not fields:
            raise ValueError("a text index needs at least one field")
        self.spark, self.folder, self.fields = spark, folder.rstrip("/"), fields

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _postings(self) -> DataFrame:
        return self._table("postings", "term string, id long, tf long, dl int, segment int")

    def _dead(self) -> DataFrame:
        return self._table("dead", "id long, segment int").groupBy("id").agg(F.max("segment").alias("gone"))

    def _changes(self) -> DataFrame:
        return self._table("changes", "segment int, documents long, words long")

    def _live(self, found: DataFrame) -> DataFrame:
        return found.join(self._dead(), "id", "left").where("gone is null or segment >= gone").drop("gone")

    def _change(self, ids: DataFrame, new: DataFrame | None) -> None:
        """One segment: the postings of ``ids`` die, those of ``new`` (term, id, tf, dl) are added."""
        segment = (self._changes().agg(F.max("segment")).first()[0] or 0) + 1
        old = self._live(self._postings().join(ids, "id", "left_semi")).select("id", "dl").distinct()
        lost = old.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if lost[0]:
            durable(old.select("id"), "replaced").select("id", F.lit(segment).alias("segment")).write.mode("append").parquet(f"{self.folder}/dead")
        won = (0, 0)
        if new is not None:
            path = f"{self.folder}/postings/segment={segment}"
            new.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(path)
            won = self.spark.read.parquet(path).select("id", "dl").distinct().agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
        row = [(segment, won[0] - lost[0], won[1] - lost[1])]
        self.spark.createDataFrame(row, "segment int, documents long, words long").write.mode("append").parquet(f"{self.folder}/changes")

    def add(self, df: DataFrame, id_col: str = "id") -> TextIndex:
        """Index the rows of ``df``; ids that the index knows are indexed anew."""
        own = df.select(F.col(id_col).cast("long").alias("id"), tokens(content(df, self.fields)).alias("words"))
        words = own.select("id", F.size("words").alias("dl"), F.explode("words").alias("term"))
        new = durable(words.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl")), "new-postings")
        self._change(df.select(F.col(id_col).cast("long").alias("id")).distinct(), new)
        return self

    def remove(self, ids: DataFrame) -> TextIndex:
        """Take the documents with these ids out."""
        self._change(ids.select(F.col("id").cast("long")).distinct(), None)
        return self

    def compact(self, folder: str) -> TextIndex:
        """The live postings as one segment of a new index in ``folder``."""
        out = TextIndex(self.spark, folder, self.fields)
        out._change(self.spark.createDataFrame([], "id long"), self._live(self._postings()).drop("segment"))
        return out

    def stats(self) -> DataFrame:
        """One row ``(documents, avgdl)``; documents without a token don't count."""
        total = self._changes().agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.sum("words").alias("words"))
        return total.select("documents", F.when(F.col("documents") > 0, F.col("words") / F.col("documents")).alias("avgdl"))

    def search(self, query: str, k: int = 10) -> DataFrame:
        """The best ``k`` rows ``(id, score)``, as :func:`bm25` scores them."""
        times = _asked(self.spark, query)
        found = durable(self._live(self._postings().where(F.col("term").isin(list(times)))), "found-postings")
        counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        asked = self.spark.createDataFrame([(t, n) for t, n in times.items()] or [], "term string, m long")
        small = counts.join(asked, "term").crossJoin(F.broadcast(self.stats()))  # a row a term
        score = _weight(F.col("m"), F.col("tf"), F.col("df"), F.col("dl"), F.col("documents"), F.col("avgdl"))
        each = found.join(F.broadcast(small), "term").groupBy("id").agg(F.round(F.sum(score), 6).alias("score"))
        return each.orderBy(F.desc("score"), "id").limit(k)


def text_search(df: DataFrame, query: str, fields: list[str], k: int = 10, offset: int = 0, filters: tuple[Filter, ...] = (), id_col: str = "id") -> DataFrame:
    """The best k + offset documents of the whole table, then the filters, then the page: it may come out short."""
    best = bm25(df, query, fields, id_col).orderBy(F.desc("score"), "id").limit(k + offset)
    hits = matching(df.join(F.broadcast(best.withColumnRenamed("id", "_hit")), F.col(id_col) == F.col("_hit")).drop("_hit"), *filters)
    out = hits.orderBy(F.desc("score"), id_col)
    return (out.offset(offset) if offset else out).limit(k)
