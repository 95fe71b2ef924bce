"""Vector search: filter, score, threshold, cut, re-rank, page."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import vectors as V
from tidewater.functions.predicates import Filter, matching, moment
from tidewater.plans.ranks import running_total
from tidewater.plans.scratch import durable


@dataclass(frozen=True)
class SearchOptions:
    """How a search runs; the defaults give the ten nearest by cosine."""

    k: int = 10
    metric: str = "cosine"
    threshold: float | None = None
    offset: int = 0
    limit: int | None = None
    filters: tuple[Filter, ...] = field(default_factory=tuple)
    decay: str | None = None
    half_life: float = 0.0
    importance_boost: float = 0.0
    now: datetime | None = None
    id_col: str = "id"
    vector_col: str = "vector"

    @property
    def window(self) -> int:
        return (self.k if self.k > 0 else 10) + max(0, self.offset)


def best_first(metric: str, id_col: str = "id") -> list[Column]:
    """Best score first; ties by ascending identifier."""
    return [F.col("score").desc() if V.higher_is_better(metric) else F.col("score").asc(), F.col(id_col).asc()]


def scored(df: DataFrame, q: Sequence[float], o: SearchOptions) -> DataFrame:
    """Rows that have a vector and pass the filters and the threshold, with their raw ``score`` to six places."""
    df = matching(df, *o.filters).where(F.size(o.vector_col) > 0)
    df = df.withColumn("score", F.round(V.metric(o.metric, F.col(o.vector_col), V.literal(q)), 6))
    if o.threshold is not None:
        df = df.where(F.col("score") >= o.threshold if V.higher_is_better(o.metric) else F.col("score") <= o.threshold)
    return df


def paged(df: DataFrame, o: SearchOptions, order: list[Column]) -> DataFrame:
    """Skip ``offset`` rows of the window and take ``limit``, or ``k``, of the rest."""
    take = o.limit if o.limit is not None and o.limit > 0 else (o.k if o.k > 0 else 10)
    out = df.orderBy(*order)
    return (out.offset(o.offset) if o.offset > 0 else out).limit(take)


def search(df: DataFrame, q: Sequence[float], o: SearchOptions = SearchOptions()) -> DataFrame:
    """The nearest rows, best first, with ``score``.

    Decay and boost re-rank only rows inside the cut of k + offset; the
    threshold tests the raw score.  The cut is a bounded heap in each task.
    """
    order = best_first(o.metric, o.id_col)
    found = scored(df, q, o).orderBy(*order).limit(o.window)
    if o.decay and o.now is not None or o.importance_boost > 0:
        score = F.col("score")
        if o.decay and o.now is not None:
            age = F.unix_timestamp(moment(o.now).cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))
            score = V.decay(score, age.cast("double"), o.decay, o.half_life)
        if o.importance_boost > 0:
            score = V.boost(score, F.col("importance"), o.importance_boost)
        found = found.withColumn("score", F.round(score, 6))
    return paged(found, o, order)


def unordered(df: DataFrame, q: Sequence[float], o: SearchOptions = SearchOptions()) -> DataFrame:
    """Any ``k`` rows that pass filters and threshold, with their score: a scan that stops when it has them."""
    return scored(df, q, o).limit(o.k if o.k > 0 else 10)


def explain(df: DataFrame, q: Sequence[float], o: SearchOptions = SearchOptions()) -> dict:
    """Facts of a search: rows, those with a vector that pass the filters, those within the threshold too, and the plan."""
    rows, own = df.count(), matching(df, *o.filters).where(F.size(o.vector_col) > 0).count()
    plan = search(df, q, o)._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return {"records": rows, "scored": own, "within": scored(df, q, o).count(), "metric": o.metric, "window": o.window, "plan": plan}


def truncated(df: DataFrame, column: str = "content", most: int = 2000) -> DataFrame:
    """Contents cut after ``most`` characters, with a mark that says how many were there."""
    mark = F.concat(F.lit("... ["), F.lit(most).cast("string"), F.lit(" of "), F.length(column).cast("string"), F.lit(" characters]"))
    return df.withColumn(column, F.when(F.length(column) > most, F.concat(F.left(F.col(column), F.lit(most)), mark)).otherwise(F.col(column)))


def track_access(df: DataFrame, hits: DataFrame, now: datetime, id_col: str = "id") -> DataFrame:
    """``df`` with the access count and time of the rows in ``hits`` (the whole window, not the page) brought up to date."""
    seen = hits.select(id_col).distinct().withColumn("_hit", F.lit(1))
    out = df.join(F.broadcast(seen), id_col, "left")  # a window is at most k + offset rows
    hit = F.col("_hit").isNotNull()
    return out.withColumns(
        {
            "access_count": F.col("access_count") + F.when(hit, 1).otherwise(0),
            "last_accessed_at": F.when(hit, moment(now)).otherwise(F.col("last_accessed_at")),
        }
    ).drop("_hit")


def without_content(df: DataFrame, column: str = "content") -> DataFrame:
    return df.withColumn(column, F.lit(""))


def vector_of(df: DataFrame, space: str = "default") -> Column:
    """A record's vector in a named space; '' and 'default' mean the main one."""
    return F.col("vector") if space in ("", "default") else F.try_element_at(F.col("vectors"), F.lit(space))


def search_space(df: DataFrame, space: str, q: Sequence[float], o: SearchOptions = SearchOptions()) -> DataFrame:
    """Search one space; rows without it are skipped, and decay and boost don't apply."""
    plain = SearchOptions(**{**o.__dict__, "decay": None, "importance_boost": 0.0, "vector_col": "_space"})
    own = df.withColumn("_space", vector_of(df, space)).where(F.col("_space").isNotNull())
    return search(own, q, plain).drop("_space")


#: Queries of a kNN join that are collected and broadcast at once.
QUERY_BLOCK = 20_000

#: Queries of one matrix product with a batch of base rows.
KERNEL_QUERIES = 512


def knn_join(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest base rows of each query row ``(query_id, query)``: a matrix product for each block of base rows.

    Queries are taken in blocks of at most QUERY_BLOCK, each collected and
    broadcast in turn.  Each block of base rows keeps its k best a query before
    the shuffle.
    """
    n = queries.count()
    if n <= QUERY_BLOCK:
        return _knn_block(queries.select("query_id", "query").collect(), base, k, metric)
    at = running_total(queries.select("query_id", "query"), [F.col("query_id")], name="_n")
    at = durable(at, "queries")
    block = lambda i: at.where((F.col("_n") >= i) & (F.col("_n") < i + QUERY_BLOCK)).select("query_id", "query").collect()
    # Each block's result is written before the next one is collected, so the driver holds one block.
    return reduce(DataFrame.unionAll, [durable(_knn_block(block(i), base, k, metric), "knn") for i in range(0, n, QUERY_BLOCK)])


def _knn_block(rows: list, base: DataFrame, k: int, metric: str) -> DataFrame:
    import numpy as np
    import pandas as pd

    ids, q = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)
    higher = V.higher_is_better(metric)

    def scores(q, x):
        inner = q @ x.T
        if metric == "cosine":
            norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None]
            return np.divide(inner, norm, out=np.zeros_like(inner), where=norm > 0)
        if metric == "dot":
            return inner
        s = np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * inner, 0)
        return np.sqrt(s) if metric == "euclidean" else s

    def blocks(frames):
        for f in frames:
            if not len(f) or not len(ids):
                continue
            x, own = np.stack(f["vector"].to_numpy()).astype(float), f["id"].to_numpy()
            for at in range(0, len(ids), KERNEL_QUERIES):
                s = np.round(scores(q[at : at + KERNEL_QUERIES], x), 6)
                row, best = np.arange(len(s))[:, None], np.broadcast_to(np.arange(len(own)), s.shape)
                if len(own) > k:
                    # Whatever ties with the k-th best stays, so that ties are cut by id.
                    part = np.partition(-s if higher else s, k - 1, axis=1)[:, k - 1 : k]
                    row, best = np.nonzero((-s if higher else s) <= part)
                    order = np.lexsort((own[best], -s[row, best] if higher else s[row, best], row))
                    row, best = row[order], best[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    row, best = row[rank < k], best[rank < k]
                row = np.broadcast_to(row, best.shape).ravel()
                best = best.ravel()
                yield pd.DataFrame({"query_id": ids[at : at + KERNEL_QUERIES][row], "id": own[best], "score": s[row, best]})

    near = base.select("id", "vector").mapInPandas(blocks, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(*best_first(metric))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
