"""Reciprocal rank fusion and the searches built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.search import SearchOptions, best_first, search, search_space
from tidewater.operators.text import text_search


def fuse(lists: Sequence[DataFrame], k: int = 60, weights: Sequence[float] = (), top: int | None = None, metrics: Sequence[str] = ()) -> DataFrame:
    """Rows ``(id, score)``: the sum of weight / (k + rank) over ranked lists ``(id, score)``, best first.

    k <= 0 means 60; a missing weight is 1; ties go by identifier.  The lists
    are results of searches, bounded by their cuts.
    """
    k = k if k > 0 else 60
    legs = None
    for i, leg in enumerate(lists):
        w = float(weights[i]) if i < len(weights) else 1.0
        rank = F.row_number().over(Window.orderBy(*best_first(metrics[i] if i < len(metrics) else "cosine")))
        ranked = leg.select("id", "score").select("id", (F.lit(w) / (k + rank)).alias("part"))
        legs = ranked if legs is None else legs.unionByName(ranked)
    out = legs.groupBy("id").agg(F.round(F.sum("part"), 9).alias("score")).orderBy(F.desc("score"), "id")
    return out if top is None else out.limit(top)


def fetch(o: SearchOptions) -> int:
    return max(2 * o.window, 20)


def _page(fused: DataFrame, o: SearchOptions) -> DataFrame:
    cut = fused.limit(o.window).orderBy(F.desc("score"), "id")
    return (cut.offset(o.offset) if o.offset else cut).limit(o.limit or o.k)


def hybrid(df: DataFrame, q: Sequence[float], query: str, fields: list[str], o: SearchOptions = SearchOptions(), vector_weight: float = 1.0, text_weight: float = 1.0, space: str = "default") -> DataFrame:
    """Vector and text legs of max(2(k + offset), 20) rows each, fused; weights <= 0 mean 1."""
    wide = SearchOptions(**{**o.__dict__, "k": fetch(o), "offset": 0, "limit": None, "decay": None, "importance_boost": 0.0})
    left = search_space(df, space, q, wide)
    right = text_search(df, query, fields, fetch(o), 0, o.filters)
    weights = [w if w > 0 else 1.0 for w in (vector_weight, text_weight)]
    return _page(fuse([left, right], weights=weights, metrics=[o.metric]), o)


def multi_space(df: DataFrame, queries: dict[str, Sequence[float]], o: SearchOptions = SearchOptions()) -> DataFrame:
    """One search a space in name order, fused with equal weights; empty query vectors are skipped."""
    wide = SearchOptions(**{**o.__dict__, "k": fetch(o), "offset": 0, "limit": None})
    legs = [search_space(df, s, queries[s], wide) for s in sorted(queries) if len(queries[s])]
    return _page(fuse(legs, metrics=[o.metric] * len(legs)), o)
