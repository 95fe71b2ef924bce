"""Approximate search: an inverted file of k-means cells on disk, and the exact plan as its baseline."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.predicates import matching
from tidewater.operators.search import SearchOptions, search
from tidewater.plans.scratch import exists

#: Cells are fitted to so many rows a cell, chosen by hash, and no sample holds more numbers than this (256 MB); then cells are fewer and larger.
ROWS_A_CELL, FIT_NUMBERS = 32, 32 << 20

#: Share of the cells that a search looks at; vectors without clusters need most of them for a recall of 0.95.
PROBE = 0.9


class CellIndex:
    """Vectors on disk sorted by their nearest centre, in segments; deleted ids are kept apart until it is compacted.

    Every row is indexed.  Files are sorted by cell, so the scan of some cells
    skips the row groups of others.
    """

    def __init__(self, spark: SparkSession, folder: str):
        """Open an index that is there; see :meth:`build`."""
        self.spark, self.folder = spark, folder.rstrip("/")
        rows = spark.read.parquet(f"{self.folder}/centres").orderBy("cell").collect()  # FIT_NUMBERS / ROWS_A_CELL numbers at most
        self.metric = rows[0]["metric"] if rows else "cosine"
        self.centres = np.array([r["centre"] for r in rows], float).reshape(len(rows), -1)

    @classmethod
    def build(cls, df: DataFrame, folder: str, metric: str = "cosine", cells: int | None = None, seed: int = 42) -> CellIndex:
        """A new index in ``folder`` of all rows of ``df`` (id, vector, ...) that have a vector; about a square root of their number are cells."""
        own = df.where(F.size("vector") > 0)
        n, width = own.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
        cells = max(1, min(n, cells or math.isqrt(n), FIT_NUMBERS // (ROWS_A_CELL * width)))
        most = cells * ROWS_A_CELL
        hashed = own.withColumn("_hash", F.xxhash64("id"))
        if n > 2 * most:
            hashed = hashed.where(F.col("_hash") < 2 * most * 2**64 // n - 2**63)
        x = np.array([r[0] for r in hashed.orderBy("_hash", "id").limit(most).select("vector").collect()], float).reshape(-1, width)
        if metric == "cosine":
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)] if len(x) else np.zeros((0, width))
        for _ in range(10 if len(x) else 0):
            near = _nearest(x, c, metric)
            sums, sizes = np.zeros_like(c), np.bincount(near, minlength=len(c))[:, None]
            np.add.at(sums, near, x)
            c = np.where(sizes > 0, sums / np.maximum(sizes, 1), c)
            if metric == "cosine":
                c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        rows = [(i, v.tolist(), metric) for i, v in enumerate(c)]
        df.sparkSession.createDataFrame(rows, "cell int, centre array<double>, metric string").write.parquet(f"{folder.rstrip('/')}/centres")
        return cls(df.sparkSession, folder).add(df)

    def add(self, df: DataFrame) -> CellIndex:
        """Index the rows of ``df`` as a new segment; an id that was deleted or indexed before counts as this segment has it."""
        segment, centres, metric = self._segments() + 1, self.centres, self.metric

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            return pd.Series(_nearest(np.stack(v.to_numpy()).astype(float), centres, metric).astype("int32") if len(v) else [], dtype="int32")

        own = df.where(F.size("vector") > 0)
        if segment > 1:
            self._bury(own.select("id"), segment)
        placed = own.withColumns({"cell": nearest(F.col("vector")) if len(centres) else F.lit(0), "segment": F.lit(segment)})
        placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{self.folder}/rows/segment-{segment}")
        return self

    def _segments(self) -> int:
        n = 0
        while exists(self.spark, f"{self.folder}/rows/segment-{n + 1}"):
            n += 1
        return n

    def _bury(self, ids: DataFrame, segment: int) -> None:
        ids.select(F.col("id").cast("long"), F.lit(segment).alias("gone")).write.mode("append").parquet(f"{self.folder}/dead")

    def delete(self, ids: DataFrame) -> CellIndex:
        """Rows with these ids no longer count; :meth:`undelete` brings them back until the index is compacted."""
        self._bury(ids, self._segments() + 1)
        return self

    def undelete(self, ids: DataFrame) -> CellIndex:
        """Ids that were deleted since they were last added count again."""
        last = self._rows().groupBy("id").agg(F.max("segment").alias("gone")).join(ids.select("id"), "id", "left_semi")
        last.select("id", F.col("gone")).withColumn("back", F.lit(True)).write.mode("append").parquet(f"{self.folder}/back")
        return self

    def _rows(self) -> DataFrame:
        paths = [f"{self.folder}/rows/segment-{i + 1}" for i in range(self._segments())]
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    def table(self) -> DataFrame:
        """The rows that count, with their ``cell``."""
        rows = self._rows()
        if not exists(self.spark, f"{self.folder}/dead"):
            return rows.drop("segment")
        dead = self.spark.read.parquet(f"{self.folder}/dead").groupBy("id").agg(F.max("gone").alias("gone"))
        if exists(self.spark, f"{self.folder}/back"):
            back = self.spark.read.parquet(f"{self.folder}/back").groupBy("id").agg(F.max("gone").alias("kept"))
            dead = dead.join(back, "id", "left").withColumn("gone", F.coalesce("kept", "gone")).drop("kept")
        return rows.join(dead, "id", "left").where("gone is null or segment >= gone").drop("gone", "segment")

    def compact(self, folder: str) -> CellIndex:
        """The rows that count as one segment of a new index in ``folder``, with the same centres."""
        self.spark.read.parquet(f"{self.folder}/centres").write.parquet(f"{folder.rstrip('/')}/centres")
        return CellIndex(self.spark, folder).add(self.table().drop("cell"))

    def nearest_cells(self, q: Sequence[float]) -> list[int]:
        """Cells in the order in which a search looks at them."""
        v = np.array(q, float)
        if self.metric in ("euclidean", "euclidean_squared"):
            return np.argsort(((self.centres - v) ** 2).sum(axis=1), kind="stable").tolist()
        return np.argsort(-(self.centres @ v), kind="stable").tolist()

    def search(self, q: Sequence[float], o: SearchOptions = SearchOptions(), probe: float = PROBE) -> DataFrame:
        """Exact scores over the nearest cells; if filters or the threshold leave fewer than the window, twice as many cells, up to all."""
        order, table = self.nearest_cells(q), self.table()
        n = max(1, math.ceil(probe * len(order)))
        while n < len(order):
            found = search(table.where(F.col("cell").isin(order[:n])), q, o)
            if not (o.filters or o.threshold is not None) or matching(table.where(F.col("cell").isin(order[:n])), *o.filters).limit(o.window).count() >= o.window:
                return found.drop("cell")
            n *= 2
        return search(table, q, o).drop("cell")

    def count(self) -> int:
        return self.table().count()

    def stats(self) -> DataFrame:
        """Rows of each cell that has some."""
        return self.table().groupBy("cell").count()


def _nearest(x: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    """The cell of each row: by angle for cosine, else by distance; in slices, so that no product grows with the cells."""
    step = max(1, (4 << 20) // max(1, len(centres)))
    half = 0.0 if metric == "cosine" else (centres**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((x[i : i + step] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), step))])


def recall(index: CellIndex, queries: Sequence[Sequence[float]], o: SearchOptions = SearchOptions(), probe: float = PROBE) -> float:
    """Share of the exact nearest rows that the index finds."""
    got = want = 0
    for q in queries:
        exact = {r[0] for r in search(index.table(), q, o).select("id").collect()}
        got += len(exact & {r[0] for r in index.search(q, o, probe).select("id").collect()})
        want += len(exact)
    return got / max(1, want)
