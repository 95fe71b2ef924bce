"""Snapshots, change logs and JSON as sources and sinks."""

from __future__ import annotations

import os
import re
import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.store import replay
from tidewater.plans.scratch import drop_path


def read_json(spark: SparkSession, path: str, schema: str, array: bool = False) -> DataFrame:
    """Records of JSON lines, or of one JSON array a file; a schema spares a pass over the data."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def dump_json(df: DataFrame, path: str, limit: int | None = None) -> None:
    (df if limit is None else df.orderBy("id").limit(limit)).write.mode("overwrite").json(path)


def ndjson(df: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return df.select(F.to_json(F.struct("*")).alias("line"))


class Snapshot:
    """A table folder of numbered versions and a change log; the commit protocol makes each version whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, fs = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        mark = lambda n: self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS")
        return sorted(int(n[1:]) for n in names if re.fullmatch("v[0-9]+", n) and fs.exists(mark(n)))

    def save(self, df: DataFrame) -> int:
        """Write the next version; earlier ones stay readable."""
        version = (self._versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        return version

    def load(self, version: int | None = None) -> DataFrame:
        """A version, the last by default; columns that files of an older layout lack are null."""
        version = version or self._versions()[-1]
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/v{version}")

    def _segments(self) -> list[str]:
        """The folders of the change log, each one whole append."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        fs = self._fs()[1]
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        mark = lambda n: self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log/{n}/_SUCCESS")
        return sorted(f"{self.folder}/log/{n}" for n in names if fs.exists(mark(n)))

    def append(self, changes: DataFrame) -> None:
        """Add entries ``(seq, op, id, ...)`` to the change log, as a segment of their own."""
        changes.write.parquet(f"{self.folder}/log/{uuid.uuid4().hex}")

    def _replayed(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.load()
        log = self.spark.read.option("mergeSchema", True).parquet(*segments)
        return replay(self.load(), log) if self._versions() else replay(log.where("false").drop("seq", "op"), log)

    def current(self) -> DataFrame:
        return self._replayed(self._segments())

    def checkpoint(self) -> int:
        """Fold the log into a new version and drop the segments that are in it; entries appended meanwhile stay.

        Entries are final states, so a version that was written before its
        segments were dropped replays them without harm.
        """
        segments = self._segments()
        version = self.save(self._replayed(segments))
        for s in segments:
            drop_path(self.spark, s)
        return version

    def checkpoint_at(self, log_bytes: int = 64 << 20) -> int | None:
        """:meth:`checkpoint` if the log is at least so large; None if it is not."""
        fs, path = self._fs()[1], self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        size = sum(fs.getContentSummary(path(s)).getLength() for s in self._segments())
        return self.checkpoint() if size >= log_bytes else None


def parse_duration(text: str) -> timedelta:
    """A duration such as ``1h30m``, ``250ms`` or ``2d``; raises ValueError on anything else."""
    units = {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "\u00b5s": 1e-6, "ns": 1e-9}
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ms|us|\u00b5s|ns|d|h|m|s)", text.lstrip("+-"))
    if text != "0" and (not parts or "".join(a + b for a, b in parts) != text.lstrip("+-")):
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(seconds=sum(float(a) * units[b] for a, b in parts) * (-1 if text.startswith("-") else 1))


def load_config(text: str) -> dict[str, str]:
    """Flat ``key: value`` lines with the environment put in; nested keys are joined by dots, ``#`` begins a comment."""
    out, path = {}, []
    for line in expand_env(text).splitlines():
        body = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not body.strip():
            continue
        depth = (len(body) - len(body.lstrip())) // 2
        key, _, value = body.strip().partition(":")
        path = [*path[:depth], key.strip()]
        if value.strip():
            out[".".join(path)] = value.strip().strip("\"'")
    return out


def expand_env(text: str) -> str:
    """``${NAME}`` and ``${NAME:-default}`` by the environment."""
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1]) or m[2] or "", text)


def compact(df: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Rewrite a table into files of a bounded number of rows."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)
