"""Intermediate tables in the shared folder the cluster names.

Every cut of lineage goes through :func:`durable`: a Parquet table under
``spark.checkpoint.dir``, which survives lost executors and is visible to all
of them.  Only a local master without that setting falls back to a folder of
its own.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only on a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A path under the shared folder that nothing has used."""
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def durable(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once and return it as a scan of what was written."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if _open:
        _open[-1].paths.append(path)
    return out


class Scope:
    """The scratch tables that were written while it was open."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        """Let these :func:`durable` tables outlive the scope; they belong to the one around it."""
        self.kept |= {t.scratch_path for t in tables}


_open: list[Scope] = []


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Scope]:
    """Delete the scratch tables that are written inside, unless kept, when what needs them has been written.

    What leaves the scope must not read a table that is not kept.
    """
    scope = Scope()
    _open.append(scope)
    try:
        yield scope
    finally:
        _open.remove(scope)
        for path in scope.paths:
            if path not in scope.kept:
                drop_path(spark, path)
            elif _open:
                _open[-1].paths.append(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by Spark's own file system layer."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
