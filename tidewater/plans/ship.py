"""Make the library importable on the executors of a session that was started without it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers once a session, unless PYTHONPATH already has them."""
    app = spark.sparkContext.applicationId
    here = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE.parent in here or app in _shipped:
        return
    path = Path(tempfile.mkdtemp(prefix="tidewater-ship-")) / "tidewater.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
