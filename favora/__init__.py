"""Spatial evidence analysis and corpus preparation on Spark DataFrames."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the session's Python workers, for clusters on which it isn't installed; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="favora-")) / "favora_package.zip"
    with zipfile.ZipFile(file, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(file))
    _shipped.add(app)
