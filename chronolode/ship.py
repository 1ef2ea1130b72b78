"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers where PYTHONPATH does not already hold it."""
    root = Path(__file__).resolve().parents[1]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_chronolode_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="chronolode-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/chronolode", "zip", root, "chronolode"))
    spark.sparkContext._chronolode_shipped = True
