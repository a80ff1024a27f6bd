"""Makes this package importable for Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def reachable() -> bool:
    """Do workers that inherit this environment and folder find the package?"""
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    return any(p and Path(p).resolve() == ROOT for p in places)


def ship(spark: SparkSession) -> None:
    """Hands the package to all workers by Spark's own file server, once a context, unless they find it anyway."""
    context = spark.sparkContext
    if reachable() or getattr(context, "_loamwork_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="loamwork-")) / "loamwork.zip"
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted((ROOT / "loamwork").rglob("*.py")):
            z.write(source, source.relative_to(ROOT))
    context.addPyFile(str(path))
    context._loamwork_shipped = True
