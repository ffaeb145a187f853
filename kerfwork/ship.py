"""Makes this package importable in Python workers that lack it on their path."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark's own file distribution, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as build:
        copied = shutil.copytree(package, Path(build, "root", package.name), ignore=shutil.ignore_patterns("__pycache__"))
        folder = tempfile.mkdtemp(prefix="kerfwork-")  # served by the driver until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        packed = shutil.make_archive(str(Path(folder, package.name)), "zip", copied.parent)
    context.addPyFile(packed)
