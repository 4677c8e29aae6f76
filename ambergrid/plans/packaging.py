"""Make this package importable in the Python workers of any cluster."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application (like ``--py-files``)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="ship-")) / package.name), "zip", package.parent, package.name
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
