"""Ships the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession, root: str) -> None:
    """Add the package as a zip, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="colloquy-"), "colloquy.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "colloquy")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
