"""Makes this package importable on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import sensorloom


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers as a zip file, once a Spark context, as `--py-files` would."""
    context = spark.sparkContext
    if getattr(context, "_sensorloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(sensorloom.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sensorloom-"), "sensorloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._sensorloom_shipped = True
