"""Make the package importable in Python workers, wherever the driver imported it from."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per Spark application (a zip of a few dozen kB, through Spark's own file server)."""
    context = spark.sparkContext
    if getattr(context, "_tessella_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(os.path.join(root, "tessella")):  # already running from an archive that Spark distributes
        return
    place = tempfile.mkdtemp(prefix="tessella-ship-")
    staged = os.path.join(place, "tree")
    shutil.copytree(os.path.join(root, "tessella"), os.path.join(staged, "tessella"), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(place, "tessella"), "zip", staged))
    shutil.rmtree(staged)
    context._tessella_shipped = True
