"""Sessions, and where their intermediate tables may go."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; on one machine, one shuffle partition for each core."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", str(os.cpu_count() or 8))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and runs in one process a temporary folder is made, and removed at exit.
    """
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{made}")
        place = spark.sparkContext.getCheckpointDir()
    return place


def estimated_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate; file sizes for scans, so it errs upwards for filters and joins."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
