"""Intermediate tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

from .session import shared_dir

#: The session catalog, whatever the default catalog is.
CATALOG = "spark_catalog"
ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None, size: int = 8 << 20) -> Iterator[None]:
    """Within it, actions hand Python workers at most so many rows at a time, of about ``size`` bytes."""
    if rows is None:
        yield
        return
    before = {k: spark.conf.get(k) for k in (ARROW_ROWS, ARROW_BYTES)}
    spark.conf.set(ARROW_ROWS, str(rows))
    spark.conf.set(ARROW_BYTES, str(size))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Scratch:
    """Tables written to the shared folder and read back, so that a lost executor costs a reread at most.

    They are managed tables of a database placed in that folder: dropping one removes its files wherever they are.
    Tables that a lazy result still reads stay until ``dropping`` ends around it or the driver does; ``free`` and
    ``only`` remove the others.
    """

    opened: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.n = spark, {}, 0
        self.name = f"tessella_{uuid.uuid4().hex}"
        self.root = f"{shared_dir(spark)}/{self.name}"
        place = self.root.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE DATABASE {CATALOG}.{self.name} LOCATION '{place}'")
        atexit.register(self.drop)
        Scratch.opened.append(self)

    def keep(self, df: DataFrame, batch: int | None = None) -> DataFrame:
        """``df`` written and read back; ``batch`` bounds the rows of Arrow batches on the way."""
        self.n += 1
        table = f"t{self.n:03d}"
        with arrow_batches(self.spark, batch):
            df.write.format("parquet").option("compression", "zstd").saveAsTable(f"{CATALOG}.{self.name}.{table}")
        kept = self.spark.read.schema(df.schema).parquet(f"{self.root}/{table}")
        kept._kept_at = table
        self.tables[table] = kept
        return kept

    def folder(self, name: str) -> str:
        """A place for files of other formats, removed with the tables."""
        return f"{self.root}/{name}"

    def free(self, *kept: DataFrame) -> None:
        """Remove tables that ``keep`` returned and nothing reads any more."""
        for df in kept:
            if self.tables.pop(df._kept_at, None) is not None:
                self.spark.sql(f"DROP TABLE IF EXISTS {CATALOG}.{self.name}.{df._kept_at}")

    def only(self, *kept: DataFrame) -> None:
        """Remove all tables but these, which a result still reads."""
        names = {df._kept_at for df in kept}
        self.free(*[df for name, df in list(self.tables.items()) if name not in names])

    def drop(self) -> None:
        if self not in Scratch.opened:
            return
        Scratch.opened.remove(self)
        atexit.unregister(self.drop)
        context = self.spark.sparkContext
        if context._jsc is not None and not context._jsc.sc().isStopped():
            self.spark.sql(f"DROP DATABASE IF EXISTS {CATALOG}.{self.name} CASCADE")


@contextmanager
def dropping() -> Iterator[None]:
    """Drops, at its end, what operators called inside have written. Their results must be consumed by then."""
    before = len(Scratch.opened)
    try:
        yield
    finally:
        for scratch in Scratch.opened[before:]:
            scratch.drop()
