"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, dropping
from ..session import estimated_bytes

__all__ = ["BLANK", "Scratch", "broadcast_if", "content_key", "dropping", "let", "nested", "once", "small", "table", "unnested", "unused", "words_of"]

#: Words are runs of anything but space and the five ASCII controls tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"
#: Size of the files of a written table that may be broadcast.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda evaluates what it refers to once per element; an expression bound
    this way is a variable by then.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def once(value: Column) -> Column:
    """``value``, computed where it is defined.

    Filters on it stay above: the optimiser does not push them through what it
    takes for non-deterministic, and so does not compute ``value`` again below
    for every mention of it.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def content_key(*parts: Column) -> list[Column]:
    """Two hashes, 96 bits together, that stand for equal texts (or other values); null counts as its own text."""
    return [F.xxhash64(*parts).alias("content_a"), F.hash(*parts).alias("content_b")]


def nested(docs: DataFrame, **own: Column) -> DataFrame:
    """All columns as one struct ``row``, so that no name of theirs can clash, beside those given."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(name) for name, c in own.items()])


def unnested(docs: DataFrame, **instead: Column) -> list[Column]:
    """The columns of ``docs`` out of ``row``, some replaced."""
    return [instead[c] if c in instead else F.col("row").getField(c).alias(c) for c in docs.columns]


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most so many rows; it reads file footers, no data."""
    return df.count() <= rows


def broadcast_if(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only where the written table is within bounds on its rows and bytes; otherwise the join shuffles."""
    return F.broadcast(df) if estimated_bytes(df) <= size and small(df, rows) else df
