"""Text sinks; each overwrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_keyed(df: DataFrame, path: str, separator: str = "\t") -> None:
    """One line per row, columns joined by a separator; nulls as empty text. No exchange is added, so a map-only plan stays one."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(separator, *columns).alias("value")).write.mode("overwrite").text(path)


def write_postings(df: DataFrame, path: str) -> None:
    """term, tab, doc:count,doc:count of a table (term, postings array)."""
    shown = F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc"], p["tf"].cast("string"))), ",")
    df.select(F.concat_ws("\t", "term", shown).alias("value")).write.mode("overwrite").text(path)


def write_adjacency(df: DataFrame, path: str) -> None:
    """id:target,target of a table (id, targets array)."""
    df.select(F.concat_ws(":", "id", F.array_join("targets", ",")).alias("value")).write.mode("overwrite").text(path)


def show_keyed(df: DataFrame, out: Callable[[str], None] = print, separator: str = "\t") -> int:
    """Every row as a line, in order, one partition at a time on the driver; returns their number."""
    n = 0
    for row in df.toLocalIterator():
        out(separator.join("" if x is None else str(x) for x in row))
        n += 1
    return n
