"""Term counts by four strategies of partial aggregation, which all give one answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines, whitespace_terms
from ..shipping import ship

STRATEGIES = ("combine", "shuffle_first", "per_line", "per_partition")
#: Distinct terms that a task of the per_partition strategy holds before it emits them.
HELD_TERMS = 200_000


def terms(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """One row for each term, with the columns ``keep``."""
    return docs.select(*keep, F.explode(whitespace_terms(F.col(text))).alias("term"))


def runs(ordered: str) -> Column:
    """array<struct<term, n>> of the runs of equal terms in an ordered array, in one pass over it."""
    a = F.col(ordered)
    starts = F.filter(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), i)), lambda i: i.isNotNull())
    return F.element_at(
        F.transform(F.array(starts), lambda s: F.transform(s, lambda p, j: F.struct(F.get(a, p).alias("term"), (F.coalesce(F.get(s, j + 1), F.size(a)) - p).cast("long").alias("n")))), 1
    )


def _per_partition(docs: DataFrame, text: str) -> DataFrame:
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        held: Counter[str] = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "cnt"])
            held.clear()
            return out

        table = str.maketrans("\t\n\r\f", "    ")
        for batch in batches:
            for value in batch.column(0).to_pylist():
                held.update(t for t in (value or "").translate(table).split(" ") if t)
                if len(held) >= HELD_TERMS:
                    yield emit()
        if held:
            yield emit()

    return docs.select(text).mapInArrow(count, "term string, cnt long").groupBy("term").agg(F.sum("cnt").alias("cnt"))


def term_counts(docs: DataFrame, text: str = "text", strategy: str = "combine") -> DataFrame:
    """(term, cnt).

    combine: partial counts before the shuffle, which Spark plans by itself.
    shuffle_first: every occurrence is shuffled, then counted; for comparison.
    per_line: counted within each line's own row, then added up.
    per_partition: counted in each task by a bounded map, then added up.
    """
    if strategy == "combine":
        return terms(docs, text).groupBy("term").agg(F.count("*").alias("cnt"))
    if strategy == "shuffle_first":
        return terms(docs, text).repartition("term").groupBy("term").agg(F.count("*").alias("cnt"))
    if strategy == "per_line":
        rows = docs.select(F.explode(lines(F.col(text))).alias("line")).select(F.sort_array(whitespace_terms(F.col("line"))).alias("terms"))
        return rows.select(F.explode(runs("terms")).alias("run")).groupBy(F.col("run.term").alias("term")).agg(F.sum("run.n").alias("cnt"))
    if strategy == "per_partition":
        return _per_partition(docs, text)
    raise ValueError(f"strategy is one of {STRATEGIES}")


def space_counts(docs: DataFrame, text: str = "text", keep_empty: bool = False) -> DataFrame:
    """(term, cnt) over single-space splits of each line."""
    from ..functions.text import space_terms

    rows = docs.select(F.explode(lines(F.col(text))).alias("line")).select(F.explode(space_terms(F.col("line"))).alias("term"))
    return (rows if keep_empty else rows.where("term <> ''")).groupBy("term").agg(F.count("*").alias("cnt"))


def top_terms(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """The n most frequent terms, ties by term; one bounded sort, no global one."""
    return term_counts(docs, text).orderBy(F.desc("cnt"), "term").limit(n)


def lines_containing(docs: DataFrame, word: str, text: str = "text", *keep: str) -> DataFrame:
    """Lines that hold ``word`` anywhere, case-sensitive."""
    return docs.select(*keep, F.explode(lines(F.col(text))).alias("line")).where(F.col("line").contains(word))


def hash_sample(df: DataFrame, share: float, *key: str) -> DataFrame:
    """Rows whose key hashes below ``share``: a Bernoulli sample that depends on the key alone, with no driver or task state."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key])), 1, 13), 16, 10).cast("double") / float(2**52)
    return df.where(drawn < share)
