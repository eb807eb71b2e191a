"""Inverted indexes: counts per term and document, and ordered postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import whitespace_terms
from ..scratch import Scratch
from .counts import runs

#: Documents in a part of a term's postings.
PART = 100_000


def postings_long(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(term, doc, tf), one row per posting. Terms are counted within their row. That is all for documents of one row;
    only the counts of those of several rows, which a look at the names finds first, are dealt by term and document and added."""
    rows = docs.select(F.col(doc).cast("string").alias("doc"), F.col(text).alias("text"))
    repeated = rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("_doc"))
    names = rows.groupBy("doc").agg(F.count("*").alias("n")).agg(F.count("*").alias("all"), F.coalesce(F.sum((F.col("n") > 1).cast("int")), F.lit(0)).alias("repeated")).first()
    if not names["repeated"]:
        return _row_counts(rows)
    same = F.col("doc").eqNullSafe(F.col("_doc"))
    several = rows if names["repeated"] == names["all"] else rows.join(repeated, same, "left_semi")
    added = _row_counts(several).groupBy("term", "doc").agg(F.sum("tf").alias("tf"))
    return added if several is rows else _row_counts(rows.join(repeated, same, "left_anti")).unionByName(added)


def _row_counts(rows: DataFrame) -> DataFrame:
    """(term, doc, tf) of each row (doc, text)."""
    ordered = rows.select("doc", F.sort_array(whitespace_terms(F.col("text"))).alias("terms"))
    return ordered.select("doc", F.explode(runs("terms")).alias("run")).select("run.term", "doc", F.col("run.n").alias("tf"))


def postings(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(term, postings): documents in ascending order with their counts, as structs, so no delimiter can clash.
    A term is one row, which must hold its documents; ``postings_parts`` has no such bound."""
    pairs = postings_long(docs, doc, text).groupBy("term").agg(F.collect_list(F.struct("doc", "tf")).alias("postings"))
    return pairs.select("term", F.sort_array("postings").alias("postings"))


def postings_parts(docs: DataFrame, doc: str, text: str = "text", part: int = PART) -> DataFrame:
    """(term, part, postings): a term's postings in parts of about ``part`` documents, so that no term, however common,
    has to fit in a row or a task. A document's part follows from a hash of its name and the term's document count. The
    counts are a written table, so that postings go through one exchange if it is small."""
    pairs = postings_long(docs, doc, text)
    parts = pairs.groupBy("term").agg(F.ceil(F.count("*") / part).alias("parts")).where("parts > 1")
    parts = Scratch(docs.sparkSession).keep(parts)
    place = F.conv(F.substring(F.md5("doc"), 1, 13), 16, 10).cast("double") / float(2**52)
    dealt = pairs.join(parts, "term", "left").select("term", "doc", "tf", F.floor(place * F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    return dealt.groupBy("term", "part").agg(F.sort_array(F.collect_list(F.struct("doc", "tf"))).alias("postings"))


def rendered(index: DataFrame) -> DataFrame:
    """``index`` with postings as doc:tf,doc:tf."""
    return index.withColumn("postings", F.array_join(F.transform("postings", lambda p: F.concat(p["doc"], F.lit(":"), p["tf"].cast("string"))), ","))


def postings_sorted(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """The long form ordered by term and document: a secondary sort, for consumers that stream a term's postings without
    holding them. Ranges of both columns are dealt out, so a common term takes several partitions, one after the other."""
    return postings_long(docs, doc, text).repartitionByRange("term", "doc").sortWithinPartitions("term", "doc")
