"""Corpus pipeline: quality rules, line dedup, near-duplicate join, source mixing, packing.

Every stage takes the documents that its predecessor kept; all but the last
return the columns of their input (``documents`` and any others, whatever their
names), with ``n_chars`` of the text as it is now.

Defined results: a null, empty or short text fails the quality rules; rows that
repeat an id and its text are one document after the join; an empty table gives
no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import op1_ngram_join, op2_packing, op3_line_dedup, op8_mixing, op9_quality_rules
from tessella.llm.common import Scratch, dropping, table, unused


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    length = F.length("text").cast("long")
    return docs.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that too many documents of their host share."""
    return _measured(op9_quality_rules.clean_documents(docs), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring template lines dropped; a document without a word after that goes."""
    dropped = unused(docs, "n_dropped")
    rest = op3_line_dedup.dedup_lines(docs, n_lines=unused(docs, "n_lines"), n_dropped=dropped)
    return _measured(rest.where((F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id."""
    return op1_ngram_join.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards their source's target weight, in shuffled order."""
    return op8_mixing.mix(docs, copy=unused(docs, "copy")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of full length: the pieces with their ids and places (``op2_packing.sequences`` puts them together)."""
    return op2_packing.pack_documents(docs, include_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", packing),
]

#: Tokenising and packing have no SQL form; the whole is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        with dropping():  # a stage's own tables go when its result is written
            after = kept.keep(stage(spark, docs, sf_dir))
        kept.only(after)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
