"""Text sources: lines, keyed tab-separated rows, edges and adjacency lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fields


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file): every line below a path, and the base name of its file."""
    return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))


def parse_keyed(rows: DataFrame, value: str = "value") -> DataFrame:
    """(key, payload) of lines with at least two fields: field 0, and the rest joined by tabs. Others are dropped. The key may be empty."""
    parts = rows.withColumn("_f", fields(F.regexp_replace(F.col(value), "\r$", ""))).where(F.size("_f") >= 2)
    kept = [c for c in rows.columns if c != value]
    return parts.select(F.element_at("_f", 1).alias("key"), F.array_join(F.slice("_f", 2, F.size("_f") - 1), "\t").alias("payload"), *kept)


def read_keyed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_keyed(read_lines(spark, path)).drop("file")


def read_relations(spark: SparkSession, path: str, left: str = "R.dat", right: str = "S.dat") -> tuple[DataFrame, DataFrame]:
    """The two relations of a directory, told apart by the ends of the names of its files, or of the folders in it that
    hold their parts; other files are ignored."""
    named = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(/part-[^/]*)?$", 1)
    rows = parse_keyed(spark.read.option("recursiveFileLookup", "true").text(path).select("value", named.alias("relation")))
    return rows.where(F.col("relation").endswith(left)).drop("relation"), rows.where(F.col("relation").endswith(right)).drop("relation")


def read_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(src, dst) of tab-separated edge lines."""
    return read_keyed(spark, path).select(F.col("key").alias("src"), F.split("payload", "\t")[0].alias("dst"))


def read_adjacency(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(src, dst) of lines src:dst,dst,..."""
    parts = F.split("value", ":", 2)
    # A line is taken apart before its targets become rows; in one step the source would be split off for each target again.
    halves = spark.read.text(path).where(F.size(parts) == 2).select(parts[0].alias("src"), parts[1].alias("targets"))
    return halves.select("src", F.explode(F.split("targets", ",")).alias("dst")).where("dst <> ''")
