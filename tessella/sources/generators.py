"""Seeded random tables with the shapes of the benchmark inputs. Values follow the same distributions, not the same sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

R_ROWS, S_ROWS = 100_000, 1_000_000
COURSES, TEACHERS, STUDENTS, AGES = 1_000_000, 8_000_000, 16_000_000, 100


def _drawn(n: int, seed: int) -> Column:
    """Uniform in [0, n), a function of row and seed alone, so any partitioning gives the same table."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n)).cast("string")


def relation(spark: SparkSession, kind: str, side: str, rows: int | None = None, seed: int = 1) -> DataFrame:
    """(key, payload). ``kind`` course or age; ``side`` R (teachers) or S (students)."""
    rows = rows if rows is not None else R_ROWS if side == "R" else S_ROWS
    key = F.concat(F.lit("course_"), _drawn(COURSES, seed)) if kind == "course" else _drawn(AGES, seed)
    who = F.concat(F.lit("teacher_"), _drawn(TEACHERS, seed + 100)) if side == "R" else F.concat(F.lit("student_"), _drawn(STUDENTS, seed + 100))
    return spark.range(rows).select(key.alias("key"), who.alias("payload"))


def students(spark: SparkSession, rows: int = 9_999, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(student_id, gpa) with 2.0 to 4.9, and (student_id, name, school)."""
    base = spark.range(1, rows + 1)
    gpa = F.round(2.0 + F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(30)) / 10, 1)
    school = F.concat(F.lit("school_"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(10)).cast("string"))
    return base.select(F.col("id").alias("student_id"), gpa.alias("gpa")), base.select(F.col("id").alias("student_id"), F.concat(F.lit("name_"), F.col("id").cast("string")).alias("name"), school.alias("school"))
