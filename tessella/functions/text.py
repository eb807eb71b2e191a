"""Tokenisers and line expressions. All are built-in functions, inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Delimiters of the whitespace tokeniser; vertical tab is not one.
DELIMITERS = "[ \t\n\r\f]+"


def whitespace_terms(text: Column) -> Column:
    """Terms between delimiters; none is empty. Null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), DELIMITERS), "")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n")


def space_terms(line: Column) -> Column:
    """Split on each single space: leading and interior empty terms stay, trailing ones go.
    An empty line is one empty term, a line of spaces none."""
    bare = F.rtrim(line)
    return F.when(line == "", F.array(F.lit(""))).when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def fields(line: Column) -> Column:
    """Tab-separated fields without trailing empty ones."""
    return F.split(F.regexp_replace(line, "\t+$", ""), "\t")


def doc_key(name: Column) -> Column:
    """The base name of a path."""
    return F.element_at(F.split(name, "/"), -1)
