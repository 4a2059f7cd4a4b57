"""Rows that are carried whole: all columns of a table in one struct, so that no name of theirs meets another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """A column's name as Spark's functions take it, whatever signs it has."""
    return "`" + name.replace("`", "``") + "`"


def row_of(docs: DataFrame, changed: dict[str, Column] | None = None) -> Column:
    """All columns of a table, some of them `changed`, as one struct, _row."""
    return F.struct(*[(changed or {}).get(c, F.col(quoted(c))).alias(c) for c in docs.columns]).alias("_row")


def columns_of(docs: DataFrame, changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns that `row_of` put away, some of them `changed`."""
    return [(changed or {}).get(c, F.col(f"_row.{quoted(c)}")).alias(c) for c in docs.columns]
