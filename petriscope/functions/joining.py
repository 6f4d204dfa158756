"""Joins of tables that grow with the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def merged(left: DataFrame, right: DataFrame, on: list[str] | str | Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` by sorting and merging, never by a broadcast.

    Spark would broadcast a table for the size of its Parquet files, which says
    little about rows: pixels and runs compress to a few bytes, and what
    explodes from them counts as large as they are.  So the driver would hold a
    table that grows with the input.
    """
    return left.join(right.hint("merge"), on, how)
