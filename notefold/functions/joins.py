"""Joins of tables that grow with the data.

Spark broadcasts a side whose estimated size is small, and the estimate of a
column of a compressed file is far below what the rows take in memory. Two
tables that grow are therefore joined by sorting, which AQE splits where a key
is hot; broadcasts stay for tables of a proven size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """``left.join(right)`` that is never turned into a broadcast."""
    return left.join(right.hint("merge"), on, how)
