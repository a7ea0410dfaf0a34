"""Parquet tables of an archive directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan ``{root}/{name}.parquet``; pruning and pushdown are Catalyst's."""
    return spark.read.parquet(f"{root}/{name}.parquet")
