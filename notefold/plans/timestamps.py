"""Queries of the timestamp operator (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.operators.timestamps import disagreeing_days, normalize_notes
from notefold.sources.tables import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return disagreeing_days(table(spark, sf, "notes"), table(spark, sf, "capture_zones"))


def p4_normalized(spark: SparkSession, sf: str) -> DataFrame:
    n = normalize_notes(table(spark, sf, "notes"), table(spark, sf, "capture_zones"))
    return n.select("note_id", F.col("t.kind").alias("kind"), F.date_format("t.utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("utc"), F.col("t.day").alias("day"), F.col("t.dst").alias("dst"), F.col("t.zone_from").alias("zone_from")).distinct()


QUERIES = {"p4_found": p4_found, "p4_normalized": p4_normalized}
SQL: dict[str, str] = {}
