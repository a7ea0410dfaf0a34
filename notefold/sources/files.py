"""Text, JSON, JSONL and CSV files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file whole, for HTML pages, JSON snapshots and Markdown notes."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def json_items(df: DataFrame, text: str, schema: str, out: str = "item") -> DataFrame:
    """Items of JSON arrays; bad JSON, other kinds and null items give none."""
    return df.withColumn(out, F.explode(F.filter(F.from_json(text, f"array<{schema}>"), lambda x: x.isNotNull())))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and quotes where needed; nulls as empty."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
