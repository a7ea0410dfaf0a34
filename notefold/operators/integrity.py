"""Integrity rules as one table of issues, each rule a filter or an anti join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def row_issues(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, code) for each rule that a row breaks; all rules in one scan."""
    codes = F.array_compact(F.array(*(F.when(cond, F.lit(code)) for code, cond in rules.items())))
    return df.select(key, F.explode(codes).alias("code"))


def orphans(child: DataFrame, parent: DataFrame, key: str, code: str) -> DataFrame:
    """Children whose parent is absent."""
    return child.where(F.col(key).isNotNull()).select(key).distinct().join(parent.select(key).distinct(), key, "left_anti").select(key, F.lit(code).alias("code"))


def count_mismatch(left: DataFrame, right: DataFrame, key: str, code: str) -> DataFrame:
    """Keys with another number of rows on the right than on the left states (column n)."""
    counted = right.groupBy(key).agg(F.count("*").alias("m"))
    return left.join(counted, key, "left").where(F.col("n") != F.coalesce("m", F.lit(0))).select(key, F.lit(code).alias("code"))


def archive_issues(notes: DataFrame, images: DataFrame, events: DataFrame) -> DataFrame:
    """Distinct (note_id, code) of an archive's tables; a null note id is the key of no issue."""
    n = row_issues(notes, "note_id", {
        "missing_canonical_url": blank(F.col("canonical_url")), "missing_output_dir": blank(F.col("output_dir")),
        "missing_author_stable_id": (blank(F.col("author_display_id")) | (F.col("author_display_id") == F.col("author_name"))) & (blank(F.col("author_profile_id")) | (F.col("author_profile_id") == F.col("author_name"))),
    })
    done = F.col("download_status") == "success"
    i = row_issues(images, "note_id", {
        "weak_image_sha256": done & (F.length("sha256") > 0) & (F.length("sha256") < 32), "image_width_mismatch": done & (F.col("downloaded_width") != F.col("declared_width")), "image_height_mismatch": done & (F.col("downloaded_height") != F.col("declared_height")),
        "missing_image_file_size": done & (F.coalesce("file_size", F.lit(0)) == 0), "thumbnail_suspected": F.coalesce("is_probable_thumbnail", F.lit(0)) != 0,
    })
    return n.unionByName(i).unionByName(orphans(images, notes, "note_id", "image_without_note")).unionByName(orphans(events, notes, "note_id", "event_without_note")).where(F.col("note_id").isNotNull()).distinct()
