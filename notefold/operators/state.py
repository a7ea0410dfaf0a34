"""Keyed state: merge with per-column rules, latest version, counts, event folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A row's new value: keep the first, fill in what is null, or take the new one even if null.
KEEP, FILL, REPLACE = "keep", "fill", "replace"


def latest(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """One row a key, the greatest by ``order`` and then by all columns; partial aggregation, no sort."""
    version = F.struct(*order, *(c for c in columns if c not in order))
    return df.groupBy(*key).agg(F.max(version).alias("_v")).select(*key, *(F.col(f"_v.{c}").alias(c) for c in columns))


def merge(base: DataFrame, patch: DataFrame, key: list[str], rules: dict[str, str | Column]) -> DataFrame:
    """Upsert as one full outer join: rule by column, a Column rule may use ``b.`` and ``p.``.

    Both sides must hold one row a key (see :func:`latest`). Keys on one side only
    pass through; extra columns of the base stay, those of the patch are left out.
    """
    b, p = base.alias("b"), patch.withColumn("_in", F.lit(True)).alias("p")
    joined = b.withColumn("_on", F.lit(True)).alias("b").join(p, key, "full_outer")
    made = []
    for name, rule in rules.items():
        old, new = F.col(f"b.{name}"), F.col(f"p.{name}")
        value = rule if isinstance(rule, Column) else F.coalesce(old, new) if rule == KEEP else F.coalesce(new, old) if rule == FILL else F.when(F.col("p._in"), new).otherwise(old)
        made.append(value.alias(name))
    rest = [F.col(f"b.{c}").alias(c) for c in base.columns if c not in key and c not in rules]
    return joined.select(*key, *made, *rest)


def counts(notes: DataFrame, images: DataFrame, hidden: str = "excluded") -> DataFrame:
    """(metric, value) dashboard in one pass over each table."""
    active = F.col("stage") != hidden
    per = notes.groupBy("stage").agg(F.count("*").alias("value")).select(F.concat(F.lit("stage:"), F.coalesce("stage", F.lit(""))).alias("metric"), "value")
    total = notes.agg(F.count("*").alias("total_including_excluded"), F.count_if(active).alias("total"), F.count_if(~active).alias("excluded_notes"))
    shown = images.join(notes.select("note_id", "stage"), "note_id").agg(
        F.count("*").alias("images_total_including_excluded"), F.count_if(active).alias("images_total"), F.count_if(active & (F.col("download_status") == "success")).alias("images_downloaded"),
        F.count_if(active & (F.col("ocr_status") == "success")).alias("ocr_success"), F.count_if(active & F.col("ocr_status").isin("failed", "needs_review", "vl_pending")).alias("needs_review"),
    )
    long = lambda df: df.unpivot([], df.columns, "metric", "value")
    return per.unionByName(long(total)).unionByName(long(shown))


def fold_events(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last stage and level, number of events and of errors of each key; null keys are left out."""
    last = F.max(F.struct(*order, "stage", "level")).alias("_l")
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(last, F.count("*").alias("events"), F.count_if(F.col("level") == "error").alias("errors")).select(key, F.col("_l.stage").alias("stage"), F.col("_l.level").alias("level"), "events", "errors")


def recover(stage: Column) -> Column:
    """Interrupted stages go back to the last settled one."""
    return F.when(stage == "fetching", "discovered").when(stage == "ocr_running", "fetched").otherwise(stage)


#: How each column of a table takes a newer row; what is not named stays.
BOARD = {"url": REPLACE, "title": FILL, "expected_count": FILL, "discovered_count": REPLACE, "last_collected_at": REPLACE, "updated_at": REPLACE, "created_at": KEEP}
PARSED_NOTE = {"board_id": FILL, "output_dir": FILL, **dict.fromkeys("url canonical_url title summary_title author_name author_display_id author_profile_id publish_time_raw publish_time_iso body_text fetched_at updated_at".split(), REPLACE), "discovered_at": KEEP}
IMAGE = {**dict.fromkeys("source_url source_variant declared_width declared_height local_path sha256 downloaded_width downloaded_height file_size format thumbnail_reason ocr_engine ocr_confidence".split(), FILL), **dict.fromkeys("is_probable_thumbnail download_status ocr_status last_error".split(), REPLACE)}
