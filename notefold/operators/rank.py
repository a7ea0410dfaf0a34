"""Best candidate of each position, fallback, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score of each variant of an image, best first.
VARIANT_SCORES = {"structured-original": 120, "WB_ORI": 115, "structured-url": 105, "WB_DFT": 100, "structured-default": 95, "H5_DTL": 60, "WB_PRV": 55, "structured-preview": 45, "CRD_WM_WEBP": 40}
#: Fixed value: marks of a transformed image in its URL.
THUMBNAIL_URL = r"(?i)(thumb|thumbnail|small|avatar|icon|resize|crop|quality|q_\d+|w_\d+|h_\d+|/s\d+|prv|preview|!.*prv)"


def variant_score(c: Column, scores: dict[str, int] | None = None, default: int = 60) -> Column:
    table = F.create_map(*(F.lit(x) for kv in (scores or VARIANT_SCORES).items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), F.lit(default))


def best(df: DataFrame, key: list[str], score: list[Column], columns: list[str]) -> DataFrame:
    """Row of greatest score by key; ties by the columns. One partial aggregation, no window."""
    top = F.max(F.struct(*(s.alias(f"_s{i}") for i, s in enumerate(score)), *columns))
    return df.groupBy(*key).agg(top.alias("_t")).select(*key, *(F.col(f"_t.{c}").alias(c) for c in columns))


def thumbnail_reasons(url: Column, width: Column, height: Column, declared_width: Column, declared_height: Column, size: Column, display_width: Column | None = None, display_height: Column | None = None, better: Column | None = None, variant: Column | None = None) -> Column:
    """Reasons, joined in a fixed order, why an image is probably a thumbnail; '' for none.

    Display sizes are those of the page; ``better`` says that a candidate of greater
    score exists, which counts for variants that are only what the page showed.
    """
    none = F.lit(None).cast("int")
    long = F.greatest(F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0)))
    small = lambda got, want: (want > 0) & (F.coalesce(got, F.lit(0)) < F.floor(want * 0.9))
    shown = lambda c: none if c is None else c
    second = F.lit(False) if better is None or variant is None else better & variant.isin("current-src", "legacy-url")
    rules = [
        (url.rlike(THUMBNAIL_URL), "url_has_thumbnail_or_transform_marker"), (small(width, shown(display_width)), "downloaded_width_smaller_than_display_width"), (small(height, shown(display_height)), "downloaded_height_smaller_than_display_height"),
        (small(width, declared_width), "downloaded_width_smaller_than_declared_width"), (small(height, declared_height), "downloaded_height_smaller_than_declared_height"),
        (long < 720, "native_resolution_too_small_for_text_ocr"), ((F.coalesce(size, F.lit(0)) < 30000) & (long < 1000), "file_size_small_for_text_image"), (second, "higher_priority_candidate_available"),
    ]
    return F.concat_ws(";", *(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in rules))


def candidates(df: DataFrame, key: list[str], position: str, url: str, score: Column, order: list[str]) -> DataFrame:
    """Candidates of each position once a URL, numbered by score (``place``), with whether a better one exists."""
    once = df.withColumn("_s", score).groupBy(*key, position, url).agg(F.max(F.struct("_s", *order)).alias("_b")).select(*key, position, url, F.col("_b._s").alias("score"), *(F.col(f"_b.{c}").alias(c) for c in order))
    at = Window.partitionBy(*key, position).orderBy(F.desc("score"), *(F.desc(c) for c in order), url)
    return once.withColumn("place", F.row_number().over(at)).withColumn("better", F.max("score").over(Window.partitionBy(*key, position)) > F.col("score"))


def fallback(df: DataFrame, key: list[str], score: Column, good: Column, usable: Column, columns: list[str]) -> DataFrame:
    """Best good row, else the last usable one in score order, else the best row at all, with ``outcome``."""
    s = F.struct(score.alias("_s"), *columns)
    agg = df.groupBy(*key).agg(F.max(F.when(good, s)).alias("g"), F.min(F.when(usable & ~good, s)).alias("u"), F.max(s).alias("a"))
    chosen = F.coalesce("g", "u", "a")
    outcome = F.when(F.col("g").isNotNull(), "selected").when(F.col("u").isNotNull(), "fallback").otherwise("failed")
    return agg.select(*key, outcome.alias("outcome"), *(chosen.getField(c).alias(c) for c in columns))


def sample_by_tags(df: DataFrame, key: str, tags: str, wanted: list[str], limit: int) -> DataFrame:
    """A report of ``limit`` rows: one unused row for each wanted tag in order, then the least keys."""
    chosen = None
    for i, tag in enumerate(wanted):
        pool = df.where(F.array_contains(tags, tag))
        if chosen is not None:
            pool = pool.join(chosen.select(key), key, "left_anti")
        one = pool.orderBy(key).limit(1).select(key, F.lit(i).alias("_o"))
        chosen = one if chosen is None else chosen.unionByName(one)
    rest = df.join(chosen.select(key), key, "left_anti").orderBy(key).limit(limit).select(key, F.lit(len(wanted)).alias("_o"))
    return chosen.unionByName(rest).orderBy("_o", key).limit(limit).drop("_o").join(df, key)
