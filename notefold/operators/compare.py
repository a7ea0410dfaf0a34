"""Readings of one image compared with one another, decided, and sorted by what a person has to look at."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notefold.functions import compare as C
from notefold.functions import sequence as S
from notefold.functions import text as X
from notefold.functions.arrow import flat_map_batches
from notefold.functions.joins import merge_join

#: Engine pairs that are compared, the first being the reference of the two.
PAIRS = [("ppocr", "apple_vision"), ("ppocr", "paddleocr_vl"), ("apple_vision", "paddleocr_vl")]
#: What a pair of readings is known by.
KEY = ["note_id", "image_index", "left_engine", "right_engine"]
BLOCKS = "array<struct<text:string,box:array<double>>>"
#: Reasons for a person to look, gravest first, and what a manual decision is called.
LEVELS = ["sentence_or_line_missing", "critical_token_conflict", "reading_order_conflict", "three_way_conflict", "image_quality_risk"]
CLEARING = ["accepted", "corrected", "cleared", "discarded", "discarded_by_user"]
DISCARDING = ["discarded", "discarded_by_user"]
#: Thumbnail reasons that speak against the image as a source of text.
SEVERE = ["native_resolution_too_small_for_text_ocr", "file_size_small_for_text_image", "higher_priority_candidate_available"]


def readings(results: DataFrame, columns: list[str]) -> DataFrame:
    """One successful reading of an image by an engine; several count by the least ``ocr_id``."""
    good = results.where(F.col("status").isin("success", "needs_review"))
    return good.groupBy("note_id", "image_index", "engine").agg(F.min_by(F.struct("ocr_id", *columns), "ocr_id").alias("r"))


def engine_pairs(results: DataFrame, pairs: list[tuple[str, str]] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Readings of the same image by two engines, side by side: left_*, right_*."""
    columns = columns or ["text", "blocks"]
    wanted = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs or PAIRS))
    sides = readings(results, columns).select("note_id", "image_index", "engine", "r", F.explode(wanted).alias("pair")).where((F.col("engine") == F.col("pair.a")) | (F.col("engine") == F.col("pair.b")))
    both = sides.groupBy("note_id", "image_index", "pair").agg(F.max(F.when(F.col("engine") == F.col("pair.a"), F.col("r"))).alias("l"), F.max(F.when(F.col("engine") == F.col("pair.b"), F.col("r"))).alias("r"))
    return both.where(F.col("l").isNotNull() & F.col("r").isNotNull()).select("note_id", "image_index", F.col("pair.a").alias("left_engine"), F.col("pair.b").alias("right_engine"), *(F.col(f"l.{c}").alias(f"left_{c}") for c in columns), *(F.col(f"r.{c}").alias(f"right_{c}") for c in columns))


def page_against_blocks(results: DataFrame) -> DataFrame:
    """Each page's text beside the text of its blocks, as two readings of one image; ``right_engine`` names the row."""
    text = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    placed = F.array_sort(F.transform("blocks", lambda b: F.struct(F.get(b["box"], F.lit(1)).alias("y"), F.get(b["box"], F.lit(0)).alias("x"), b["text"].alias("text"), b["box"].alias("box"))))
    ordered = F.transform(placed, lambda b: F.struct(b["text"].alias("text"), b["box"].alias("box")))
    listed = F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["box"].alias("box")))
    return results.where(F.length("text") > 0).select("note_id", "image_index", F.lit("text").alias("left_engine"), F.concat(F.lit("blocks:"), F.col("ocr_id")).alias("right_engine"), F.col("text").alias("left_text"), text.alias("right_text"), listed.alias("left_blocks"), ordered.alias("right_blocks")).dropDuplicates(["right_engine"])


def compared(pairs: DataFrame) -> DataFrame:
    """Agreement, lengths, whether numbers, dates and terms agree, and the class of the difference."""
    sides = pairs.select(*KEY, "left_text", "right_text", X.normalize_signs(F.coalesce("left_text", F.lit(""))).alias("a"), X.normalize_signs(F.coalesce("right_text", F.lit(""))).alias("b"), C.review_norm(F.col("left_text")).alias("na"), C.review_norm(F.col("right_text")).alias("nb"), C.token_set(F.col("left_text")).alias("ta"), C.token_set(F.col("right_text")).alias("tb"))
    aligned = sides.withColumns({"m": S.alignment(F.col("a"), F.col("b"))["matched"], "mn": S.alignment(F.col("na"), F.col("nb"))["matched"], "edits": S.alignment(F.coalesce("left_text", F.lit("")), F.coalesce("right_text", F.lit("")))["changed"]})
    a, b = F.col("a"), F.col("b")
    kind = C.difference(F.col("na"), F.col("nb"), F.col("ta"), F.col("tb"), F.col("edits"), F.col("mn"))
    return aligned.select(
        *KEY, S.likeness(F.col("m"), a, b).alias("agreement"), S.exclusive(F.col("m"), a, b).alias("exclusive_chars"), (X.numbers(a) == X.numbers(b)).alias("numbers_equal"), (X.dates(a) == X.dates(b)).alias("dates_equal"), (X.terms(a) == X.terms(b)).alias("terms_equal"),
        F.length(a).alias("left_length"), F.length(b).alias("right_length"), F.when(F.coalesce("left_text", F.lit("")) != F.coalesce("right_text", F.lit("")), kind).alias("difference"),
    )


def adjudicate(primary: Column, secondary: Column, third: Column, agreement: Column, tokens_equal: Column, least: float = 0.97) -> Column:
    """Struct (text, source, reason, needs_human) of up to three readings; null is a reading that failed.

    Two equal readings stand, the first pair in order; where the tokens of two differ
    and there is no third, neither stands; else the first at good agreement, or what
    there is, for a person to look at.
    """
    made = lambda text, source, reason, human: F.struct(text.alias("text"), F.lit(source).alias("source"), F.lit(reason).alias("reason"), F.lit(human).alias("needs_human"))
    return (
        F.when(primary == secondary, made(primary, "agree", "equal", False)).when(primary == third, made(primary, "ppocr", "equal-to-third", False)).when(secondary == third, made(secondary, "apple_vision", "equal-to-third", False))
        .when(primary.isNotNull() & secondary.isNotNull() & third.isNull() & ~tokens_equal, made(primary, "uncertain", "tokens-differ", True)).when(primary.isNotNull() & (agreement >= least), made(primary, "ppocr", "agreement", False))
        .when(primary.isNotNull() & secondary.isNull(), made(primary, "ppocr", "secondary-unavailable", True)).when(secondary.isNotNull(), made(secondary, "apple_vision", "primary-unavailable", True)).otherwise(made(F.lit(None).cast("string"), "uncertain", "no-reading", True))
    )


# ---- blocks and lines -----------------------------------------------------


def block_rows(pairs: DataFrame) -> DataFrame:
    """(key, side, ord, text, norm, box) of the blocks of both readings; a box that is not four numbers is none."""
    sides = pairs.select(*KEY, F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.coalesce(F.transform(f"{s}_blocks", lambda b: F.struct(b["text"].alias("text"), b["box"].alias("box"))), F.array().cast(BLOCKS)).alias("blocks")) for s in ("left", "right")))).alias("s"))
    rows = sides.select(*KEY, F.col("s.side").alias("side"), F.posexplode("s.blocks").alias("ord", "b"))
    return rows.select(*KEY, "side", "ord", F.coalesce("b.text", F.lit("")).alias("text"), C.review_norm(F.col("b.text")).alias("norm"), F.when(F.size("b.box") == 4, F.col("b.box")).alias("box"))


def line_rows(pairs: DataFrame, least: int = 3) -> DataFrame:
    """The same of the lines of both texts, without places; lines of fewer than ``least`` characters are left out."""
    sides = pairs.select(*KEY, F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.coalesce(f"{s}_text", F.lit("")).alias("t")) for s in ("left", "right")))).alias("s"))
    rows = sides.select(*KEY, F.col("s.side").alias("side"), F.posexplode(F.split("s.t", "\n")).alias("ord", "text")).withColumn("norm", C.review_norm(F.col("text")))
    return rows.where(F.length("norm") >= least).withColumn("box", F.lit(None).cast("array<double>"))


def _geometry(left: list, right: list) -> np.ndarray:
    """How well each left place fits each right one; NaN where a side has no place."""
    fit = np.full((len(left), len(right)), np.nan)
    a, b = [i for i, x in enumerate(left) if x is not None], [j for j, y in enumerate(right) if y is not None]
    if a and b:
        x, y = np.array([left[i] for i in a], float)[:, None, :], np.array([right[j] for j in b], float)[None, :, :]
        wide, high = (np.clip(np.minimum(x[..., k + 2], y[..., k + 2]) - np.maximum(x[..., k], y[..., k]), 0, None) for k in (0, 1))
        hx, hy = (np.maximum(z[..., 3] - z[..., 1], 1.0) for z in (x, y))
        area = (x[..., 2] - x[..., 0]) * hx + (y[..., 2] - y[..., 0]) * hy - wide * high
        iou = np.divide(wide * high, area, out=np.zeros_like(area), where=area > 0)
        apart = np.abs(x[..., 1] + x[..., 3] - y[..., 1] - y[..., 3]) / 2 / np.maximum(hx, hy)
        fit[np.ix_(a, b)] = np.maximum(2 * iou, high / np.minimum(hx, hy) - np.minimum(0.15 * apart, 0.4))
    return fit


def _paired(left: list, right: list, least: float) -> list[tuple[int, int, float]]:
    """Each left item in reading order takes the free right item of greatest score, if that is ``least`` or more."""
    fit = _geometry([x[2] for x in left], [y[2] for y in right])
    matcher, out, free = SequenceMatcher(), [], set(range(len(right)))
    score = lambda alike, place: alike if np.isnan(place) else max(0.6 * alike, place) + (0.25 if alike >= 0.85 else 0.0)
    for i in sorted(range(len(left)), key=lambda i: ((left[i][2] or [0, 0])[1], (left[i][2] or [0, 0])[0], left[i][1])):
        matcher.set_seq1(left[i][1])
        top, at = 0.0, None
        for j in sorted(free):
            matcher.set_seq2(right[j][1])
            if score(matcher.real_quick_ratio(), fit[i, j]) <= top or score(matcher.quick_ratio(), fit[i, j]) <= top:
                continue
            s = score(matcher.ratio(), fit[i, j])
            if s > top:
                top, at = s, j
        if at is not None and top >= least:
            free.discard(at)
            out.append((left[i][0], right[at][0], float(top)))
    return out


def matches(rows: DataFrame, least: float = 0.45) -> DataFrame:
    """(key, left_block, right_block, score) of one-to-one matches of the items of a pair of readings.

    Greedy consumption is sequential, so the items of one pair, a page, come together.
    """
    item = F.struct("ord", "norm", "box")
    pages = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.when(F.col("side") == "left", item))).alias("l"), F.array_sort(F.collect_list(F.when(F.col("side") == "right", item))).alias("r"))

    def run(*columns):
        for *key, left, right in zip(*columns):
            plain = lambda items: [(x["ord"], x["norm"], x["box"]) for x in items]
            for a, b, s in _paired(plain(left), plain(right), least):
                yield *key, a, b, s

    return flat_map_batches(pages.select(*KEY, "l", "r"), run, "note_id string, image_index int, left_engine string, right_engine string, left_block int, right_block int, score double")


def block_matches(pairs: DataFrame) -> DataFrame:
    return matches(block_rows(pairs))


def inversions(matched: DataFrame) -> DataFrame:
    """Share of matched items that stand in the opposite order, for three matches or more.

    A page is cut into its pairs by its own right positions: for each item, how
    many earlier ones of the page lie behind it, counted in one sorted pass.
    """
    listed = matched.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("left_block", "right_block"))), lambda m: m["right_block"]).alias("at")).where(F.size("at") >= 3)

    def run(*columns):
        from bisect import bisect_right, insort

        for *key, at in zip(*columns):
            turned, before = 0, []
            for x in at:
                turned += len(before) - bisect_right(before, x)
                insort(before, x)
            yield *key, len(at), turned / (len(at) * (len(at) - 1) / 2)

    return flat_map_batches(listed.select(*KEY, "at"), run, "note_id string, image_index int, left_engine string, right_engine string, matched int, inversion_ratio double")


def order_conflicts(pairs: DataFrame, alike: float = 0.9, share: float = 0.25) -> DataFrame:
    """Pairs of readings whose lines, matched by text alone, stand in another order."""
    return inversions(matches(line_rows(pairs), alike)).where(F.col("inversion_ratio") >= share)


def block_differences(pairs: DataFrame) -> DataFrame:
    """(key, left_block, right_block, left_text, right_text, difference) of every place where two readings differ.

    Where both wholes have one normal form, the pair is one difference of format.
    Matched blocks differ by class; a block that only one reading has is format when
    the other's whole contains it, missing when it matters, else minor.
    """
    rows = block_rows(pairs)
    both = rows.groupBy(*KEY).agg(F.count_if(F.col("side") == "left").alias("nl"), F.count_if(F.col("side") == "right").alias("nr")).where((F.col("nl") > 0) & (F.col("nr") > 0)).select(*KEY)
    joined = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("ord", "norm")))), lambda x: x["norm"]), "")
    raw = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("ord", "text")))), lambda x: x["text"]), "\n")
    wholes = merge_join(rows, both, KEY, "left_semi").groupBy(*KEY).agg(joined("left").alias("wl"), joined("right").alias("wr"), raw("left").alias("rl"), raw("right").alias("rr"))
    same = wholes.where((F.col("wl") == F.col("wr")) & (F.col("rl") != F.col("rr"))).select(*KEY, F.lit(None).cast("int").alias("left_block"), F.lit(None).cast("int").alias("right_block"), F.lit("").alias("left_text"), F.lit("").alias("right_text"), F.lit(C.FORMAT).alias("difference"))
    open_ = wholes.where(F.col("wl") != F.col("wr")).select(*KEY, "wl", "wr")
    items = merge_join(rows, open_, KEY)
    found = matches(items.select(*KEY, "side", "ord", "norm", "box"))
    side = lambda s: items.where(F.col("side") == s).select(*KEY, F.col("ord").alias(f"{s}_block"), F.col("text").alias(f"{s}_text"), F.col("norm").alias(f"{s}_norm"))
    met = merge_join(merge_join(found, side("left"), [*KEY, "left_block"]), side("right"), [*KEY, "right_block"]).where(F.col("left_text") != F.col("right_text"))
    met = met.withColumns({"ta": C.token_set(F.col("left_text")), "tb": C.token_set(F.col("right_text")), "edits": S.alignment(F.col("left_text"), F.col("right_text"))["changed"], "m": S.alignment(F.col("left_norm"), F.col("right_norm"))["matched"]})
    classed = met.select(*KEY, "left_block", "right_block", "left_text", "right_text", C.difference(F.col("left_norm"), F.col("right_norm"), F.col("ta"), F.col("tb"), F.col("edits"), F.col("m")).alias("difference"))
    used = found.select(*KEY, F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("left_block").alias("ord")), F.struct(F.lit("right").alias("side"), F.col("right_block").alias("ord")))).alias("u")).select(*KEY, "u.*")
    alone = merge_join(items, used, [*KEY, "side", "ord"], "left_anti").where(F.length("norm") > 0)
    other = F.when(F.col("side") == "left", F.col("wr")).otherwise(F.col("wl"))
    kind = F.when(other.contains(F.col("norm")), C.FORMAT).when(C.grave_alone(F.col("text")), C.MISSING).otherwise(C.MINOR)
    at = lambda s, c, none: F.when(F.col("side") == s, F.col(c)).otherwise(none)
    left_over = alone.select(*KEY, at("left", "ord", F.lit(None)).alias("left_block"), at("right", "ord", F.lit(None)).alias("right_block"), at("left", "text", F.lit("")).alias("left_text"), at("right", "text", F.lit("")).alias("right_text"), kind.alias("difference"))
    return same.unionByName(classed).unionByName(left_over)


def three_way(results: DataFrame, alike: float = 0.92) -> DataFrame:
    """(note_id, image_index) of images that three engines or more read in three different ways, with other tokens or nothing alike."""
    one = readings(results, ["text"]).select("note_id", "image_index", "engine", F.coalesce("r.text", F.lit("")).alias("text")).withColumns({"norm": C.review_norm(F.col("text")), "tokens": C.token_set(F.col("text"))})
    many = one.groupBy("note_id", "image_index").agg(F.count("*").alias("n"), F.count_distinct("norm").alias("norms"), F.count_distinct("tokens").alias("sets"), F.array_sort(F.collect_list(F.struct("engine", "norm"))).alias("r")).where((F.col("n") >= 3) & (F.col("norms") >= 3))
    norm = lambda i: F.col("r")[i]["norm"]
    near = lambda i, j: S.likeness(S.alignment(norm(i), norm(j))["matched"], norm(i), norm(j))
    return many.where((F.col("sets") > 1) | (F.greatest(near(0, 1), near(0, 2), near(1, 2)) < alike)).select("note_id", "image_index")


def quality_reasons(side_long: int = 1000, side_short: int = 300) -> Column:
    """Reasons against an image as a source of text, in order; columns of an image row, ``present`` says whether its file is there."""
    wide, high = (F.coalesce(F.nullif(F.col(f"downloaded_{s}"), F.lit(0)), F.nullif(F.col(f"declared_{s}"), F.lit(0)), F.lit(0)) for s in ("width", "height"))
    small = (wide > 0) & (high > 0) & ((F.greatest(wide, high) < side_long) | (F.least(wide, high) < side_short))
    marked = F.coalesce(F.col("thumbnail_reason"), F.lit(""))
    severe = (F.coalesce("is_probable_thumbnail", F.lit(0)) != 0) & marked.rlike("|".join(SEVERE))
    return F.array_compact(F.array(F.when(F.coalesce("download_status", F.lit("")) != "success", "image_download_not_success"), F.when(~F.col("present"), "image_file_missing"), F.when(small, "download_resolution_below_review_threshold"), F.when(severe, marked)))


def manual_clears(status: Column, required: Column) -> Column:
    """Whether a manual decision clears a review: a clearing status that says no person is required any more."""
    return F.coalesce(status.isin(CLEARING) & F.lower(required.cast("string")).isin("false", "0"), F.lit(False))


def review_levels(images: DataFrame, reasons: DataFrame) -> DataFrame:
    """(note_id, image_index, level, reasons, human_required, previous, regions) of every image.

    ``images`` has note_id, image_index, previous (was to be reviewed), manual_status and
    manual_required; ``reasons`` has one row a finding with its ``reason``, one of
    LEVELS or a class of difference that needs nobody.
    """
    found = reasons.groupBy("note_id", "image_index").agg(F.collect_set("reason").alias("all"), F.count_if(F.col("reason").isin(LEVELS)).alias("regions"))
    joined = merge_join(images, found, ["note_id", "image_index"], "left")
    every = F.coalesce("all", F.array().cast("array<string>"))
    graded = F.filter(F.array(*map(F.lit, LEVELS)), lambda x: F.array_contains(every, x))
    cleared = manual_clears(F.col("manual_status"), F.col("manual_required"))
    discarded = cleared & F.col("manual_status").isin(DISCARDING)
    level = F.when(discarded, "discarded_by_user").when(cleared & (F.size(graded) > 0), "manual_accepted").when(F.size(graded) > 0, graded[0]).when(F.array_contains(every, C.MINOR), C.MINOR).when(F.array_contains(every, C.FORMAT), C.FORMAT).otherwise("auto_accepted")
    kept = F.when(cleared, F.array().cast("array<string>")).otherwise(graded)
    return joined.select("note_id", "image_index", level.alias("level"), kept.alias("reasons"), (F.size(kept) > 0).alias("human_required"), "previous", F.when(F.size(kept) > 0, F.coalesce("regions", F.lit(0))).otherwise(0).alias("regions"))


def review_summary(levels: DataFrame) -> DataFrame:
    """(metric, value): images by level and further reason, those for a person, and those cleared since."""
    names = ["auto_accepted", C.FORMAT, C.MINOR, "manual_accepted", "discarded_by_user", *LEVELS]
    one = levels.agg(
        F.count("*").alias("total_images"), F.count_if("previous").alias("previous_needs_review"), *(F.count_if((F.col("level") == n) | F.array_contains("reasons", n)).alias(n) for n in names),
        F.count_if("human_required").alias("human_review_required"), F.coalesce(F.sum(F.when(F.col("human_required"), F.greatest("regions", F.lit(1)))), F.lit(0)).alias("human_review_regions"), F.count_if(F.col("previous") & ~F.col("human_required")).alias("auto_cleared_from_previous_needs_review"),
    )
    return one.unpivot([], one.columns, "metric", "value")


# ---- rates against a truth ------------------------------------------------


def line_rates(pairs: DataFrame, least: float = 0.82) -> DataFrame:
    """(key, missing, order): of the left text's lines, how many the right neither contains nor resembles, and how many are not found or turned against the one before."""
    whole = X.compact(F.coalesce("right_text", F.lit("")))
    lines = pairs.select(*KEY, whole.alias("whole"), F.filter(F.transform(F.split(F.coalesce("right_text", F.lit("")), "\n"), X.compact), lambda x: x != "").alias("others"), F.posexplode(F.split(F.coalesce("left_text", F.lit("")), "\n")).alias("ord", "raw")).withColumn("line", X.compact(F.col("raw"))).where(F.col("line") != "")
    at = lines.withColumn("pos", F.nullif(F.instr("whole", F.col("line")), F.lit(0)))
    seen = at.withColumn("before", F.last("pos", ignorenulls=True).over(Window.partitionBy(*KEY).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)))
    unseen = F.when(F.col("pos").isNull(), F.col("line"))
    per = seen.withColumn("lost", F.col("pos").isNull() & (S.best_likeness(unseen, "others") < least)).groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if("lost").alias("lost"), F.count_if(F.col("pos").isNull() | (F.col("before") > F.col("pos"))).alias("turned"))
    return per.select(*KEY, (F.col("lost") / F.col("n")).alias("missing"), F.when(F.col("n") > 1, F.col("turned") / F.col("n")).otherwise(0.0).alias("order"))


def error_rates(pairs: DataFrame) -> DataFrame:
    """(key, cer, missing, order, numbers, terms, auto_pass) of each right reading against its left one."""
    own = pairs.select(*KEY, C.error_rate(F.col("left_text"), F.col("right_text")).alias("cer"), C.list_error_rate(X.numbers(F.col("left_text")), X.numbers(F.col("right_text"))).alias("numbers"), C.list_error_rate(X.terms(F.col("left_text")), X.terms(F.col("right_text"))).alias("terms"))
    both = merge_join(own, line_rates(pairs), KEY, "left").withColumns({"missing": F.coalesce("missing", F.lit(0.0)), "order": F.coalesce("order", F.lit(0.0))})
    zero = lambda c: F.coalesce(c, F.lit(0.0)) == 0
    return both.withColumn("auto_pass", (F.col("cer") <= 0.01) & zero("missing") & zero("order") & zero("numbers") & zero("terms"))
