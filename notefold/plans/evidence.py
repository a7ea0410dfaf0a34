"""Queries that compare OCR readings, parse captured documents, and window events."""

from __future__ import annotations

from pyspark.sql import functions as F

from notefold.functions import compare as C
from notefold.functions import text as X
from notefold.operators import compare, extract
from notefold.sources.tables import table
from notefold.streaming import events as E


def engine_pairs(s, d):
    return compare.engine_pairs(table(s, d, "ocr_results"), columns=["text"])


def text_compare(s, d):
    return compare.compared(compare.page_against_blocks(table(s, d, "ocr_results")))


def block_match(s, d):
    return compare.block_matches(compare.page_against_blocks(table(s, d, "ocr_results")))


def reading_order(s, d):
    return compare.inversions(block_match(s, d))


def ocr_metrics(s, d):
    """Error rates of the blocks' text against the page text."""
    rates = compare.error_rates(compare.page_against_blocks(table(s, d, "ocr_results")))
    return rates.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("cer", "missing", "order", "numbers", "terms")), F.count("*").alias("pages"), F.count_if("auto_pass").alias("auto_pass"))


def order_conflicts(s, d):
    """Pages whose blocks stand in another order than their lines."""
    return compare.order_conflicts(compare.page_against_blocks(table(s, d, "ocr_results")))


def block_differences(s, d):
    """Where the blocks of a page and its lines, taken as blocks, differ."""
    p = compare.page_against_blocks(table(s, d, "ocr_results"))
    lines = F.transform(F.split("left_text", "\n"), lambda x: F.struct(x.alias("text"), F.lit(None).cast("array<double>").alias("box")))
    return compare.block_differences(p.withColumn("left_blocks", lines)).select("note_id", "image_index", "right_engine", "left_block", "right_block", "difference")


def critical_tokens(s, d):
    """Tokens that matter in each page, by category, in code point order."""
    o = table(s, d, "ocr_results").where(F.length("text") > 0).select("ocr_id", "text").distinct()
    return o.select("ocr_id", F.array_join(C.token_set(F.col("text")), "|").alias("tokens"))


def term_corrections(s, d):
    """Pages with variants of known terms: what was changed to what."""
    o = table(s, d, "ocr_results").where(F.length("text") > 0).select("ocr_id", "text").distinct()
    return o.select("ocr_id", F.explode(C.corrected(F.col("text"))["log"]).alias("c")).groupBy("ocr_id", "c.original", "c.corrected").agg(F.count("*").alias("n"))


def image_quality(s, d):
    """Reasons against each downloaded or failed image as a source of text."""
    i = table(s, d, "images").where(F.col("note_id").isNotNull() & F.col("position").isNotNull()).withColumn("present", F.col("local_path").isNotNull())
    return i.select("image_id", F.explode(compare.quality_reasons()).alias("reason")).distinct()


def _levels(s, d):
    i = table(s, d, "images").where(F.col("note_id").isNotNull() & F.col("position").isNotNull()).withColumn("present", F.col("local_path").isNotNull())
    images = i.groupBy("note_id", F.col("position").alias("image_index")).agg(F.bool_or(F.coalesce(F.col("ocr_status").isin("failed", "needs_review", "vl_pending"), F.lit(False))).alias("previous")).withColumns({"manual_status": F.lit(None).cast("string"), "manual_required": F.lit(None).cast("string")})
    poor = i.select("note_id", F.col("position").alias("image_index"), F.explode(compare.quality_reasons()).alias("r")).select("note_id", "image_index", F.lit("image_quality_risk").alias("reason"))
    found = compare.block_differences(compare.engine_pairs(table(s, d, "ocr_results"))).select("note_id", "image_index", F.col("difference").alias("reason"))
    turned = compare.order_conflicts(compare.engine_pairs(table(s, d, "ocr_results"))).select("note_id", "image_index", F.lit("reading_order_conflict").alias("reason"))
    apart = compare.three_way(table(s, d, "ocr_results")).select("note_id", "image_index", F.lit("three_way_conflict").alias("reason"))
    return compare.review_levels(images, poor.unionByName(found).unionByName(turned).unionByName(apart))


def review_levels(s, d):
    """What a person has to look at, image by image: quality of the image and, where engines read it twice, their differences."""
    return _levels(s, d).select("note_id", "image_index", "level", "human_required", "previous", "regions")


def review_summary(s, d):
    return compare.review_summary(_levels(s, d))


def review_text(s, d):
    """Note titles without markup, signs, width or case, and as file names."""
    n = table(s, d, "notes").where(F.col("title").isNotNull()).select("note_id", "title").distinct()
    return n.select("note_id", C.review_norm(F.col("title")).alias("norm"), C.safe_filename(F.col("title")).alias("file_name"))


def _pages(s, d):
    """Note rows as captured pages; the tables hold no HTML snapshots.

    Each page links to its own note twice, to another note, to a foreign site and
    to a page that is no note.
    """
    n = table(s, d, "notes").where(F.col("url").isNotNull()).select("note_id", "url", "title", "author_name", "body_text").distinct()
    state = F.to_json(F.struct(F.struct(F.col("author_name").alias("name")).alias("author")))
    path = F.regexp_replace("url", r"^[a-z]+://[^/]+", "")
    links = F.concat_ws("", F.lit("<a href='"), path, F.lit("'>x</a><a href='https://www.rednote.example/explore/"), F.reverse("note_id"), F.lit("'>y</a><a href='"), path, F.lit("'>x</a><a href='https://elsewhere.example/explore/"), F.reverse("note_id"), F.lit("'>z</a><a href='/about'>w</a>"))
    body = F.regexp_replace(F.regexp_replace(F.coalesce("body_text", F.lit("")), "&", "&amp;"), "<", "&lt;")
    return n.select("note_id", "url", F.concat_ws("", F.lit("<html><head><title>"), F.col("title"), F.lit("</title><script type='application/ld+json'>"), state, F.lit("</script></head><body><article>"), links, F.lit("<p>"), body, F.lit("</p></article></body></html>")).alias("html"))


def page_parse(s, d):
    return extract.parse_notes(_pages(s, d), "note_id", "html").select("note_id", "title", "author", "published", F.length("body").alias("chars"), F.size("tags").alias("tags"))


def page_links(s, d):
    return extract.page_links(_pages(s, d).select(F.col("note_id").alias("page"), "html", "url"), "page", "html", "url", "rednote.example")


def json_refs(s, d):
    """References of nested documents: a card, a bare id beside a title, a URL; one to be passed over, and page marks of two depths."""
    n = table(s, d, "notes").where(F.col("note_id").isNotNull()).groupBy("note_id").agg(F.max(F.coalesce("retry_count", F.lit(0))).alias("r"))
    more = F.when(F.col("r") == 0, F.lit(True)).when(F.col("r") == 1, F.lit(False))
    doc = F.struct(
        F.struct(F.lit("boardboardboard").alias("id"), F.concat(F.lit("c"), F.col("r")).alias("cursor"), more.alias("hasMore"), F.lit("boardboardboard").alias("noteId")).alias("board"),
        F.array(F.to_json(F.struct(F.lit(1)))).alias("trace"),
        F.struct(
            F.lit("top").alias("lastCursor"),
            F.struct(F.col("note_id").alias("noteId"), F.lit("短").alias("displayTitle")).alias("noteCard"),
            F.struct(F.reverse("note_id").alias("id"), F.lit("t").alias("displayTitle")).alias("second"),
            F.struct(F.concat(F.lit("https://www.rednote.example/explore/"), F.substring(F.md5("note_id"), 1, 24), F.lit("?x=1")).alias("link"), F.col("note_id").alias("id")).alias("third"),
        ).alias("items"),
    )
    return extract.json_refs(n.select(F.col("note_id").alias("k"), F.to_json(doc).alias("doc")), "k", "doc", F.lit("boardboardboard"))


def json_state(s, d):
    i = table(s, d, "images").where(F.col("source_url").isNotNull()).select("image_id", "source_url", "source_variant").distinct()
    doc = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.col("source_variant").alias("imageScene"), F.col("source_url").alias("url"))).alias("infoList"))).alias("imageList")))
    return extract.state_images(i.select("image_id", doc.alias("doc")), "image_id", "doc")


def events_window(s, d):
    return E.windows(table(s, d, "events"), "ts", ["event_type"]).select(F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "event_type", "n")


def events_session(s, d):
    return E.sessions(table(s, d, "events"), "ts", "user_id").select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


def snapshot_dedupe(s, d):
    return E.first_seen(table(s, d, "stage_events").select("event_id", "note_id", "stage", "created_at"), "created_at", ["note_id", "stage"]).select("note_id", "stage")


QUERIES = {f.__name__: f for f in (engine_pairs, text_compare, block_match, reading_order, order_conflicts, block_differences, ocr_metrics, critical_tokens, term_corrections, image_quality, review_levels, review_summary, review_text, page_parse, page_links, json_refs, json_state, events_window, events_session, snapshot_dedupe)}
_READ = """(SELECT note_id, image_index, engine, arg_min(text, ocr_id) AS text FROM (SELECT note_id, image_index, engine, ocr_id, coalesce(text, chr(0)) AS text FROM ocr_results WHERE status IN ('success', 'needs_review')) GROUP BY ALL)"""
SQL = {
    "engine_pairs": f"""SELECT l.note_id, l.image_index, l.engine AS left_engine, r.engine AS right_engine, nullif(l.text, chr(0)) AS left_text, nullif(r.text, chr(0)) AS right_text FROM {_READ} l JOIN {_READ} r USING (note_id, image_index) WHERE (l.engine, r.engine) IN (('ppocr', 'apple_vision'), ('ppocr', 'paddleocr_vl'), ('apple_vision', 'paddleocr_vl'))""",
    "page_links": """WITH p AS (SELECT DISTINCT note_id, url, regexp_extract(url, '/(?:explore|discovery/item)/([0-9A-Za-z_-]{8,80})', 1) AS own FROM notes WHERE url IS NOT NULL),
o AS (SELECT note_id AS page, CAST(1 AS INTEGER) AS ord, own AS note_id, url FROM p WHERE own <> '')
SELECT * FROM o UNION ALL SELECT note_id AS page, CAST(CASE WHEN own <> '' THEN 2 ELSE 1 END AS INTEGER) AS ord, reverse(note_id) AS note_id, 'https://www.rednote.example/explore/' || reverse(note_id) AS url FROM p WHERE note_id IS NOT NULL AND reverse(note_id) <> own""",
    "json_refs": """WITH n AS (SELECT note_id, max(coalesce(retry_count, 0)) AS r FROM notes WHERE note_id IS NOT NULL GROUP BY note_id),
r AS (SELECT note_id AS k, note_id, 1 AS o, r FROM n UNION ALL SELECT note_id, reverse(note_id), 2, r FROM n UNION ALL SELECT note_id, substr(md5(note_id), 1, 24), 3, r FROM n),
f AS (SELECT k, note_id, min(o) AS o, any_value(r) AS r FROM r GROUP BY k, note_id)
SELECT k, note_id, 'top' AS cursor, CAST(row_number() OVER (PARTITION BY k ORDER BY o) AS INTEGER) AS sequence, CASE r WHEN 0 THEN true WHEN 1 THEN false END AS has_more, 'c' || r AS next_cursor FROM f""",
    "image_quality": """WITH i AS (SELECT image_id, download_status, local_path, coalesce(nullif(downloaded_width, 0), nullif(declared_width, 0), 0) AS w, coalesce(nullif(downloaded_height, 0), nullif(declared_height, 0), 0) AS h, coalesce(is_probable_thumbnail, 0) AS thumb, coalesce(thumbnail_reason, '') AS why FROM images WHERE note_id IS NOT NULL AND position IS NOT NULL)
SELECT DISTINCT image_id, reason FROM (
SELECT image_id, 'image_download_not_success' AS reason FROM i WHERE coalesce(download_status, '') <> 'success'
UNION ALL SELECT image_id, 'image_file_missing' FROM i WHERE local_path IS NULL
UNION ALL SELECT image_id, 'download_resolution_below_review_threshold' FROM i WHERE w > 0 AND h > 0 AND (greatest(w, h) < 1000 OR least(w, h) < 300)
UNION ALL SELECT image_id, why FROM i WHERE thumb <> 0 AND (contains(why, 'native_resolution_too_small_for_text_ocr') OR contains(why, 'file_size_small_for_text_image') OR contains(why, 'higher_priority_candidate_available')))""",
    "json_state": "SELECT image_id, CAST(1 AS INTEGER) AS position, regexp_replace(source_url, '^http://', 'https://') AS url, CASE source_variant WHEN 'structured-original' THEN 120 WHEN 'WB_ORI' THEN 115 WHEN 'structured-url' THEN 105 WHEN 'WB_DFT' THEN 100 WHEN 'structured-default' THEN 95 WHEN 'H5_DTL' THEN 60 WHEN 'WB_PRV' THEN 55 WHEN 'structured-preview' THEN 45 WHEN 'CRD_WM_WEBP' THEN 40 ELSE 60 END AS score FROM (SELECT DISTINCT image_id, source_url, source_variant FROM images WHERE source_url IS NOT NULL)",
    "events_window": "SELECT (epoch_us(ts) // 3600000000) * 3600000000 AS start_us, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "events_session": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n FROM i GROUP BY user_id, k""",
    "snapshot_dedupe": "SELECT DISTINCT note_id, stage FROM stage_events",
}
