"""Queries over the archive's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notefold.functions import text as X
from notefold.functions.joins import merge_join
from notefold.operators import catalog, integrity, rank, reconcile, runs, state
from notefold.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def latest_notes(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return state.latest(table(s, d, "notes").where(F.col("note_id").isNotNull()), ["note_id"], ["updated_at", "retry_count"], list(columns))


#: Latest version of each note in SQL: greatest (updated_at, retry_count, columns).
def _latest(*columns: str) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in ("updated_at", "retry_count", *columns))
    return f"(SELECT note_id, {', '.join(columns)} FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY {order}) AS rn FROM notes WHERE note_id IS NOT NULL) WHERE rn = 1)"


@query(f"""
WITH n AS {_latest('stage')}, i AS (SELECT images.*, n.stage FROM images JOIN n USING (note_id))
SELECT 'stage:' || coalesce(stage, '') AS metric, count(*) AS value FROM n GROUP BY stage
UNION ALL SELECT 'total_including_excluded', count(*) FROM n
UNION ALL SELECT 'total', count(*) FILTER (WHERE stage <> 'excluded') FROM n
UNION ALL SELECT 'excluded_notes', count(*) FILTER (WHERE stage = 'excluded') FROM n
UNION ALL SELECT 'images_total_including_excluded', count(*) FROM i
UNION ALL SELECT 'images_total', count(*) FILTER (WHERE stage <> 'excluded') FROM i
UNION ALL SELECT 'images_downloaded', count(*) FILTER (WHERE stage <> 'excluded' AND download_status = 'success') FROM i
UNION ALL SELECT 'ocr_success', count(*) FILTER (WHERE stage <> 'excluded' AND ocr_status = 'success') FROM i
UNION ALL SELECT 'needs_review', count(*) FILTER (WHERE stage <> 'excluded' AND ocr_status IN ('failed', 'needs_review', 'vl_pending')) FROM i
""")
def status_counts(s, d):
    return state.counts(latest_notes(s, d, "stage"), table(s, d, "images"))


@query(f"SELECT stage, count(*) AS n FROM {_latest('stage')} GROUP BY stage")
def stage_histogram(s, d):
    return latest_notes(s, d, "stage").groupBy("stage").agg(F.count("*").alias("n"))


ENGINES = ["ppocr", "apple_vision", "paddleocr_vl"]
_FLAGS = "(SELECT note_id, bool_or(engine = 'ppocr') AS ppocr, bool_or(engine = 'apple_vision') AS apple_vision, bool_or(engine = 'paddleocr_vl') AS paddleocr_vl FROM ocr_results GROUP BY note_id)"


def _flags(s, d):
    return reconcile.presence(table(s, d, "ocr_results"), ["note_id"], "engine", ENGINES)


@query(f"""WITH f AS {_FLAGS} SELECT 'ppocr' AS source, count(*) FILTER (WHERE ppocr) AS n FROM f UNION ALL SELECT 'apple_vision', count(*) FILTER (WHERE apple_vision) FROM f
UNION ALL SELECT 'paddleocr_vl', count(*) FILTER (WHERE paddleocr_vl) FROM f UNION ALL SELECT 'union', count(*) FROM f""")
def evidence_by_source(s, d):
    return reconcile.source_counts(_flags(s, d), ENGINES)


_PAIRS = [(a, b) for a in ENGINES for b in ENGINES if a != b]


@query(f"WITH f AS {_FLAGS} " + " UNION ALL ".join(f"SELECT '{a}_not_{b}' AS difference, note_id FROM f WHERE {a} AND NOT {b}" for a, b in _PAIRS))
def source_differences(s, d):
    return reconcile.differences(_flags(s, d), ["note_id"], _PAIRS)


@query("""SELECT note_id, image_index, engine, ocr_id FROM (SELECT *, row_number() OVER (PARTITION BY note_id, image_index ORDER BY
CASE engine WHEN 'ppocr' THEN 0 WHEN 'apple_vision' THEN 1 WHEN 'paddleocr_vl' THEN 2 ELSE 3 END, engine, ocr_id) AS rn FROM ocr_results) WHERE rn = 1""")
def union_refs(s, d):
    return reconcile.union_by_priority(table(s, d, "ocr_results"), ["note_id", "image_index"], "engine", ENGINES, ["ocr_id"])


#: Boards say whether more notes follow: fewer counted than expected, as many, or no answer.
_MORE = "CASE WHEN discovered_count < expected_count THEN true WHEN discovered_count = expected_count THEN false END"


@query(f"""WITH n AS {_latest('board_id', 'stage')}, f AS (SELECT board_id, count(*) AS found FROM n WHERE stage <> 'excluded' GROUP BY board_id), j AS (
SELECT b.board_id, b.expected_count AS expected, coalesce(found, 0) AS found, {_MORE} AS more FROM boards b LEFT JOIN f USING (board_id))
SELECT board_id, expected, found, more AS has_more, CASE WHEN expected > 0 THEN greatest(0, expected - found) END AS gap,
CASE WHEN expected IS NULL OR expected <= 0 THEN 'discovery_completed_without_expected_count' WHEN found >= expected THEN 'complete' WHEN more = false THEN 'sources_exhausted_but_count_mismatch' WHEN more THEN 'sources_not_exhausted_count_mismatch' ELSE 'count_mismatch_unresolved' END AS status FROM j""")
def discovery_report(s, d):
    found = latest_notes(s, d, "board_id", "stage").where(F.col("stage") != "excluded").groupBy("board_id").agg(F.count("*").alias("found"))
    more = F.when(F.col("discovered_count") < F.col("expected_count"), F.lit(True)).when(F.col("discovered_count") == F.col("expected_count"), F.lit(False))
    j = table(s, d, "boards").select("board_id", F.col("expected_count").alias("expected"), more.alias("has_more")).join(found, "board_id", "left").withColumn("found", F.coalesce("found", F.lit(0)).cast("bigint"))
    return j.select("board_id", "expected", "found", "has_more", reconcile.gap(F.col("expected"), F.col("found")).cast("bigint").alias("gap"), reconcile.count_status(F.col("expected"), F.col("found"), F.col("has_more")).alias("status"))


@query("""SELECT note_id, has_more FROM (SELECT note_id, CASE level WHEN 'info' THEN true WHEN 'warning' THEN false END AS has_more, row_number() OVER (PARTITION BY note_id ORDER BY created_at DESC, event_id DESC, level DESC) AS rn FROM stage_events WHERE note_id IS NOT NULL) WHERE rn = 1""")
def has_more_last(s, d):
    """The last answer of a note's responses to whether more follow, null where the last gives none."""
    e = table(s, d, "stage_events").where(F.col("note_id").isNotNull())
    says = F.when(F.col("m.level") == "info", F.lit(True)).when(F.col("m.level") == "warning", F.lit(False))
    return e.groupBy("note_id").agg(F.max(F.struct("created_at", "event_id", "level")).alias("m")).select("note_id", says.alias("has_more"))


#: Runs of a board are months; a stage stands for the source that saw the note.
_SOURCE = "CASE stage WHEN 'discovered' THEN 'network' WHEN 'fetching' THEN 'dom' WHEN 'fetched' THEN 'embedded_state' ELSE 'redbook' END"
_RUNS = f"""n AS {_latest('board_id')}, b AS (SELECT board_id, min(expected_count) AS e FROM boards GROUP BY board_id),
e AS (SELECT n.board_id AS grp, n.board_id || strftime(created_at, '-%Y-%m') AS run_id, strftime(created_at, '%Y-%m') AS started, {_SOURCE} AS source, note_id AS key, created_at, event_id, level FROM stage_events JOIN n USING (note_id) WHERE n.board_id IS NOT NULL AND stage IS NOT NULL AND created_at IS NOT NULL),
r AS (SELECT run_id, grp, started, CASE last WHEN 'info' THEN true WHEN 'warning' THEN false END AS has_more, e // 100 AS expected FROM (SELECT run_id, grp, started, arg_max(level, (created_at, event_id, level)) AS last FROM e WHERE level IS NOT NULL GROUP BY ALL) LEFT JOIN b ON b.board_id = grp),
c AS (SELECT run_id, count(DISTINCT key) FILTER (WHERE source = 'network') AS network_count, count(DISTINCT key) FILTER (WHERE source = 'dom') AS dom_count, count(DISTINCT key) FILTER (WHERE source = 'embedded_state') AS embedded_state_count, count(DISTINCT key) FILTER (WHERE source = 'redbook') AS redbook_count, count(DISTINCT key) AS union_count FROM e GROUP BY run_id),
w AS (SELECT f AS run_id, count(*) AS new_count FROM (SELECT grp, key, min(run_id) AS f FROM e GROUP BY grp, key) GROUP BY f),
report AS (SELECT r.run_id, grp, started, expected, has_more, coalesce(network_count, 0) AS network_count, coalesce(dom_count, 0) AS dom_count, coalesce(embedded_state_count, 0) AS embedded_state_count, coalesce(redbook_count, 0) AS redbook_count, coalesce(union_count, 0) AS union_count, coalesce(new_count, 0) AS new_count,
CASE WHEN expected > 0 THEN greatest(0, expected - coalesce(union_count, 0)) END AS gap, CASE WHEN expected IS NULL OR expected <= 0 THEN 'discovery_completed_without_expected_count' WHEN union_count >= expected THEN 'complete' WHEN has_more = false THEN 'sources_exhausted_but_count_mismatch' WHEN has_more THEN 'sources_not_exhausted_count_mismatch' ELSE 'count_mismatch_unresolved' END AS status,
coalesce(expected > 0 AND union_count < expected, false) AS possibly_incomplete, coalesce(expected > 0 AND union_count >= expected, false) AS complete FROM r LEFT JOIN c USING (run_id) LEFT JOIN w USING (run_id))"""


def _report(s, d):
    n = latest_notes(s, d, "board_id")
    source = F.when(F.col("stage") == "discovered", "network").when(F.col("stage") == "fetching", "dom").when(F.col("stage") == "fetched", "embedded_state").otherwise("redbook")
    month = F.date_format("created_at", "yyyy-MM")
    e = merge_join(table(s, d, "stage_events").where(F.col("stage").isNotNull() & F.col("created_at").isNotNull()), n.where(F.col("board_id").isNotNull()), "note_id")
    e = e.select(F.col("board_id").alias("grp"), F.concat_ws("-", "board_id", month).alias("run_id"), month.alias("started"), source.alias("source"), F.col("note_id").alias("key"), "created_at", "event_id", "level")
    expected = table(s, d, "boards").groupBy("board_id").agg(F.floor(F.min("expected_count") / 100).alias("expected"))
    last = e.where(F.col("level").isNotNull()).groupBy("run_id", "grp", "started").agg(F.max(F.struct("created_at", "event_id", "level")).alias("m"))
    has_more = F.when(F.col("m.level") == "info", F.lit(True)).when(F.col("m.level") == "warning", F.lit(False))
    made = last.join(expected.withColumnRenamed("board_id", "grp"), "grp", "left").select("run_id", "grp", "started", "expected", has_more.alias("has_more"))
    return runs.reports(made, e.select("run_id", "source", "key"))


@query(f"WITH {_RUNS} SELECT * FROM report")
def run_report(s, d):
    return _report(s, d)


@query(f"WITH {_RUNS} SELECT grp, arg_min(expected, n) AS confirmed FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY started DESC, run_id DESC) AS n FROM report) WHERE n <= 20 AND complete GROUP BY grp")
def confirmed_counts(s, d):
    return runs.confirmed_counts(_report(s, d))


@query(f"""WITH {_RUNS}, p AS (SELECT *, lag(run_id) OVER v AS previous_run, lag(expected) OVER v AS pe, lag(union_count) OVER v AS pu, lag(gap) OVER v AS pg FROM report WINDOW v AS (PARTITION BY grp ORDER BY started, run_id)),
q AS (SELECT *, coalesce(pe > 0 AND pg > 0 AND expected = union_count AND pu = union_count AND pe - expected = pg, false) AS resolved FROM p)
SELECT run_id, grp, started, previous_run, resolved, CASE WHEN resolved THEN pg END AS removed, CASE WHEN resolved AND status = 'complete' THEN 'complete_after_invalid_notes_cleanup' ELSE status END AS status FROM q""")
def run_resolution(s, d):
    return runs.resolved(_report(s, d))


_IMAGE_COLUMNS = list(state.IMAGE)


@query("""WITH i AS (SELECT *, row_number() OVER (PARTITION BY note_id, position ORDER BY image_id) AS a, row_number() OVER (PARTITION BY note_id, position ORDER BY image_id DESC) AS z FROM (SELECT DISTINCT * FROM images WHERE note_id IS NOT NULL AND position IS NOT NULL)),
b AS (SELECT * FROM i WHERE a = 1), p AS (SELECT * FROM i WHERE z = 1 AND a > 1) SELECT note_id, position, """ + ", ".join(f"CASE WHEN p.note_id IS NOT NULL THEN p.{c} ELSE b.{c} END AS {c}" if r == state.REPLACE else f"coalesce(p.{c}, b.{c}) AS {c}" for c, r in state.IMAGE.items()) + " FROM b LEFT JOIN p USING (note_id, position)")
def image_upsert(s, d):
    """The first image row of each position, updated by the last by the rules of its columns."""
    i = table(s, d, "images").where(F.col("note_id").isNotNull() & F.col("position").isNotNull())
    row = F.struct(*_IMAGE_COLUMNS)
    ends = i.groupBy("note_id", "position").agg(F.min_by(row, "image_id").alias("b"), F.max_by(row, "image_id").alias("p"), F.count_distinct("image_id").alias("n"))
    base, patch = ends.select("note_id", "position", "b.*"), ends.where(F.col("n") > 1).select("note_id", "position", "p.*")
    return state.merge(base, patch, ["note_id", "position"], state.IMAGE)


_LAST = """(SELECT note_id, stage, level FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY created_at DESC, event_id DESC, stage DESC, level DESC) AS rn FROM stage_events WHERE note_id IS NOT NULL) WHERE rn = 1)"""


@query(f"WITH l AS {_LAST}, c AS (SELECT note_id, count(*) AS events, count(*) FILTER (WHERE level = 'error') AS errors FROM stage_events WHERE note_id IS NOT NULL GROUP BY note_id) SELECT note_id, stage, level, events, errors FROM l JOIN c USING (note_id)")
def state_fold(s, d):
    return state.fold_events(table(s, d, "stage_events").select("note_id", "created_at", "event_id", "stage", "level"), "note_id", ["created_at", "event_id"])


@query(f"SELECT note_id, CASE stage WHEN 'fetching' THEN 'discovered' WHEN 'ocr_running' THEN 'fetched' ELSE stage END AS stage FROM {_LAST}")
def state_recovered(s, d):
    return state_fold(s, d).select("note_id", state.recover(F.col("stage")).alias("stage"))


_DAILY = "(SELECT stage, CAST(created_at AS DATE) AS day, count(DISTINCT note_id) AS n FROM stage_events WHERE stage IS NOT NULL GROUP BY ALL)"


def _daily(s, d):
    return table(s, d, "stage_events").where(F.col("stage").isNotNull()).groupBy("stage", F.to_date("created_at").alias("day")).agg(F.count_distinct("note_id").alias("n"))


@query(f"SELECT stage, CAST(day AS VARCHAR) AS day, n, lag(n) OVER (PARTITION BY stage ORDER BY day) AS previous, n - lag(n) OVER (PARTITION BY stage ORDER BY day) AS delta FROM {_DAILY}")
def run_delta(s, d):
    return reconcile.delta(_daily(s, d), ["stage"], "day", "n").withColumn("day", F.col("day").cast("string"))


@query(f"SELECT stage, CAST(day AS VARCHAR) AS day, n FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY day DESC) AS rn FROM {_DAILY}) WHERE rn = 1")
def latest_run(s, d):
    return _daily(s, d).groupBy("stage").agg(F.max(F.struct("day", "n")).alias("m")).select("stage", F.col("m.day").cast("string").alias("day"), "m.n")


@query("""WITH f AS (SELECT stage, note_id, min(CAST(created_at AS DATE)) AS day FROM stage_events WHERE stage IS NOT NULL AND note_id IS NOT NULL GROUP BY ALL),
r AS (SELECT DISTINCT stage, CAST(created_at AS DATE) AS day FROM stage_events WHERE stage IS NOT NULL AND note_id IS NOT NULL), c AS (SELECT stage, day, count(*) AS n FROM f GROUP BY ALL)
SELECT stage, CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS "new", CAST(sum(coalesce(n, 0)) OVER (PARTITION BY stage ORDER BY day) AS BIGINT) AS total FROM r LEFT JOIN c USING (stage, day)""")
def running_distinct(s, d):
    e = table(s, d, "stage_events").where(F.col("stage").isNotNull() & F.col("note_id").isNotNull()).select("stage", "note_id", F.to_date("created_at").alias("day"))
    return reconcile.running_distinct(e, ["stage"], "day", "note_id").withColumn("day", F.col("day").cast("string"))


@query("""WITH b AS (SELECT note_id, title, summary_title, retry_count FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY updated_at, retry_count, title DESC NULLS LAST, summary_title DESC NULLS LAST) AS rn FROM notes WHERE retry_count = 0 AND note_id IS NOT NULL) WHERE rn = 1),
p AS (SELECT note_id, title, summary_title, retry_count FROM (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY updated_at DESC, retry_count DESC, title DESC NULLS LAST, summary_title DESC NULLS LAST) AS rn FROM notes WHERE retry_count > 0 AND note_id IS NOT NULL) WHERE rn = 1)
SELECT note_id, coalesce(p.title, b.title) AS title, coalesce(b.summary_title, p.summary_title) AS summary_title, CASE WHEN p.note_id IS NOT NULL THEN p.retry_count ELSE b.retry_count END AS retry_count FROM b FULL JOIN p USING (note_id)""")
def upsert_merge(s, d):
    n = table(s, d, "notes").where(F.col("note_id").isNotNull()).select("note_id", "title", "summary_title", "retry_count", "updated_at")
    cols = ["title", "summary_title", "retry_count"]
    base = state.latest(n.where("retry_count = 0").withColumn("o", -F.unix_micros("updated_at")), ["note_id"], ["o"], cols)
    patch = state.latest(n.where("retry_count > 0").withColumnRenamed("retry_count", "r").withColumn("retry_count", F.col("r")), ["note_id"], ["updated_at", "r"], cols)
    return state.merge(base, patch, ["note_id"], {"title": state.FILL, "summary_title": state.KEEP, "retry_count": state.REPLACE})


_SCORE = "CASE source_variant WHEN 'structured-original' THEN 120 WHEN 'WB_ORI' THEN 115 WHEN 'structured-url' THEN 105 WHEN 'WB_DFT' THEN 100 WHEN 'structured-default' THEN 95 WHEN 'H5_DTL' THEN 60 WHEN 'WB_PRV' THEN 55 WHEN 'structured-preview' THEN 45 WHEN 'CRD_WM_WEBP' THEN 40 ELSE 60 END"


@query(f"SELECT note_id, position, image_id, source_variant FROM (SELECT *, row_number() OVER (PARTITION BY note_id, position ORDER BY {_SCORE} DESC, image_id DESC, source_variant DESC NULLS LAST) AS rn FROM images) WHERE rn = 1")
def best_candidate(s, d):
    return rank.best(table(s, d, "images"), ["note_id", "position"], [rank.variant_score(F.col("source_variant"))], ["image_id", "source_variant"])


_THUMB = "(regexp_matches(coalesce(source_url, ''), '(?i)(thumb|thumbnail|small|avatar|icon|resize|crop|quality|q_[0-9]+|w_[0-9]+|h_[0-9]+|/s[0-9]+|prv|preview|!.*prv)'))"
_REASONS = f"""concat_ws(';', CASE WHEN {_THUMB} THEN 'url_has_thumbnail_or_transform_marker' END,
CASE WHEN declared_width > 0 AND coalesce(downloaded_width, 0) < floor(declared_width * 0.9) THEN 'downloaded_width_smaller_than_declared_width' END,
CASE WHEN declared_height > 0 AND coalesce(downloaded_height, 0) < floor(declared_height * 0.9) THEN 'downloaded_height_smaller_than_declared_height' END,
CASE WHEN greatest(coalesce(downloaded_width, 0), coalesce(downloaded_height, 0)) < 720 THEN 'native_resolution_too_small_for_text_ocr' END,
CASE WHEN coalesce(file_size, 0) < 30000 AND greatest(coalesce(downloaded_width, 0), coalesce(downloaded_height, 0)) < 1000 THEN 'file_size_small_for_text_image' END)"""


def _reasons():
    return rank.thumbnail_reasons(*(F.col(c) for c in ("source_url", "downloaded_width", "downloaded_height", "declared_width", "declared_height", "file_size")))


@query(f"SELECT image_id, {_REASONS} AS reasons FROM images")
def thumbnail_reasons(s, d):
    return table(s, d, "images").select("image_id", _reasons().alias("reasons"))


@query(f"""WITH c AS (SELECT note_id, position, image_id, {_SCORE} AS score, download_status = 'success' AS ok, {_REASONS} = '' AS clean FROM images),
g AS (SELECT *, row_number() OVER (PARTITION BY note_id, position ORDER BY CASE WHEN ok AND clean THEN 0 WHEN ok THEN 1 ELSE 2 END,
CASE WHEN ok AND NOT clean THEN score ELSE -score END, CASE WHEN ok AND NOT clean THEN image_id ELSE -image_id END) AS rn FROM (SELECT note_id, position, image_id, score, coalesce(ok, false) AS ok, clean FROM c))
SELECT note_id, position, CASE WHEN ok AND clean THEN 'selected' WHEN ok THEN 'fallback' ELSE 'failed' END AS outcome, image_id FROM g WHERE rn = 1""")
def candidate_fallback(s, d):
    i = table(s, d, "images").withColumn("_ok", F.coalesce(F.col("download_status") == "success", F.lit(False))).withColumn("_clean", _reasons() == "")
    return rank.fallback(i, ["note_id", "position"], rank.variant_score(F.col("source_variant")), F.col("_ok") & F.col("_clean"), F.col("_ok"), ["image_id"])


@query("""SELECT DISTINCT url, coalesce(nullif(regexp_extract(url, '/(?:explore|discovery/item)/([0-9A-Za-z_-]{8,80})(?:[/?#]|$)', 1), '')) AS id,
'https://www.rednote.example/explore/' || nullif(regexp_extract(url, '/(?:explore|discovery/item)/([0-9A-Za-z_-]{8,80})(?:[/?#]|$)', 1), '') AS canonical, substring(sha256(trim(url)), 1, 16) AS hash FROM notes WHERE url IS NOT NULL""")
def note_id_extract(s, d):
    u = table(s, d, "notes").where(F.col("url").isNotNull()).select("url").distinct()
    return u.select("url", X.note_id(F.col("url")).alias("id"), X.canonical_url(F.col("url"), "https://www.rednote.example/explore/").alias("canonical"), X.board_id(F.col("url")).alias("hash"))


@query("SELECT DISTINCT url, nullif(regexp_extract(url, '/board/([^/?#]+)', 1), '') AS slug FROM boards")
def board_slug(s, d):
    return table(s, d, "boards").select("url", X.board_slug(F.col("url")).alias("slug")).distinct()


@query("SELECT event_id, 'https://a.example/x?k=' || user_id || '&sign=REDACTED&cursor=' || event_id || '&xsec_token=REDACTED#f' AS url FROM events")
def url_redact(s, d):
    made = F.concat(F.lit("https://a.example/x?k="), F.col("user_id"), F.lit("&sign="), F.col("event_id"), F.lit("&cursor="), F.col("event_id"), F.lit("&xsec_token=t"), F.col("user_id"), F.lit("#f"))
    return table(s, d, "events").select("event_id", X.redact_url(made).alias("url"))


@query(r"""WITH t AS (SELECT DISTINCT publish_time_raw AS raw, trim(publish_time_raw) AS x FROM notes WHERE publish_time_raw IS NOT NULL), w AS (SELECT raw, x,
regexp_extract(x, '^([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})日?$', 1) AS y, regexp_extract(x, '^([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})日?$', 2) AS m, regexp_extract(x, '^([0-9]{4})[-/.年]([0-9]{1,2})[-/.月]([0-9]{1,2})日?$', 3) AS dd,
regexp_extract(x, '(20[0-9]{2})[./年-]([0-9]{1,2})[./月-]([0-9]{1,2})', 1) AS y2, regexp_extract(x, '(20[0-9]{2})[./年-]([0-9]{1,2})[./月-]([0-9]{1,2})', 2) AS m2, regexp_extract(x, '(20[0-9]{2})[./年-]([0-9]{1,2})[./月-]([0-9]{1,2})', 3) AS d2 FROM t)
SELECT raw, coalesce(CASE WHEN y <> '' THEN CAST(TRY_CAST(y || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) AS VARCHAR) END, CASE WHEN y2 <> '' THEN y2 || '-' || lpad(m2, 2, '0') || '-' || lpad(d2, 2, '0') END) AS day FROM w""")
def publish_date(s, d):
    t = table(s, d, "notes").where(F.col("publish_time_raw").isNotNull()).select(F.col("publish_time_raw").alias("raw")).distinct()
    return t.select("raw", X.publish_date(F.col("raw")).alias("day"))


@query(r"""SELECT doc_id, array_to_string(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'), ',') AS numbers, array_to_string(regexp_extract_all(text, '(?:20|19)[0-9]{2}[./年-][0-9]{1,2}[./月-][0-9]{1,2}'), ',') AS dates FROM documents""")
def numbers_dates(s, d):
    return table(s, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.array_join(X.numbers(F.col("text")), ",")).alias("numbers"), F.when(F.col("text").isNotNull(), F.array_join(X.dates(F.col("text")), ",")).alias("dates"))


_TERMS = sorted(X.TERMS)


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{t.lower()}') THEN '{t}' END" for t in _TERMS) + ") AS terms FROM documents WHERE text IS NOT NULL")
def terms(s, d):
    return table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.array_join(X.terms(F.col("text")), ",").alias("terms"))


@query(r"SELECT doc_id, regexp_replace(translate(text, '，。：；（）？！｜—－', ',.:;()?!|--'), '[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+', '', 'g') AS norm FROM documents WHERE text IS NOT NULL")
def normalize_text(s, d):
    return table(s, d, "documents").where(F.col("text").isNotNull()).select("doc_id", X.normalize_signs(F.col("text")).alias("norm"))


@query(f"""WITH n AS {_latest('stage', 'title')}, o AS (SELECT note_id, string_agg(text, chr(10) ORDER BY image_index, ocr_id, text) AS ocr FROM (SELECT DISTINCT note_id, image_index, ocr_id, text FROM ocr_results WHERE length(text) > 0) GROUP BY note_id),
i AS (SELECT note_id, count(*) AS images, bool_and(coalesce(ocr_status = 'success', false)) AS all_ok, bool_or(coalesce(ocr_status IN ('failed', 'needs_review', 'vl_pending'), false)) AS review FROM images GROUP BY note_id)
SELECT note_id, stage, title, coalesce(images, 0) AS images, CASE WHEN coalesce(all_ok, false) THEN 'success' ELSE 'pending' END AS ocr_status, coalesce(review, false) AS review, length(o.ocr) AS ocr_chars, md5(o.ocr) AS ocr_md5
FROM n LEFT JOIN i USING (note_id) LEFT JOIN o USING (note_id) WHERE stage <> 'excluded'""")
def catalog_rows(s, d):
    ocr = table(s, d, "ocr_results").where(F.length("text") > 0).select("note_id", "image_index", "ocr_id", "text").distinct()
    o = catalog.ordered_text(ocr, "note_id", ["image_index", "ocr_id"], "text", "ocr")
    bad = F.coalesce(F.col("ocr_status").isin("failed", "needs_review", "vl_pending"), F.lit(False))
    i = table(s, d, "images").groupBy("note_id").agg(F.count("*").alias("images"), F.bool_and(F.coalesce(F.col("ocr_status") == "success", F.lit(False))).alias("ok"), F.bool_or(bad).alias("review"))
    n = latest_notes(s, d, "stage", "title").where(F.col("stage") != "excluded").join(i, "note_id", "left").join(o, "note_id", "left")
    return n.select("note_id", "stage", "title", F.coalesce("images", F.lit(0)).alias("images"), F.when(F.col("ok"), "success").otherwise("pending").alias("ocr_status"), F.coalesce("review", F.lit(False)).alias("review"), F.length("ocr").cast("bigint").alias("ocr_chars"), F.md5("ocr").alias("ocr_md5"))


@query("SELECT 'lang' AS facet, coalesce(nullif(lang, ''), '未分类') AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', coalesce(nullif(source, ''), '未分类'), count(*) FROM documents GROUP BY ALL")
def facet_index(s, d):
    return catalog.facets(table(s, d, "documents"), ["lang", "source"])


_TAGS = "CASE WHEN contains(lower(body_text), 'offer') OR contains(lower(body_text), 'oc') OR contains(body_text, '已录') THEN '疑似通过' WHEN contains(body_text, '挂') OR contains(body_text, '拒') OR contains(body_text, '凉') THEN '疑似未通过' ELSE '' END"


def _hint(names):
    return "coalesce(" + ", ".join(f"CASE WHEN contains(body_text, '{n}') THEN '{n}' END" for n in names) + ", '')"


@query(f"SELECT DISTINCT note_id, {_hint(X.COMPANIES)} AS company, {_hint(X.ROLES)} AS position, {_hint(X.ROUNDS)} AS round, {_TAGS} AS result FROM notes WHERE body_text IS NOT NULL")
def light_tags(s, d):
    return table(s, d, "notes").where(F.col("body_text").isNotNull()).select("note_id", catalog.light_tags(F.col("body_text")).alias("t")).select("note_id", "t.*").distinct()


@query(rf"""WITH n AS (SELECT DISTINCT note_id, title, body_text FROM notes), m AS (SELECT note_id, title, body_text, length(regexp_replace(coalesce(title, ''), '[^\p{{L}}\p{{N}}]|_', '', 'g')) >= 4 AS good,
array_to_string(list_filter([{", ".join(f"CASE WHEN contains(body_text, '{h}') THEN '{h}' END" for h in [*X.COMPANIES, *X.ROLES, *X.ROUNDS])}], lambda x: x IS NOT NULL)[1:4], '') AS hints,
list_filter(list_transform(regexp_split_to_array(coalesce(body_text, ''), '[\r\n]+'), lambda x: trim(x, chr(32) || chr(9) || chr(160) || chr(12288))), lambda x: length(regexp_replace(x, '[^\p{{L}}\p{{N}}]|_', '', 'g')) >= 4)[1] AS line FROM n)
SELECT note_id, substring(trim(CASE WHEN good THEN title WHEN hints <> '' THEN hints || '面经' WHEN line IS NOT NULL THEN line ELSE '无标题面经_' || substring(note_id, 1, 8) END, chr(32) || chr(9) || chr(160) || chr(12288)), 1, 30) AS summary FROM m""")
def summary_titles(s, d):
    return table(s, d, "notes").select("note_id", catalog.summary_title(F.col("title"), F.col("body_text"), F.col("note_id")).alias("summary")).distinct()


#: Fields of a note's head, in order.
HEAD = ["note_id", "canonical_url", "board_id", "title", "summary_title", "author_name", "author_display_id", "author_profile_id", "publish_time_raw", "publish_time_iso", "stage", "fetched_at", "updated_at"]
_QUOTED = lambda c: f"coalesce(CAST(to_json(CAST({c} AS VARCHAR)) AS VARCHAR), 'null')"
_HEAD_SQL = " || chr(10) || ".join(f"'{c}: ' || " + (_QUOTED(f"epoch_us({c})") if c.endswith("_at") else _QUOTED(c)) for c in HEAD)


@query(f"""WITH n AS {_latest(*(c for c in [*HEAD[1:], 'body_text'] if c != 'updated_at')).replace('SELECT note_id,', 'SELECT note_id, updated_at,', 1)}, o AS (SELECT note_id, string_agg(text, chr(10) ORDER BY image_index, ocr_id, text) AS ocr FROM (SELECT DISTINCT note_id, image_index, ocr_id, text FROM ocr_results WHERE length(text) > 0 AND note_id IS NOT NULL) GROUP BY note_id)
SELECT note_id, md5('---' || chr(10) || {_HEAD_SQL} || chr(10) || '---' || chr(10) || '# ' || coalesce(title, '') || chr(10) || coalesce(body_text, '') || coalesce(chr(10) || '## OCR' || chr(10) || ocr, '')) AS md5 FROM n LEFT JOIN o USING (note_id) WHERE stage <> 'excluded'""")
def note_markdown(s, d):
    """Each note as Markdown with its whole head; the digest of the text, for files are what it is for."""
    n = latest_notes(s, d, *(c for c in [*HEAD[1:], "body_text"] if c != "updated_at"), "updated_at").where(F.col("stage") != "excluded")
    texts = table(s, d, "ocr_results").where(F.col("note_id").isNotNull()).select("note_id", "image_index", "ocr_id", "text").distinct()
    o = catalog.ordered_text(texts, "note_id", ["image_index", "ocr_id"], "text", "ocr")
    fields = {c: F.unix_micros(c) if c.endswith("_at") else F.col(c) for c in HEAD}
    return merge_join(n, o, "note_id", "left").select("note_id", F.md5(catalog.markdown(F.col("title"), F.col("body_text"), F.col("ocr"), fields)).alias("md5"))


@query("SELECT DISTINCT image_id, note_id, position, ocr_status, round(ocr_confidence, 4) AS confidence FROM images WHERE ocr_status IN ('failed', 'needs_review', 'vl_pending')")
def review_queue(s, d):
    i = table(s, d, "images").where(F.col("ocr_status").isin("failed", "needs_review", "vl_pending"))
    return i.select("image_id", "note_id", "position", "ocr_status", F.round("ocr_confidence", 4).alias("confidence")).distinct()


@query("SELECT engine, count(mean_confidence) AS scored, round(avg(mean_confidence), 6) AS confidence, round(avg(elapsed_seconds), 6) AS seconds, count(*) FILTER (WHERE needs_review) AS review FROM ocr_results GROUP BY engine")
def bench_aggregate(s, d):
    return table(s, d, "ocr_results").groupBy("engine").agg(F.count("mean_confidence").alias("scored"), F.round(F.avg("mean_confidence"), 6).alias("confidence"), F.round(F.avg("elapsed_seconds"), 6).alias("seconds"), F.count_if("needs_review").alias("review"))


@query("""SELECT DISTINCT note_id, code FROM (
SELECT note_id, 'missing_canonical_url' AS code FROM notes WHERE coalesce(canonical_url, '') = ''
UNION ALL SELECT note_id, 'missing_output_dir' FROM notes WHERE coalesce(output_dir, '') = ''
UNION ALL SELECT note_id, 'missing_author_stable_id' FROM notes WHERE (coalesce(author_display_id, '') = '' OR author_display_id = author_name) AND (coalesce(author_profile_id, '') = '' OR author_profile_id = author_name)
UNION ALL SELECT note_id, 'weak_image_sha256' FROM images WHERE download_status = 'success' AND length(sha256) > 0 AND length(sha256) < 32
UNION ALL SELECT note_id, 'image_width_mismatch' FROM images WHERE download_status = 'success' AND downloaded_width <> declared_width
UNION ALL SELECT note_id, 'image_height_mismatch' FROM images WHERE download_status = 'success' AND downloaded_height <> declared_height
UNION ALL SELECT note_id, 'missing_image_file_size' FROM images WHERE download_status = 'success' AND coalesce(file_size, 0) = 0
UNION ALL SELECT note_id, 'thumbnail_suspected' FROM images WHERE coalesce(is_probable_thumbnail, 0) <> 0
UNION ALL SELECT note_id, 'image_without_note' FROM images WHERE note_id NOT IN (SELECT note_id FROM notes WHERE note_id IS NOT NULL)
UNION ALL SELECT note_id, 'event_without_note' FROM stage_events WHERE note_id NOT IN (SELECT note_id FROM notes WHERE note_id IS NOT NULL)) WHERE note_id IS NOT NULL""")
def integrity_issues(s, d):
    return integrity.archive_issues(table(s, d, "notes"), table(s, d, "images"), table(s, d, "stage_events"))


@query()
def eval_sample(s, d):
    """A report of 50 images for evaluation; the limit is the feature."""
    i = table(s, d, "images").where(F.col("download_status") == "success").select("image_id", "downloaded_width", "downloaded_height", "is_probable_thumbnail").distinct()
    w, h = F.col("downloaded_width"), F.col("downloaded_height")
    tags = F.array_compact(F.array(F.when(h / w >= 1.8, "long"), F.when(w / h >= 1.2, "wide"), F.when(F.col("is_probable_thumbnail") == 1, "thumbnail"), F.lit("ordinary_text")))
    return rank.sample_by_tags(i.withColumn("tags", tags), "image_id", "tags", ["long", "wide", "thumbnail"], 50).select("image_id", "tags")
