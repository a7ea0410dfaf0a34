import struct
import zlib

import pytest
from pyspark.sql import functions as F

from notefold.functions import compare as C
from notefold.functions import text as X
from notefold.operators import catalog, compare, extract, integrity, rank, reconcile, runs, state
from notefold.sources.images import header
from notefold.streaming import events


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,found", [("111111111111111111111111", "1" * 24), ("https://h.example/explore/abcdefgh12?x=1", "abcdefgh12"), ("/discovery/item/abcdefgh12", "abcdefgh12"), ("https://h.example/a?note_id=abcdefgh12", "abcdefgh12"), ("short", None), ("", None), (None, None)])
def test_note_id(spark, text, found):
    assert one(spark, text, X.note_id) == found


def test_scalars(spark):
    assert one(spark, "https://h/x?cursor=1&xsec_token=a&sign=b#f", X.redact_url) == "https://h/x?cursor=1&xsec_token=REDACTED&sign=REDACTED#f"
    assert one(spark, "https://h/x", X.redact_url) == "https://h/x"
    assert one(spark, "笔记・573", X.ui_count) == 573
    assert one(spark, "无", X.ui_count) is None
    assert [one(spark, d, X.publish_date) for d in ("2025/3/8", "2025年3月8日", "发布于2025-13-40", "2025-02-30", "无", None)] == ["2025-03-08", "2025-03-08", "2025-13-40", "2025-02-30", None, None]
    assert one(spark, "Ａ，b　c", X.normalize_signs) == "Ａ,bc"
    assert one(spark, "redis 与 MYSQL", X.terms) == ["MySQL", "Redis"]
    assert one(spark, "面经ab", X.meaningful) and not one(spark, "面经", X.meaningful) and not one(spark, None, X.meaningful)


def test_merge_is_idempotent_and_keeps_clashing_columns_apart(spark):
    base = spark.createDataFrame([("a", "t1", None, 1, "e"), ("b", "t2", "s2", 2, "e")], "k string, title string, summary string, n int, extra string")
    patch = spark.createDataFrame([("a", None, "s1", None, "z"), ("c", "t3", None, 3, "z")], "k string, title string, summary string, n int, extra string")
    rules = {"title": state.FILL, "summary": state.KEEP, "n": state.REPLACE}
    once = state.merge(base, patch, ["k"], rules)
    assert sorted(map(tuple, once.collect()), key=str) == [("a", "t1", "s1", None, "e"), ("b", "t2", "s2", 2, "e"), ("c", "t3", None, 3, None)]
    assert sorted(map(tuple, state.merge(once, patch, ["k"], rules).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_reconcile(spark):
    df = spark.createDataFrame([("a", "net"), ("a", "dom"), ("b", "dom"), ("b", "dom"), ("c", "net")], "id string, src string")
    flags = reconcile.presence(df, ["id"], "src", ["net", "dom", "state"])
    assert {(r[0], r[1]) for r in reconcile.differences(flags, ["id"], [("net", "dom"), ("dom", "net"), ("net", "state")]).collect()} == {("net_not_dom", "c"), ("dom_not_net", "b"), ("net_not_state", "a"), ("net_not_state", "c")}
    assert {r[0]: r[1] for r in reconcile.source_counts(flags, ["net", "dom", "state"]).collect()} == {"net": 2, "dom": 2, "state": 0, "union": 3}
    status = spark.createDataFrame([(3, 3, None), (0, 3, None), (5, 3, False), (5, 3, True), (5, 3, None), (None, 3, None)], "e int, f int, m boolean").select(reconcile.count_status(F.col("e"), F.col("f"), F.col("m")), reconcile.gap(F.col("e"), F.col("f"))).collect()
    assert [r[0] for r in status] == ["complete", "discovery_completed_without_expected_count", "sources_exhausted_but_count_mismatch", "sources_not_exhausted_count_mismatch", "count_mismatch_unresolved", "discovery_completed_without_expected_count"]
    assert [r[1] for r in status] == [0, None, 2, 2, 2, None]


def test_rank(spark):
    df = spark.createDataFrame([("n", 1, 10, "WB_PRV"), ("n", 1, 11, "WB_DFT"), ("n", 1, 12, "WB_DFT"), ("n", 2, 13, None)], "n string, p int, i int, v string")
    assert {tuple(r) for r in rank.best(df, ["n", "p"], [rank.variant_score(F.col("v"))], ["i"]).collect()} == {("n", 1, 12), ("n", 2, 13)}
    out = rank.fallback(df, ["n", "p"], rank.variant_score(F.col("v")), F.col("i") == 10, F.col("i") < 13, ["i"]).collect()
    assert {(r.p, r.outcome, r.i) for r in out} == {(1, "selected", 10), (2, "failed", 13)}


def test_catalog_and_integrity(spark):
    df = spark.createDataFrame([("n", 2, "b"), ("n", 1, "a"), ("n", 3, ""), ("n", 4, None)], "k string, i int, t string")
    assert catalog.ordered_text(df, "k", ["i"], "t", "all").first().all == "a\nb"
    assert {tuple(r) for r in catalog.facets(df, ["k", "t"]).collect()} == {("k", "n", 4), ("t", "a", 1), ("t", "b", 1), ("t", "未分类", 2)}
    notes = spark.createDataFrame([("n1", "u", "d", "a", "1", "2"), ("n2", None, "", "a", "a", None)], "note_id string, canonical_url string, output_dir string, author_name string, author_display_id string, author_profile_id string")
    images = spark.createDataFrame([("n1", "success", "ab", 10, 20, 10, 20, 5, 0), ("n3", "failed", None, None, None, None, None, None, None)], "note_id string, download_status string, sha256 string, declared_width int, declared_height int, downloaded_width int, downloaded_height int, file_size long, is_probable_thumbnail int")
    got = {tuple(r) for r in integrity.archive_issues(notes, images, notes.select("note_id")).collect()}
    assert got == {("n1", "weak_image_sha256"), ("n2", "missing_canonical_url"), ("n2", "missing_output_dir"), ("n2", "missing_author_stable_id"), ("n3", "image_without_note")}
    md = spark.createDataFrame([("t", "b", 'say "x"')], "t string, b string, a string").select(catalog.markdown(F.col("t"), F.col("b"), F.lit(None).cast("string"), {"author": F.col("a"), "none": F.lit(None)})).first()[0]
    assert md.startswith('---\nauthor: "say \\"x\\""\nnone: null\n---\n# t\nb')


def cells(spark, rows, schema, **columns):
    return [r.asDict() for r in spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in columns.items())).collect()]


def test_text_comparison(spark):
    pairs = spark.createDataFrame([("n", i, "l", "r", a, b) for i, (a, b) in enumerate([("Redis，RDB\n缓存", "redis, rdb 缓存"), ("2025年面试", "2026年面试"), ("a", "a"), (None, ""), ("一段普通的话说了很久", "一段普通的话说了很"), ("第一段讲了这些东西然后继续讲后面的东西", "第一段讲了"), ("techmysql好用", "sql好用")])], "note_id string, image_index int, left_engine string, right_engine string, left_text string, right_text string")
    got = {r.image_index: r.difference for r in compare.compared(pairs).collect()}
    assert [got[i] for i in range(6)] == ["formatting_only", "critical_token_conflict", None, None, "minor_noncritical", "sentence_or_line_missing"]
    rates = cells(spark, [("abcd", "abxd"), ("", ""), ("", "a"), (None, None)], "t string, r string", cer=C.error_rate(F.col("t"), F.col("r")))
    assert [r["cer"] for r in rates] == [0.25, 0.0, 1.0, 0.0]
    lists = cells(spark, [(["a", "b"], ["a"]), ([], ["a"]), (["a"], ["a"])], "t array<string>, r array<string>", e=C.list_error_rate(F.col("t"), F.col("r")))
    assert [r["e"] for r in lists] == [0.5, None, 0.0]
    assert cells(spark, [("1. 用 Redis 3.5万\n2024年\n10、不会",)], "t string", k=C.token_set(F.col("t")))[0]["k"] == ["amount35万", "date2024", "negation不", "number10", "number2024", "number35", "techredis"]
    done = cells(spark, [("htps 与 Mysq1，AI 和 Al", ), (None,)], "t string", c=C.corrected(F.col("t")))
    assert done[0]["c"].text == "HTTPS 与 MySQL，AI 和 AI" and [tuple(x) for x in done[0]["c"].log] == [("htps", "HTTPS"), ("Al", "AI"), ("Mysq1", "MySQL")] and done[1]["c"] is None
    assert [r["f"] for r in cells(spark, [(' a/b:c  d. ',), ("___",), (None,)], "t string", f=C.safe_filename(F.col("t")))] == ["a_b_c_d", "untitled", None]


SIDES = "note_id string, image_index int, left_engine string, right_engine string, left_text string, right_text string, left_blocks array<struct<text:string,box:array<double>>>, right_blocks array<struct<text:string,box:array<double>>>"


def test_block_matching_and_order(spark):
    first, second, third = (("第一行的内容", [0.0, 0.0, 10.0, 5.0]), ("第二行的内容", [0.0, 10.0, 10.0, 15.0]), ("第三行说的别的", [0.0, 20.0, 10.0, 25.0]))
    rows = [("n", 1, "a", "b", "第一行\n第二行\n第三行", "第三行\n第二行\n第一行", [first, second], [second, first]), ("n", 2, "a", "b", None, None, None, [first]), ("n", 3, "a", "b", "x", "x", [(first[0], None), third], [(first[0], None)])]
    pairs = spark.createDataFrame(rows, SIDES)
    assert {(r.image_index, r.left_block, r.right_block) for r in compare.block_matches(pairs).collect()} == {(1, 0, 1), (1, 1, 0), (3, 0, 0)}
    assert [(r.image_index, r.matched, r.inversion_ratio) for r in compare.order_conflicts(pairs).collect()] == [(1, 3, 1.0)]
    assert {(r.image_index, r.left_block, r.difference) for r in compare.block_differences(pairs).collect()} == {(3, 1, "minor_noncritical")}
    assert compare.block_differences(pairs.limit(0)).count() == 0 and compare.order_conflicts(pairs.limit(0)).count() == 0
    overlap = cells(spark, [([0.0, 0.0, 10.0, 10.0], [0.0, 5.0, 10.0, 15.0])], "a array<double>, b array<double>", o=C.overlap(F.col("a"), F.col("b")))[0]["o"]
    assert (round(overlap.iou, 3), overlap.vertical, overlap.distance) == (0.333, 0.5, 0.5)


def test_inversions(spark):
    m = spark.createDataFrame([("n", 1, "a", "b", i, j, 1.0) for i, j in ((0, 2), (1, 1), (2, 0), (3, 3))], "note_id string, image_index int, left_engine string, right_engine string, left_block int, right_block int, score double")
    r = compare.inversions(m).first()
    assert (r.matched, r.inversion_ratio) == (4, 0.5)


def test_rates_of_lines(spark):
    rows = [("n", 1, "a", "b", "甲行一二三\n乙行四五六\n丙行七八九", "乙行四五六\n甲行一二三\n丙行七八"), ("n", 2, "a", "b", "只有一行", "全然不同"), ("n", 3, "a", "b", None, None)]
    got = {r.image_index: r for r in compare.error_rates(spark.createDataFrame(rows, "note_id string, image_index int, left_engine string, right_engine string, left_text string, right_text string")).collect()}
    assert (got[1].missing, round(got[1].order, 3), got[2].missing, got[2].order, got[3].cer, got[3].auto_pass) == (0.0, 0.667, 1.0, 0.0, 0.0, True)


def test_review_levels(spark):
    images = spark.createDataFrame([("n", 1, True, None, None), ("n", 2, True, "accepted", "false"), ("n", 3, False, "discarded", "0"), ("n", 4, True, "accepted", "true"), ("n", 5, False, None, None), ("n", 6, True, None, None)], "note_id string, image_index int, previous boolean, manual_status string, manual_required string")
    reasons = spark.createDataFrame([("n", 1, "image_quality_risk"), ("n", 1, "critical_token_conflict"), ("n", 1, "critical_token_conflict"), ("n", 2, "reading_order_conflict"), ("n", 3, "image_quality_risk"), ("n", 4, "image_quality_risk"), ("n", 5, "minor_noncritical")], "note_id string, image_index int, reason string")
    levels = compare.review_levels(images, reasons)
    assert {r.image_index: (r.level, r.human_required, r.regions) for r in levels.collect()} == {1: ("critical_token_conflict", True, 3), 2: ("manual_accepted", False, 0), 3: ("discarded_by_user", False, 0), 4: ("image_quality_risk", True, 1), 5: ("minor_noncritical", False, 0), 6: ("auto_accepted", False, 0)}
    total = {r.metric: r.value for r in compare.review_summary(levels).collect()}
    assert (total["total_images"], total["previous_needs_review"], total["human_review_required"], total["human_review_regions"], total["image_quality_risk"], total["auto_cleared_from_previous_needs_review"]) == (6, 4, 2, 4, 2, 2)
    three = spark.createDataFrame([("n", 1, e, "success", str(i), t) for i, (e, t) in enumerate([("ppocr", "甲乙丙丁"), ("apple_vision", "子丑寅卯"), ("paddleocr_vl", "天地玄黄")])] + [("n", 2, e, "success", e, "同") for e in "abc"], "note_id string, image_index int, engine string, status string, ocr_id string, text string")
    assert [(r.note_id, r.image_index) for r in compare.three_way(three).collect()] == [("n", 1)]


PAGE = """<html><head><title>x - 站</title><meta property="og:title" content="示例复盘"/><script type="application/ld+json">{"author": {"name": "u", "identifier": "77"}, "datePublished": "2025-03-28", "image": ["https://i.example/notes/01.webp", "https://i.example/notes/02.webp"]}</script></head>
<body><article><p>正文 #面经 #后端</p><img src="//i.example/notes/01.webp"><a href="/explore/222222222222222222222222">n</a><a href="/explore/222222222222222222222222">n</a><a href="https://other.example/explore/333333333333333333333333">o</a></article></body>"""


def test_extraction(spark):
    df = spark.createDataFrame([("p", PAGE, "https://www.h.example/board/1"), ("q", "", None), ("r", None, None)], "id string, html string, base string")
    got = {r.id: r for r in extract.parse_notes(df, "id", "html").collect()}
    p = got["p"]
    assert (p.title, p.author, p.author_id, p.published, p.images, p.tags) == ("示例复盘", "u", "77", "2025-03-28", ["https://i.example/notes/01.webp", "https://i.example/notes/02.webp"], ["面经", "后端"])
    assert got["q"].title is None and got["r"].body is None
    assert [tuple(r) for r in extract.page_links(df, "id", "html", "base", "h.example").collect()] == [("p", 1, "2" * 24, "https://www.h.example/explore/" + "2" * 24)]
    docs = [("a", '{"data": {"board": {"id": "aaaaaaaaaaaaaaaaaaaaaaaa", "cursor": "c1", "has_more": false, "notes": [{"id": "bbbbbbbbbbbbbbbbbbbbbbbb", "display_title": "t"}, {"note_card": {"note_id": "cccccccccccccccccccccccc"}}, {"noteId": true}]}}}'), ("a", None), ("bad", "{bad"), ("list", '[["https://h.example/explore/dddddddddddddddddddddddd"], {"id": "eeeeeeeeeeee"}]'), (None, "{}")]
    refs = {(r.k, r.note_id, r.cursor, r.sequence, r.has_more, r.next_cursor) for r in extract.json_refs(spark.createDataFrame(docs, "k string, d string"), "k", "d", F.lit("a" * 24)).collect()}
    assert refs == {("a", "b" * 24, "c1", 1, False, "c1"), ("a", "c" * 24, "c1", 2, False, "c1"), ("list", "d" * 24, None, 1, None, None)}
    s = spark.createDataFrame([("k", '{"imageList": [{"infoList": [{"imageScene": "WB_PRV", "url": "http://a/1"}, {"imageScene": "WB_DFT", "url": "http://a/2"}]}]}'), ("bad", "{")], "k string, d string")
    assert [tuple(r) for r in extract.state_images(s, "k", "d").collect()] == [("k", 1, "https://a/2", 100)]


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 120, 80, 8, 2, 0, 0, 0) + struct.pack(">I", zlib.crc32(b""))
    assert header(png) == (120, 80, "png")
    assert header(b"GIF89a" + struct.pack("<HH", 7, 9)) == (7, 9, "gif")
    assert header(b"") == header(None) == header(b"\xff\xd8\xff") == header(b"text") == (None, None, None)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:10:00", "a" if i % 2 else "b") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, ts string, kind string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    q = events.windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts", ["kind"]).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in events.windows(df, "ts", ["kind"]).collect()}


@pytest.mark.parametrize("url,ok", [("https://h.example/board/1", True), ("https://h.example.:443/board/1?x=1", True), ("http://h.example/board/1", False), ("https://u@h.example/board/1", False), ("https://h.example.evil/board/1", False), ("https://h.example:8443/board/1", False), ("https://h.example/explore/1", False), (None, False)])
def test_board_url(spark, url, ok):
    assert one(spark, url, lambda c: X.valid_board_url(c, ["h.example"])) is ok


def test_runs(spark):
    made = spark.createDataFrame([("r1", "g", "1", 5, True), ("r2", "g", "2", 4, False), ("r3", "g", "3", None, None)], "run_id string, grp string, started string, expected int, has_more boolean")
    seen = spark.createDataFrame([(r, s, k) for r, ks in (("r1", "abcd"), ("r2", "abcd")) for k in ks for s in ("network", "dom", "dom")] + [("r1", "dom", None)], "run_id string, source string, key string").where("key IS NOT NULL")
    report = runs.reports(made, seen)
    got = {r.run_id: r for r in report.collect()}
    assert (got["r1"].union_count, got["r1"].new_count, got["r1"].gap, got["r1"].status) == (4, 4, 1, "sources_not_exhausted_count_mismatch")
    assert (got["r2"].new_count, got["r2"].status, got["r3"].union_count, got["r3"].gap) == (0, "complete", 0, None)
    assert {(r.run_id, r.resolved, r.removed, r.status) for r in runs.resolved(report).collect()} == {("r1", False, None, "sources_not_exhausted_count_mismatch"), ("r2", True, 1, "complete_after_invalid_notes_cleanup"), ("r3", False, None, "discovery_completed_without_expected_count")}
    assert [tuple(r) for r in runs.confirmed_counts(report).collect()] == [("g", 4)]
    first = runs.keep_first(spark.createDataFrame([("k", 2, "b"), ("k", 1, None), ("k", 3, "c")], "k string, t int, v string"), ["k"], ["t"], ["v"])
    assert [tuple(r) for r in first.collect()] == [("k", "b", 1)]
    counts = cells(spark, [(0, 7, 9), (5, 7, 9), (None, None, 9), (None, None, None)], "a int, b int, c int", e=runs.expected_count(F.col("a"), F.col("b"), F.col("c")))
    assert [tuple(r["e"]) for r in counts] == [(7, "page", True), (5, "user", True), (9, "confirmed", False), (None, "unknown", False)]


def test_candidates_and_all_thumbnail_reasons(spark):
    df = spark.createDataFrame([("n", 1, "u1", "WB_DFT", 5), ("n", 1, "u1", "WB_PRV", 4), ("n", 1, "u2", "current-src", 3)], "n string, p int, u string, v string, i int")
    got = [(r.u, r.place, r.better) for r in rank.candidates(df, ["n"], "p", "u", rank.variant_score(F.col("v")), ["i", "v"]).orderBy("place").collect()]
    assert got == [("u1", 1, False), ("u2", 2, True)]
    row = spark.createDataFrame([("http://a/x", 500, 400, None, None, 90000, 800, 400, True, "current-src")], "url string, w int, h int, dw int, dh int, size int, sw int, sh int, better boolean, v string")
    why = row.select(rank.thumbnail_reasons(*(F.col(c) for c in row.columns))).first()[0]
    assert why == "downloaded_width_smaller_than_display_width;native_resolution_too_small_for_text_ocr;higher_priority_candidate_available"
