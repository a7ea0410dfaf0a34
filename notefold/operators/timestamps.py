"""Mixed timestamp formats and zones brought to one UTC instant or day.

An ordered cascade of anchored patterns, each parsed strictly (an impossible
month, hour or offset gives null). Everything stays in JVM expressions.

Policy, for every input:

* null, blank or unrecognised text gives ``kind`` null and no instant or day;
* an instant with a zone gives that instant;
* a wall-clock time without a zone is read in ``zone``; without a zone no result;
* an ambiguous local time (clocks set back) takes the earlier instant, a
  nonexistent one (clocks set forward) is moved on by the gap; ``dst`` says which;
* a day without a time stays that day and has no instant;
* "n hours ago" counts back from the fetch instant; "yesterday hh:mm" is that time
  of the day before the fetch on the clock of ``zone``, an instant with its UTC day.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English month abbreviations in calendar order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Markers before a time that say nothing about it.
PREFIX = r"^\s*(?:编辑于|发布于|更新于|edited|posted|updated)?\s*"
SUFFIX = r"(Z|z|UTC|GMT|[+-]\d{2}:?\d{2}|\((?:UTC|GMT)[+-]\d{1,2}:?\d{2}\)|(?:UTC|GMT)[+-]\d{1,2}:?\d{2}|[（(]北京时间[)）]|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)?"
NUMERIC = r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?[T ](上午|下午)?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*" + SUFFIX + r"$"
COMPACT = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?$"
DAY_FIRST = r"^(?:[A-Z][a-z]{2}, )?(\d{1,2}) ([A-Z][a-z]{2})[a-z]* (\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?\s*" + SUFFIX + r"$"
MONTH_FIRST = r"^([A-Z][a-z]{2})[a-z]* (\d{1,2}), (\d{4}),? (\d{1,2}):(\d{2})(?::(\d{2}))? ?(AM|PM)?\s*" + SUFFIX + r"$"
DATE_ONLY = r"^(\d{4})[-/.年](\d{1,2})[-/.月](\d{1,2})日?$"
EPOCH = r"^(\d{10})(?:(\d{3})(\d{3})?)?(?:\.(\d{1,9}))?$"
HOURS_AGO = r"^(\d{1,4})\s*(?:小时前|hours? ago)$"
YESTERDAY = r"^(?:昨天|[Yy]esterday)\s*(?:at )?(\d{1,2}):(\d{2})$"


def _settle(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns behind a one-row generator, past which Catalyst neither merges
    projections nor moves filters: each is evaluated once, not once per use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in cols.items())))))


def _g(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i)


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _month(c: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(c)).cast("int"), F.lit(0))


def _local(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, frac: Column | None = None) -> Column:
    sec = F.coalesce(s, F.lit(0)).cast("decimal(16,6)")
    if frac is not None:
        sec = sec + F.when(frac != "", F.substring(F.rpad(frac, 6, "0"), 1, 6).cast("decimal(16,6)") / F.lit(1000000)).otherwise(F.lit(0)).cast("decimal(16,6)")
    return F.try_make_timestamp_ntz(y, mo, d, h, mi, sec.cast("decimal(16,6)"))


def _half(hour: Column, marker: Column) -> Column:
    """Hour of a 12-hour clock; hour 13 and more under a marker is impossible."""
    pm = marker.isin("下午", "PM")
    am = marker.isin("上午", "AM")
    return F.when((pm | am) & (hour > 12), F.lit(None).cast("int")).when(pm & (hour < 12), hour + 12).when(am & (hour == 12), F.lit(0)).otherwise(hour)


def _offset(suffix: Column) -> Column:
    """Minutes east of UTC that a suffix states, null when it states none or an impossible one."""
    m = r"([+-])(\d{1,2}):?(\d{2})"
    h, mi = _int(_g(suffix, m, 2)), _int(_g(suffix, m, 3))
    stated = F.when(_g(suffix, m, 1) == "-", -(h * 60 + mi)).otherwise(h * 60 + mi)
    return F.when(suffix.isin("Z", "z", "UTC", "GMT"), F.lit(0)).when(suffix.contains("北京时间"), F.lit(480)).when((h <= 18) & (mi < 60) & ~suffix.contains("/"), stated)


#: The cascade: pattern, then the canonical record it is rewritten to,
#: kind|year|month|day|half|hour|minute|second|fraction|suffix.
CASCADE = [
    (EPOCH, "epoch|$1|$2|$3|||||$4|"),
    (NUMERIC, "clock|$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (COMPACT, "clock|$1|$2|$3||$4|$5|$6||$7"),
    (DAY_FIRST, "clock|$3|$2|$1||$4|$5|$6||$7"),
    (MONTH_FIRST, "clock|$3|$1|$2|$7|$4|$5|$6||$8"),
    (DATE_ONLY, "day|$1|$2|$3||0|0|0||"),
    (HOURS_AGO, "hours_ago|$1||||||||"),
    (YESTERDAY, "yesterday|||||$1|$2|||"),
]


def normalize_times(df: DataFrame, raw: str, fetched: str, zone: str, out: str = "t", zones: list[str] | None = None) -> DataFrame:
    """Add struct ``out``: kind, utc (timestamp_ntz), day (date), dst, zone_from.

    ``raw`` text, ``fetched`` timestamp (an instant), ``zone`` IANA zone or null.
    A zone name that is not in ``zones`` counts as no zone.
    """
    known = zones or sorted(available_timezones())
    c = F.regexp_replace(F.regexp_replace(F.col(raw), PREFIX, ""), r"\s+$", "")
    record = F.lit(None).cast("string")
    for pattern, template in reversed(CASCADE):
        record = F.when(F.col("_c").rlike(pattern), F.regexp_replace("_c", pattern, template)).otherwise(record)
    step = _settle(_settle(df, _c=c), _p=F.split(record, r"\|"))
    part = lambda i: F.get("_p", F.lit(i))
    month = F.when(part(2).rlike("^[A-Za-z]"), _month(part(2))).otherwise(_int(part(2)))
    is_clock = part(0).isin("clock", "day")
    micro = F.col("_p")[1].cast("bigint") * 1000000 + F.coalesce(_int(part(2)), F.lit(0)) * 1000 + F.coalesce(_int(part(3)), F.lit(0)) + F.when(part(8) != "", F.substring(F.rpad(part(8), 6, "0"), 1, 6).cast("int")).otherwise(F.lit(0))
    step = _settle(
        step,
        _local=F.when(is_clock, _local(_int(part(1)), month, _int(part(3)), _half(_int(part(5)), part(4)), _int(part(6)), _int(part(7)), part(8))),
        _suffix=F.when(part(0) == "clock", part(9)),
        _home=F.when(F.col(zone).isin(known), F.col(zone)),
        _fetch=F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(fetched).cast("timestamp").cast("timestamp_ntz")),
        _epoch=F.when(part(0) == "epoch", F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(micro).cast("timestamp_ntz"))),
    )
    lo = F.col("_local")
    step = _settle(
        step,
        _offset=_offset(F.col("_suffix")),
        _zone=F.when(F.col("_suffix").contains("/"), F.when(F.col("_suffix").isin(known), F.col("_suffix"))).when(F.col("_suffix") == "", F.col("_home")),
        _eve=F.when(part(0) == "yesterday", F.date_sub(F.convert_timezone(F.lit("UTC"), F.col("_home"), F.col("_fetch")).cast("date"), 1)),
    )
    eve = F.col("_eve")
    step = _settle(step, _eve_local=F.when(eve.isNotNull(), _local(F.year(eve), F.month(eve), F.dayofmonth(eve), _int(part(5)), _int(part(6)), F.lit(0))))
    kind = (
        F.when(F.col("_epoch").isNotNull(), "epoch").when((part(0) == "day") & lo.isNotNull(), "day").when(lo.isNotNull() & F.col("_offset").isNotNull(), "offset")
        .when(lo.isNotNull() & (F.col("_suffix") != ""), "named_zone").when(lo.isNotNull(), "local").when(part(0).isin("hours_ago", "yesterday"), part(0))
    )
    step = _settle(step, _kind=kind)
    k = F.col("_kind")
    step = _settle(
        step,
        _utc=F.when(k == "epoch", F.col("_epoch")).when(k == "offset", lo - F.make_dt_interval(mins=F.col("_offset"))).when(k.isin("named_zone", "local"), F.convert_timezone(F.col("_zone"), F.lit("UTC"), lo))
        .when(k == "hours_ago", F.col("_fetch") - F.make_dt_interval(hours=_int(part(1)))).when(k == "yesterday", F.convert_timezone(F.col("_home"), F.lit("UTC"), F.col("_eve_local"))),
    )
    u = F.col("_utc")
    wall = lambda minutes: F.convert_timezone(F.lit("UTC"), F.col("_zone"), u + F.make_dt_interval(mins=F.lit(minutes)))
    dst = F.when(k.isin("named_zone", "local") & u.isNotNull(), F.when(wall(0) != lo, "nonexistent").when((wall(60) == lo) | (wall(30) == lo), "ambiguous"))
    day = F.when(k == "day", lo.cast("date")).otherwise(u.cast("date"))
    zone_from = F.when(k.isin("epoch", "offset", "named_zone"), "text").when(k.isin("local", "yesterday"), F.when(F.col("_home").isNotNull(), "lookup")).when(k == "hours_ago", "fetch")
    made = F.struct(k.alias("kind"), u.alias("utc"), day.alias("day"), dst.alias("dst"), zone_from.alias("zone_from"))
    return _settle(step, **{out: made}).drop("_c", "_p", "_local", "_suffix", "_home", "_fetch", "_epoch", "_offset", "_zone", "_eve", "_eve_local", "_kind", "_utc")


ISO_DATE = r"^(\d{4})-(\d{2})-(\d{2})$"
ISO_INSTANT = r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(Z|[+-]\d{2}:?\d{2})$"


def iso_day(c: Column) -> Column:
    """UTC day of ISO text: a bare date is that day, an instant its UTC day, else null."""
    date = F.to_date(F.try_make_timestamp_ntz(*(_int(_g(c, ISO_DATE, i)) for i in (1, 2, 3)), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)")))
    local = _local(*(_int(_g(c, ISO_INSTANT, i)) for i in range(1, 7)))
    return F.when(c.rlike(ISO_DATE), date).when(c.rlike(ISO_INSTANT), (local - F.make_dt_interval(mins=_offset(_g(c, ISO_INSTANT, 8)))).cast("date"))


def normalize_notes(notes: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per note row: note_id, raw, iso, t (struct), iso_day.

    ``zones`` (board_id, zone_name) is the source-zone lookup; a board listed
    twice takes its least zone name. A note without a board has no zone.
    """
    lookup = zones.where(F.col("board_id").isNotNull()).groupBy("board_id").agg(F.min("zone_name").alias("_source_zone"))
    rows = notes.select("note_id", "board_id", "publish_time_raw", "publish_time_iso", "fetched_at").join(lookup, "board_id", "left")
    return normalize_times(rows, "publish_time_raw", "fetched_at", "_source_zone").transform(lambda d: _settle(d, iso_day=iso_day(F.trim("publish_time_iso")))).select("note_id", "publish_time_raw", "publish_time_iso", "t", "iso_day")


def disagreeing_days(notes: DataFrame, zones: DataFrame) -> DataFrame:
    """Distinct note ids whose raw and ISO times both give a UTC day and the days differ."""
    n = normalize_notes(notes, zones)
    return n.where(F.col("t.day") != F.col("iso_day")).select("note_id").distinct()
