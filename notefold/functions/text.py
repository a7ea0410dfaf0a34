"""Scalar text functions as Column expressions; JVM-side throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width signs and the ASCII signs they count as.
SIGNS = ("，。：；（）？！｜—－", ",.:;()?!|--")
#: Terms of the trade; a parameter of every function that uses them.
TERMS = ["Java", "JVM", "Redis", "RDB", "AOF", "MySQL", "PostgreSQL", "Spring", "Spring Boot", "Kafka", "RPC", "HTTP", "HTTPS", "TCP", "UDP", "Linux", "Docker", "Kubernetes", "LeetCode", "字节跳动", "阿里", "腾讯", "美团", "一面", "二面", "三面", "HR面"]
#: Hints for the light structure of a note.
COMPANIES = ["字节", "腾讯", "阿里", "美团", "百度", "快手", "小红书", "拼多多", "京东", "华为", "微软", "Google", "Amazon", "Meta"]
ROLES = ["后端", "前端", "算法", "客户端", "数据", "测试", "产品", "运营", "Java", "Go", "Python", "C++"]
ROUNDS = ["一面", "二面", "三面", "hr", "HR", "终面", "笔试", "oc", "OC"]
#: Fixed value: query keys whose values are secrets.
SECRET = r"(?i)(token|cookie|session|auth|sign|sig|secret|key|ticket)"
SPACE = r"[\s\u0085   -     　\x1c-\x1f]"


def bind(c: Column, fn) -> Column:
    """``fn(c)`` with ``c`` evaluated once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """White space runs as one space, ends stripped, empty as null."""
    return F.nullif(strip(F.regexp_replace(c, f"{SPACE}+", " ")), F.lit(""))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", "")


def normalize_signs(c: Column) -> Column:
    """Full-width punctuation as ASCII, no white space."""
    return compact(F.translate(c, *SIGNS))


def meaningful(c: Column) -> Column:
    """Four or more letters or digits of any script."""
    return F.coalesce(F.length(F.regexp_replace(c, r"(?U)[\W_]+", "")) >= 4, F.lit(False))


def note_id(c: Column) -> Column:
    """Id that a URL or bare text names: the bare id, the path after explore or item, a query key, else the last fitting path part."""
    bare = r"^[0-9A-Za-z_-]{8,80}$"
    text = strip(c)
    path = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    named = F.regexp_extract(path, r"/(?:explore|discovery/item)/([0-9A-Za-z_-]{8,80})(?:/|$)", 1)
    query = F.regexp_extract(text, r"[?&](?:note_id|noteId|id)=([0-9A-Za-z_-]{8,80})(?:[&#]|$)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p.rlike(bare))
    return F.when(text.rlike(bare), text).otherwise(F.coalesce(F.nullif(named, F.lit("")), F.nullif(query, F.lit("")), F.try_element_at(parts, F.lit(-1))))


def canonical_url(c: Column, prefix: str) -> Column:
    """Null where no id is named."""
    return F.concat(F.lit(prefix), note_id(c))


def board_id(c: Column) -> Column:
    return F.substring(F.sha2(strip(c), 256), 1, 16)


def board_slug(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"/board/([^/?#]+)", 1), F.lit(""))


def redact_url(c: Column) -> Column:
    """Values of secret query keys replaced, order kept."""
    query = F.regexp_extract(c, r"\?([^#]*)", 1)
    shown = F.array_join(F.transform(F.split(query, "&"), lambda p: F.when(F.split(p, "=")[0].rlike(SECRET) & p.contains("="), F.concat(F.split(p, "=")[0], F.lit("=REDACTED"))).otherwise(p)), "&")
    return F.when(query == "", c).otherwise(F.concat(F.regexp_extract(c, r"^([^?]*\?)", 1), shown, F.regexp_extract(c, r"(#.*)$", 1)))


def ui_count(c: Column) -> Column:
    """Number of notes that a page states, up to five digits."""
    unit = r"\s*(?:篇|个)?\s*(?:笔记|帖子|收藏)"
    found = [F.regexp_extract(c, r"(?:收藏专辑|收藏夹|专辑|合集|面经)?[^0-9]{0,10}([0-9]{1,5})" + unit, 1), F.regexp_extract(c, r"(?:笔记|帖子|收藏)[^0-9]{0,6}([0-9]{1,5})", 1), F.regexp_extract(c, r"([0-9]{1,5})" + unit, 1)]
    return F.coalesce(*(F.nullif(f, F.lit("")) for f in found)).cast("int")


def publish_date(c: Column) -> Column:
    """Date text yyyy-mm-dd: a whole date of four forms, else the first date inside, unchecked."""
    text = strip(c)
    whole = r"^([0-9]{4})(?:-([0-9]{1,2})-([0-9]{1,2})|/([0-9]{1,2})/([0-9]{1,2})|\.([0-9]{1,2})\.([0-9]{1,2})|年([0-9]{1,2})月([0-9]{1,2})日)$"
    g = lambda i: F.regexp_extract(text, whole, i)
    month, day = F.concat(*(g(i) for i in (2, 4, 6, 8))), F.concat(*(g(i) for i in (3, 5, 7, 9)))
    strict = F.try_to_date(F.concat_ws("-", g(1), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd").cast("string")
    inside = r"(20[0-9]{2})[./年-]([0-9]{1,2})[./月-]([0-9]{1,2})"
    h = lambda i: F.regexp_extract(text, inside, i)
    loose = F.when(h(1) != "", F.concat_ws("-", h(1), F.lpad(h(2), 2, "0"), F.lpad(h(3), 2, "0")))
    return F.coalesce(F.when(text.rlike(whole), strict), loose)


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def dates(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?:20|19)[0-9]{2}[./年-][0-9]{1,2}[./月-][0-9]{1,2}"), F.lit(0))


def terms(c: Column, dictionary: list[str] | None = None) -> Column:
    """Terms of the dictionary that the text contains, case aside, in code point order."""
    known = F.array(*map(F.lit, sorted(dictionary or TERMS)))
    return F.when(c.isNotNull(), bind(F.lower(c), lambda low: F.filter(known, lambda t: low.contains(F.lower(t)))))


def first_hint(c: Column, hints: list[str]) -> Column:
    return F.coalesce(*(F.when(c.contains(h), F.lit(h)) for h in hints), F.lit(""))


def any_marker(c: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | c.contains(m)
    return F.coalesce(out, F.lit(False))


def key_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def within(child: Column, root: Column) -> Column:
    """Whether a path lies at or below another, at a boundary."""
    base = F.regexp_replace(root, "/+$", "")
    return (child == base) | child.startswith(F.concat(base, F.lit("/")))


def lenient_int(c: Column) -> Column:
    return F.floor(c.try_cast("double")).try_cast("bigint")


#: Marks of a page that asks for a login or a check.
AUTH_MARKERS = ["登录后查看", "请登录", "扫码登录", "安全验证", "验证码", "访问频繁", "captcha", "CAPTCHA", "verify"]


def asks_for_login(c: Column) -> Column:
    return any_marker(c, AUTH_MARKERS)


def valid_board_url(c: Column, hosts: list[str]) -> Column:
    """https, an allowed host (a final dot aside), no user part, port 443 or none, a path below /board/; else false."""
    m = r"^https://([^/?#@:]+)(?::(\d+))?(/board/[^?#]+)(?:[?#].*)?$"
    host = F.lower(F.regexp_replace(F.regexp_extract(strip(c), m, 1), r"\.$", ""))
    return F.coalesce(host.isin(hosts) & F.regexp_extract(strip(c), m, 2).isin("", "443"), F.lit(False))
