"""Records out of HTML and JSON: notes, links, references, image candidates."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notefold.functions.arrow import flat_map_batches
from notefold.functions.joins import merge_join
from notefold.functions.text import publish_date
from notefold.operators.rank import variant_score

#: Keys of captured responses, lower case without signs.
CURSOR_KEYS = ["cursor", "nextcursor", "lastcursor", "searchid"]
MORE_KEYS = ["hasmore", "ismore", "more"]
CONTEXT_KEYS = ["cover", "coverurl", "displaytitle", "interactinfo", "imagelist", "notecard", "notetype", "xsectoken"]
NOTE_PATH = re.compile(r"/(?:explore|discovery/item)/([0-9A-Za-z_-]{8,80})")
BARE_ID = re.compile(r"^[0-9A-Za-z_-]{8,80}$")
_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
NOTE = T.StructType([T.StructField(n, _TEXTS if n in ("images", "tags") else _TEXT) for n in ("title", "body", "author", "author_id", "published", "images", "tags")])


class _Page(HTMLParser):
    """Meta data, links, images, scripts and text of a page in reading order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.links: list[str] = []
        self.images: list[str] = []
        self.scripts: list[tuple[str, str]] = []
        self.title, self.text, self.article = [], [], []
        self._in: list[str] = []
        self._script = ""

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("property") or a.get("name")):
            self.meta.setdefault((a.get("property") or a["name"]).lower(), a.get("content") or "")
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "img":
            self.images += [a[k] for k in ("src", "data-src") if a.get(k)][:1]
        if tag == "script":
            self._script = a.get("type") or ""
        if tag in ("script", "style", "title", "article"):
            self._in.append(tag)

    def handle_endtag(self, tag):
        if tag in self._in:
            del self._in[len(self._in) - 1 - self._in[::-1].index(tag) :]

    def handle_data(self, data):
        if "script" in self._in:
            self.scripts.append((self._script, data))
        elif "title" in self._in:
            self.title.append(data)
        elif "style" not in self._in and data.strip():
            self.text.append(data.strip())
            if "article" in self._in:
                self.article.append(data.strip())


def balanced_json(text: str) -> object | None:
    """First JSON object or array in a text, None without one."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text or ""):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def _walk(value: object, keys: list[str]):
    """Values under any of the keys, depth first in document order."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k.lower() in keys:
                yield v
            yield from _walk(v, keys)
    elif isinstance(value, list):
        for v in value:
            yield from _walk(v, keys)


def parse_note(html: str | None) -> tuple | None:
    """Fields of NOTE; null HTML gives null, missing fields are null or empty."""
    if html is None:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    data = [d for kind, s in page.scripts if "json" in kind and (d := balanced_json(s)) is not None]
    scalar = lambda keys: next((str(v) for d in data for v in _walk(d, keys) if isinstance(v, (str, int))), None)
    author = next((v for d in data for v in _walk(d, ["author", "user"]) if isinstance(v, dict)), {})
    title = page.meta.get("og:title") or page.meta.get("twitter:title") or re.sub(r"\s+[-|]\s+[^-|]{1,12}$", "", "".join(page.title).strip()) or None
    body = "\n".join(page.article) or page.meta.get("description") or "\n".join(page.text) or None
    images = [page.meta[k] for k in ("og:image", "twitter:image") if page.meta.get(k)]
    for d in data:
        for v in _walk(d, ["image", "images", "imagelist", "url", "urldefault"]):
            images += [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, str) and re.search(r"(?i)\.(?:jpe?g|png|webp|gif)|/notes?/", x)]
    images = [re.sub(r"^(?://|http://)", "https://", u) for u in images + page.images]
    published = scalar(["datepublished", "publishtime", "time"]) or next(iter(re.findall(r"20\d{2}[./年-]\d{1,2}[./月-]\d{1,2}", "\n".join(page.text))), None)
    tags = re.findall(r"#([^\s#]{1,40})", body or "")
    return title, body, author.get("name") or author.get("nickname"), str(author.get("identifier") or author.get("userId") or "") or None, published, list(dict.fromkeys(images)), list(dict.fromkeys(tags))


def parse_notes(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, NOTE fields) of every page."""
    schema = T.StructType([df.schema[key], *NOTE.fields])
    parsed = flat_map_batches(df.select(key, html), lambda ks, pages: ((k, *(parse_note(p) or (None,) * 7)) for k, p in zip(ks, pages)), schema)
    return parsed.withColumn("published", publish_date(F.col("published")))


def page_links(df: DataFrame, key: str, html: str, base: str, host: str) -> DataFrame:
    """(key, ord, note_id, url) of note links on a page, first of each id, relative ones resolved."""
    def run(keys, pages, bases):
        for k, text, b in zip(keys, pages, bases):
            page = _Page()
            page.feed(text or "")
            seen: set[str] = set()
            for href in page.links:
                url = urljoin(b or "", href)
                m = NOTE_PATH.search(urlsplit(url).path)
                if m and (urlsplit(url).hostname or "").endswith(host) and m.group(1) not in seen:
                    seen.add(m.group(1))
                    yield k, len(seen), m.group(1), url

    return flat_map_batches(df.select(key, html, base), run, T.StructType([df.schema[key], *T._parse_datatype_string("ord int, note_id string, url string").fields]))


#: A JSON document laid out: one row a scalar member, in document order.
MEMBERS = "ord int, node int, name string, text string, kind string, noted boolean, cursor string"


def _plain(key: str) -> str:
    return re.sub(r"[^a-z0-9]", "", key.lower())


def members(text: str | None) -> Iterator[tuple]:
    """MEMBERS rows of a document; none of one that is no JSON.

    ``node`` numbers the objects. ``noted`` says that the member stands below a key,
    or beside one, that speaks of notes. ``cursor`` is the page mark of its object,
    else of the nearest object around it that has one.
    """
    try:
        todo: list[tuple] = [("", json.loads(text or "null"), 0, False, False, None)]
    except ValueError:
        return
    ord_, nodes = 0, 0
    while todo:
        name, value, node, below, noted, cursor = todo.pop()
        if isinstance(value, dict):
            nodes += 1
            plain = {k: _plain(k) for k in value}
            marks = [str(v) for k, v in value.items() if plain[k] in CURSOR_KEYS and isinstance(v, (str, int)) and str(v)]
            cursor = marks[0] if marks else cursor
            here = below or any("note" in p or p in CONTEXT_KEYS for p in plain.values())
            inner = [(plain[k], v, nodes, below or "note" in plain[k], here, cursor) for k, v in value.items()]
            if cursor is not None:
                ord_ += 1
                yield ord_, nodes, "", None, "object", here, cursor
            todo += reversed(inner)
        elif isinstance(value, list):
            todo += [("", v, node, below, False, cursor) for v in reversed(value)]
        elif value is not None:
            ord_ += 1
            kind = "flag" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "text"
            yield ord_, node, name, str(value), kind, noted, cursor


def json_refs(df: DataFrame, key: str, text: str, slug: Column | None = None) -> DataFrame:
    """(key, note_id, cursor, sequence, has_more, next_cursor) of every note that a captured document names, once each.

    A member names a note by a key that speaks of a note's id, by the bare key "id"
    where notes are spoken of, or by a note's URL; ``slug`` is the board's own name
    and no note. A document says that more follow when any of its objects does, that
    none do when some say so and none the contrary. Repeated documents of one key
    count as one; bad JSON and null give no rows.
    """
    docs = df.select(key, F.col(text).alias("_doc"), (slug if slug is not None else F.lit(None).cast("string")).alias("_slug")).where(F.col(key).isNotNull() & F.col("_doc").isNotNull()).groupBy(key).agg(F.min(F.struct("_doc", "_slug")).alias("_d")).select(key, "_d.*")

    def lay_out(keys, texts, slugs):
        for k, t, own in zip(keys, texts, slugs):
            for row in members(t):
                yield k, own, *row

    schema = T.StructType([df.schema[key], *T._parse_datatype_string("slug string, " + MEMBERS).fields])
    rows = flat_map_batches(docs, lay_out, schema)
    name, value = F.col("name"), F.trim("text")
    by_url = F.nullif(F.regexp_extract(value, NOTE_PATH.pattern, 1), F.lit(""))
    bare = F.when(value.rlike(BARE_ID.pattern), value)
    by_key = F.col("kind").isin("text", "number") & ((name.contains("note") & name.contains("id")) | ((name == "id") & F.col("noted")))
    named = rows.withColumn("note_id", F.when(by_key, F.coalesce(by_url, bare)).when(F.col("kind") == "text", by_url))
    refs = named.where(F.col("note_id").isNotNull() & ~F.col("note_id").eqNullSafe(F.col("slug"))).groupBy(key, "note_id").agg(F.min(F.struct("ord", "cursor")).alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("first.ord"))
    says = F.when(F.col("kind") == "number", F.col("text").try_cast("double") != 0).otherwise(F.lower("text") == "true")
    flags = rows.where(name.isin(MORE_KEYS) & ((F.col("kind") != "text") | F.lower("text").isin("true", "false"))).groupBy(key, "node").agg(F.min_by(says, "ord").alias("more"))
    more = flags.groupBy(key).agg(F.bool_or("more").alias("has_more"))
    marks = rows.where(F.col("cursor").isNotNull()).groupBy(key).agg(F.min_by("cursor", "ord").alias("next_cursor"))
    listed = refs.select(key, "note_id", F.col("first.cursor").alias("cursor"), place.alias("sequence"))
    return merge_join(merge_join(listed, more, key, "left"), marks, key, "left").select(key, "note_id", "cursor", "sequence", "has_more", "next_cursor")


STATE = "title string, desc string, time bigint, user struct<userId: string, nickname: string>, imageList array<struct<infoList: array<struct<imageScene: string, url: string>>, url: string>>"


def state_images(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, url, score): best image of each position of a JSON page state; http as https, ties by URL."""
    state = df.select(key, F.from_json(text, STATE).alias("s"))
    at = state.select(key, F.posexplode("s.imageList").alias("p", "image")).select(key, (F.col("p") + 1).alias("position"), F.explode(F.concat(F.coalesce(F.transform("image.infoList", lambda i: F.struct(i["url"].alias("url"), variant_score(i["imageScene"]).alias("score"))), F.array()), F.array(F.struct(F.col("image.url").alias("url"), F.lit(105).alias("score"))))).alias("c"))
    named = at.where(F.col("c.url").isNotNull()).select(key, "position", F.regexp_replace("c.url", "^http://", "https://").alias("url"), F.col("c.score").alias("score"))
    return named.groupBy(key, "position").agg(F.max(F.struct("score", "url")).alias("b")).select(key, "position", F.col("b.url").alias("url"), F.col("b.score").alias("score"))
