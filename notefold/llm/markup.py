"""Markup residue turned into clean text that keeps structure (problem 7).

A text is parsed into markup nodes of four kinds (html, markdown, wiki, latex).
Pages of one host are merged into a site style tree: for each node path the
entropy of its presentations and of its contents says how important it is, and
branches of low importance (navigation, footers: the same on page after page)
are cut before the rest is rendered as plain text with headings, lists, code
and formulas kept.

Defined results: null, empty and blank texts have no nodes and render as they
are; repeated rows give one row; a text of any length is parsed whole.
"""

from __future__ import annotations

import html

import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.functions.arrow import flat_map_batches
from notefold.functions.checkpoint import settle
from notefold.functions.joins import merge_join

#: Element names of HTML.
TAGS = "a abbr address article aside audio b blockquote body br button canvas caption center cite code col colgroup dd del details div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark meta nav noscript object ol optgroup option p param path picture pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"
#: Commands of LaTeX that stand without braces.
COMMANDS = "item alpha beta gamma delta epsilon theta lambda mu pi sigma omega infty cdot times leq geq neq approx le ge ne sum prod int frac sqrt log ln sin cos lim rightarrow leftarrow Rightarrow to quad qquad hline newline noindent centering maketitle tableofcontents par clearpage newpage ldots dots mathcal left right begin end"
_TAG = "(?:" + "|".join(sorted(TAGS.split(), key=len, reverse=True)) + ")"
_ATTR = r"(?:\s+[A-Za-z_:@][-\w:.]*(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=`]+))?)"

#: Node grammars by kind and type, tried in this order.
GRAMMARS: dict[str, dict[str, str]] = {
    "html": {
        "comment": r"<!--(?s:.*?)-->|<!DOCTYPE[^>]*>|<!\[CDATA\[",
        "tag": rf"(?i:</?{_TAG}{_ATTR}*\s*/?>)",
        "cut_tag": rf"(?i:<{_TAG}\s+[a-z-]+\s*=\s*\"[^\"<>]*(?:\"|\Z|\n)|</{_TAG}(?=\s*(?:\n|\Z)))",
        "entity": r"&(?:#\d{1,6}|#x[0-9A-Fa-f]{1,5}|nbsp|amp|lt|gt|quot|apos|copy|reg|trade|hellip|mdash|ndash|ldquo|rdquo|lsquo|rsquo|middot|bull|times|laquo|raquo|ensp|emsp|thinsp|deg|euro|yen|pound|cent|sect|para|divide|plusmn)\s?;",
    },
    "markdown": {
        "fence": r"^[ \t]*(?:```|~~~(?!~))[ \t]*[\w+#.-]*[ \t]*$",
        "heading": r"^[ \t]{0,3}#{1,6}[ \t]+(?=\S)",
        "table": r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$",
        "image_link": r"!?\[[^\[\]\n]*+\]\s?\((?:[^()\s]|\n(?!\n)|\([^()\s]*+\))++(?:\s\"[^\"\n]*\")?\)|!\[[^\[\]\n]*+\]",
        "task": r"^[ \t]*[-*+] \[[ xX]\] ",
        "quote": r"^>{1,3} +(?=\S)",
        "bold": r"(?<![\d*/])\*\*(?=[^\s*])(?:[^*\n]|\n(?!\n))+?(?<=[^\s*])\*\*(?![\d*])|(?<![A-Za-z0-9_*])__(?=[^\s_])(?![a-z0-9]+__)[^_\n]+?__(?![A-Za-z0-9_])",
        "strike": r"~~(?=[^\s~])(?:[^~\n]|\n(?!\n))+?~~(?!~)",
        "code": r"(?<!`)`(?!`)(?:[^`\n]|\n(?!\n))++`(?!`)",
        "emphasis": r"(?<![A-Za-z0-9*/])\*(?=[^\s*])(?:[^*\n]|\n(?!\n))+?(?<=\S)\*(?![A-Za-z0-9*/])",
        "bullet": r"^[ \t]*[-+] (?=\S)(?!\d+ -\s*$)",
        "left_bold": r"(?<![\d*/ ])\*\*(?![\d*/ ])|`{3}",
        "rule": r"^(?:-{3,}|\*{3,})[ \t]*$",
    },
    "wiki": {
        "link": r"\[\[(?:[^\[\]\n]|\n(?!\n))++\]\]|\[\[(?=[^\s\[\]])|(?<=[^\s\[\]])\]\]",
        "external": r"\[https?://[^\s\[\]]+(?:\s[^\[\]\n]*)?\]",
        "heading": r"^[ \t]*(?P<marks>={2,6})[ \t]*[^=\n]+?[ \t]*(?P=marks)[ \t]*$",
        "quote": r"(?<!')'{2,3}(?!')",
        "table": r"^[ \t]*(?:\{\|(?!\|)|\|\}(?!\})|\|-[ \t]*$|![^!\n]+!!)|^[ \t]*\|[^|\n]*\|\|",
        "template": r"\{\{[A-Za-z][^{}|\n]*+\|[^{}]*+\}\}",
        "ref": r"</?ref(?:\s[^<>]*)?/?>|</?nowiki>|__(?:TOC|NOTOC|FORCETOC)__|~~~~|#REDIRECT",
    },
    "latex": {
        "environment": r"\\(?:begin|end)\s?\{[a-zA-Z]+\*?\}",
        "command": r"\\[a-zA-Z]+\*?(?:\[[^\[\]\n]*\])?\{",
        "bare": r"\\(?:" + "|".join(COMMANDS.split()) + r")(?![A-Za-z])",
        "math": r"\$\$(?=[^$])(?:[^$\n]|\n(?!\n))++\$\$|\$(?=[^\s$\d{A-Z]|[A-Z]\()(?:[^$\n\p{Han}\\^_{}=<>]|\n(?!\n))*+[\\^_{}=<>](?:[^$\n\p{Han}]|\n(?!\n))*+\$(?!\d)|\\\((?:(?!\\[()]|\n\n)(?s:.))++\\\)|\\\[(?:(?!\\[\[\]]|\n\n)(?s:.))++\\\]",
        "tie": r"~\\(?:ref|cite|eqref)",
    },
}
COMPILED = {kind: re.compile("|".join(f"(?P<{t}>{p})" for t, p in g.items()), re.M) for kind, g in GRAMMARS.items()}
#: Characters without which a kind cannot occur.
SIGNS = {"html": ("<", "&"), "markdown": ("*", "`", "~~", "](", "![", "#", "> ", "- ", "+ ", "---", "__"), "wiki": ("[", "''", "==", "{|", "|}", "|-", "||", "!!", "{{", "<ref", "__", "~~~~"), "latex": ("\\", "$")}
FENCED = re.compile(r"```.*?```|<pre>.*?</pre>", re.S)
STAR_LINE = re.compile(r"^[ \t]*[*#:;]{1,3} (?=\S)", re.M)


def nodes(text: str | None) -> list[tuple[str, str, str]]:
    """(kind, type, source) of each markup node, kind by kind, in reading order.

    A line mark that several languages share (a star bullet) belongs to the wiki
    when other wiki markup is about, else to Markdown.
    """
    if not text:
        return []
    found: list[tuple[str, str, str]] = []
    code = None
    for kind, rx in COMPILED.items():
        if not any(s in text for s in SIGNS[kind]):
            continue
        if code is None:
            code = [m.span() for m in FENCED.finditer(text)] if ("```" in text or "<pre>" in text) else []
        for m in rx.finditer(text):
            if code and kind != "markdown" and m.lastgroup not in ("tag", "comment") and any(a < m.start() < b - 3 for a, b in code):
                continue
            if code and kind == "markdown" and m.lastgroup not in ("fence", "left_bold") and any(a < m.start() < b - 3 for a, b in code):
                continue
            found.append((kind, m.lastgroup, m.group(0)))
    if "* " in text and STAR_LINE.search(text):
        wiki = any(k == "wiki" for k, _, _ in found)
        found += [("wiki" if wiki else "markdown", "star", m.group(0)) for m in STAR_LINE.finditer(text) if wiki or m.group(0).strip() == "*"]
    return found


# ---- style tree -----------------------------------------------------------

VOID = set("area base br col embed hr img input link meta param source wbr".split())
ELEMENT = re.compile(rf"(?i)<(/?)({_TAG}){_ATTR}*\s*(/?)>")


def elements(text: str | None) -> list[tuple[str, str, str, int, int]]:
    """(path, presentation, content, start, end) of each HTML element of a text.

    The path is the names of the enclosing elements, the presentation the names
    of the direct children, the content the element's text. Unclosed elements
    end with their parent; stray end tags are passed over.
    """
    out: list[tuple[str, str, str, int, int]] = []
    if not text or "<" not in text:
        return out
    stack: list[list] = []

    def close(end: int) -> None:
        name, start, inner, kids, path = stack.pop()
        content = re.sub(r"\s+", " ", ELEMENT.sub("", text[inner:end])).strip()
        out.append((path, ",".join(kids), content, start, end))

    for m in ELEMENT.finditer(text):
        name = m.group(2).lower()
        if m.group(1):
            if any(f[0] == name for f in stack):
                while stack[-1][0] != name:
                    close(m.start())
                f = stack[-1]
                content = re.sub(r"\s+", " ", ELEMENT.sub("", text[f[2] : m.start()])).strip()
                stack.pop()
                out.append((f[4], ",".join(f[3]), content, f[1], m.end()))
        else:
            if stack:
                stack[-1][3].append(name)
            if name not in VOID and not m.group(3):
                path = "/".join([*(f[0] for f in stack), name])
                stack.append([name, m.start(), m.end(), [], path])
    while stack:
        close(len(text))
    return out


def pages_of(notes: DataFrame, ocr: DataFrame) -> DataFrame:
    """(field, record_key, host, text); the host of a note is that of its URL, a scan's is its engine."""
    a = notes.select(F.lit("notes.body_text").alias("field"), F.col("note_id").alias("record_key"), F.coalesce(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)), F.lit("")).alias("host"), F.col("body_text").alias("text"))
    b = ocr.select(F.lit("ocr_results.text").alias("field"), F.col("ocr_id").alias("record_key"), F.coalesce(F.col("engine"), F.lit("")).alias("host"), F.col("text"))
    return a.unionByName(b).where(F.col("text").isNotNull() & F.col("record_key").isNotNull())


def dom(text: str | None) -> list[tuple[str, str, str, str, int, int]]:
    """(kind, path, presentation, content, start, end) of each node of a text's document tree.

    HTML elements nest; the nodes of the other languages, and HTML's entities,
    comments and cut tags, hang below the root by kind and type. Presentation is
    the names of an element's children or the marks of a node without its words,
    content the words.
    """
    found = [("html", *e) for e in elements(text)]
    return found + [(kind, f"{kind}:{name}", WORDS.sub("", source), " ".join(WORDS.findall(source)), -1, -1) for kind, name, source in nodes(text) if name != "tag" or not found]


WORDS = re.compile(r"[\p{L}\p{N}]+")


def site_nodes(pages: DataFrame) -> DataFrame:
    """(field, record_key, host, kind, path, shown, content): the nodes of every text's tree, before they are merged."""
    def scan(fields, keys, hosts, texts):
        for f, k, host, text in zip(fields, keys, hosts, texts):
            for kind, path, shown, content, _, _ in dom(text):
                yield f, k, host, kind, path, hash_of(shown), hash_of(content)

    return flat_map_batches(pages.select("field", "record_key", "host", "text"), scan, "field string, record_key string, host string, kind string, path string, shown bigint, content bigint")


def markup_found(pages: DataFrame) -> DataFrame:
    """Distinct (field, record_key, kind): texts with a node of the site tree's; one leftover counts, important or not."""
    return site_nodes(pages).select("field", "record_key", "kind").distinct()


#: Weight by which a node's own presentations fade against its children, for each presentation more.
FADE = 0.9


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the merged trees.

    The entropy of a node's presentations over the pages of its host, and for a
    leaf of its contents, is near 0 where every page shows the same and 1 where all
    differ. An inner node weighs its own entropy against its children's importance,
    the children more the fewer presentations it has; importance is passed up
    level by level. All counts are grouped sums with partial aggregation, so a
    host with most of the pages is no hot task.
    """
    feats = site_nodes(pages).select("host", "path", F.explode(F.array(F.struct(F.lit("p").alias("what"), F.col("shown").alias("h")), F.struct(F.lit("c").alias("what"), F.col("content").alias("h")))).alias("f")).select("host", "path", "f.*")
    counts = feats.groupBy("host", "path", "what", "h").count()
    per = counts.groupBy("host", "path", "what").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.log("count")).alias("clogc"), F.count("*").alias("kinds"))
    entropy = F.when(F.col("n") > 1, (F.log("n") - F.col("clogc") / F.col("n")) / F.log("n")).otherwise(F.lit(1.0))
    own = per.withColumn("e", entropy).groupBy("host", "path").agg(F.max("n").alias("pages"), F.max(F.when(F.col("what") == "p", F.col("e"))).alias("shown"), F.max(F.when(F.col("what") == "c", F.col("e"))).alias("content"), F.max(F.when(F.col("what") == "p", F.col("kinds"))).alias("kinds"))
    own = settle(own.withColumn("depth", F.size(F.split("path", "/"))).withColumn("parent", F.regexp_replace("path", "/[^/]*$", "")))
    deepest = own.agg(F.max("depth")).first()[0] or 0
    done = own.where(F.col("depth") == deepest).withColumn("importance", F.col("content"))
    level = done
    for depth in range(deepest - 1, 0, -1):
        below = level.groupBy("host", F.col("parent").alias("path")).agg((F.sum(F.col("importance") * F.col("pages")) / F.sum("pages")).alias("inner"))
        fade = F.pow(F.lit(FADE), F.col("kinds"))
        level = merge_join(own.where(F.col("depth") == depth), below, ["host", "path"], "left").withColumn("importance", F.when(F.col("inner").isNull(), F.col("content")).otherwise((1 - fade) * F.col("shown") + fade * F.col("inner"))).drop("inner")
        done = done.unionByName(level)
    return done.select("host", "path", "pages", "importance")


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s) - (1 << 63)


# ---- rendering ------------------------------------------------------------

def _wiki(t: str) -> str:
    t = re.sub(r"^[ \t]*\{\|.*$|^[ \t]*\|\}[ \t]*$|^[ \t]*\|-+[ \t]*$", "", t, flags=re.M)
    t = re.sub(r"^[ \t]*[|!](?=[^|\n])(.*(?:\|\||!!).*)$", lambda m: " | ".join(c.strip() for c in re.split(r"\|\||!!", m.group(1))), t, flags=re.M)
    t = re.sub(r"\[\[(?:File|Image|文件|图像):[^\[\]]*\]\]|\[\[(?:Category|分类):[^\[\]]*\]\]", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    t = re.sub(r"\[https?://[^\s\[\]]+(?:\s([^\[\]\n]*))?\]", lambda m: m.group(1) or "", t)
    t = re.sub(r"^[ \t]*(={2,6})[ \t]*([^=\n]+?)[ \t]*\1[ \t]*$", lambda m: "#" * len(m.group(1)) + " " + m.group(2), t, flags=re.M)
    t = re.sub(r"(?<!')'{2,3}(?!')", "", t)
    return re.sub(r"\[\[|\]\]", "", t)


def _latex(t: str) -> str:
    t = re.sub(r"\\(?:chapter|section|subsection|subsubsection|paragraph)\*?\s?\{([^{}]*)\}", r"\n# \1\n", t)
    t = re.sub(r"\\begin\s?\{(?:equation|align|displaymath)\*?\}(.*?)\\end\s?\{(?:equation|align|displaymath)\*?\}", lambda m: "$$" + m.group(1).strip() + "$$", t, flags=re.S)
    held: list[str] = []
    t = COMPILED["latex"].sub(lambda m: (held.append(m.group(0)) or f"\x00{len(held) - 1}\x00") if m.lastgroup == "math" else m.group(0), t)
    t = re.sub(r"[ \t]*\\item\b[ \t]*", "\n- ", t)
    t = re.sub(r"\\(?:begin|end)\s?\{[a-zA-Z]+\*?\}", "", t)
    t = re.sub(r"~?\\(?:ref|cite|eqref|label)\s?\{[^{}]*\}", "", t)
    t = re.sub(r"\\frac\s?\{([^{}]*)\}\s?\{([^{}]*)\}", r"\1/\2", t)
    for _ in range(3):
        t = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\[\]\n]*\])?\{([^{}]*)\}", r"\1", t)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m.group(1))], t)


def _html(t: str) -> str:
    t = re.sub(r"<!--.*?-->|<!DOCTYPE[^>]*>", "", t, flags=re.S)
    t = re.sub(r"(?i)<(script|style)\b[^>]*>.*?</\1>", "", t, flags=re.S)
    t = re.sub(r"(?i)<pre[^>]*>(.*?)</pre>", lambda m: "\n```\n" + re.sub(r"<[^>]+>", "", m.group(1)).strip("\n") + "\n```\n", t, flags=re.S)
    t = re.sub(r"(?i)<h([1-6])[^>]*>", lambda m: "\n" + "#" * int(m.group(1)) + " ", t)
    t = re.sub(r"(?i)<li[^>]*>", "\n- ", t)
    t = re.sub(r"(?i)<code[^>]*>(.*?)</code>", r"`\1`", t, flags=re.S)
    t = re.sub(r"(?i)</(?:p|div|h[1-6]|ul|ol|tr|table|blockquote)>|<br\s*/?>|<(?:p|div|tr|ul|ol)\b[^>]*>", "\n", t)
    t = ELEMENT.sub("", t)
    return html.unescape(re.sub(r"(&#?\w+)\s;", r"\1;", t)).replace("\xa0", " ")


def _markdown(t: str) -> str:
    t = re.sub(r"!\[([^\[\]\n]*)\]\s?\([^()]*\)", r"\1", t)
    t = re.sub(r"\[([^\[\]\n]*)\]\s?\([^()\n]*\n?[^()\n]*\)", r"\1", t)
    for name in ("bold", "strike", "emphasis"):
        t = re.sub(GRAMMARS["markdown"][name], lambda m: m.group(0).strip("*~_"), t)
    t = re.sub(GRAMMARS["markdown"]["table"], "", t, flags=re.M)
    t = re.sub(r"^> +", "", t, flags=re.M)
    return re.sub(r"^[ \t]*[*+] (?=\S)", "- ", t, flags=re.M)


RENDER = {"html": _html, "wiki": _wiki, "latex": _latex, "markdown": _markdown}


def clean(text: str | None, cut: set[str] | None = None) -> str | None:
    """Plain text of a marked-up one; headings '#', lists '-', code and formulas stay marked.

    ``cut`` names element paths of low importance; those branches are left out.
    """
    if not text:
        return text
    kinds = {k for k, _, _ in nodes(text)}
    if not kinds:
        return text
    if cut:
        spans = sorted((s, e) for path, _, _, s, e in elements(text) if path in cut)
        last, parts = 0, []
        for s, e in spans:
            if s >= last:
                parts.append(text[last:s])
                last = e
        text = "".join(parts) + text[last:]
    for kind, render in RENDER.items():
        if kind in kinds:
            text = render(text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip("\n")


#: Most rows of (host, path) that are shipped to the workers as they are; beyond, they are joined.
FEW = 100_000


def clean_texts(pages: DataFrame, low: float = 0.2, least_pages: int = 20) -> DataFrame:
    """(field, record_key, clean): every text rendered, unimportant branches of its host cut.

    A path is cut when its importance is below ``low`` over ``least_pages`` pages or
    more. The cut paths come to the texts, whole texts are not gathered by host:
    up to FEW of them with the function, more by a join in which hosts are salted.
    """
    cut = style_tree(pages).where((F.col("importance") < low) & (F.col("pages") >= least_pages)).select("host", "path")
    rows = cut.limit(FEW + 1).collect()
    if len(rows) <= FEW:
        paths: dict[str, set[str]] = {}
        for r in rows:
            paths.setdefault(r.host, set()).add(r.path)

        def render(fields, keys, hosts, texts):
            for f, k, host, text in zip(fields, keys, hosts, texts):
                yield f, k, clean(text, paths.get(host))

        return flat_map_batches(pages.select("field", "record_key", "host", "text"), render, "field string, record_key string, clean string")
    salts = 64
    per = cut.groupBy("host").agg(F.collect_set("path").alias("cut")).select("host", "cut", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("record_key"), F.lit(salts)).cast("int"))

    def render_joined(fields, keys, texts, cuts):
        for f, k, text, c in zip(fields, keys, texts, cuts):
            yield f, k, clean(text, set(c) if c else None)

    return flat_map_batches(merge_join(salted, per, ["host", "salt"], "left").select("field", "record_key", "text", "cut"), render_joined, "field string, record_key string, clean string")
