"""Personal information found in free text and replaced by typed placeholders (problem 6).

Structured entities (e-mail, phone, identity number, address) follow grammars
over a *view* of the text in which markup, line wraps, full-width forms and
invisible characters do not stand in the way; positions map back to the text.

Names are decided by disclosure. A term that stands in a context that speaks of a
person somewhere is looked for in every text, in whatever context; how often it
stands in such a context, against how often any candidate does, says how strongly
it discloses a person, in bits. A term of half the possible disclosure or more is
a name wherever it stands; a word that happens to stand in such a context once is
not. Every mention of a name is replaced, cued or not. Uses are counted with
partial aggregation and joined back; what is shipped is a bitmap of fixed size
that spares the workers most terms nobody asked for. The structured kinds disclose
by their form alone and have no terms.

Defined results: null, empty and blank texts hold nothing and redact to
themselves; repeated rows give one row; texts are read whole.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import regex as re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.functions.arrow import flat_map_batches
from notefold.functions.checkpoint import settle
from notefold.functions.joins import merge_join

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Full-width ASCII and a few variants by their ASCII form, one character each.
NARROW = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 32, 0xA0: 32, 0x2009: 32, 0x202F: 32, 0x2003: 32, 0x2010: 45, 0x2011: 45, 0x2013: 45, 0x2212: 45, 0x3014: 40, 0x3015: 41}
INVISIBLE = "­​‌‍⁠﻿"
NOISE = re.compile(
    rf"(?P<drop>[{INVISIBLE}]+|<[A-Za-z/!][^<>\n]{{0,120}}>|\*{{1,3}}(?!\d)|'{{2,3}}|`+|~~|\[\[(?:[^\[\]|\n]{{0,60}}\|)?|\]\]|\\(?:textbf|emph|texttt|textit)\s?\{{|(?<=[A-Za-z])[‐¬]\n(?=[A-Za-z])|(?<=-)\n|(?<=[A-Za-z0-9][#@])\n|(?<=\()\n|(?<=[#@][A-Za-z.]{{2,30}}\.)\n|\n(?=[#@)][A-Za-z]|\))|(?<=[A-Za-z0-9])\}}(?=[A-Za-z0-9.@])|(?<=[^\x00-\x7f])\n+|\n+(?=[^\x00-\x7f]))|(?P<space>\s*\n\s*|&nbsp;|\\(?:item|quad)\b)"
)

LOCAL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}"
DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|点)\s?[\])}]\s?|\s(?:dot|DOT)\s|。)"
HOST = rf"[A-Za-z0-9](?:[A-Za-z0-9-]{{0,62}})(?:{DOT}[A-Za-z0-9-]{{1,63}}){{0,4}}{DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])"
EMAIL = re.compile(rf"{LOCAL}(?:\s?@\s?|\s?[\[({{]\s?(?:at|AT|@|艾特)\s?[\])}}]\s?|\s(?:at|AT)\s(?=\S+\s(?:dot|DOT)\s)){HOST}|{LOCAL}\s?[#*]{HOST}(?=\s?\([#*]\s?(?:换成|改成|替换为|=|is|for)\s?@\s?\))")
#: Digits as Chinese writes them, with the one used for 1 on the phone.
HAN_DIGIT = "零〇一二三四五六七八九幺"
PHONE = re.compile(
    rf"(?<![\d.+-])(?:\(?(?:\+|00)?86\)?[-. ]?)?1[3-9]\d(?P<sep>[-. ]?)\d{{4}}(?P=sep)\d{{4}}(?![\d])(?![.-]\d)"
    rf"|(?<![{HAN_DIGIT}])[一幺][{HAN_DIGIT}]{{10}}(?![{HAN_DIGIT}])"
    r"|(?<![\d.-])\(?0\d{2,3}\)?[- ]\d{7,8}(?![\d-])"
    r"|(?<![\d.])(?:\+44[ -]?\(?0?\)?7\d{3}|07\d{3})[ -]?\d{3}[ -]?\d{3}(?!\d)"
    r"|(?<![\d.-])(?:\+?1[-. ]?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?![\d-])"
    r"|(?<![\d.])\+\d{1,3}[ -]\d{2,4}(?:[ -]\d{3,4}){2}(?!\d)"
)
ID_NUMBER = re.compile(r"(?<![\dA-Za-z.])[1-9]\d{5}(?P<s>[ -]?)(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?P=s)\d{3}[\dXx](?![\dA-Za-z])|(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
#: The words streets end with.
STREET_EN = "Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Close|Drive|Dr|Way|Court|Ct|Square|Terrace|Place|Crescent|Row|Hill|Walk"
#: Number and unit of a Chinese address; what stands before is read leftwards from it.
CORE_ZH = re.compile(r"(?<=\p{Han})(?:路|街|大道|巷|道|弄|坡|胡同|里)\s?\d{1,5}\s?(?:号|弄)(?!\p{Han}?线)(?:院|楼)?(?:\s?[·-]?\s?[A-Za-z\d一二三四五六七八九十]{1,4}\s?(?:座|栋|幢|号楼|单元|层|室)(?:\s?\d{1,4}\s?(?:室|层|号)?)?){0,4}(?:\s?\d{2,4}室?)?")
LEFT_ZH = [re.compile(p) for p in (r"\p{Han}{2}(?:省|市|县|州)(?=\p{Han}*$)", r"\p{Han}{2}(?:区|镇|乡|街道)(?=\p{Han}*$)", r"\p{Han}{1,4}$")]
ADDRESS_EN = re.compile(
    rf"(?<![\w$])\d{{1,5}}[A-Za-z]? (?:[A-Z][a-z]+(?:-[a-z]+)? ){{1,3}}(?:{STREET_EN})\b\.?(?:,? (?:Apt|Apartment|Suite|Unit|Flat|Floor|No|#)\.? ?[A-Z]?\d{{1,5}}[A-Z]?)?(?:, ?[A-Z][a-z]+(?: [A-Z][a-z]+)?(?: \d{{5}}(?:-\d{{4}})?)?)?"
)
HAS_STREET = re.compile(rf"\d [A-Z][a-z]+.{{0,40}}?\b(?:{STREET_EN})\b")
HAS_DIGITS = re.compile(rf"\d{{3}}|[{HAN_DIGIT}]{{11}}")
HAS_ID = re.compile(r"\d{6}|\d-\d\d-\d{4}")
#: Signs without which there is no address to write to.
AT_SIGNS = ("@", "#", "at]", "at)", "AT]", "AT)", " dot ", "艾特")
KINDS = ["email", "phone", "id_number", "address"]

#: Two-character surnames, then one-character surnames.
SURNAMES_2 = "欧阳 上官 司徒 司马 诸葛 夏侯 东方 皇甫 尉迟 公孙 慕容 令狐 轩辕 宇文 长孙 南宫 端木 独孤 百里 呼延".split()
SURNAMES_1 = "王李张刘陈杨黄赵周吴徐孙朱马胡郭林何高梁郑罗宋谢唐韩曹许邓萧冯曾程蔡彭潘袁于董余苏叶吕魏蒋田杜丁沈姜范江傅钟卢汪戴崔任陆廖姚方金邱夏谭韦贾邹石熊孟秦阎薛侯雷白龙段郝孔邵史毛常万顾赖武康贺严尹钱施牛洪龚汤陶黎温莫易樊乔文安殷颜庄章鲁倪庞邢俞翟蓝聂齐向申葛岳骆祁戚蔺霍虞纪柳裴卓柏宁柯阮季"
_NAME = rf"(?P<zh>(?:(?:{'|'.join(SURNAMES_2)})\p{{Han}}{{1,2}}?|[{SURNAMES_1}]\p{{Han}}{{1,2}}?))"
#: Words that follow a name at once; they end it.
AFTER = r"(?=[，,。.；;：:！!？?、（(\s]|$|同学|老师|女士|先生|帮我|也在|的|说|在|给|和|人很|回复|电话|邮箱|微信|推荐|内推|提醒|约我|问我|告诉|负责|带我)"
#: Contexts that speak of a person, before the name.
CUE_ZH = re.compile(rf"(?:联系人|收件人|感谢|多谢|谢谢|内推人|推荐人|介绍人|面试官(?:叫|是)|[Hh][Rr](?:叫|是|小姐姐)|同组的|同事|我叫|名叫|姓名|署名|经手人|负责人|导师|师兄|师姐|学长|学姐)(?:是|叫|为)?[：: ]{{0,2}}{_NAME}{AFTER}")
TITLED_ZH = re.compile(rf"{_NAME}(?=同学|老师|女士|先生|小姐|经理)")
#: Where a Chinese name can begin.
SURNAME_AT = re.compile(rf"(?:{'|'.join(SURNAMES_2)}|[{SURNAMES_1}])(?=\p{{Han}})")
_W = r"(?:[A-Z][’'])?[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}(?:[-’'][A-Za-zÀ-ÖØ-öø-ÿ]{2,20})?"
#: Candidates in English: two or three capitalised words, initials between them; contexts are read to left and right.
PLAIN_EN = re.compile(rf"(?<![A-Za-zÀ-ÿ])(?=({_W}(?: [A-Z]\.){{0,2}} {_W})(?P<third> {_W})?(?![A-Za-zÀ-ÿ]))")
CUE_LEFT = re.compile(
    r"(?:(?:interviewer|recruiter|manager|mentor|colleague|engineer|referrer|contact),? (?:is |was |named |called )?|(?:[Tt]hanks|[Tt]hank you|[Cc]redit|[Kk]udos) to |(?:[Aa]sk for|[Rr]each|[Cc]ontact:?|[Ee]mail|[Mm]essage|[Cc]all|[Mm]et|[Tt]ell|Dear|[Ww]rite to|[Tt]alk to|[Ss]peak (?:to|with)|referred by|signed by|named|[Nn]ame:|name is|I am|Mr\.?|Ms\.?|Mrs\.?|Dr\.?) )$"
)
CUE_RIGHT = re.compile(r" via \S+(?:@|\s?[\[(]at|#)")
NAME_RULES = [(CUE_ZH, "zh"), (TITLED_ZH, "zh")]


def view(text: str, mapped: bool = False) -> tuple[str, list[int], list[int]]:
    """The text as a reader takes it; with ``mapped``, segment starts in the view and in the text."""
    t = text.translate(NARROW) if not text.isascii() else text
    if not mapped:
        return NOISE.sub(lambda m: "" if m.lastgroup == "drop" else " ", t), [], []
    out, at_view, at_text, n, last = [], [], [], 0, 0
    for m in NOISE.finditer(t):
        out.append(t[last : m.start()])
        at_view.append(n)
        at_text.append(last)
        n += m.start() - last
        if m.lastgroup == "space":
            out.append(" ")
            at_view.append(n)
            at_text.append(m.start())
            n += 1
        last = m.end()
    out.append(t[last:])
    return "".join(out), at_view + [n], at_text + [last]


def addresses(v: str) -> list[tuple[int, int]]:
    found = []
    if "号" in v or "弄" in v:
        for m in CORE_ZH.finditer(v):
            a = max(0, m.start() - 18)
            start = next((a + left.start() for rx in LEFT_ZH if (left := rx.search(v[a : m.start()]))), m.start())
            found.append((start, m.end()))
    if HAS_STREET.search(v):
        found += [m.span() for m in ADDRESS_EN.finditer(v)]
    return found


def structured(v: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in a view; of overlapping finds of two kinds the earlier of KINDS holds."""
    found: list[tuple[str, int, int]] = []
    digits = HAS_DIGITS.search(v)
    spans = {
        "email": [m.span() for m in EMAIL.finditer(v)] if any(x in v for x in AT_SIGNS) else [],
        "phone": [m.span() for m in PHONE.finditer(v)] if digits else [],
        "id_number": [m.span() for m in ID_NUMBER.finditer(v)] if HAS_ID.search(v) else [],
        "address": addresses(v),
    }
    for kind in KINDS:
        for s, e in spans[kind]:
            if not any(a < e and s < b for _, a, b in found):
                found.append((kind, s, e))
    return found


def english(v: str):
    """(term, start, end) of two-word and three-word candidates, at every place where one can begin."""
    for m in PLAIN_EN.finditer(v):
        s, e = m.span(1)
        yield m.group(1), s, e
        if m.group("third"):
            yield v[s : m.end("third")], s, m.end("third")


def key_of(term: str) -> str:
    return term.replace("-", "") if term.isascii() else term


def cued_names(v: str, pairs: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """(term, start, end) of candidates in a context that speaks of a person; ``pairs`` are the English ones, if known."""
    found: dict[tuple[int, int], str] = {}
    for rx, g in NAME_RULES:
        for m in rx.finditer(v):
            span = m.span(g)
            if not any(s < span[1] and span[0] < e for s, e in found):
                found[span] = m.group(g)
    for term, s, e in english(v) if pairs is None else pairs:
        if CUE_LEFT.search(v[max(0, s - 28) : s]) or CUE_RIGHT.match(v, e):
            found[s, e] = key_of(term)
    return [(term, s, e) for (s, e), term in found.items()]


def uses(v: str, known) -> list[tuple[str, int, int]]:
    """(term, start, end) of candidates for which ``known(term)`` holds, in any context, the longest at each place."""
    found = []
    if not v.isascii():
        for m in SURNAME_AT.finditer(v):
            s = m.start()
            for n in (4, 3, 2):
                term = v[s : s + n]
                if len(term) == n and known(term):
                    found.append((term, s, s + n))
                    break
    for term, s, e in english(v):
        if known(key_of(term)):
            found.append((key_of(term), s, e))
    return found


#: Numbers of bits of the filter of wanted terms; fixed, so its size is bounded.
FILTER = 1 << 20


def slot(term: str) -> int:
    return xxhash.xxh64_intdigest(term) & (FILTER - 1)


def cues(texts: DataFrame) -> DataFrame:
    """(field, record_key, kind, term, n): structured kinds without a term, cued names with theirs, and of each batch how many candidates it has (kind null)."""
    def scan(fields, keys, column):
        candidates = 0
        for f, k, text in zip(fields, keys, column):
            v, _, _ = view(text)
            for kind in {kind for kind, _, _ in structured(v)}:
                yield f, k, kind, None, 1
            pairs = list(english(v))
            for term in {term for term, _, _ in cued_names(v, pairs)}:
                yield f, k, "name", term, 1
            candidates += len({s for _, s, _ in pairs}) + (0 if v.isascii() else len(SURNAME_AT.findall(v)))
        yield None, None, None, None, candidates

    return flat_map_batches(texts.select("field", "record_key", "text"), scan, "field string, record_key string, kind string, term string, n bigint")


def mentions(texts: DataFrame, cued: DataFrame) -> DataFrame:
    """(field, record_key, term): every record that mentions a term which is cued in some record."""
    terms = cued.where(F.col("kind") == "name").select("term").distinct()
    wanted = np.zeros(FILTER, bool)
    bins = flat_map_batches(terms, lambda column: ((slot(t),) for t in column), "bin int").distinct().toArrow()
    wanted[bins.column("bin").to_numpy()] = True

    def scan(fields, keys, column):
        for f, k, text in zip(fields, keys, column):
            v, _, _ = view(text)
            for term in {term for term, _, _ in uses(v, lambda t: wanted[slot(t)])}:
                yield f, k, term

    return flat_map_batches(texts.select("field", "record_key", "text"), scan, "field string, record_key string, term string")


def disclosure(cued: DataFrame, used: DataFrame) -> DataFrame:
    """(term, n, n_cued, bits, share): how far a term raises the chance of a person context above any candidate's.

    ``share`` is the part of the greatest possible disclosure, that of a term which
    stands in person contexts alone.
    """
    counted = cued.where(F.col("kind") == "name").select("term", F.lit(1).alias("c"), F.lit(0).alias("u")).unionByName(used.select("term", F.lit(0).alias("c"), F.lit(1).alias("u")))
    terms = counted.groupBy("term").agg(F.sum("c").alias("n_cued"), F.greatest(F.sum("u"), F.sum("c")).alias("n")).where(F.col("n_cued") > 0)
    total = cued.agg(F.sum(F.when(F.col("kind") == "name", F.col("n"))).alias("c"), F.sum(F.when(F.col("kind").isNull(), F.col("n"))).alias("all")).first()
    base = min(0.5, max(total["c"] or 1, 1) / max(total["all"] or 1, 1))
    bits = F.log2(F.col("n_cued") / F.col("n") / F.lit(base))
    return terms.select("term", "n", "n_cued", bits.alias("bits"), (bits / F.lit(-math.log2(base))).alias("share"))


def named(texts: DataFrame, least_share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Cue rows, and (field, record_key, term) of the mentions of terms whose disclosure reaches ``least_share`` of the possible.

    A frequent name has many mentions, so terms are joined by sorting, which splits hot keys.
    """
    cued = settle(cues(texts))
    used = settle(mentions(texts, cued).unionByName(cued.where(F.col("kind") == "name").select("field", "record_key", "term")).distinct())
    known = disclosure(cued, used).where(F.col("share") >= least_share).select("term")
    return cued, merge_join(used, known, "term", "left_semi")


def personal_found(texts: DataFrame) -> DataFrame:
    """Distinct (field, record_key, kind)."""
    cued, names = named(texts)
    return cued.where(F.col("kind") != "name").select("field", "record_key", "kind").unionByName(names.select("field", "record_key", F.lit("name").alias("kind"))).distinct()


def redact(text: str | None, known: set[str] | None) -> str | None:
    """The text with typed placeholders; every mention of the names ``known`` is replaced."""
    if not text:
        return text
    v, at_view, at_text = view(text, True)
    spans = structured(v)
    if known:
        spans += [("name", s, e) for _, s, e in sorted(uses(v, known.__contains__) + [c for c in cued_names(v) if c[0] in known], key=lambda x: x[1] - x[2])]
    if not spans:
        return text

    def back(i: int) -> int:
        j = bisect_right(at_view, i) - 1
        return at_text[j] + i - at_view[j]

    parts, last = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        a, b = back(s), back(e - 1) + 1
        if a >= last:
            parts += [text[last:a], PLACEHOLDER[kind]]
            last = b
    return "".join(parts) + text[last:]


def redacted(texts: DataFrame) -> DataFrame:
    """(field, record_key, redacted) of every distinct text."""
    _, names = named(texts)
    per = names.groupBy("field", "record_key").agg(F.collect_set("term").alias("terms"))

    def apply(fields, keys, column, terms):
        for f, k, text, t in zip(fields, keys, column, terms):
            yield f, k, redact(text, set(t) if t else None)

    return flat_map_batches(merge_join(texts.select("field", "record_key", "text").distinct(), per, ["field", "record_key"], "left").select("field", "record_key", "text", "terms"), apply, "field string, record_key string, redacted string")
