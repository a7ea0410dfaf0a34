"""Template residue, filler and error-page text (problem 3).

Placeholders are found by one grammar per delimiter. A placeholder is let off
when its context is code or talk about templates, or when most placeholders of
its delimiter are; a title or body that *consists* of filler, an error message or
a notice is judged by its parts.

Defined results: null and blank fields give no row; repeated rows give one row;
texts are read whole, whatever their length.
"""

from __future__ import annotations

from bisect import bisect_left

import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.functions.arrow import flat_map_batches
from notefold.functions.joins import merge_join

#: Bracketed capitals that are log or list marks rather than slots.
MARKS = ["ERROR", "WARN", "WARNING", "INFO", "DEBUG", "TRACE", "FATAL", "TODO", "FIXME", "DONE", "OK", "FAIL", "PASS", "IMG", "URL", "NOTE"]
#: Words that ask for input or stand for it.
ASK_EN = r"(?:your|insert|enter|add|type|fill in|placeholder|replace|put|write|here)"
ASK_ZH = r"(?:此处|请填写|填写|请输入|输入|替换|待填|待补|占位|某某|XX)"
SLOT_ZH = r"(?:名称|姓名|公司|岗位|部门|日期|时间|地点|轮次|标题|正文|作者|内容)"

#: One grammar for each delimiter pair: name, opening to closing.
GRAMMARS = {
    "double_brace": r"\{\{-?\s*[\p{L}_][\p{L}\d_. |-]{0,60}?\s*-?\}\}",
    "dollar_brace": r"\$\{(?:[a-z_]\w*(?:\.\w+)*|\p{Han}{1,12})\}",
    "hash_brace": r"(?<![\p{L}\d&])#\{[\p{L}_][\p{L}\d_.]{0,40}\}",
    "percent_paren": r"%\([A-Za-z_]\w{0,40}\)[sdfr]",
    "angle": r"<<\s*[\p{L}_][\p{L}\d_ ]{0,40}>>",
    "at_pair": r"@@[A-Za-z_]\w{1,40}@@",
    "percent_pair": r"%%[A-Za-z_]\w{1,40}%%|(?<![\w%])%[A-Z][A-Z_]{2,40}%(?![\w%])",
    "single_brace": r"(?<![A-Za-z0-9_}^\\${#\])])\{(?:[a-z][a-z_]{1,30}|\d)\}(?![}({\[])",
    "square": r"(?<![\[\p{L}\d\]!\\])\[(?:[A-Z][A-Z_ ]{2,30}|" + ASK_EN + r"\b[^\[\]\n]{0,40}|[^\[\]\n]{1,40}\bhere|" + ASK_ZH + r"[^\[\]\n]{0,20}|\p{Han}{0,10}" + SLOT_ZH + r")\](?![\](\[])",
    "lenticular": r"【[^【】\n]{0,10}" + ASK_ZH + r"[^【】\n]{0,20}】",
}
PLACEHOLDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in GRAMMARS.items()))
SQUARE_CASE = re.compile(r"(?<![\[\p{L}\d\]!\\])\[(?:" + ASK_EN + r"\b[^\[\]\n]{0,40}|[^\[\]\n]{1,40}\bhere)\](?![\](\[])", re.I)
CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]+`|<(code|pre)\b[^>]*>.*?</\1>|\\begin\{(verbatim|lstlisting)\}.*?\\end\{\2\}", re.S | re.I)
#: Words by which a sentence talks about templates or shells.
TALK = re.compile(r"模板引擎|插值|占位符|字符串格式化|shell|printf|Jinja|Vue|Mustache|Handlebars|template engine|interpolat|f-string|env(?:ironment)? var|环境变量|compiled", re.I)
#: Ends of a sentence.
STOP = re.compile(r"[。！？!?\n]|\.(?=\s)")

#: Messages of a failed page.
ERRORS = [
    r"(?:HTTP )?(?:error|错误(?:码)?|状态码)[ :：]*[45]\d\d", r"HTTP ERROR [45]\d\d", r"[45]\d\d[ :：-]*(?:Not Found|Bad Gateway|Service (?:Temporarily )?Unavailable|Gateway Time-?out|Forbidden|Gone|Unauthorized|Bad Request|Too Many Requests|Internal Server Error|Request Timeout)",
    r"(?:Internal )?Server Error", r"(?:Page )?Not Found", r"Bad Gateway", r"Service Unavailable", r"Gateway Timeout", r"Access denied", r"Forbidden", r"Page (?:unavailable|not found)", r"Oops[,!.， ]*(?:nothing here|something went wrong)?", r"nothing here", r"Request (?:blocked|failed|timed out)", r"出错(?:啦|了)", r"网络开小差了?", r"Something went wrong", r"This page (?:isn.t|is not) (?:available|working)",
    r"服务器(?:内部)?错误", r"系统(?:繁忙|错误|异常|维护中?)", r"加载失败", r"网络(?:错误|异常|繁忙|连接失败)", r"请求(?:失败|超时)", r"页面(?:不见了|不存在|已?失效|走丢了|出错了?|无法(?:访问|打开|显示|渲染))", r"你?您?访问的(?:页面|内容|笔记)(?:走丢了|不存在|不见了|已删除|已失效)", r"当前内容无法展示", r"内容(?:不存在|已删除|无法(?:展示|显示|查看))", r"该?(?:此)?(?:笔记|内容|帖子|文章|页面)已?被?(?:作者)?(?:隐藏|删除|下架|屏蔽)", r"访问(?:过于频繁|受限|被拒绝|太频繁)", r"操作(?:过于|太)?频繁", r"(?:暂)?无(?:权限)?(?:访问|查看)(?:权限)?", r"undefined", r"null", r"NaN", r"None", r"\[object Object\]", r"#N/A", r"nil",
]
#: Notices that ask for scripts, verification or login.
NOTICES = [
    r"(?:本页|该页面|此页面|网站|页面)?(?:需要|要求)(?:启用|开启|支持)? ?(?:JavaScript|JS|脚本)(?: ?支持)?", r"请?(?:启用|开启|打开|允许(?:运行)?)(?:浏览器的?)? ?(?:JavaScript|JS|脚本)(?:功能)?(?:后.{0,8})?", r"请启用后(?:刷新|重试|继续.{0,4})", r"为了正常(?:显示|浏览)(?:内容|页面)?", r"检测到脚本被(?:拦截|禁用|屏蔽)", r"请开启浏览器的脚本功能后继续浏览",
    r"(?:Please )?(?:turn on|enable|allow|activate) (?:JavaScript|JS|scripts?|cookies)(?: .{0,40})?", r"You need to enable (?:JavaScript|scripts)(?: .{0,40})?", r"(?:Your browser|This browser) has (?:scripts|JavaScript) disabled", r"enable them to continue", r"JavaScript is (?:disabled|required|not enabled).{0,40}", r"This (?:page|site|app) (?:requires|needs) (?:JavaScript|scripts).{0,30}",
    r"请?(?:先)?完成(?:安全|人机|滑块|身份)?验证(?:后.{0,8})?", r"拖动(?:左边|下方)?滑块.{0,10}", r"(?:点击|请)?(?:进行|通过)?(?:安全|人机)验证(?:后.{0,8})?", r"Checking your browser(?: before .{0,30})?", r"(?:Please )?verify (?:that )?you are (?:a )?human.{0,30}", r"(?:Please )?complete the (?:captcha|security check).{0,30}", r"正在跳转", r"如?长时间未响应.{0,10}", r"Redirecting.{0,30}",
    r"请?(?:先)?登录(?:后|以|即可|账号)?(?:查看|继续|阅读|浏览|访问)?.{0,8}", r"(?:Please )?(?:log|sign) ?in to .{0,30}", r"登录后可见.{0,6}",
]
#: Default texts of input fields.
DEFAULTS = [
    r"(?:请|在这里|在此|点击)?(?:输入|填写|添加|编辑)(?:一下|你的|您的)?(?:标题|正文|内容|文字|文本|描述|简介)", r"分享你的.{0,8}", r"(?:Your|Add(?: a)?|Enter(?: a| your)?|Insert(?: a| your)?) ?(?:title|content|text|body|description|headline) ?(?:goes )?(?:here)?", r"Type (?:your text|something|here).{0,10}", r"(?:标题|正文|内容|文字|文本)占位(?:文字|文本|符)?", r"(?:这里|此处)是(?:内容|标题|正文|文字)", r"示例(?:文本|标题|内容|文字)", r"测试(?:标题|内容|文本|数据)?", r"(?:无标题|未命名|新建(?:笔记|文档)|Untitled(?: note| document)?|New note)", r"placeholder(?: text)?", r"title|text|content|body|foo|bar|baz|asdf|qwer(?:ty)?|test|xxx+|aaa+|bbb+", r"lorem ipsum.*", r"TBD|TODO|待补充?|待填写?",
]
#: What follows an error message.
TAILS = [r"错误码?[ :：]?\w{0,12}", r"请?(?:稍后|稍候)(?:再试|重试|访问)?", r"若?多次出现请?反馈? ?\w{0,12}", r"点击(?:刷新|重试|返回)", r"请?返回(?:首页|上一页)", r"去看看别的吧?", r"刷新(?:重试|页面)", r"(?:please )?(?:try|come) (?:again|back) ?(?:later)?", r"(?:please )?go back(?: .{0,12})?", r"upstream did not answer", r"the link may be broken", r"(?:ref|code|id|trace|request id)[ :：#]*\w{0,16}", r"nginx.{0,12}", r"[a-z_]+=\w+", r"联系(?:管理员|客服)"]


def _whole(parts: list[str]) -> re.Pattern:
    return re.compile("(?:" + "|".join(f"(?:{p})" for p in parts) + ")", re.I)


ERROR, NOTICE, DEFAULT, TAIL = map(_whole, (ERRORS, NOTICES, DEFAULTS, TAILS))
SPLIT = re.compile(r"\s*(?:[\n|。！!…，、；;]|\.(?=\s|$)|,(?=\s)| [-–—·:] |\s{2,})+\s*")
#: Function words; running text in these languages cannot do without.
FUNCTION_WORDS = set(
    "a an the and or but if of to in on at for with from by as is are was were be been it its this that these those i you he she we they my your our their not no so then than when how what why who which had has have do did does will would can could should about into after before over under because although since while once only "
    "le la les un une des du de et à en pour par sur avec dans est il elle on nous ce qui que m’a l’ au aux el los las una y o con para por es se lo no más como der die das und ein eine ist nicht mit zu von für auf im in den dem es ich wir hätte wurde".split()
)
LATIN_SENTENCE = re.compile(r"(?:[A-Z]?[a-z]{2,}[,.]?\s+){3,}[A-Z]?[a-z]{2,}[.!?]?")
NOT_WORD = re.compile(r"[\W_]+")


def periodic(text: str) -> bool:
    """Whether the letters of the text are one unit, twice or more."""
    s = NOT_WORD.sub("", text)
    return len(s) >= 4 and (s + s).find(s, 1) < len(s)


def pseudo_latin(text: str, known: frozenset[str] = frozenset()) -> bool:
    """Filler in the manner of lorem ipsum: sentences of plain lower-case words without one function word."""
    if not text.isascii():
        return False
    whole = LATIN_SENTENCE.sub("", text)
    if NOT_WORD.sub("", whole):
        return False
    words = [w.lower() for w in re.findall(r"[A-Za-z]+", text)]
    return len(words) >= 4 and text.rstrip()[-1:] in ".!?" and not FUNCTION_WORDS.intersection(words)


def consists_of(text: str) -> str | None:
    """'filler', 'error' or 'notice' when the whole text is that and nothing else, else None."""
    t = text.strip()
    if not t:
        return None
    if periodic(t) or pseudo_latin(t):
        return "filler"
    kind = None
    for part in [t] if ERROR.fullmatch(t) else SPLIT.splititer(t):
        part = part.strip(" \t\r\"'“”()（）【】.。…!！?？")
        if not part:
            continue
        if ERROR.fullmatch(part):
            kind = kind or "error"
        elif NOTICE.fullmatch(part):
            kind = kind or "notice"
        elif DEFAULT.fullmatch(part) or periodic(part):
            kind = kind or "filler"
        elif not TAIL.fullmatch(part):
            return None
    return kind


def placeholders(text: str) -> list[str]:
    """Unfilled placeholders of the text, without those that it talks about.

    A placeholder in code, or in a sentence that talks about templates, is let off.
    Density decides about the others: where half or more of the placeholders of one
    delimiter are let off, the text is about that delimiter, a tutorial, and the
    rest of them are let off too.
    """
    if not any(c in text for c in "{}[]<>@%【"):
        return []
    found = [(m.lastgroup, m) for m in PLACEHOLDER.finditer(text)]
    if "[" in text:
        found += [("square", m) for m in SQUARE_CASE.finditer(text)]
    if not found:
        return []
    spans = [m.span() for m in CODE.finditer(text)] if ("`" in text or "<" in text or "\\begin" in text) else []
    talk = [m.start() for m in TALK.finditer(text)]
    stops = [m.start() for m in STOP.finditer(text)] if talk else []
    kept: list[tuple[str, str]] = []
    off: dict[str, int] = {}
    for delimiter, m in found:
        s, e = m.span()
        inner = m.group(0)
        if inner[1:-1] in MARKS:
            continue
        i, j = bisect_left(stops, s), bisect_left(stops, e)
        a, b = stops[i - 1] + 1 if i else 0, stops[j] if j < len(stops) else len(text)
        if any(p <= s < q for p, q in spans) or any(a <= t < b and not s <= t < e for t in talk[bisect_left(talk, a) : bisect_left(talk, b)]):
            off[delimiter] = off.get(delimiter, 0) + 1
        else:
            kept.append((delimiter, inner))
    left: dict[str, int] = {}
    for delimiter, _ in kept:
        left[delimiter] = left.get(delimiter, 0) + 1
    return [inner for delimiter, inner in kept if off.get(delimiter, 0) < left[delimiter]]


def residue(text: str | None) -> list[tuple[str, str]]:
    """(kind, evidence) of one field: 'placeholder', 'filler', 'error', 'notice'. Null and blank give none."""
    if text is None or not text.strip():
        return []
    found = [("placeholder", p) for p in dict.fromkeys(placeholders(text))]
    whole = consists_of(text)
    return found + ([(whole, text.strip()[:80])] if whole else [])


def template_residue(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows (key, field, kind, evidence) for each field with residue, one per row of ``df`` and finding."""
    def scan(keys, *columns):
        for name, column in zip(fields, columns):
            for k, text in zip(keys, column):
                for kind, evidence in residue(text):
                    yield k, name, kind, evidence

    return flat_map_batches(df.select(key, *fields), scan, f"{key} string, field string, kind string, evidence string")


def residue_found(notes: DataFrame) -> DataFrame:
    return template_residue(notes, "note_id", ["title", "body_text"]).select("note_id", "field").distinct()


def real_content(notes: DataFrame) -> DataFrame:
    """Note rows without residue and with a body that is not blank; extra columns pass through."""
    bad = residue_found(notes).select("note_id").distinct()
    return merge_join(notes.where(F.length(F.trim("body_text")) > 0), bad, "note_id", "left_anti")
