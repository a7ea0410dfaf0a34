"""Noise in text from scanned pages repaired (problem 1).

Misread characters are corrected by a noisy channel: confusion probabilities of
characters times n-gram likelihood of the corpus, decoded by Viterbi over the
candidate words of each line. Word and bigram counts of all pages go into two
tables of fixed size, the only thing shipped to the workers. Words split over
lines are joined where the corpus knows the joined word; running headers are
lines that stand, read well or badly, above the content of two or more pages of
a note; page numbers are lines above or below the content.

Defined results: pages with null or empty text have no noise and no paragraphs;
repeated rows count once; a page of any length is read whole; pages without a
note id or image index keep their own header and page-number lines apart.
"""

from __future__ import annotations

import math
import re as builtin_re
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import regex as re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.functions.arrow import flat_map_batches
from notefold.functions.joins import merge_join
from notefold.llm.lookalikes import normalize_text

#: Counters of each table, a power of two; fixed, so their size is bounded.
BINS = 1 << 20
#: What a Latin character is read as, by how often (true, read, probability).
CONFUSION = [("e", "c", 0.02), ("a", "@", 0.02), ("t", "f", 0.02), ("o", "0", 0.02), ("l", "1", 0.02), ("i", "1", 0.01), ("i", "l", 0.01), ("h", "b", 0.01), ("s", "5", 0.01), ("g", "9", 0.01), ("B", "8", 0.01), ("m", "rn", 0.01), ("rn", "m", 0.01), ("l", "I", 0.01), ("I", "l", 0.01), ("O", "0", 0.01), ("S", "5", 0.01), ("l", "|", 0.01), ("cl", "d", 0.005), ("d", "cl", 0.005), ("w", "vv", 0.005), ("z", "2", 0.005), ("b", "6", 0.005), ("q", "9", 0.005), ("s", "$", 0.01), ("E", "£", 0.005)]
#: Han characters that are read for one another.
HAN_PAIRS = "已己 未末 日曰 土士 千干 人入 天夫 大太 体休 复夏 锁销 索素 缓援 线钱 幂幕 熔溶 性牲 并井 比此 王玉 延廷 治冶 往住 侯候 拆折 析折 找我 贷货 晴睛 辨辩 拔拨 免兔 鸟乌 刀力 几儿 木本 今令 目自 田由 白自 微徽 载裁 推堆 准淮 决快 清请 数教 历厉 压庄 限恨 栈钱 链琏 据椐 面而 试式 端瑞 题颗 密蜜 端湍 墙樯 峰蜂 播插 储诸 查杳 询洵 池地 程桯 统绕 志忘 效郊 率卒 层屋 构枸 测侧 轮抡 锋峰 集隼 群郡 码妈 机杌 迟退 通诵 账帐 户尸 网冈 务夯 云去 库厍 存仔"
#: By what was read: (true, log probability).
READ_AS: dict[str, list[tuple[str, float]]] = {}
for _t, _r, _p in CONFUSION:
    READ_AS.setdefault(_r, []).append((_t, math.log(_p)))
HAN_READ: dict[str, list[str]] = {}
for _a, _b in (p for p in HAN_PAIRS.split()):
    HAN_READ.setdefault(_a, []).append(_b)
    HAN_READ.setdefault(_b, []).append(_a)
#: Classes of the confusions, by which lines read well or badly are the same.
FOLD = str.maketrans({"c": "e", "@": "a", "f": "t", "0": "o", "1": "l", "i": "l", "|": "l", "b": "h", "5": "s", "$": "s", "9": "g", "8": "h", "q": "g"})
HAN_FOLD = {}
for _a, _b in (p for p in HAN_PAIRS.split()):
    HAN_FOLD[_b] = HAN_FOLD.get(_a, _a)
HAN_FOLD = str.maketrans(HAN_FOLD)

#: Ranges of Han characters, for the built-in expressions, which find units in two thirds of the time.
HAN = "".join(f"{m[0]}-{m[-1]}" for m in re.findall(r"\p{Han}+", "".join(map(chr, range(0x2E80, 0x40000)))))
UNIT = builtin_re.compile(rf"[A-Za-zÀ-ÿœ0-9@|$£]+|[{HAN}]")
WORDLIKE = builtin_re.compile(r"[A-Za-zÀ-ÿœ]")
#: A run of letters is tried where it begins or where the last match ended, not again at each of its letters; so in split words.
RUN = r"(?:(?<![A-Za-z0-9._+-])|\G)[A-Za-z0-9._+-]++"
MASK = re.compile(rf"{RUN}\s?[@＠#]\s?[A-Za-z0-9-]++\.[A-Za-z0-9.-]++|https?://\S+|{RUN} ?[\[(](?:at|AT)[\])]|(?<![A-Za-z0-9._-])[A-Za-z]++(?:[._-][A-Za-z]++)++\d++")
#: Signs without which there is nothing to mask.
MASK_SIGNS = ("@", "＠", "#", "://", "[at", "(at", "[AT", "(AT")
CAMEL = builtin_re.compile(r"(?<=[a-zà-ÿ0-9@|$£])(?=[A-Z])")
COMPOUND = re.compile(r"[A-Za-zÀ-ÿ]+-[A-Za-zÀ-ÿ]+")
LINE_HYPHEN = re.compile(r"[-‐‑¬][ \t]*\n")
SPLIT_WORD = re.compile(r"(?:(?<![A-Za-zÀ-ÿœ0-9@])|\G)([A-Za-zÀ-ÿœ0-9@]++)([-‐‑¬])[ \t]*\n[ \t]*([A-Za-zÀ-ÿœ0-9@]+)(?![A-Za-z0-9._-]*\s?[@＠#(\[])")


#: Most confusions of a word that a reading may undo.
MOST = 4
#: Beginnings of words are known at multiples of so many characters.
STEP = 3
#: Characters that something else may be read as.
READ_SIGNS = builtin_re.compile("[" + "".join(builtin_re.escape(c) for c in sorted({r[0] for r in READ_AS})) + "]")

#: A sign or digit between the letters of a word.
INNER_SIGN = builtin_re.compile(r"[A-Za-z][@|$£0-9]+[a-z]|^[@|$£0-9][a-z]{2,}|[a-z]{2,}[@|$£0-9]$")


def slots(unit: str) -> tuple[int, int]:
    """Places of a unit in the two halves of a table; the smaller count is nearer the truth."""
    h = xxhash.xxh64_intdigest(unit)
    half = BINS // 2
    return h & (half - 1), half + ((h >> 32) & (half - 1))


def units_of(text: str) -> list[str]:
    return UNIT.findall(MASK.sub(" ", text) if any(s in text for s in MASK_SIGNS) else text)


class Memo(dict):
    """Results of a function of one argument, looked up like a dict; begun anew beyond ``most`` of them."""

    def __init__(self, fn: Callable, most: int) -> None:
        self.fn, self.most = fn, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.fn(key)
        return value


class Model:
    """Unit and bigram counts in fixed tables (count-min, two rows each)."""

    def __init__(self, one: np.ndarray, two: np.ndarray) -> None:
        self.one, self.two = one, two
        self.total = float(one[: BINS // 2].sum()) + 1.0
        #: The greatest count of any unit: what is so frequent that nothing can be far better known is not searched.
        self.most = float(min(one[: BINS // 2].max(), one[BINS // 2 :].max()))
        self._count = Memo(self._counted, 500_000)
        #: By unit: (word, log channel probability) of what it may have been; empty when nothing better is known.
        self.readings = Memo(self._find, 300_000)
        #: The same by a Han character and its neighbours.
        self.han_readings = Memo(self._find_han, 300_000)

    def __reduce__(self):
        return Model, (self.one, self.two)

    def _counted(self, unit: str) -> float:
        i, j = slots(unit)
        return float(min(self.one[i], self.one[j]))

    def seen(self, unit: str) -> float:
        return self._count[unit]

    def pair(self, a: str, b: str) -> float:
        i, j = slots(a + " " + b)
        return float(min(self.two[i], self.two[j]))

    def count(self, unit: str) -> float:
        """Of a word, or from the rarest part of a name written in camel case."""
        n = self.seen(unit)
        parts = CAMEL.split(unit)
        if len(parts) > 1:
            n = max(n, 0.05 * min(self.seen("." + p) for p in parts))
        return n

    def trust(self, unit: str, alts: list) -> float:
        """Share of a unit's counts that are not misreadings: small where far better known readings exist."""
        return 1.0 if not alts or len(unit) == 1 else 0.0 if INNER_SIGN.search(unit) else 0.2

    def follows(self, a: str, b: str, trust_a: float, trust_b: float) -> float:
        """Log probability of b after a, backed off to b alone."""
        alone = (trust_b * self.count(b) + 0.01) / self.total
        return math.log((trust_a * trust_b * self.pair(a, b) + 4.0 * alone) / (trust_a * self.count(a) + 4.0))

    def _find_han(self, key: tuple[str, str, str]) -> list[tuple[str, float]]:
        """Characters that the neighbours of a Han character speak for clearly, with the channel probability."""
        before, read, after = key
        old = self.pair(before, read) + self.pair(read, after)
        known = []
        for true, p in self.readings[read]:
            left, right = self.pair(before, true) if before else 1, self.pair(true, after) if after else 1
            if min(left, right) >= 1 and left + right > 8 * (old + 1):
                known.append((true, p))
        return known

    def _find(self, unit: str) -> list[tuple[str, float]]:
        if len(unit) == 1:
            return [(t, math.log(0.002)) for t in HAN_READ.get(unit, ())]
        if len(unit) < 3 or not WORDLIKE.search(unit) or not READ_SIGNS.search(unit):
            return []
        parts = CAMEL.split(unit)
        if len(parts) == 1:
            return self._search(unit, "")
        # a name in camel case: its parts one by one, then a changed border between parts
        out = [("", 0.0)]
        changed = False
        for p in parts:
            better = self._search(p, ".") if READ_SIGNS.search(p) else []
            changed |= bool(better)
            out = [(w + o, c + q) for w, c in out for o, q in better or [(p, 0.0)]]
        return out if changed else self._search(unit, None)

    def needed(self, own: float, sign: bool, changes: int) -> float:
        """Count that a reading by so many confusions must have to be far better known than the unit."""
        return 4 + 2 * own if sign else 5 + 8 * own if changes < 3 else 30 + 40 * own

    def _search(self, unit: str, mark: str | None) -> list[tuple[str, float]]:
        """Readings of fewest confusions (MOST at most) that the corpus knows far better than the unit itself.

        The unit is walked from one place that may be misread to the next; a walk ends where no
        word of the corpus begins so, whatever the number of characters that may be misread.
        """
        count, end = self._count, len(unit)
        seen = self.count if mark is None else (lambda w: count[mark + w])
        own, sign = seen(unit), INNER_SIGN.search(unit) is not None
        if self.needed(own, sign, 1) > self.most:
            return []
        spots = [i for i in range(end) if unit[i] in READ_AS or unit[i : i + 2] in READ_AS]
        best: dict[int, list[tuple[str, float]]] = {}
        fewest = 1 if mark is None else MOST
        stack = [(0, "", 0, 0.0)]
        while stack:
            at, made, changes, cost = stack.pop()
            # as it was read up to the next place that may be misread, or to the end when no confusion is left
            spot = next((i for i in spots if i >= at), end) if changes < fewest else end
            if spot > at:
                word = made + unit[at:spot]
                if not self._begins(word, len(made), spot == end, mark):
                    continue
                at, made = spot, word
            if at == end:
                if changes and seen(made) >= self.needed(own, sign, changes):
                    best.setdefault(changes, []).append((made, cost))
                    fewest = min(fewest, changes)
                continue
            steps = [(at + 1, unit[at], 0, 0.0)]
            for r in (unit[at], unit[at : at + 2]):
                if len(r) == 1 or at + 1 < end:
                    steps += [(at + len(r), t, 1, p) for t, p in READ_AS.get(r, ())]
            for nxt, t, more, c in steps:
                word = made + t
                if self._begins(word, len(made), nxt == end, mark):
                    stack.append((nxt, word, changes + more, cost + c))
        return sorted(best.get(min(best, default=0), []))

    def _begins(self, word: str, known: int, whole: bool, mark: str | None) -> bool:
        """A word of the corpus begins like ``word``, of which so many characters were looked up before; a whole word is not its own beginning."""
        for k in range(known // STEP * STEP + STEP, len(word) + 1, STEP):
            if (k < len(word) or not whole) and self._count["^" + word[:k]] < 1 and (mark is not None or not CAMEL.search(word[:k])):
                return False
        return True


def model_of(pages: DataFrame) -> Model:
    """Counts over every different page text; two arrays of BINS numbers reach the driver.

    Copies of a page count once, so that its misreadings do not become usual.
    """
    texts = pages.select("text").groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    def tally(batches):
        a, b = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            # units by number, 0 between texts
            numbers: defaultdict[str, int] = defaultdict(count().__next__)
            numbers[""]
            units = array("q")
            compounds: list[str] = []
            for text in batch.column(0).to_pylist():
                units.extend(map(numbers.__getitem__, units_of(text.replace("\n", " ") if text.isascii() else text)))
                units.append(0)
                if "-" in text:
                    compounds += COMPOUND.findall(text)
            row, names, size = np.array(units, np.int64), list(numbers), len(numbers)
            one = dict(zip(names, np.bincount(row, minlength=size).tolist()))
            del one[""]
            left, right = row[:-1], row[1:]
            both, times = np.unique((left * size + right)[(left > 0) & (right > 0)], return_counts=True)
            two = {names[u] + " " + names[v]: n for u, v, n in zip((both // size).tolist(), (both % size).tolist(), times.tolist())}
            parts: Counter[str] = Counter("-" + c for c in compounds)
            heads: dict[str, int] = {}
            for u, n in one.items():
                if len(u) > 3:
                    for p in CAMEL.split(u):
                        parts["." + p] += n
                        for k in range(STEP, len(p), STEP):
                            heads["^" + p[:k]] = 1
                    for k in range(STEP, len(u), STEP):
                        heads["^" + u[:k]] = 1
            for table, counts in ((a, one), (a, parts), (a, heads), (b, two)):
                at = np.fromiter((xxhash.xxh64_intdigest(u) for u in counts), np.uint64, len(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                half = BINS // 2
                np.add.at(table, (at & np.uint64(half - 1)).astype(np.int64), n)
                np.add.at(table, half + ((at >> np.uint64(32)) & np.uint64(half - 1)).astype(np.int64), n)
        for table, counts in ((0, a), (1, b)):
            at = np.flatnonzero(counts)
            for part in np.array_split(at, len(at) // 50_000 + 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), table, np.int32)), pa.array(part.astype(np.int32)), pa.array(counts[part])], names=["which", "bin", "n"])

    rows = texts.select("text").mapInArrow(tally, "which int, bin int, n bigint").groupBy("which", "bin").agg(F.sum("n").alias("n")).toArrow()
    which, at, n = (rows.column(c).to_numpy() for c in ("which", "bin", "n"))
    tables = np.zeros((2, BINS), np.float32)
    tables[which, at] = n
    return Model(tables[0], tables[1])


def viterbi(units: list[str], options: list[list[tuple[str, float]]], model: Model) -> list[str]:
    """The likeliest words of a line under channel and bigram model."""
    states = [("", 1.0, 0.0, ())]  # word, trust in its counts, score, path
    for unit, alts in zip(units, options):
        nxt = []
        for word, channel in [(unit, math.log(0.95)), *alts]:
            trust = model.trust(unit, alts) if word == unit else 1.0
            score, path = max(((s + model.follows(w, word, tw, trust), p) for w, tw, s, p in states), key=lambda x: x[0])
            nxt.append((word, trust, score + channel, (*path, word)))
        states = nxt
    return list(max(states, key=lambda s: s[2])[3])


def changes(units: list[str], model: Model) -> Iterator[tuple[int, str]]:
    """(position, true) of the units that decoding changes, window by window; those that two windows saw come twice."""
    readings = model.readings
    alts = {}
    for i in compress(range(len(units)), map(readings.__getitem__, units)):
        u = units[i]
        a = readings[u] if len(u) > 1 else model.han_readings[units[i - 1] if i else "", u, units[i + 1] if i + 1 < len(units) else ""]
        if a:
            alts[i] = a
    done = -1
    for i in alts:
        if i <= done:
            continue
        j = i
        while j + 1 in alts or j + 2 in alts:
            j += 1
        lo, hi = max(0, i - 2), min(len(units), j + 3)
        window = units[lo:hi]
        out = viterbi(window, [alts.get(k, []) for k in range(lo, hi)], model)
        yield from ((lo + k, b) for k, (a, b) in enumerate(zip(window, out)) if a != b)
        done = j


def misread(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, true) of the units that decoding changes, each with its line's neighbours in view."""
    masked = MASK.sub(lambda m: " " * len(m.group(0)), text) if any(s in text for s in MASK_SIGNS) else text
    found = list(changes(UNIT.findall(masked), model))
    places = [m.span() for m in UNIT.finditer(masked)] if found else []
    return [(*places[i], true) for i, true in found]


def split_words(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, joined) of words split over a line end by a hyphen-like sign."""
    out: list[tuple[int, int, str]] = []
    if not LINE_HYPHEN.search(text):
        return out
    for m in SPLIT_WORD.finditer(text):
        a, sign, b = m.groups()
        if not (WORDLIKE.search(a) and WORDLIKE.search(b)):
            continue
        whole, compound = a + b, a + "-" + b
        if sign != "-":
            out.append((*m.span(), whole))
            continue
        joined, apart = model.count(whole), model.seen("-" + compound)
        if joined >= 0.2 and joined >= apart or (apart < 1 and not (b[:1].islower() and model.count(a) >= 20 and model.count(b) >= 20)):
            out.append((*m.span(), whole))
    return out


PAGE_WORD = r"(?:[Pp][a@][g9][ec]|[Pp]\s?\.|第|頁|页)"
PAGE_NO = re.compile(rf"^[\s\-—–·.\[\](){{}}|~*]*(?:{PAGE_WORD}\s*)?[\dOolIZSB]{{1,4}}\s*(?:页|頁)?\s*(?:(?:/|／|of|ot|0f|共|\|)\s*(?:第|共)?\s*[\dOolIZSB]{{1,4}}\s*(?:页|頁)?)?[\s\-—–·.\[\](){{}}|~*]*$")
HAS_DIGIT = re.compile(r"\d")
JOINED = re.compile(r"^(?P<head>.*?\S)(?:\s*[·|—–/-]\s*|\s{2,}|\s+(?=\S{1,4}$))(?:[Pp]\.?\s?)?(?P<no>\d{1,4})\s*$|^(?P<no>\d{1,4})(?:\s*[·|—–/-]\s*|\s{2,})(?P<head>\S.*)$")


NO_WORD = re.compile(r"[\s\W_]+")
SIGN_LETTERS = str.maketrans({"@": "a", "|": "l", "$": "s"})


def fold_line(line: str) -> str:
    """What a header line is, read well or badly: classes of confusable characters, no spaces, no signs."""
    t = unicodedata.normalize("NFKC", normalize_text(line) or "").lower().replace("rn", "m")
    return NO_WORD.sub("", t.translate(SIGN_LETTERS)).translate(FOLD).translate(HAN_FOLD)


def edges(text: str) -> tuple[list[str], int, int]:
    """Lines of a page and the positions of its first and last line that is not blank (-1 without one)."""
    lines = text.splitlines()
    first = next((i for i, x in enumerate(lines) if x.strip()), -1)
    return lines, first, next(i for i in range(len(lines) - 1, -1, -1) if lines[i].strip()) if first >= 0 else -1


def is_page_number(line: str) -> bool:
    return len(line.strip()) <= 24 and HAS_DIGIT.search(line) is not None and PAGE_NO.match(line.strip()) is not None


def top_line(lines: list[str], first: int, last: int) -> tuple[int, str, bool]:
    """(position, line without a number that is joined to it, whether there is one) of a page's top line, past a page number."""
    i = first
    if is_page_number(lines[i]) and i < last:
        i = next(k for k in range(i + 1, last + 1) if lines[k].strip())
    m = JOINED.match(lines[i].strip())
    return i, m.group("head") if m else lines[i], m is not None


def header_candidate(text: str) -> tuple[str, str, bool] | None:
    """(folded header, fold of the line below, a number is joined to it) of a page's top line."""
    lines, first, last = edges(text)
    if first < 0:
        return None
    i, head, joined = top_line(lines, first, last)
    fold = fold_line(head)
    if len(fold) < 4:
        return None
    below = next((fold_line(lines[k]) for k in range(i + 1, len(lines)) if lines[k].strip()), "")
    return fold, below, joined


def headers(pages: DataFrame) -> DataFrame:
    """(note_id, fold) of the running headers: above the content of two or more pages of a note.

    Lines are counted by note and fold with partial aggregation; a note with a
    third of all pages is no hot group, its pages are never gathered.
    """
    def top(notes, indexes, texts):
        for n, i, text in zip(notes, indexes, texts):
            c = header_candidate(text)
            if c and n is not None and i is not None:
                yield n, i, c[0], c[1]

    lines = flat_map_batches(pages.select("note_id", "image_index", "text"), top, "note_id string, image_index int, fold string, below string").distinct()
    kinds = lines.groupBy("note_id", "fold").agg(F.count_distinct("image_index").alias("pages"), F.count_distinct("below").alias("belows"))
    return kinds.where((F.col("pages") > 1) & (F.col("belows") > 1)).select("note_id", "fold")


def pages_of(ocr: DataFrame) -> DataFrame:
    return ocr.select("ocr_id", "note_id", "image_index", "text").where((F.length("text") > 0) & F.col("ocr_id").isNotNull()).distinct()


def with_headers(pages: DataFrame) -> DataFrame:
    """Pages with ``folds``, the running headers of their note (null without one)."""
    heads = headers(pages).groupBy("note_id").agg(F.collect_set("fold").alias("folds"))
    return merge_join(pages, heads, "note_id", "left")


#: A line end between Han characters.
HAN_BREAK = re.compile(r"\n(?<=\p{Han}\n)(?=\p{Han})")
NUMBER_END = re.compile(r"\S(?:\s*·\s*|\s{2,})\d{1,3}\s*$")


def page_noise(text: str, folds: set[str], model: Model) -> set[str]:
    """Kinds of noise of a page: hyphen, misread, header, page_no."""
    kinds = set()
    lines, first, last = edges(text)
    if first < 0:
        return kinds
    if first < last and (is_page_number(lines[first]) or is_page_number(lines[last])):
        kinds.add("page_no")
    _, head, joined = top_line(lines, first, last)
    fold = fold_line(head) if folds or joined else ""
    if fold in folds:
        kinds.add("header")
        if joined:
            kinds.add("page_no")
    elif joined and len(fold) >= 4 and len(lines[first]) < 40 and NUMBER_END.search(lines[first]):
        kinds.add("page_no")
    clean = normalize_text(text) or ""
    splits = split_words(clean, model)
    if splits:
        kinds.add("hyphen")
        clean = join_splits(clean, splits)
    if any(True for _ in changes(units_of(HAN_BREAK.sub("", clean)), model)):
        kinds.add("misread")
    return kinds


def join_splits(text: str, splits: list[tuple[int, int, str]]) -> str:
    parts, last = [], 0
    for s, e, whole in splits:
        parts += [text[last:s], whole]
        last = e
    return "".join(parts) + text[last:]


def noise_found(ocr: DataFrame) -> DataFrame:
    """Distinct (ocr_id, kind)."""
    pages = pages_of(ocr)
    model = model_of(pages)

    def scan(ids, texts, folds):
        for i, text, f in zip(ids, texts, folds):
            for kind in page_noise(text, set(f or ()), model):
                yield i, kind

    return flat_map_batches(with_headers(pages).select("ocr_id", "text", "folds"), scan, "ocr_id string, kind string").distinct()


SENTENCE_END = re.compile(r"[。！？!?…:：；;.]['\"”’)）」』]*$")
BLOCK = re.compile(r"^\s*(?:#{1,6} |[-*+] |\d+[.)、] |```|\||<|\\|=+ )")


def repair(text: str | None, folds: set[str], model: Model) -> str | None:
    """Continuous paragraphs of a page: header and page number dropped, words joined, misread characters corrected."""
    if not text:
        return text
    lines, first, last = edges(text)
    if first < 0:
        return ""
    drop = {i for i in (first, last) if first < last and is_page_number(lines[i])}
    c = header_candidate(text)
    if c and c[0] in folds:
        drop.add(next(i for i in range(first, last + 1) if i not in drop and lines[i].strip()))
    body = normalize_text("\n".join(x for i, x in enumerate(lines) if i not in drop)) or ""
    body = join_splits(body, split_words(body, model))
    out = ""
    for line in body.split("\n"):
        if not line.strip():
            out = out.rstrip() + "\n\n" if out else out
        elif not out or out.endswith("\n"):
            out += line.strip()
        elif BLOCK.match(line) or (SENTENCE_END.search(out[-3:]) and len(out) - out.rfind("\n") < 24):
            out += "\n" + line.strip()
        else:
            out += ("" if ord(out[-1]) > 0x2E7F or ord(line.strip()[0]) > 0x2E7F else " ") + line.strip()
    # a unit that two windows saw is changed once
    return join_splits(out, sorted({(a, b): (a, b, true) for a, b, true in misread(out, model)}.values())).strip()


def paragraphs(ocr: DataFrame) -> DataFrame:
    """(ocr_id, paragraphs) of every page; blocks stand in for a page whose text is null or empty."""
    lines = F.concat_ws("\n", F.transform(F.array_sort(F.transform("blocks", lambda b: F.struct(F.coalesce(F.get(b["box"], F.lit(1)), F.lit(0.0)).alias("y"), F.coalesce(F.get(b["box"], F.lit(0)), F.lit(0.0)).alias("x"), b["text"].alias("text")))), lambda b: b["text"]))
    pages = pages_of(ocr.withColumn("text", F.coalesce(F.nullif(F.col("text"), F.lit("")), lines)))
    model = model_of(pages)

    def mend(ids, texts, folds):
        for i, text, f in zip(ids, texts, folds):
            yield i, repair(text, set(f or ()), model)

    return flat_map_batches(with_headers(pages).select("ocr_id", "text", "folds"), mend, "ocr_id string, paragraphs string")
