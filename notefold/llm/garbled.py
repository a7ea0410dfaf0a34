"""Text decoded with the wrong encoding: found, and restored where possible (problem 10).

A code-page swap (bytes of encoding R read as W) is a substitution cipher over
bytes. Three steps lead to the result:

1. Character bigrams of the whole corpus, counted into a table of fixed size, are
   the language model. A text counts by its least odd *reading*: runs that are
   well-formed UTF-8 or dense multi-byte code count as what they encode, and text
   that no orthography writes (capitals within words, accents side by side) counts
   as the one swap that mends it or, where several do, not at all. So a source that
   is garbled throughout does not teach the model its garble.
2. Passages about unlikely bigrams are deciphered by every swap.
3. Expectation-maximisation learns, for each group of sources and each swap, the
   letter that a byte stands for and how often the swap occurs. The page's letter
   is only the prior: with enough text against it the bigrams move a byte to
   another letter. A passage takes the swap of greatest posterior, or stays as it
   is, and the learned table is applied as ``translate()`` does.

Where R is a multi-byte encoding the cipher acts on byte groups, so EM weighs the
transcoded passage and learns no letters for it; the bytes that a decoder replaced
by U+FFFD are lost and the passage is only reported.

Defined results: null, empty, blank and ASCII texts are never found; a text that
quotes garbled sequences in quotation marks is not; texts are read whole; repeated
rows count once in the result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import regex as re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.functions.arrow import flat_map_batches, flat_map_partitions
from notefold.functions.checkpoint import settle
from notefold.functions.joins import merge_join

#: Number of counters of the bigram table, a power of two; fixed, so its size is bounded.
BINS = 1 << 20
#: Groups of sources, by hash, that learn tables of their own; fixed, so the tables' size is bounded.
GROUPS = 8

#: Swaps (name, read as, written in), single-byte code pages.
SINGLE = [("latin_as_cp437", "cp437", "cp1252"), ("latin_as_cp850", "cp850", "cp1252"), ("latin_as_mac", "mac_roman", "cp1252"), ("latin_as_cp1251", "cp1251", "cp1252"), ("latin_as_koi8", "koi8_r", "cp1252"), ("mac_as_latin", "cp1252", "mac_roman"), ("cp437_as_latin", "cp1252", "cp437"), ("cp850_as_latin", "cp1252", "cp850"), ("latin_as_cp1250", "cp1250", "cp1252"), ("latin_as_iso5", "iso8859_5", "cp1252"), ("latin_as_iso7", "iso8859_7", "cp1252"), ("latin_as_cp1253", "cp1253", "cp1252"), ("koi8_as_cp1251", "cp1251", "koi8_r"), ("cp1251_as_koi8", "koi8_r", "cp1251"), ("cp866_as_cp1251", "cp1251", "cp866"), ("cp1251_as_cp866", "cp866", "cp1251"), ("cp1251_as_latin", "cp1252", "cp1251"), ("koi8_as_latin", "cp1252", "koi8_r"), ("cp866_as_latin", "cp1252", "cp866"), ("iso5_as_latin", "cp1252", "iso8859_5"), ("iso5_as_cp1251", "cp1251", "iso8859_5"), ("cp1251_as_iso5", "iso8859_5", "cp1251"), ("koi8_as_cp866", "cp866", "koi8_r"), ("cp1251_as_mac", "mac_roman", "cp1251")]
#: Swaps whose bytes are in a multi-byte encoding.
MULTI = [("gbk_as_latin", "cp1252", "gb18030"), ("gbk_as_cp1251", "cp1251", "gb18030"), ("gbk_as_mac", "mac_roman", "gb18030"), ("gbk_as_cp437", "cp437", "gb18030"), ("big5_as_latin", "cp1252", "big5"), ("sjis_as_latin", "cp1252", "cp932"), ("big5_as_gbk", "gb18030", "big5")]
#: Single-byte encodings that UTF-8 was read as.
UTF8_AS = ["cp1252", "cp1251", "mac_roman", "cp437", "cp850", "koi8_r", "cp1250", "iso8859_5", "cp866"]


def high_chars(encoding: str) -> dict[int, str]:
    """Byte to character of the upper half; undefined bytes stay C1 controls, as lenient decoders do."""
    out = {}
    for b in range(128, 256):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


PAGE = {e: high_chars(e) for e in {w for _, w, _ in SINGLE} | {r for _, _, r in SINGLE} | set(UTF8_AS)}
TO_BYTE = {e: {ord(c): chr(b) for b, c in page.items()} | ({b: chr(b) for b in range(128, 160)} if e in ("cp1252", "cp1251", "cp1250") else {}) for e, page in PAGE.items()}
#: For each single-byte swap, the cipher that translate() applies.
CIPHER = {name: {ord(c): PAGE[r][b] for b, c in PAGE[w].items()} for name, w, r in SINGLE}
MULTI_PAGE = {w for _, w, _ in MULTI if w != "gb18030"}


def _utf8_pattern(encoding: str) -> re.Pattern:
    page = PAGE[encoding]

    def chars(lo: int, hi: int) -> str:
        both = {page[b] for b in range(lo, hi)} | ({chr(b) for b in range(lo, hi) if b < 160} if encoding in ("cp1252", "cp1251", "cp1250") else set())
        return "[" + "".join(re.escape(c) for c in sorted(both)) + "]"

    cont = chars(0x80, 0xC0)
    return re.compile(f"(?:{chars(0xC2, 0xE0)}{cont}|{chars(0xE0, 0xF0)}{cont}{{2}}|{chars(0xF0, 0xF5)}{cont}{{3}})+")


LEAD = {e: {PAGE[e][b] for b in range(0xC2, 0xF5)} for e in UTF8_AS}
CONT = {e: {PAGE[e][b] for b in range(0x80, 0xC0)} | ({chr(b) for b in range(128, 160)} if e in ("cp1252", "cp1251", "cp1250") else set()) for e in UTF8_AS}
HIGH = {e: set(PAGE[e].values()) for e in PAGE}
HAN = re.compile("[一-鿿].*[一-鿿]", re.S)
#: Han characters that the two bytes of an accented Latin letter make, and such a one beside a Latin letter.
GBK_LETTERS = {x for c in range(0xC0, 0x180) if len(x := chr(c).encode().decode("gb18030", "ignore")) == 1}
GBK_LETTER = re.compile("(?:(?<=[A-Za-z ,'])(?P<c>[" + "".join(sorted(GBK_LETTERS)) + "])(?=[a-z ,.]))")
UTF8_RUN = {e: _utf8_pattern(e) for e in UTF8_AS}
NOT_HAN = re.compile("[\x80-\u2dff\ufffd]")
HAN_RUN = re.compile("[\u2e80-\U0003ffff\ufffd\u2000-\u22ff\u3000-\u30ff]{3,}")
QUOTES = re.compile("[\u201c\"\u300c'\u2018\u00ab][^\u201c\u201d\"\u300c\u300d\n]{0,24}[\u201d\"\u300d'\u2019\u00bb]")
LOST = re.compile("\ufffd")
WORDISH = re.compile(r"\w")
#: Runs of a page's upper half, as multi-byte text makes them; few ASCII bytes between.
DENSE = {w: re.compile(f"[{h}](?:[!-~]{{0,3}}[{h}]){{3,}}[@-~]?") for w in sorted(MULTI_PAGE) for h in ["".join(re.escape(c) for c in sorted(HIGH[w] | ({chr(b) for b in range(128, 160)} if w in ("cp1252", "cp1251") else set())))]}


def bins_of(text: str) -> np.ndarray:
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(a) < 2:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    h = (a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(44)
    return h.astype(np.int64), (a[:-1] > 127) | (a[1:] > 127)


def transcode(run: str, read_as: str, written: str) -> str | None:
    """The run as it was, when every byte of it survives; None otherwise."""
    try:
        if read_as == "gb18030":
            return run.encode("gb18030").decode(written)
        return run.translate(TO_BYTE[read_as]).encode("latin-1").decode(written)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None



def peel(run: str, enc: str) -> str | None:
    """Undo UTF-8 read as ``enc``, again while it was done more than once."""
    was = transcode(run, enc, "utf-8")
    for _ in range(2):
        more = transcode(was, enc, "utf-8") if was and not was.isascii() else None
        if not more or len(more) >= len(was):
            break
        was = more
    return was


#: By code point below 2^16 and swap, what the swap makes of a character.
BECOMES = np.repeat(np.arange(1 << 16, dtype=np.uint64)[:, None], len(SINGLE), axis=1)
for _k, (_name, _, _) in enumerate(SINGLE):
    for _c, _to in CIPHER[_name].items():
        BECOMES[_c, _k] = ord(_to)
#: Code points below 2^16 that any swap changes.
SWAPPED = BECOMES != np.arange(1 << 16, dtype=np.uint64)[:, None]
CHANGES = SWAPPED.any(axis=1)




#: Nats that a pair of characters costs that no orthography writes often, however usual the corpus makes it.
ODD = 3.0


def kind_of(c: str) -> int:
    """0 neutral, 1 ASCII letter, 2 and 3 other Latin letter, lower and upper, 4 and 5 Cyrillic or Greek letter, lower and upper, 6 other sign."""
    if c.isascii() and c >= " " or ord(c) > 0x2E7F or c in "“”‘’„«»–—…·°№€£§©®¡¿\xa0\t\n\r":
        return int(c.isascii() and c.isalpha())
    if not c.isalpha():
        return 6 if 0x7F < ord(c) < 0xA0 or c not in "\xad" else 0
    upper = c.isupper()
    return 4 + upper if 0x370 <= ord(c) < 0x530 else 2 + upper if ord(c) < 0x250 or 0x1E00 <= ord(c) < 0x1F00 else 0


KIND = np.array([kind_of(chr(c)) for c in range(1 << 16)], np.int8)
#: Capitals within a word, accents side by side, scripts mixed in a word, signs beside letters.
COST = np.zeros((7, 7), np.float32)
for _x, _y in [(x, y) for x in range(1, 6) for y in (3, 5)] + [(x, y) for x in (2, 3) for y in (2, 3)] + [(x, y) for x in (1, 2, 3) for y in (4, 5)] + [(x, y) for x in (4, 5) for y in (1, 2, 3)] + [(x, 6) for x in range(1, 7)] + [(6, y) for y in range(1, 7)]:
    COST[_x, _y] = ODD
#: By code point and swap, the kind of what the swap makes of it.
KIND_BECOMES = KIND[BECOMES.astype(np.int64)]


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Log probability by bin, less the corpus's mean: usual bigrams lie about 0 at every corpus size."""
    seen = max(1, int((counts > 0).sum()))
    logs = np.log((counts + 0.05) / (counts.sum() + 0.05 * seen))
    return (logs - float((counts * logs).sum() / max(1.0, counts.sum()))).astype(np.float32)


def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bins of the bigrams of code points ``a`` before ``b``."""
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(44)).astype(np.int64)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


# ---- the language model ---------------------------------------------------

def _marked(chars: set[str]) -> np.ndarray:
    table = np.zeros(1 << 16, bool)
    table[[ord(c) for c in chars if ord(c) < 1 << 16]] = True
    return table


#: The same by code point: what can begin and go on a group of UTF-8 bytes in a page, and a page's upper half.
LEADS, CONTS = {e: _marked(x) for e, x in LEAD.items()}, {e: _marked(x) for e, x in CONT.items()}
UPPERS = {w: _marked(HIGH[w]) for w in DENSE}


def groups_in(a: np.ndarray) -> list[str]:
    """Pages in which some two characters in a row may be the first bytes of a group of UTF-8."""
    return [e for e in UTF8_AS if (LEADS[e][a[:-1]] & CONTS[e][a[1:]]).any()]


#: Letters and signs of a page's upper half; punctuation that every script uses is none.
STRANGE = CHANGES & (KIND != 0)
#: Least length of a run of well-formed UTF-8 that is no accident, by the page it was read in.
NO_ACCIDENT = {"cp1252": 2, "cp1250": 4, "mac_roman": 4, "cp437": 4, "cp850": 4}


#: Characters of two bytes that are the first two of a Han character in UTF-8; few texts hold any.
UTF8_IN_GBK = np.zeros(1 << 16, bool)
for _lead in range(0xE3, 0xEA):
    for _trail in range(0x80, 0xC0):
        _c = bytes([_lead, _trail]).decode("gb18030", "ignore")
        if len(_c) == 1 and _c.isalpha():
            UTF8_IN_GBK[ord(_c)] = True


LETTER_IN_GBK = _marked(GBK_LETTERS)
MADE = STRANGE | UTF8_IN_GBK
MADE[0xFFFD] = True


def reading(text: str) -> str:
    """What a text says by its structure alone; parts that several swaps mend equally are left out."""
    if text.isascii():
        return text
    a = np.minimum(codes_of(text), 0xFFFF)
    if int(STRANGE[a].sum()) >= 2:
        for enc in groups_in(a):
            text = UTF8_RUN[enc].sub(lambda m, enc=enc: (peel(m.group(0), enc) or m.group(0)) if len(m.group(0)) >= NO_ACCIDENT.get(enc, 6) else m.group(0), text)
        for name, w, r in MULTI:
            if w in DENSE and r == "gb18030" and int((UPPERS[w][a[:-1]] & UPPERS[w][a[1:]]).sum()) >= 3:
                text = DENSE[w].sub(lambda m, w=w, r=r: _dense(m.group(0), w, r), text)
        a = np.minimum(codes_of(text), 0xFFFF)
        at = np.flatnonzero(CHANGES[a[:-1]] | CHANGES[a[1:]]) if len(a) > 1 else ()
        if len(at):
            x, y = a[at], a[at + 1]
            base = float(COST[KIND[x], KIND[y]].sum())
            if base >= 2 * ODD and base >= 0.45 * len(at):
                mended = COST[KIND_BECOMES[x], KIND_BECOMES[y]].sum(axis=0)
                best = float(mended.min())
                if base - best >= 0.6 * base:
                    equal = np.flatnonzero(mended <= best + ODD)
                    text = text.translate(CIPHER[SINGLE[equal[0]][0]]) if len(equal) == 1 else "".join(" " if c > "\x7f" and STRANGE[min(ord(c), 0xFFFF)] else c for c in text)
        a = np.minimum(codes_of(text), 0xFFFF)
    return HAN_RUN.sub(lambda m: _from_gbk(m.group(0)) or m.group(0), text) if 200 * int(UTF8_IN_GBK[a].sum()) > max(600, len(a)) else text


def _dense(run: str, w: str, r: str) -> str:
    """A dense run as Chinese, if nearly all of it is in the rows of usual characters and signs."""
    raw = run.translate(TO_BYTE[w]).encode("latin-1", "replace")
    leads, at = [], 0
    while at < len(raw):
        if raw[at] < 128:
            at += 1
        else:
            leads.append(raw[at])
            at += 2
    usual = sum(0xA1 <= b <= 0xA3 or 0xB0 <= b <= 0xD7 for b in leads)
    return (transcode(run, w, r) or run) if usual >= 0.85 * len(leads) else run


def _from_gbk(run: str) -> str | None:
    """A run of Han as UTF-8, if most of its bytes are; true Chinese seldom is."""
    if len(run) < 6:
        return None
    was = run.replace("\ufffd", "?").encode("gb18030", "replace").decode("utf-8", "replace")
    kept = len(was) - was.count("\ufffd") - was.count("?")
    return was if kept >= 3 and kept >= 0.6 * len(was) else None


def bigram_table(docs: DataFrame) -> np.ndarray:
    """Log probabilities of character bigrams by bin (see log_probabilities), counted over every text; BINS floats."""
    def count(batches):
        total = np.zeros(BINS, np.int64)
        for (texts,) in batches:
            total += np.bincount(bins_of("\x00".join(reading(t) for t in texts if t))[0], minlength=BINS)
        at = np.flatnonzero(total)
        yield from zip(at.tolist(), total[at].tolist())

    rows = flat_map_partitions(docs.select("text"), count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BINS)
    counts[rows.column("bin").to_numpy()] = rows.column("n").to_numpy()
    return log_probabilities(counts)


# ---- passages -------------------------------------------------------------

#: How far below the corpus's mean log probability a bigram is unlikely, and a run of Han as a whole.
LOW, HAN_DOUBT = 3.6, 4.1
#: Unlikely bigrams no further apart than this are one passage's.
GAP = 24
#: Least gain in nats of a swap of letters, a bigram's mean, and the same of a passage of one letter only.
LEAST_GAIN, MEAN_GAIN, LONE_GAIN = 5.0, 0.7, 3.0
#: Letters that a swap into another alphabet must give: alphabets change word by word.
WORD = 4
ALPHABET = [r in ("cp1251", "koi8_r", "cp866", "iso8859_5", "iso8859_7", "cp1253") for _, _, r in SINGLE]
#: How far a gain may fall back before its passage ends.
FALL = 12.0


def stretches(gain: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Stretches (first, last + 1) of greatest sum, each at least ``least``, that no fall of FALL parts."""
    out, start, total, best, end = [], 0, 0.0, 0.0, 0
    for i, g in enumerate(gain.tolist()):
        total += g
        if total > best:
            best, end = total, i + 1
        if total <= 0.0 or total < best - FALL:
            if best >= least:
                out.append((start, end))
            start, total, best = i + 1, 0.0, 0.0
    if best >= least:
        out.append((start, end))
    return out


def mean_of(text: str, lm: np.ndarray) -> tuple[float, int]:
    """Mean log probability of the bigrams with a character outside ASCII, and their number."""
    b, high = bins_of(text)
    b = b[high]
    return (float(lm[b].sum()) / len(b), len(b)) if len(b) else (0.0, 0)


def by_letters(text: str, a: np.ndarray, lo: int, hi: int, free: np.ndarray, lm: np.ndarray):
    """(start, end, swap, gain) of stretches between ``lo`` and ``hi`` that a swap of single bytes reads better."""
    w = a[lo:hi]
    at = np.flatnonzero((CHANGES[w[:-1]] | CHANGES[w[1:]]) & free[lo : hi - 1])
    if len(at) < 2:
        return
    x, y = w[at], w[at + 1]
    kinds = np.unique(np.concatenate([x, y]))
    swaps = np.flatnonzero(SWAPPED[kinds].any(axis=0))
    if not len(swaps):
        return
    old = lm[hashed(x, y)] - COST[KIND[x], KIND[y]]
    gain = lm[hashed(BECOMES[x][:, swaps], BECOMES[y][:, swaps])] - COST[KIND_BECOMES[x][:, swaps], KIND_BECOMES[y][:, swaps]] - old[:, None]
    total = gain.cumsum(axis=0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(total, axis=0), 0.0)
    most = np.maximum(total[0], (total[1:] - low[:-1]).max(axis=0, initial=-1e9))
    for k in np.flatnonzero(most >= LEAST_GAIN):
        for i, j in stretches(gain[:, k], LEAST_GAIN):
            s, e = lo + int(at[i]), lo + int(at[j - 1]) + 2
            changed = np.flatnonzero(SWAPPED[a[s:e], swaps[k]])
            if not len(changed):
                continue
            s, e = s + int(changed[0]), s + int(changed[-1]) + 1
            part = gain[i:j, k]
            spots = a[s:e][SWAPPED[a[s:e], swaps[k]]]
            if len(spots) < WORD and ALPHABET[swaps[k]]:
                continue
            if part.mean() > (LONE_GAIN if len(set(spots.tolist())) == 1 else MEAN_GAIN):
                yield s, e, SINGLE[swaps[k]][0], float(part.sum())


def decipher(text: str, lm: np.ndarray) -> list[tuple[int, int, str, float, str | None]]:
    """(start, end, swap, gain in nats, restored or None) of passages that a swap may explain better than the text as it is."""
    if text.isascii():
        return []
    found: list[tuple[int, int, str, float, str | None]] = []
    quoted: list[tuple[int, int]] | None = None

    def in_quotes(s: int, e: int) -> bool:
        nonlocal quoted
        if quoted is None:
            quoted = [m.span() for m in QUOTES.finditer(text)]
        return any(p <= s and e <= q for p, q in quoted)

    a = np.minimum(codes_of(text), 0xFFFF)
    # what garble is made of: signs of a page, Han that UTF-8 makes, Han between Latin letters
    marked = MADE[a]
    between = np.flatnonzero(LETTER_IN_GBK[a[1:]] & (a[:-1] < 128)) + 1
    marked[between] = True
    marked = np.flatnonzero(marked)
    low = ()
    if len(marked):
        b, high = bins_of(text)
        likely = lm[b]
        low = np.flatnonzero(high & (likely < -LOW))
    if len(low):
        cuts = np.flatnonzero(np.diff(low) > GAP)
        los, his = np.maximum(low[np.concatenate([[0], cuts + 1])] - 8, 0), np.minimum(low[np.concatenate([cuts, [len(low) - 1]])] + 10, len(text))
        sizes = np.diff(np.concatenate([[0], cuts + 1, [len(low)]]))
        worth = np.searchsorted(marked, los) < np.searchsorted(marked, his)
    if len(low) and worth.any():
        sums = np.concatenate([[0.0], np.where(high, likely, 0.0).cumsum(dtype=np.float64)])
        highs = np.concatenate([[0], high.cumsum()])

        def as_it_is(p: int, q: int) -> tuple[float, int]:
            n = int(highs[q - 1] - highs[p]) if q > p else 0
            return (float(sums[q - 1] - sums[p]) / n if n else 0.0), n

        free = np.ones(len(a), bool)
        for lo, hi, size in zip(los[worth].tolist(), his[worth].tolist(), sizes[worth].tolist()):
            sub, near = text[lo:hi], a[lo:hi]
            if STRANGE[near].any():
                signs = set(sub)
                for enc in groups_in(near):
                    for m in UTF8_RUN[enc].finditer(sub):
                        s, e = lo + m.start(), lo + m.end()
                        if not free[s:e].any():
                            continue
                        was = peel(m.group(0), enc)
                        if was is None or in_quotes(s, e):
                            continue
                        p, q = max(0, s - 1), min(len(text), e + 1)
                        sure = e - s >= 6 and NO_ACCIDENT.get(enc, 6) < 6 or e - s >= 12
                        gain = 0.0 if sure else mean_of(text[p:s] + was + text[e:q], lm)[0] - as_it_is(p, q)[0]
                        if sure or gain > 0.5 or (m.group(0)[0] in "ÃÂâ" and gain > -0.5):
                            found.append((s, e, f"utf8_as_{enc}", max(gain, 3.0 if sure else 0.1) * (e - s), was))
                            free[max(0, s - 1) : e] = False
                if size > 1 and free[lo:hi].any():
                    for s, e, name, gain in by_letters(text, a, lo, hi, free, lm):
                        if not in_quotes(s, e):
                            found.append((s, e, name, gain, text[s:e].translate(CIPHER[name])))
                    for name, w, r in MULTI:
                        if w not in DENSE or signs.isdisjoint(HIGH[w]):
                            continue
                        for m in DENSE[w].finditer(sub):
                            run = m.group(0)
                            if 2 * int(free[lo + m.start() : lo + m.end()].sum()) < len(run):
                                continue
                            if not any(c > "\x7f" and STRANGE[min(ord(c), 0xFFFF)] for c in run):
                                continue
                            base, n = as_it_is(lo + m.start(), lo + m.end())
                            was = transcode(run, w, r)
                            part_was = was or run.translate(TO_BYTE[w]).encode("latin-1", "replace").decode(r, "replace")
                            gain = mean_of(part_was, lm)[0] - base
                            if gain > (0.7 if was else 1.5) and not in_quotes(lo + m.start(), lo + m.end()):
                                found.append((lo + m.start(), lo + m.end(), name, gain * n, was))
            strange_han = int(UTF8_IN_GBK[near].sum())
            for m in HAN_RUN.finditer(sub) if strange_han > 1 or "\ufffd" in sub else ():
                run = m.group(0)
                base, n = as_it_is(lo + m.start(), lo + m.end())
                if base > -HAN_DOUBT or not HAN.search(run):
                    continue
                was = run.replace("\ufffd", "?").encode("gb18030", "replace").decode("utf-8", "replace")
                kept = len(was) - was.count("\ufffd") - was.count("?")
                if kept >= 2 and kept >= 0.45 * len(was):
                    gain = mean_of(was, lm)[0] - base
                    s, e = lo + m.start(), lo + m.end()
                    if gain > 0.3 and not in_quotes(s, e):
                        found.append((s, e, "utf8_as_gbk", gain * n, transcode(run, "gb18030", "utf-8") if "\ufffd" not in run else None))
            for m in GBK_LETTER.finditer(sub) if len(between) else ():
                s, e = lo + m.start(), lo + m.end()
                was = transcode(m.group(0), "gb18030", "utf-8")
                if was:
                    p, q = max(0, s - 1), min(len(text), e + 1)
                    gain = mean_of(text[p:s] + was + text[e:q], lm)[0] - as_it_is(p, q)[0]
                    if gain > 0.5:
                        found.append((s, e, "utf8_as_gbk", gain * 2, was))
    lost = [m.start() for m in LOST.finditer(text) if not in_quotes(m.start(), m.start() + 1)] if "\ufffd" in text else []
    if lost:
        beside = any((i and WORDISH.match(text[i - 1])) or (i + 1 < len(text) and WORDISH.match(text[i + 1])) for i in lost)
        if len(lost) > 1 or beside:
            found.append((lost[0], lost[-1] + 1, LOST_BYTES, 1.0 * len(lost), None))
    return found


LOST_BYTES = "lost"
PASSAGES = "doc_id bigint, source string, start int, stop int, before string, garbled string, after string, options array<struct<swap:string,gain:double,restored:string>>"


def passages_of(docs: DataFrame, lm: np.ndarray) -> DataFrame:
    """One row a passage: where it stands, its neighbours, and the swaps that may explain it (at most one option a swap)."""
    def scan(ids, sources, texts):
        for i, src, text in zip(ids, sources, texts):
            if not text or text.isascii():
                continue
            at: dict[tuple[int, int], dict[str, tuple]] = {}
            for s, e, swap, gain, was in decipher(text, lm):
                options = at.setdefault((s, e), {})
                if swap not in options or gain > options[swap][0]:
                    options[swap] = gain, was
            for (s, e), options in at.items():
                yield i, src, s, e, text[max(0, s - 1) : s], text[s:e], text[e : e + 1], [{"swap": k, "gain": g, "restored": w} for k, (g, w) in sorted(options.items())]

    return flat_map_batches(docs.select("doc_id", "source", "text"), scan, PASSAGES)


# ---- expectation-maximisation ---------------------------------------------

#: Counts that the page's letter of a byte starts with, and every other letter.
PAGE_PRIOR, OTHER_PRIOR = 20.0, 0.02
#: Counts that each swap of a group and standing as it is start with.
SWAP_PRIOR, AS_IS_PRIOR = 1.0, 2.0
ROUNDS = 2
SWAPS = [name for name, _, _ in SINGLE]
#: By swap and byte, the letters that the byte may stand for: the page's own first, then those of all pages that text read so was written in, -1 where there is none.
LETTERS = np.full((len(SINGLE), 128, 12), -1, np.int64)
#: By swap and code point, the byte less 128; -1 outside the upper half.
BYTE_OF = np.full((len(SINGLE), 1 << 16), -1, np.int16)
for _k, (_name, _w, _r) in enumerate(SINGLE):
    for _b, _c in PAGE[_w].items():
        BYTE_OF[_k, ord(_c)] = _b - 128
        _options = list(dict.fromkeys([PAGE[_r][_b], *(PAGE[r][_b] for _, w, r in SINGLE if w == _w), _c]))[: LETTERS.shape[2]]
        LETTERS[_k, _b - 128, : len(_options)] = [ord(x) for x in _options]


class Ciphers:
    """Learned log probabilities of letters by group, swap and byte, and of swaps by group."""

    def __init__(self, letters: np.ndarray | None = None, swaps: dict[tuple[int, str], float] | None = None) -> None:
        prior = np.where(LETTERS >= 0, OTHER_PRIOR, 0.0)
        prior[:, :, 0] = PAGE_PRIOR
        counts = (np.zeros((GROUPS, *LETTERS.shape)) if letters is None else letters) + prior
        with np.errstate(divide="ignore"):
            self.theta = np.log(counts / counts.sum(axis=3, keepdims=True)).astype(np.float32)
        #: The likeliest letter of a byte.
        self.best = np.take_along_axis(np.broadcast_to(LETTERS, counts.shape), counts.argmax(axis=3)[..., None], 3)[..., 0]
        self.swaps = swaps or {}

    def share(self, group: int, swap: str) -> float:
        return math.log(self.swaps.get((group, swap), 0.0) + (AS_IS_PRIOR if swap == AS_IS else SWAP_PRIOR))

    def weigh(self, group: int, before: str, garbled: str, after: str, options: list[dict], lm: np.ndarray, learn=None) -> tuple[str, float, str | None]:
        """The likeliest (swap, posterior, restored) of a passage; ``learn`` is told the expected letters."""
        if not any(o["swap"] in INDEX for o in options):
            ranked = [(o["gain"] + self.share(group, o["swap"]), o["swap"], o["restored"]) for o in options]
            if all(o["swap"] != LOST_BYTES for o in options):
                ranked.append((self.share(group, AS_IS), AS_IS, None))
            score, swap, was = max(ranked, key=lambda r: r[0])
            return swap, 1.0 / sum(math.exp(r[0] - score) for r in ranked), was
        whole = np.minimum(codes_of(before + garbled + after), 0xFFFF).astype(np.int64)
        first, last = len(before), len(before) + len(garbled)
        scores, texts, made = [], [], []
        for o in options:
            k = INDEX.get(o["swap"])
            if k is None:
                scores.append(o["gain"] + self.share(group, o["swap"]))
                texts.append(o["restored"])
                made.append(None)
                continue
            byte = BYTE_OF[k, whole]
            byte[:first] = byte[last:] = -1
            at = np.flatnonzero(byte >= 0)
            read = whole.copy()
            read[at] = self.best[group, k, byte[at]]
            pairs = np.unique(np.concatenate([at, at - 1]))
            pairs = pairs[(pairs >= 0) & (pairs < len(whole) - 1)]
            x, y, u, v = read[pairs], read[pairs + 1], whole[pairs], whole[pairs + 1]
            gain = float((lm[hashed(x, y)] - COST[KIND[x], KIND[y]] - lm[hashed(u, v)] + COST[KIND[u], KIND[v]]).sum()) + float(self.theta[group, k, byte[at]].max(axis=1).sum())
            scores.append(gain + self.share(group, o["swap"]))
            texts.append("".join(map(chr, read[first:last])) if (whole[first:last] < 0xFFFF).all() else garbled.translate(dict(zip(whole[at].tolist(), read[at].tolist()))))
            made.append((k, at, byte[at], read))
        if all(o["swap"] != LOST_BYTES for o in options):
            scores.append(self.share(group, AS_IS))  # bytes that a decoder lost were never written so
            texts.append(None)
        scores = np.array(scores)
        post = np.exp(scores - scores.max())
        post /= post.sum()
        if learn:
            for p, m in zip(post.tolist(), made):
                if m and p > 1e-3:
                    k, at, byte, read = m
                    letters = LETTERS[k, byte]
                    seen = np.maximum(letters, 0)
                    left, right = read[np.maximum(at - 1, 0)][:, None], read[np.minimum(at + 1, len(read) - 1)][:, None]
                    fits = np.where(at[:, None] > 0, lm[hashed(np.broadcast_to(left, seen.shape), seen)], 0.0) + np.where(at[:, None] < len(read) - 1, lm[hashed(seen, np.broadcast_to(right, seen.shape))], 0.0)
                    fits = np.where(letters >= 0, fits + self.theta[group, k, byte], -1e9)
                    fits = np.exp(fits - fits.max(axis=1, keepdims=True))
                    learn(k, byte, p * fits / fits.sum(axis=1, keepdims=True))
        i = int(post.argmax())
        return (options[i]["swap"] if i < len(options) else AS_IS), float(post[i]), texts[i]


AS_IS = "as_is"
INDEX = {name: k for k, name in enumerate(SWAPS)}


def group_of(source: str | None) -> int:
    return xxhash.xxh64_intdigest(source or "") % GROUPS


def learned(passages: DataFrame, lm: np.ndarray) -> Ciphers:
    """The tables after ROUNDS rounds; each sends the driver at most GROUPS x swaps x 128 x 12 sums."""
    ciphers = Ciphers()
    shape = (GROUPS, *LETTERS.shape)
    for _ in range(ROUNDS):
        def expected(batches, ciphers=ciphers):
            letters = np.zeros(shape)
            swaps: dict[tuple[int, str], float] = {}
            for sources, befores, texts, afters, options in batches:
                for src, before, text, after, opts in zip(sources, befores, texts, afters, options):
                    g = group_of(src)
                    swap, post, _ = ciphers.weigh(g, before, text, after, opts, lm, lambda k, byte, n, g=g: np.add.at(letters[g, k], byte, n))
                    swaps[g, swap] = swaps.get((g, swap), 0.0) + post
            at = np.flatnonzero(letters)
            yield from ((int(i), None, float(n)) for i, n in zip(at, letters.flat[at]))
            yield from ((g, swap, n) for (g, swap), n in swaps.items())

        rows = flat_map_partitions(passages.select("source", "before", "garbled", "after", "options"), expected, "at int, swap string, n double").groupBy("at", "swap").agg(F.sum("n").alias("n")).collect()
        letters = np.zeros(shape)
        for r in rows:
            if r.swap is None:
                letters.flat[r.at] = r.n
        ciphers = Ciphers(letters, {(r.at, r.swap): r.n for r in rows if r.swap is not None})
    return ciphers


def chosen(docs: DataFrame) -> DataFrame:
    """(doc_id, start, stop, swap, restored) of the passages that a swap explains better than their standing as they are."""
    lm = bigram_table(docs)
    passages = settle(passages_of(docs, lm))
    ciphers = learned(passages, lm)

    def decide(ids, sources, starts, stops, befores, texts, afters, options):
        for i, src, s, e, before, text, after, opts in zip(ids, sources, starts, stops, befores, texts, afters, options):
            swap, _, was = ciphers.weigh(group_of(src), before, text, after, opts, lm)
            if swap != AS_IS:
                yield i, s, e, swap, was

    return flat_map_batches(passages, decide, "doc_id bigint, start int, stop int, swap string, restored string")


def garbled_found(docs: DataFrame) -> DataFrame:
    """Distinct doc_id of texts with a passage that a swap explains best."""
    return chosen(docs).select("doc_id").distinct()


def restored(docs: DataFrame) -> DataFrame:
    """(doc_id, swaps, text) of affected texts; passages that cannot be restored stay as they are."""
    per = chosen(docs).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop", "swap", "restored")).alias("passages"))

    def mend(ids, texts, passages):
        for i, text, ps in zip(ids, texts, passages):
            parts, last = [], 0
            for p in sorted(ps, key=lambda p: (p["start"], -p["stop"], p["swap"])):
                if p["restored"] is not None and p["start"] >= last:
                    parts += [text[last : p["start"]], p["restored"]]
                    last = p["stop"]
            yield i, sorted({p["swap"] for p in ps}), "".join(parts) + text[last:]

    return flat_map_batches(merge_join(docs.select("doc_id", "text").distinct(), per, "doc_id"), mend, "doc_id bigint, swaps array<string>, text string")
