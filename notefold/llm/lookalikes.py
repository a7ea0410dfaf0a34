"""Visually identical text brought to one form (problem 2).

Tokens that hold an unusual character are looked up in a trie of the corpus
vocabulary by a weighted edit automaton in which look-alikes and ignorables
cost nothing. A match gives the canonical spelling; tokens without a match are
normalised by table. The vocabulary is counted over the whole corpus; trie and
tokens meet in hash buckets of their skeleton, so no table is broadcast; words seen
once are in it.

Defined results: null, empty and blank texts normalise to themselves and are
never found; repeated rows give one row; texts are read whole.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.functions.arrow import flat_map_batches, flat_map_partitions
from notefold.functions.joins import merge_join

#: Letters of other alphabets by the Latin letter they look like.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеоорсухіјѕԁԛԝһӏѵгп", "ABESIJKMHOPCTYXaeoopcyxijsdqwhlvrn"))
CYRILLIC.update({"к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "З": "3"})
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχγ", "ABEZHIKMNOPTYXaikvoptuxy"))
LOOKALIKE = {**CYRILLIC, **GREEK}
#: Look-alikes near enough to stand in for a Latin letter by themselves.
STRICT = {k: v for k, v in LOOKALIKE.items() if k not in "кмтнвгпиκτυχγιν" or k in "ιν"}
STRICT.update({"ι": "i", "ν": "v", "υ": "u", "χ": "x", "κ": "k", "τ": "t", "γ": "y"})
#: Beside Latin letters of the same token any Cyrillic look-alike stands in.
WIDE = {**STRICT, **CYRILLIC}
#: Characters that show nothing.
IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
#: Spaces other than the ASCII space.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
FULLWIDTH = "\uff10-\uff19\uff21-\uff3a\uff41-\uff5a"
COMPAT = "\u2e80-\u2fdf\uf900-\ufaff\U0002f800-\U0002fa1f\ufb00-\ufb06"
MARKS = "\u0300-\u036f"
OTHER = "\u0370-\u03ff\u0400-\u052f"
ODD = re.compile(f"[{IGNORABLE}{SPACES}{FULLWIDTH}{COMPAT}{MARKS}{OTHER}]")
#: Joiners and selectors inside emoji belong to them.
EMOJI = "\U0001f000-\U0001faff\u2600-\u27bf"
EMOJI_JOINT = re.compile(f"(?<=[{EMOJI}\ufe0f])\u200d(?=[{EMOJI}])")
#: Stands for such a joiner while a text is worked on (a private-use character).
HELD = "\uf8ff"
#: A token: a run of letters, digits and marks with ignorables inside; it holds an unusual character.
TOKEN = re.compile(rf"[A-Za-z0-9À-ÿ{FULLWIDTH}{COMPAT}{MARKS}{OTHER}{IGNORABLE}]*[{FULLWIDTH}{COMPAT}{MARKS}{OTHER}{IGNORABLE}][A-Za-z0-9À-ÿ{FULLWIDTH}{COMPAT}{MARKS}{OTHER}{IGNORABLE}]*")
SPACE = re.compile(f"[{SPACES}]")
WORD = re.compile(r"[A-Za-zÀ-ÿ][A-Za-z0-9À-ÿ]+")
LATIN = re.compile("[A-Za-z]")
TRANSLATE = {ord(c): None for c in IGNORABLE} | {ord(c): " " for c in SPACES}
#: A mark whose letter stands on another line has nothing to join.
LONE_MARK = re.compile(f"^[{MARKS}]+")
TABLE_RANGE = re.compile(f"[{FULLWIDTH}{COMPAT}]+")


def skeleton(token: str) -> str:
    """What all zero-cost variants of a token share: ignorables dropped, look-alikes folded."""
    t = token.translate(TRANSLATE)
    t = unicodedata.normalize("NFKC", t)
    table = table_of(t)
    return "".join(table.get(c, c) for c in t)


def table_of(token: str) -> dict[str, str]:
    """The look-alikes that count in a token: more of them in company of Latin letters."""
    return WIDE if LATIN.search(token) else STRICT


class Trie:
    """Vocabulary trie walked by a weighted edit automaton.

    Reading a character may follow the edge of that character or of one it looks
    like (cost 0), or stay in place when the character is ignorable (cost 0).
    Other edits are not allowed, so a match is visually identical.
    """

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = (count, word)

    def match(self, token: str) -> str | None:
        """The most frequent visually identical word, ties by code point; None without one."""
        states = [self.root]
        table = table_of(token)
        for c in unicodedata.normalize("NFC", token):
            if c in IGNORABLE:
                continue
            readings = {c, table.get(c, c), *unicodedata.normalize("NFKC", c)[:1]} if not c.isascii() else {c}
            wide = unicodedata.normalize("NFKC", c)
            step = []
            for node in states:
                for r in readings:
                    if r in node:
                        step.append(node[r])
                if len(wide) > 1:
                    n = node
                    for r in wide:
                        n = n.get(r) if n else None
                    if n:
                        step.append(n)
            states = step
            if not states:
                return None
        ends = [n[""] for n in states if "" in n]
        return min(ends, key=lambda e: (-e[0], e[1]))[1] if ends else None


def by_table(token: str) -> str:
    """Canonical form of a token by table alone: look-alikes change only in company of Latin letters."""
    t = unicodedata.normalize("NFC", token.translate(TRANSLATE))
    t = LONE_MARK.sub("", t)
    t = TABLE_RANGE.sub(lambda m: unicodedata.normalize("NFKC", m.group(0)), t)
    if LATIN.search(t):
        parts = re.split(f"([{OTHER}]+)", t)
        # a run that is spelt only with look-alikes stands in; a run with other letters is a word of its own
        t = "".join("".join(WIDE.get(c, c) for c in p) if i % 2 and all(c in WIDE for c in p) else p for i, p in enumerate(parts))
    return t


def odd_tokens(text: str | None) -> list[str]:
    """Distinct tokens of a text that hold an unusual character, unusual spaces as themselves."""
    if not text or text.isascii() or not ODD.search(text):
        return []
    t = EMOJI_JOINT.sub(HELD, text)
    return list(dict.fromkeys([m.group(0) for m in TOKEN.finditer(t)] + [m.group(0) for m in SPACE.finditer(t)]))


def normalize_text(text: str | None, canonical: dict[str, str] | None = None) -> str | None:
    """One consistent form of a text; ``canonical`` overrides the table token by token."""
    if not text or text.isascii() or not ODD.search(text):
        return text
    t = EMOJI_JOINT.sub(HELD, text)
    t = TOKEN.sub(lambda m: (canonical or {}).get(m.group(0)) or by_table(m.group(0)), t)
    return SPACE.sub(" ", t).replace(HELD, "\u200d") if HELD not in text else SPACE.sub(" ", t)


def texts_of(notes: DataFrame, ocr: DataFrame) -> DataFrame:
    """(field, record_key, text) of both text columns; null keys and null texts are left out."""
    a = notes.select(F.lit("notes.body_text").alias("field"), F.col("note_id").alias("record_key"), F.col("body_text").alias("text"))
    b = ocr.select(F.lit("ocr_results.text").alias("field"), F.col("ocr_id").alias("record_key"), F.col("text"))
    return a.unionByName(b).where(F.col("text").isNotNull() & F.col("record_key").isNotNull())


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, n) of every Latin-letter word of the corpus, counted over all texts."""
    def count(column):
        seen: Counter[str] = Counter()
        for text in column:
            seen.update(WORD.findall(text))
        return seen.items()

    return flat_map_batches(texts.select("text"), count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def resolve(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, canonical, how) for distinct tokens; how is 'trie' or 'table'.

    Tokens and words meet by a hash of the skeleton. Only words whose skeleton
    some token has are shuffled into a trie (left semi on the skeleton).
    """
    t = flat_map_batches(tokens.select("token").distinct(), lambda values: ((v, skeleton(v)) for v in values), "token string, skel string")
    v = merge_join(vocab.withColumn("skel", F.col("word")), t.select("skel").distinct(), "skel", "left_semi")
    both = t.select("skel", "token", F.lit(None).cast("string").alias("word"), F.lit(None).cast("bigint").alias("n")).unionByName(v.select("skel", F.lit(None).cast("string").alias("token"), "word", "n"))

    def run(batches):
        trie = Trie()
        for skels, toks, words, counts in batches:
            for tok, w, n in zip(toks, words, counts):
                if tok is None:
                    trie.add(w, n)
                else:
                    hit = trie.match(tok)
                    yield (tok, hit, "trie") if hit else (tok, by_table(tok), "table")

    # after the semi join words are few; within a bucket they come first and make its trie
    parts = both.repartition("skel").sortWithinPartitions(F.col("word").isNull(), "skel")
    return flat_map_partitions(parts, run, "token string, canonical string, how string")


def occurrences(texts: DataFrame) -> DataFrame:
    """(field, record_key, token) of unusual tokens; unusual spaces, which need no vocabulary, are one token null."""
    def scan(fields, keys, column):
        for f, k, text in zip(fields, keys, column):
            for token in dict.fromkeys(None if SPACE.fullmatch(t) else t for t in odd_tokens(text)):
                yield f, k, token

    return flat_map_batches(texts.select("field", "record_key", "text"), scan, "field string, record_key string, token string")


def lookalikes_found(texts: DataFrame) -> DataFrame:
    """Distinct (field, record_key) of texts with a token that changes in normalisation."""
    occ = occurrences(texts)
    words = occ.where(F.col("token").isNotNull())
    canon = resolve(words, vocabulary(texts)).where(F.col("canonical") != F.col("token")).select("token")
    spaces = occ.where(F.col("token").isNull()).select("field", "record_key")
    return spaces.unionByName(merge_join(words, canon, "token", "left_semi").select("field", "record_key")).distinct()


def normalized(texts: DataFrame) -> DataFrame:
    """(field, record_key, text, normal) with every text in one consistent form."""
    occ = occurrences(texts).where(F.col("token").isNotNull())
    canon = resolve(occ, vocabulary(texts))
    per = merge_join(occ.distinct(), canon.where(F.col("how") == "trie"), "token").groupBy("field", "record_key").agg(F.map_from_entries(F.collect_set(F.struct("token", "canonical"))).alias("canon"))

    def apply(fields, keys, column, canons):
        for f, k, text, c in zip(fields, keys, column, canons):
            yield f, k, text, normalize_text(text, dict(c) if c else None)

    return flat_map_batches(merge_join(texts.select("field", "record_key", "text").distinct(), per, ["field", "record_key"], "left").select("field", "record_key", "text", "canon"), apply, "field string, record_key string, text string, normal string")
