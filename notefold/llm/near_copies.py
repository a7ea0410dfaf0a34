"""Near-duplicate records with small edits (problem 5).

Texts with the same characters (white space aside) are one class, so a text
copied a million times is compared once. Classes meet in blocks: ``BANDS`` keys
of ``ROWS`` minima each, taken of the set of five-character strings itself. Two
sets of similarity s share a key with probability 1 - (1 - s^ROWS)^BANDS, which
depends on the pair alone: no other copy of the text, however many there are,
can keep the two apart. Every key counts, none is dropped for its block's size.

A block is a branch of a signature tree whose nodes hold the OR and the AND of
the members' token bitmaps and the range of their sizes. A dual traversal visits
pairs of nodes and turns back where the sizes or the largest possible overlap
rule out every pair below; the bound is exact, it never loses a pair. What
remains is verified on the whole sets of strings. A block too large for one task
is cut into chunks that are traversed chunk by chunk.

Defined results: null, empty and short texts (fewer than ``least`` characters
without white space) have no partners; repeated rows count once; texts are read
whole; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notefold.functions.arrow import flat_map_batches, flat_map_partitions
from notefold.functions.checkpoint import settle
from notefold.functions.joins import merge_join

#: White space of every script, as Python's str.isspace has it.
SPACE = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Least and greatest number of bits of a token bitmap; it has twice as many bits as the set has tokens, or more.
LEAST_BITS, MOST_BITS = 512, 1 << 16
#: Keys of a class, and minima in each: a pair of similarity 0.6 is missed once in 85, one of 0.65 once in 500, one of 0.7 once in 6 000.
BANDS, ROWS = 32, 4
#: Bits of a key, and of the shorter form by which keys are counted; a false match costs time, never a result.
KEY_BITS, COUNT_BITS = 48, 40
#: Children of a tree node.
FANOUT = 8

_draw = np.random.default_rng(5)
_XOR = _draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)[:, None]
_TIMES = (_draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1))[:, None]


def shingles_of(text: str, width: int) -> np.ndarray:
    """Distinct 32-bit hashes of the ``width``-character strings of a text."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(a) - width + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    h = a[:n].copy()
    for i in range(1, width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += a[i : i + n]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def band_keys(hashes: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit key for each band; equal minima in equal bands make equal keys.

    Long sets are reduced piece by piece, so that memory stays small.
    """
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 4096):
        np.minimum(least, ((hashes[None, i : i + 4096] ^ _XOR) * _TIMES).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(seed)
    for r in range(ROWS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r]
        key ^= key >> np.uint64(29)
    return ((key * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """One bit a token; the width is a power of two that follows the size of the set."""
    width = min(max(LEAST_BITS, 1 << (2 * len(hashes) - 1).bit_length()), MOST_BITS) if len(hashes) else LEAST_BITS
    bits = np.zeros(width, np.uint8)
    bits[(hashes & np.uint32(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: int, width: int, to: int) -> int:
    """A bitmap at a narrower width: the bits that fall together are OR-combined."""
    while width > to:
        width //= 2
        bits = (bits & ((1 << width) - 1)) | (bits >> width)
    return bits


def squeezed(texts: DataFrame, least: int) -> DataFrame:
    """(field, record_key, cls, t): texts long enough without their white space, and the class of each."""
    t = F.regexp_replace("text", SPACE, "")
    return texts.select("field", "record_key", t.alias("t")).where(F.length("t") >= least).select("field", "record_key", F.xxhash64("field", "t").alias("cls"), "t")


def signatures(found: DataFrame, width: int) -> DataFrame:
    """(field, record_key, cls, size, bits, bands); a class that a task has met before is not signed again (nulls)."""
    def scan(batches):
        met: set[int] = set()
        for fields, keys, classes, column in batches:
            for f, k, c, t in zip(fields, keys, classes, column):
                if c in met:
                    yield f, k, c, None, None, None
                    continue
                met.add(c)
                h = shingles_of(t, width)
                yield f, k, c, len(h), bitmap(h), band_keys(h, xxhash.xxh32_intdigest(f)).tolist()

    return flat_map_partitions(found.select("field", "record_key", "cls", "t"), scan, "field string, record_key string, cls bigint, size int, bits binary, bands array<bigint>", 2000)


class Node:
    """A branch: OR and AND of the bitmaps below at their least width, least and greatest size."""

    __slots__ = ("any", "every", "high", "kids", "low", "member", "width")

    def __init__(self, kids: list[Node] | None, member: tuple | None = None) -> None:
        self.kids, self.member = kids, member
        if member:
            self.any = self.every = int.from_bytes(member[2], "little")
            self.width = 8 * len(member[2])
            self.low = self.high = member[1]
        else:
            self.width = min(k.width for k in kids)
            self.any, self.every = 0, -1
            for k in kids:
                self.any |= folded(k.any, k.width, self.width)
                self.every &= folded(k.every, k.width, self.width)
            self.low, self.high = min(k.low for k in kids), max(k.high for k in kids)


def tree(members: list[tuple]) -> Node:
    """Balanced signature tree; neighbours in size and bitmap share a branch."""
    level = [Node(None, m) for m in sorted(members, key=lambda m: (m[1], m[2]))]
    while len(level) > 1:
        level = [Node(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
    return level[0]


def possible(a: Node, b: Node, similarity: float) -> bool:
    """Whether a pair below the two nodes may reach the similarity.

    A bit that every set of one branch has and no set of the other stands for a
    token of the one that the other lacks; so the overlap is at most the greater
    size less these bits, on either side. Sets of similarity s overlap in at
    least s / (1 + s) of their sizes' sum.
    """
    if a.high < similarity * b.low or b.high < similarity * a.low:
        return False
    width = min(a.width, b.width)
    x, y = folded(a.any, a.width, width), folded(b.any, b.width, width)
    if a.member and b.member:
        overlap = (a.high + b.high - (x ^ y).bit_count()) / 2
    else:
        overlap = min(a.high - (folded(a.every, a.width, width) & ~y).bit_count(), b.high - (folded(b.every, b.width, width) & ~x).bit_count())
    return overlap * (1 + similarity) >= similarity * (a.low + b.low) - 1e-9


def traverse(a: Node, b: Node, similarity: float):
    """Pairs of members, one under each node (under the same node: each pair once)."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x is y:
            if x.kids:
                for i, k in enumerate(x.kids):
                    stack.append((k, k))
                    stack.extend((k, m) for m in x.kids[i + 1 :])
        elif possible(x, y, similarity):
            if x.member and y.member:
                yield x.member, y.member
            elif y.member or (x.kids and x.high - x.low >= y.high - y.low):
                stack.extend((k, y) for k in x.kids)
            else:
                stack.extend((x, k) for k in y.kids)


def blocks(found: DataFrame, chunk: int) -> DataFrame:
    """(h, lo, hi, first, cls, size, bits): each class in every block that it shares with another.

    Counts of a key are partial aggregates; a copy counts once a task at most. A
    block of more than ``chunk`` classes becomes a triangle of chunk pairs.
    """
    signed = found.where(F.col("bands").isNotNull())
    postings = signed.select("cls", F.explode("bands").alias("h"))
    short = F.shiftright("h", KEY_BITS - COUNT_BITS)
    count = postings.groupBy(short.alias("c")).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    placed = merge_join(postings, count, short == F.col("c")).select("cls", "h", "n").repartition("cls").groupBy("cls", "h").agg(F.max("n").alias("n"))
    sets = signed.groupBy("cls").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    at = merge_join(placed, sets, "cls")
    m = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    mine = F.pmod(F.xxhash64("cls"), m.cast("bigint")).cast("int")
    spread = at.select("cls", "size", "bits", "h", mine.alias("mine"), F.explode(F.sequence(F.lit(0), m - 1)).alias("other"))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    return spread.select("h", lo.alias("lo"), hi.alias("hi"), (F.col("mine") == lo).alias("first"), "cls", "size", "bits")


def candidate_pairs(placed: DataFrame, similarity: float) -> DataFrame:
    """Distinct (a, b) of classes that the traversals leave."""
    parts = placed.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")

    def run(batches):
        pending: list[tuple] = []
        current = None
        out: set[tuple[int, int]] = set()

        def finish():
            if len(pending) < 2:
                return
            lo, hi = current[1:]
            left = [m for m in pending if m[3]]
            right = [m for m in pending if not m[3]] if lo != hi else left
            if not left or not right:
                return
            a = tree(left)
            for x, y in traverse(a, a if lo == hi else tree(right), similarity):
                if x[0] != y[0]:
                    out.add((min(x[0], y[0]), max(x[0], y[0])))

        def flush():
            rows = sorted(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"])

        for batch in batches:
            hs, los, his, firsts, cs, ss, bs = (c.to_pylist() for c in batch.columns)
            for h, lo, hi, first, c, s, b in zip(hs, los, his, firsts, cs, ss, bs):
                if (h, lo, hi) != current:
                    finish()
                    pending.clear()
                    current = (h, lo, hi)
                pending.append((c, s, b, first))
            if len(out) > 50_000:
                yield flush()
        finish()
        yield flush()

    return parts.select("h", "lo", "hi", "first", "cls", "size", "bits").mapInArrow(run, "a bigint, b bigint").distinct()


def bodies_of(pairs: DataFrame, long: DataFrame) -> DataFrame:
    """(cls, t): one text of each class in a pair."""
    ids = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    return merge_join(long.groupBy("cls").agg(F.first("t").alias("t")), ids, "cls", "left_semi")


def verified(pairs: DataFrame, bodies: DataFrame, similarity: float, width: int) -> DataFrame:
    """(a, b, similarity) of the pairs of classes whose whole sets of strings reach the similarity."""
    left = merge_join(pairs.select("a", "b"), bodies.select(F.col("cls").alias("a"), F.col("t").alias("ta")), "a")
    both = merge_join(left, bodies.select(F.col("cls").alias("b"), F.col("t").alias("tb")), "b")

    def strings(t: str) -> set[str]:
        return {t[i : i + width] for i in range(len(t) - width + 1)}

    def check(aa, bb, tas, tbs):
        last, right = None, set()
        for a, b, ta, tb in zip(aa, bb, tas, tbs):
            if b != last:
                last, right = b, strings(tb)
            left = strings(ta)
            common = len(left & right)
            j = common / (len(left) + len(right) - common)
            if j >= similarity:
                yield a, b, j

    return settle(flat_map_batches(both.select("a", "b", "ta", "tb"), check, "a bigint, b bigint, similarity double"))


def near_copies(texts: DataFrame, similarity: float = 0.6, width: int = 5, least: int = 150, chunk: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Members (field, record_key, cls) and class pairs (a, b, similarity).

    Within a class every two members are copies; between classes the pairs link
    representatives, so that exact copies are not spread into all pairs.
    """
    long = squeezed(texts.select("field", "record_key", "text"), least)
    found = settle(signatures(long, width))
    members = found.select("field", "record_key", "cls").distinct()
    pairs = settle(candidate_pairs(blocks(found, chunk), similarity))
    return members, verified(pairs, bodies_of(pairs, long), similarity, width)


def copies_found(texts: DataFrame) -> DataFrame:
    """Distinct (field, key_a, key_b) of records that are copies, keys in code point order.

    The form asked for lists pairs, so a class of many exact copies gives many;
    :func:`copy_groups` is the form for data with large classes.
    """
    members, pairs = near_copies(texts)
    left = members.select("field", F.col("cls").alias("a"), F.col("record_key").alias("ka"))
    right = members.select(F.col("cls").alias("b"), F.col("record_key").alias("kb"))
    across = merge_join(merge_join(pairs.select("a", "b"), left, "a"), right, "b").select("field", "ka", "kb")
    several = members.groupBy("cls").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("cls")
    inside = merge_join(members, several, "cls", "left_semi")
    within = merge_join(inside.select("field", "cls", F.col("record_key").alias("ka")), inside.select("cls", F.col("record_key").alias("kb")), "cls").where(F.col("ka") < F.col("kb")).select("field", "ka", "kb")
    return across.unionByName(within).where(F.col("ka") != F.col("kb")).select("field", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def copy_groups(texts: DataFrame) -> DataFrame:
    """(field, record_key, cls, grp, links): each record's class, its group of linked classes, and its number of class links.

    Groups are found by passing the least class id along the links and then along
    pointers, until nothing changes.
    """
    members, pairs = near_copies(texts)
    edges = settle(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settle(edges.select("a").distinct().select("a", F.col("a").alias("grp")))
    while True:
        near = merge_join(edges, label.select(F.col("a").alias("b"), "grp"), "b").groupBy("a").agg(F.min("grp").alias("m"))
        step = merge_join(label, near, "a").select("a", F.least("grp", "m").alias("grp"), F.col("grp").alias("old"))
        jump = step.select(F.col("a").alias("p"), F.col("grp").alias("pg"))
        nxt = settle(merge_join(step, jump, step.grp == jump.p).select("a", F.least("grp", "pg").alias("grp"), "old"))
        label = nxt.select("a", "grp")
        if not nxt.where(F.col("grp") != F.col("old")).take(1):
            break
    links = edges.groupBy("a").agg(F.count("*").alias("links"))
    info = merge_join(label, links, "a").withColumnRenamed("a", "cls")
    return merge_join(members, info, "cls", "left").select("field", "record_key", "cls", F.coalesce("grp", "cls").alias("grp"), F.coalesce("links", F.lit(0)).alias("links"))
