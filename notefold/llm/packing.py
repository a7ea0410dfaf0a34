"""Items packed into containers of fixed capacity (problem 9).

The driver sees only the histogram of lengths, at most one entry per length up
to the capacity. On it a configuration linear program (which combinations of
lengths fill a container, and how many of each) is solved by multiplicative
weights: lengths not yet covered weigh more, and a knapsack dynamic program
prices the most valuable combination. The solution is rounded down; what is left
over goes, in runs of equal lengths, where it fits best. The outcome is a plan
of runs: items rank by rank of one length to consecutive containers. Each item
finds its container from its length and its rank among items of that length.

Defined results: an item longer than the capacity is cut into full pieces and a
rest; an item of length 0 or null takes no space and sits in container 0; an
empty table has no rows; a capacity that is null or below 1 has no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notefold.functions.checkpoint import settle
from notefold.llm.bpe import TOKENIZERS, encode_corpus


def price(value: np.ndarray, units: np.ndarray, room: int) -> list[int]:
    """Classes of the combination of greatest value within ``room`` units (unbounded knapsack)."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1, np.int64)
    order = np.argsort(units, kind="stable")
    u, v = units[order], value[order]
    for c in range(1, room + 1):
        k = np.searchsorted(u, c, side="right")
        if k:
            got = best[c - u[:k]] + v[:k]
            j = int(got.argmax())
            if got[j] > best[c - 1]:
                best[c], pick[c] = got[j], order[j]
                continue
        best[c] = best[c - 1]
    combo, c = [], room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            combo.append(int(pick[c]))
            c -= int(units[pick[c]])
    return combo


def solve(counts: np.ndarray, units: np.ndarray, room: int, rounds: int = 400, step: float = 0.1, eta: float = 12.0) -> list[tuple[list[int], float]]:
    """Configurations and fractional amounts that cover the counts, by multiplicative weights."""
    covered = np.zeros(len(counts))
    made: dict[tuple[int, ...], float] = {}
    for _ in range(rounds):
        share = covered / counts
        if share.min() >= 1:
            break
        weight = np.exp(-eta * (share - share.min())) / counts
        weight[share >= 1] = 0
        combo = price(weight * units.mean() + 1e-12 * units, units, room)
        kinds, times = np.unique(combo, return_counts=True)
        amount = max(step * float((counts[kinds] / times).min()), 1.0)
        covered[kinds] += amount * times
        key = tuple(sorted(combo))
        made[key] = made.get(key, 0.0) + amount
    return sorted(((list(k), x) for k, x in made.items()), key=lambda kx: (-kx[1], kx[0]))


class Plan:
    """Runs (length, first rank, how many, first container) built from a histogram."""

    def __init__(self, histogram: dict[int, int], capacity: int, classes: int = 512) -> None:
        self.capacity = capacity
        self.runs: list[tuple[int, int, int, int]] = []
        self.used = {s: 0 for s in histogram}
        self.left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
        self.containers = 0
        full = self.left.pop(capacity, 0)
        self._open(capacity, full)
        groups: list[list[int]] = []  # residual, first container, how many
        unit = -(-capacity // classes)
        if self.left:
            self._configured(unit, groups)
        self._best_fit(groups)

    def _take(self, size: int, n: int, container: int) -> None:
        self.runs.append((size, self.used[size], n, container))
        self.used[size] += n
        if size in self.left:
            self.left[size] -= n
            if not self.left[size]:
                del self.left[size]

    def _open(self, size: int, n: int) -> int:
        first = self.containers
        if n:
            self._take(size, n, first)
            self.containers += n
        return first

    def _configured(self, unit: int, groups: list[list[int]]) -> None:
        by_class: dict[int, list[int]] = {}
        for s in sorted(self.left, reverse=True):
            by_class.setdefault(-(-s // unit), []).append(s)
        units = np.array(sorted(by_class), np.int64)
        counts = np.array([sum(self.left[s] for s in by_class[u]) for u in units], float)
        remaining = counts.astype(np.int64)
        room = self.capacity // unit
        fits = units <= room
        if not fits.any():
            return
        for combo, x in solve(counts[fits], units[fits], room):
            kinds, times = np.unique(np.flatnonzero(fits)[combo], return_counts=True)
            k = int(min(np.floor(x), (remaining[kinds] // times).min()))
            if k < 1:
                continue
            remaining[kinds] -= k * times
            mine = [[self.capacity, self.containers, k]]
            self.containers += k
            for c, t in zip(kinds.tolist(), times.tolist()):
                sizes = by_class[int(units[c])]
                for _ in range(t):
                    nxt: list[list[int]] = []
                    for residual, first, n in mine:
                        while n:
                            while sizes[0] not in self.left:
                                sizes.pop(0)
                            m = min(n, self.left[sizes[0]])
                            self._take(sizes[0], m, first)
                            nxt.append([residual - sizes[0], first, m])
                            first, n = first + m, n - m
                    mine = nxt
            groups += mine

    def _best_fit(self, groups: list[list[int]]) -> None:
        """Rest items, longest first, each run into the fullest containers that take it."""
        free = sorted([r, first, n] for r, first, n in groups if r > 0)
        for size in sorted(self.left, reverse=True):
            n = self.left[size]
            while n:
                i = bisect_left(free, [size])
                if i == len(free):
                    per = self.capacity // size
                    whole = n // per
                    if whole:
                        first = self.containers
                        self.containers += whole
                        for _ in range(per):
                            self._take(size, whole, first)
                        n -= whole * per
                        if self.capacity - per * size:
                            insort(free, [self.capacity - per * size, first, whole])
                    else:
                        first = self.containers
                        self.containers += 1
                        for _ in range(n):
                            self._take(size, 1, first)
                        if self.capacity - n * size:
                            insort(free, [self.capacity - n * size, first, 1])
                        n = 0
                    continue
                residual, first, m = free.pop(i)
                k = min(n, m)
                self._take(size, k, first)
                n -= k
                if k < m:
                    insort(free, [residual, first + k, m - k])
                if residual - size:
                    insort(free, [residual - size, first, k])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        runs = np.array(sorted(self.runs) or [(0, 0, 0, 0)], np.int64)
        return runs[:, 0], runs[:, 1], runs[:, 2], runs[:, 3]


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, size): each item whole, or cut where it exceeds the capacity."""
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    count = F.greatest(F.lit(1), F.ceil(n / F.lit(capacity))).cast("int")
    cut = items.select("doc_id", n.alias("n_tokens"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("size"))


def pack(items: DataFrame, capacity: int, salts: int = 64) -> DataFrame:
    """(doc_id, piece, size, container) of items (doc_id, n_tokens).

    Ranks are counted in ``salts`` parts per length, so that one frequent length is
    no single task; the parts' offsets are at most capacity x salts numbers.
    """
    from pyspark.sql import Window

    cut = pieces(items, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    parts = cut.groupBy("size", "salt").count().toPandas().sort_values(["size", "salt"])
    parts["offset"] = parts.groupby("size")["count"].cumsum() - parts["count"]
    plan = Plan({int(s): int(n) for s, n in parts.groupby("size")["count"].sum().items()}, capacity)
    sizes, ranks, _, firsts = plan.arrays()
    keys = sizes * (1 << 40) + ranks
    offset_key = (parts["size"].to_numpy(np.int64) * salts + parts["salt"].to_numpy(np.int64)) if len(parts) else np.zeros(0, np.int64)
    offsets = parts["offset"].to_numpy(np.int64) if len(parts) else np.zeros(0, np.int64)
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece")) - 1)
    out = T.StructType([T.StructField("doc_id", items.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("container", T.LongType())])

    def place(batches):
        import pyarrow as pa

        for b in batches:
            size = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            salt = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = rank + offsets[np.searchsorted(offset_key, size * salts + salt)] if len(rank) else rank
            run = np.searchsorted(keys, size * (1 << 40) + rank, side="right") - 1
            container = np.where(size > 0, firsts[np.maximum(run, 0)] + rank - ranks[np.maximum(run, 0)], 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(container)], names=out.names)

    return ranked.select("doc_id", "piece", "size", "salt", "rank").mapInArrow(place, out)


def pack_documents(docs: DataFrame, capacities: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(capacity_id, doc_id, piece, size, container) for each row of ``capacities`` (a small fixed table)."""
    rows = sorted((r.capacity_id, r.tokenizer, r.capacity) for r in capacities.distinct().collect() if r.capacity and r.capacity > 0)
    lengths = {name: settle(encode_corpus(docs, folder=folder, name=name, lengths_only=True)) for name in {r[1] for r in rows}}
    out = None
    for cid, name, capacity in rows:
        one = pack(lengths[name], capacity).select(F.lit(cid).alias("capacity_id"), "doc_id", "piece", "size", "container")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "capacity_id int, doc_id bigint, piece int, size int, container bigint")
    return out


def fill(packed: DataFrame) -> DataFrame:
    """(capacity_id, containers, tokens, largest): how full the containers are."""
    per = packed.groupBy("capacity_id", "container").agg(F.sum("size").alias("t"))
    return per.groupBy("capacity_id").agg(F.count_if(F.col("t") > 0).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("largest"))
