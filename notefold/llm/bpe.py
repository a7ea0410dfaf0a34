"""Byte-pair encoding of a corpus by dynamic programming over prefixes (problem 8).

For each prefix of a pre-token there is exactly one token that can come last in
its encoding: the longest vocabulary token that ends there and is compatible
with the last token of the prefix before it. An automaton of the vocabulary's
suffixes yields the matches, pair compatibility is decided from the merge ranks,
and the back-pointers of the full prefix give the ids. Pre-tokens of a batch are
worked on side by side with array operations, each distinct one once.

Defined results: a null text and an empty text have no ids (an empty list).
Special tokens' strings are ordinary text. Texts are read whole.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Folder of the public tokenizer files, a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the split pattern of byte-level BPE with 50k tokens.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = re.compile(PATTERN)
NONE = np.int32(-1)


class Vocabulary:
    """Tables of one byte-level BPE vocabulary given as ranked byte strings."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = n = len(ranks)
        by_id = [b""] * n
        for token, rank in ranks.items():
            by_id[rank] = token
        self.length = np.array([len(t) for t in by_id], np.int32)
        # split of each token into the two it was merged from: the last merge its own bytes make
        self.left = np.arange(n, dtype=np.int32)
        self.right = np.arange(n, dtype=np.int32)
        pairs: dict[int, int] = {}
        for rank, token in enumerate(by_id):
            if len(token) > 1:
                a, b = self._last_merge(token, rank, ranks)
                self.left[rank], self.right[rank] = a, b
                pairs[a * n + b] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self._automaton(ranks)
        self.memo_key = np.full(1 << 20, -1, np.int64)
        self.memo_ok = np.zeros(1 << 20, bool)

    @staticmethod
    def _last_merge(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 30))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def _automaton(self, ranks: dict[bytes, int]) -> None:
        """Trie with suffix links: per state the longest token ending there; per token the next shorter one."""
        goto: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for token, rank in ranks.items():
            s = 0
            for c in token:
                nxt = goto[s].get(c)
                if nxt is None:
                    nxt = goto[s][c] = len(goto)
                    goto.append({})
                    ends.append(-1)
                s = nxt
            ends[s] = rank
        n = len(goto)
        table = np.zeros((n, 256), np.int32)
        longest = np.full(n, NONE)
        shorter = np.full(self.size, NONE)
        link = np.zeros(n, np.int32)
        level = [0]
        for c, t in goto[0].items():
            table[0, c] = t
        while level:
            below = []
            for s in level:
                for c, t in goto[s].items():
                    if s:
                        link[t] = table[link[s], c]
                    below.append(t)
            for t in below:
                table[t] = table[link[t]]
                for c, u in goto[t].items():
                    table[t, c] = u
                up = longest[link[t]]
                if ends[t] >= 0:
                    longest[t] = ends[t]
                    shorter[ends[t]] = up
                else:
                    longest[t] = up
            level = below
        self.table, self.longest, self.shorter = table, longest, shorter

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may follow token a: no merge across their border comes earlier than either was made."""
        ok = a < 0
        key = a.astype(np.int64) * self.size + b
        slot = self._slot(key)
        known = self.memo_key[slot] == key
        ok = np.where(ok, True, self.memo_ok[slot] & known)
        todo = np.flatnonzero(~known & (a >= 0))
        if len(todo):
            keys, first = np.unique(key[todo], return_index=True)
            fresh = self._decide(a[todo[first]].astype(np.int64), b[todo[first]].astype(np.int64))
            at = self._slot(keys)
            self.memo_key[at], self.memo_ok[at] = keys, fresh
            ok[todo] = fresh[np.searchsorted(keys, key[todo])]
        return ok

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _decide(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo the two tokens' merges, latest first; a border pair that merges before the undone one forbids them."""
        n = len(a)
        ok = np.ones(n, bool)
        a, b = a.copy(), b.copy()
        limit = np.full(n, 1 << 40, np.int64)
        live = np.arange(n)
        while len(live):
            x, y = a[live], b[live]
            key = x * self.size + y
            pos = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merged = (self.pair_keys[pos] == key) & (self.pair_rank[pos] < limit[live])
            ok[live[merged]] = False
            live, x, y = live[~merged], x[~merged], y[~merged]
            a_whole, b_whole = self.left[x] == x, self.left[y] == y
            done = a_whole & b_whole
            # the later of the two merges is undone first; on equal ranks the left one is later in time
            turn_a = ~a_whole & (b_whole | (x > y))
            turn_b = ~turn_a & ~done
            limit[live[turn_a]] = x[turn_a]
            limit[live[turn_b]] = y[turn_b] + 1
            a[live[turn_a]] = self.right[x[turn_a]]
            b[live[turn_b]] = self.left[y[turn_b]]
            live = live[~done]
        return ok

    def encode_tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words after one another, and each word's end in them."""
        n = len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        last = np.empty(len(data), np.int32)
        order = np.argsort(-lengths, kind="stable")
        sorted_len = -lengths[order]
        state = np.zeros(n, np.int32)
        top = int(lengths.max()) if n else 0
        for i in range(top):
            act = order[: np.searchsorted(sorted_len, -i, side="left")]
            at = start[act] + i
            st = self.table[state[act], data[at]]
            state[act] = st
            token = self.longest[st].copy()
            open_ = np.arange(len(act))
            while len(open_):
                t = token[open_]
                before = i + 1 - self.length[t]
                fits = before >= 0
                prev = np.full(len(open_), NONE)
                inner = before > 0
                prev[inner] = last[start[act[open_[inner]]] + before[inner] - 1]
                good = fits.copy()
                good[inner] = self.compatible(prev[inner], t[inner])
                bad = open_[~good]
                token[bad] = self.shorter[token[bad]]
                open_ = bad
            last[at] = token
        # back-pointers, all words at once, from their ends
        pos = start + lengths - 1
        live = np.flatnonzero(lengths > 0)
        ids, owner, step = [], [], []
        k = 0
        while len(live):
            t = last[pos[live]]
            ids.append(t)
            owner.append(live)
            step.append(np.full(len(live), k))
            pos[live] -= self.length[t]
            live = live[pos[live] >= start[live]]
            k += 1
        if not ids:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        ids, owner, step = map(np.concatenate, (ids, owner, step))
        by = np.lexsort((-step, owner))
        return ids[by], np.cumsum(np.bincount(owner, minlength=n))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


class Encoder:
    """Encodes batches of texts; distinct pre-tokens of recent batches are remembered."""

    def __init__(self, path: str, remember: int = 400_000) -> None:
        self.vocab, self.remember = vocabulary(path), remember
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts after one another, and each text's end in them."""
        if len(self.index) > self.remember:
            self._reset()
        index, fresh, refs, counts = self.index, [], [], []
        for text in texts:
            words = SPLIT.findall(text) if text else []
            counts.append(len(words))
            for w in words:
                k = index.get(w)
                if k is None:
                    k = index[w] = len(index)
                    fresh.append(w.encode("utf-8", "surrogatepass"))
                refs.append(k)
        if fresh:
            ids, ends = self.vocab.encode_tokens(fresh)
            self.ends = np.concatenate([self.ends, ends + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        refs = np.array(refs, np.int64)
        starts = np.concatenate([[0], self.ends])[:-1]
        size = (self.ends - starts)[refs] if len(refs) else np.zeros(0, np.int64)
        stop = np.cumsum(size)
        flat = np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts[refs] - (stop - size), size)
        text_end = np.concatenate([[0], stop])[np.cumsum(np.array(counts, np.int64))] if texts else np.zeros(0, np.int64)
        return self.ids[flat], text_end


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k", lengths_only: bool = False) -> DataFrame:
    """(key, ids) of every row; with ``lengths_only`` (key, n_tokens). No shuffle."""
    path = f"{folder}/{name}.tiktoken"
    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()) if lengths_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, ends = encoder.encode(part.column(1).to_pylist())
                if lengths_only:
                    second = pa.array(np.diff(ends, prepend=0), pa.int64())
                else:
                    second = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids, pa.int32()))
                    second = second.cast(pa.list_(pa.field("element", pa.int32(), False)))
                yield pa.RecordBatch.from_arrays([part.column(0), second], names=[key, out.fields[1].name])

    return docs.select(key, text).mapInArrow(run, out)
