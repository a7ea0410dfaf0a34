import base64
import random
import re

import numpy as np
import pytest

from notefold.llm import bpe, lookalikes, near_copies, packing

PATH = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"


# ---- problem 8 ----
def test_ids_equal_the_public_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdeéü中文 \n\t'sr0129.,!🙂ａ") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", None, "  \r\n x", "<|endoftext|>", "a" * 4000, "中" * 3000, "同" * 50]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for row in bpe.encode_corpus(df).collect():
        t = texts[row.doc_id]
        assert row.ids == (enc.encode_ordinary(t) if t else []), t
    assert {r.doc_id: r.n_tokens for r in bpe.encode_corpus(df, lengths_only=True).collect()} == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# ---- problem 9 ----
@pytest.mark.parametrize("capacity", [1, 7, 64, 2048])
def test_packing(spark, capacity):
    rng = random.Random(capacity)
    sizes = [rng.choice([0, 1, capacity, capacity + 3, rng.randint(1, 3 * capacity)]) for _ in range(400)] + [capacity // 2 or 1] * 300
    items = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(9999, None)], "doc_id long, n_tokens long")
    rows = packing.pack(items, capacity, salts=8).collect()
    load, per = {}, {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.size
        per.setdefault(r.doc_id, []).append(r.size)
    assert max(load.values()) <= capacity
    for i, n in [*enumerate(sizes), (9999, 0)]:
        assert sum(per[i]) == n and all(s == capacity for s in sorted(per[i], reverse=True)[: n // capacity]) and len(per[i]) == max(1, -(-n // capacity))
    used = sum(v > 0 for v in load.values())
    assert used <= -(-sum(sizes) // capacity) * 1.08 + 2
    assert packing.pack(items.limit(0), capacity).count() == 0


# ---- problem 5 ----
def brute(texts, width=5, least=150, similarity=0.6):
    sets = {}
    for k, t in texts.items():
        t = re.sub(near_copies.SPACE, "", t or "")
        if len(t) >= least:
            sets[k] = {t[i : i + width] for i in range(len(t) - width + 1)}
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    texts = {}
    for g in range(40):
        base = [word() for _ in range(rng.randint(40, 120))]
        for c in range(rng.randint(1, 5)):
            copy = [word() if rng.random() < 0.05 else w for w in base]
            if rng.random() < 0.3:
                i = rng.randrange(len(copy))
                copy = copy[i:] + copy[:i]
            texts[f"{g:02d}-{c}"] = " ".join(copy)
    texts["x1"] = texts["x2"] = texts["x3"] = "完全相同的一段文字" * 30
    texts["short1"] = texts["short2"] = "短" * 100
    texts["none"], texts["empty"] = None, ""
    notes = spark.createDataFrame([(k, t) for k, t in texts.items()] + [("x1", texts["x1"])], "note_id string, body_text string")
    ocr = spark.createDataFrame([("x9", texts["x1"])], "ocr_id string, text string")
    found = {(r.key_a, r.key_b) for r in near_copies.copies_found(lookalikes.texts_of(notes, ocr)).collect()}
    want = brute(texts)
    assert found <= want and len(found) >= 0.97 * len(want)
    groups = {r.record_key: (r.grp, r.links) for r in near_copies.copy_groups(lookalikes.texts_of(notes, ocr)).collect()}
    assert groups["x1"][0] == groups["x2"][0] == groups["x3"][0] and all(groups[a][0] == groups[b][0] for a, b in found)


def test_hot_block_in_chunks(spark):
    """A block cut into chunks gives the pairs of the whole block."""
    rng = random.Random(7)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400))
    rows = []
    for i in range(30):
        t = list(base)
        for _ in range(4):
            t[rng.randrange(400)] = "#"
        rows.append((f"k{i:02d}", "".join(t)))
    notes = spark.createDataFrame(rows, "note_id string, body_text string")
    texts = lookalikes.texts_of(notes, spark.createDataFrame([], "ocr_id string, text string"))
    _, pairs = near_copies.near_copies(texts, chunk=4)
    assert pairs.count() == len(brute(dict(rows))) == 30 * 29 // 2


def test_family_of_one_revision(spark):
    """Copies that share their edits do not keep the original from any of them."""
    rng = random.Random(11)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)]
    revised = list(base)
    for i in range(20, 400, 46):
        revised[i] = "#"
    rows = [("t", "".join(base))]
    for i in range(12):
        t = list(revised)
        t[rng.randrange(400)] = "%"
        rows.append((f"r{i:02d}", "".join(t)))
    texts = lookalikes.texts_of(spark.createDataFrame(rows, "note_id string, body_text string"), spark.createDataFrame([], "ocr_id string, text string"))
    assert {(r.key_a, r.key_b) for r in near_copies.copies_found(texts).collect()} == brute(dict(rows))


def test_bound_never_loses_a_pair():
    rng = random.Random(3)
    sets = []
    for _ in range(60):
        base = [rng.getrandbits(32) for _ in range(rng.randint(150, 1200))]
        sets += [base, base[: int(len(base) * rng.uniform(0.5, 1))] + [rng.getrandbits(32) for _ in range(rng.randint(0, 300))]]
    members = []
    for i, s in enumerate(sets):
        h = np.unique(np.array(s, np.uint32))
        members.append((i, len(h), near_copies.bitmap(h), True))
        sets[i] = set(h.tolist())
    root = near_copies.tree(members)
    left = {tuple(sorted((a[0], b[0]))) for a, b in near_copies.traverse(root, root, 0.6)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert want <= left and len(left) < len(sets) * (len(sets) - 1) / 4


def test_near_copies_of_nothing(spark):
    texts = lookalikes.texts_of(spark.createDataFrame([], "note_id string, body_text string"), spark.createDataFrame([], "ocr_id string, text string"))
    assert near_copies.copies_found(texts).count() == 0 and near_copies.copy_groups(texts).count() == 0
