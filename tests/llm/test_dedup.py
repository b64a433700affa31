"""SimHash classes and repeated strings against brute-force versions."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from siftline.llm import components, simhash_gray, suffix_levels
from siftline.llm import rows as llm_rows


def roots(ids, edges):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 80)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    want = roots({x for e in edges for x in e}, edges)
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: k for i, k in want.items() if any(i in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("trial", range(6))
def test_gray_index_joins_all_links(trial):
    rng = np.random.default_rng(trial)
    prints = []
    for base in rng.integers(0, 2**63, 30, dtype=np.uint64):
        for _ in range(int(rng.integers(1, 60))):
            v = int(base)
            for k in rng.integers(0, 64, int(rng.integers(0, 6))):
                v ^= 1 << int(k)
            prints.append(v)
    fp = np.unique(np.array(prints, np.uint64))
    bucket = (fp % np.uint64(3)).astype(np.int64) if trial % 2 else np.zeros(len(fp), np.int64)
    side = rng.integers(1, 3, len(fp)) if trial > 3 else np.zeros(len(fp), np.int64)
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4) & (bucket[:, None] == bucket) & ((side[:, None] == 0) | (side[:, None] != side))
    ids = [int(x) for x in fp]
    a, b = simhash_gray.GrayIndex(bucket, fp, side).join(4)
    assert roots(ids, zip(map(int, a), map(int, b), strict=True)) == roots(ids, [(ids[i], ids[j]) for i, j in np.argwhere(np.triu(near, 1))])


def documents(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéfgh") for _ in range(r.randrange(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [text(60) for _ in range(4)]
    texts = [None, "", "a" * 199, "a" * 200, "a" * 201, "b" * 1000, "ab" * 500, passages[0], passages[0], passages[0] + "x", "y" + passages[0][5:] + "z"]
    for _ in range(60):
        texts.append(text(r.randrange(5, 60)) + " " + r.choice(passages)[r.randrange(80) :][: r.randrange(150, 400)] + " " + text(r.randrange(50)))
    for _ in range(10):
        base = text(150).split()
        texts.append(" ".join(base))
        for _ in range(3):
            own = list(base)
            own[r.randrange(150)] = "EDIT"
            texts.append(" ".join(own))
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(7, passages[0], 1, "x"), (None, passages[1], 1, "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, gram int, fp string").repartition(3)


def test_simhash_equals_brute_force(spark):
    rows, frame = documents(spark)
    prints = {}
    for k, (_, t, *_) in enumerate(rows):
        w = (t or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    edges = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 4]
    own = roots(prints, edges)
    least = collections.defaultdict(list)
    for k, root in own.items():
        least[root] += [rows[k][0]] if rows[k][0] is not None else []
    want = collections.Counter((rows[k][0], f"{prints[k]:016x}", min(least[own[k]], default=None)) for k in prints)
    for hot in (simhash_gray.HOT, 3):
        assert collections.Counter(map(tuple, simhash_gray.near_duplicates(frame, hot=hot).collect())) == want
    kept = simhash_gray.keep_one(frame)
    assert kept.columns == frame.columns and kept.count() == len(set(own.values()))
    assert simhash_gray.near_duplicates(frame.limit(0)).count() == 0


def brute(texts):
    count, datas = collections.Counter(), [(t or "").encode() for t in texts]
    for d in datas:
        count.update(d[i : i + 200] for i in range(len(d) - 199))
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if count[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(d, gone, strict=True) if not y)
        yield len(d), len(d) - len(kept), sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()


def test_repeats_equal_brute_force(spark, monkeypatch):
    rows, frame = documents(spark)
    want = collections.Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows]), strict=True))
    for hot, shares in ((suffix_levels.HOT, 10_000), (0, 10_000), (suffix_levels.HOT, 3), (0, 3)):
        monkeypatch.setattr(llm_rows, "SHARES", shares)
        assert collections.Counter(map(tuple, suffix_levels.remove_repeats(frame, hot).collect())) == want
    assert suffix_levels.remove_repeats(frame.limit(0)).count() == 0


def test_repeats_across_chunks_and_thue_morse(spark, monkeypatch):
    """Texts longer than a chunk, and texts on which polynomial hashes collide."""
    r = random.Random(7)
    morse = "".join("ab"[i.bit_count() % 2] for i in range(6_000))
    body = "".join(r.choice("abcdefgh ") for _ in range(9_000))
    texts = [morse, morse[1_500:], body, "x" + body[200:5_000] + "y" + body[5_100:], body[4_000:4_400], "\0" * 500 + "a", "\0" * 199]
    monkeypatch.setattr(suffix_levels, "CHUNK", 1_000)
    want = collections.Counter((i, *b) for i, b in enumerate(brute(texts)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert collections.Counter(map(tuple, suffix_levels.remove_repeats(frame).collect())) == want


@pytest.mark.parametrize("batch", [3, 7, 1000])
def test_batches_of_one_gram_equal_pairs(batch):
    """However the suffixes come in batches, reaches are those of all pairs."""
    r = np.random.default_rng(batch)
    reach, length = suffix_levels.REACH, suffix_levels.LENGTH
    stems = r.integers(97, 99, (4, reach + length)).astype(np.uint8)
    rows = stems[r.integers(0, 4, 60)].copy()
    rows[:, reach : reach + 32] = 65
    for row in rows:
        for at in r.integers(0, reach + length, r.integers(0, 3)):
            if not reach <= at < reach + 32:
                row[at] = 99
    left, right = np.where(r.random(60) < 0.2, r.integers(0, reach, 60), reach), np.where(r.random(60) < 0.2, r.integers(32, length, 60), length)
    for row, a, b in zip(rows, left, right, strict=True):
        row[: reach - a] = 0
        row[reach + b :] = 0
    want = [[0, 0] for _ in rows]
    for i in range(60):
        for j in range(60):
            for a in range(reach + 1):
                if i != j and a <= min(left[i], left[j]) and length - a <= min(right[i], right[j]) and (rows[i, reach - a : reach - a + length] == rows[j, reach - a : reach - a + length]).all():
                    want[i] = [max(want[i][0], a), max(want[i][1], length - a)]
    levels = suffix_levels.SuffixLevels()
    for at in range(0, 60, batch):
        levels.add(rows[at : at + batch], left[at : at + batch], right[at : at + batch])
    assert np.stack([levels.reach_left, levels.reach_right], axis=1)[:60].tolist() == want


def test_levels_grow_geometrically():
    levels = suffix_levels.SuffixLevels()
    rng = np.random.default_rng(1)
    width = suffix_levels.REACH + suffix_levels.LENGTH
    for _ in range(37):
        rows = rng.integers(97, 123, (8, width)).astype(np.uint8)
        levels.add(rows, np.full(8, suffix_levels.REACH), np.full(8, suffix_levels.LENGTH))
    sizes = [len(x) for x in levels.levels]
    assert sum(sizes) == 37 * 8 and len(sizes) <= 6 and all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    again = levels.rows[:8].copy()
    levels.add(again, np.full(8, suffix_levels.REACH), np.full(8, suffix_levels.LENGTH))
    right, left = levels.reach_right[: levels.size], levels.reach_left[: levels.size]
    assert (right[:8] == 200).all() and (left[-8:] == suffix_levels.REACH).all() and not right[8:-8].any()
