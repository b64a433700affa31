"""The pipeline's near-copy classes against all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from siftline.llm import near_copies, simhash_gray


def planted():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(2000)]
    texts = [None, "", "  ", "one two", "One Two", "one three"]
    for n, edits in ((150, 2), (150, 3), (400, 5), (400, 8), (900, 18), (60, 1), (30, 1), (150, 5), (150, 8), (400, 20)):
        for _ in range(6):
            base = [r.choice(words) for _ in range(n)]
            own = list(base)
            for k in range(edits):
                own[(2 * k + 1) * n // (2 * edits)] = "EDIT"
            texts += [" ".join(base), " ".join(own)]
    hub = [r.choice(words) for _ in range(300)]
    texts.append(" ".join(hub))
    for k in range(40):
        own = list(hub)
        for at in r.sample(range(300), 5):
            own[at] = f"own{k}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("least", [(near_copies.LEAST, near_copies.LEAST_SHARED), (100, 40)])
def test_near_copies_equal_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(near_copies, "LEAST", least[0])
    monkeypatch.setattr(near_copies, "LEAST_SHARED", least[1])
    texts = planted()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for t in texts]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root = list(range(len(texts)))
    near = 0
    for j in range(len(texts)):
        for i in range(j):
            if alike(sets[i], sets[j]):
                near += sets[i] != sets[j]
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert near > 60
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.simhash_near_dedup(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_hot_buckets_and_empty_input(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(planted())] + [(3, "one two"), (None, "one two")], "doc_id long, text string")
    want, cut = ({(r["doc_id"], r["text_hash"], r["class_fp"]) for r in near_copies.classes(frame, hot=h).collect()} for h in (simhash_gray.HOT, 5))
    assert len({c for *_, c in want}) == len({c for *_, c in cut})
    assert near_copies.keep_one(frame.limit(0)).count() == 0


def test_candidates_come_from_simhash_blocks(spark):
    """Nodes meet in a bucket where a block of their SimHashes is equal, and only there; every similar pair is a candidate."""
    frame = spark.createDataFrame(list(enumerate(planted())), "doc_id long, text string")
    rows = near_copies.sketches(frame).where("length(print) > 0").dropDuplicates(["node"])
    bits = {r["node"]: np.unpackbits(np.frombuffer(r["print"], np.uint8)) for r in rows.collect()}
    assert {len(b) // near_copies.BITS // near_copies.TABLES for b in bits.values()} <= {1, 2}
    own = near_copies.shingle_set(planted()[6])
    ones = sum(simhash_gray.wide_print(own[k : k + 1], 1).astype(int) for k in range(len(own)))
    assert simhash_gray.wide_print(own, 1).tolist() == (2 * ones > len(own)).astype(int).tolist()
    placed = rows.select("node", "print").mapInArrow(near_copies._placed, near_copies.MEMBER.removesuffix(", side int")).toPandas()
    blocks = lambda b: {(k, b[k * near_copies.BITS : (k + 1) * near_copies.BITS].tobytes()) for k in range(len(b) // near_copies.BITS)}
    held = placed.groupby("node")["bucket"].agg(set).to_dict()
    nodes = sorted(bits)[:60]
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            assert len(held[a] & held[b]) == len(blocks(bits[a]) & blocks(bits[b]))
    kept = corpus_pipeline.simhash_near_dedup(spark, frame, "").count()
    assert kept < len(bits)


def test_wide_index_connects_what_all_pairs_do():
    r = np.random.default_rng(3)
    words = [r.integers(0, 1 << 63, 900, dtype=np.uint64) for _ in range(3)]
    for k in range(300):  # chains of near ones
        for w in words:
            w[600 + k] = w[k if k % 3 else 600 + max(k - 1, 0)] ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 6, dtype=np.uint64))
    bucket, side = r.integers(0, 3, 300).repeat(3).reshape(300, 3).T.ravel(), np.zeros(900, np.int64)
    index = simhash_gray.GrayIndex(bucket, words[0], side, tuple(words[1:]), 40)
    root = index.order[index.grow(14)]
    root = dict(zip(index.order.tolist(), root.tolist(), strict=True))
    want = list(range(900))
    for a in range(900):
        apart = [np.bitwise_count(w[a] ^ w[:a]).astype(int) for w in words]
        for b in np.flatnonzero((bucket[:a] == bucket[a]) & (apart[0] <= 14) & (sum(apart) <= 40)).tolist():
            x, y = want[a], want[b]
            want = [x if v == y else v for v in want]
    assert len(set(want)) < 700
    assert len(set(zip(want, (root[k] for k in range(900)), strict=True))) == len(set(want)) == len(set(root.values()))


def test_large_group_has_two_pairs_a_node_checked(spark, monkeypatch):
    """Texts of a group whose pairs are all candidates: two pairs of each node meet their texts, not one for every bucket, and the classes are whole."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(2000)]
    texts = []
    for edits in (3, 9):  # copies that are similar to each other, and copies whose pairs mostly are not
        base = [r.choice(words) for _ in range(200)]
        for k in range(150):
            own = list(base)
            for at in r.sample(range(200), edits):
                own[at] = f"own{k}"
            texts.append(" ".join(own))
    sets = [near_copies.shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if root[i] != root[j] and near_copies.similarity(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    checked, similar = [], near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda t, pairs, s: checked.append(pairs.count()) or similar(t, pairs, s))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in near_copies.keep_one(frame).collect())
    assert kept == sorted(set(root))
    assert 0 < checked[0] <= 2 * len(texts)
    assert len(checked) == 1  # sets of up to LEAST shingles are decided in their buckets


def test_pair_is_decided_in_its_first_table():
    """Members that differ in one bit share nearly every block; only the bucket of the first one compares them, and cut buckets compare all."""
    fp = np.array([[7, 8, 9], [7, 8, 9 ^ 1]], np.uint64)
    blocks, none = near_copies._blocks(fp), np.zeros(2, np.int64)
    of = lambda bucket, size: near_copies._Bucket(bucket, fp, blocks, none, np.array(size), np.array([1, 2]), 0.8).open(0).tolist()
    assert blocks.shape == (2, 64 * near_copies.WORDS // near_copies.BITS)
    assert of(5, (100, 90)) == [1] and of(5 + (3 << near_copies.BITS), (100, 90)) == []
    assert of(-5, (100, 90)) == [1] and of(1 << 60, (100, 90)) == [1]
    assert of(5, (100, 79)) == []
