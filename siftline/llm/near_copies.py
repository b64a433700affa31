"""Near-copies for training: texts whose sets of word shingles have a Jaccard similarity of ``SIMILAR`` or more.

Texts with the same set of five-word shingles are one node. Each node has a SimHash of
``TABLES`` blocks of ``BITS`` bits, and goes to one bucket for each block. At a similarity of
0.8 a bit differs with probability 0.152, so a pair shares a block with probability 0.139, and
none of 69 with 3e-5. Sets of up to ``FEW`` shingles, of which more bits may differ, have twice as
many blocks; of sets of up to 50 none has more than 8e-5. In a bucket the nodes are the members of a Gray-ordered hierarchical index
(``simhash_gray.GrayIndex``) of the SimHash's first ``WORDS`` words: pairs that differ in at
most ``RADIUS`` bits of the first and ``WIDE`` of all (about 29 at 0.8, with a deviation of 5;
others in about 96, with one of 7) are candidates, and a candidate is a link only if the
shingle sets, computed again from the whole texts, are similar enough. Components of the links
are the classes.

Candidates come in two rounds, so a large class does not have all its pairs checked. First a bucket
names those that connect its members, and each member with the middle of those so connected; of a
node's candidates from all its buckets two are checked, the nearest and the least one, so there are no more than
twice as many pairs as nodes. Then buckets that still hold several components get the ``LEAST`` smallest shingle hashes of
those members that have a candidate of another component, which they do not meet in a table before. Where
these are both members' whole sets they decide a pair exactly, in the bucket's task, and
only pairs that join components leave it. Of larger sets a pair goes on to its texts if
``LEAST_SHARED`` hashes are equal: at 0.8 some 410 are, with a deviation of 9, so a link is
lost with probability 4e-7.

Defined results: texts without words are one class; texts of fewer than five words have
one shingle; repeated rows share a class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut, stored
from . import simhash_gray
from .components import connected_components
from .rows import map_rows

SHINGLE = 5
SIMILAR = 0.8
TABLES, BITS, FEW = 69, 12, 16
WORDS, RADIUS, WIDE = 3, 24, 58
LEAST, LEAST_SHARED = 512, 364
HELD = 1 << 17
SEED = 42
PRINT = [f"w{k}" for k in range(WORDS)]
MEMBER = "bucket long, node long, " + ", ".join(f"{w} long" for w in PRINT) + ", side int"


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    return np.unique(simhash_gray.shingle_hashes(text, SHINGLE))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two shingle sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def sketch(own: np.ndarray) -> tuple[int, int, bytes]:
    """Hash of a shingle set, its size, and its SimHash; a set that only an equal one is similar to has none."""
    name = int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64))
    if len(own) < 4:
        return name, len(own), b""
    words = -(-TABLES * BITS // 64) * (2 if len(own) <= FEW else 1)
    return name, len(own), np.packbits(simhash_gray.wide_print(own, words)).tobytes()


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, node (hash of the shingle set), size (how many shingles it has) and print (its SimHash) of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_rows(rows, lambda: lambda i, h, t: [(i, h, *sketch(shingle_set(t)))], "doc_id long, text_hash long, node long, size long, print binary")


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block of each node's SimHash: the bucket of all that have this block, node, and the words to compare."""
    for batch in batches:
        for at in range(0, len(batch), 2048):
            part = batch.slice(at, 2048)
            nodes, prints = part.column("node").to_numpy(zero_copy_only=False), part.column("print").to_pylist()
            lengths = np.array([len(p) for p in prints])
            for size in np.unique(lengths[lengths > 0]).tolist():
                own = lengths == size
                raw = np.frombuffer(b"".join(p for p in prints if len(p) == size), np.uint8).reshape(-1, size)
                tables = size * 8 // BITS
                bits = np.unpackbits(raw, axis=1)[:, : tables * BITS].reshape(-1, tables, BITS).astype(np.int64)
                bucket = (bits << np.arange(BITS)).sum(axis=2) + (np.arange(tables) << BITS)
                words = raw[:, : 8 * WORDS].copy().view(np.int64)
                columns = [bucket.ravel(), np.repeat(nodes[own], tables), *(np.repeat(words[:, k], tables) for k in range(WORDS))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["bucket", "node", *PRINT])


def _buckets(batches: Iterable[pa.RecordBatch], *columns: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The columns in order of bucket, and the starts and sizes of the buckets."""
    held = list(batches)
    if not held:
        return [np.zeros(0, np.int64)] * len(columns), np.zeros(0, np.int64), np.zeros(0, np.int64)
    t = pa.Table.from_batches(held)
    bucket = t.column("bucket").to_numpy()
    order = np.argsort(bucket, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else order
    return [t.column(c).to_numpy()[order] for c in columns], starts, np.diff(np.r_[starts, len(order)])


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches in order of bucket, put together to about ``HELD`` rows or one bucket, and cut where a bucket ends."""
    held, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n >= HELD:
            bucket = batch.column(0).to_numpy()
            at = int(np.searchsorted(bucket, bucket[-1]))
            if at:
                yield [*held[:-1], batch.slice(0, at)]
                held, n = [batch.slice(at)], len(batch) - at
    if held:
        yield held


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of buckets that have a candidate there, and candidate pairs that connect them (side -1; node, the other one as bucket, and as the first word in how many bits they differ).

    Rows are in order of bucket, so a task holds some ``HELD`` of them, or those of one bucket, at a time.
    """
    for held in _whole_buckets(batches):
        yield _near_of(held)


def _near_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    (bucket, node, *words, side), *_ = _buckets(held, "bucket", "node", *PRINT, "side")
    words = [w.view(np.uint64) for w in words]
    index = simhash_gray.GrayIndex(bucket, words[0], side, tuple(words[1:]), WIDE)
    root, order = index.grow(RADIUS), index.order
    linked = np.flatnonzero(root != np.arange(len(root)))
    inside = np.union1d(linked, root[linked])
    kept = order[inside]
    fp = np.stack([index.fp, *index.more], axis=1)
    hub = inside[_middle(fp[inside], root[inside], node[kept])]
    held_by = index.close(inside, hub, RADIUS)
    none = np.zeros(0, np.int64)
    a, b = (np.concatenate([none, *(e[k] for e in index.edges), (inside, hub)[k][held_by]]) for k in (0, 1))
    apart = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64)
    a, b = node[order[a]], node[order[b]]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), apart], axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    zero, mark = np.zeros(len(pairs), np.int64), np.full(len(pairs), -1, np.int32)
    more = [pairs[:, 2], *(zero for _ in words[1:])]
    columns = [(bucket[kept], pairs[:, 1]), (node[kept], pairs[:, 0]), *((w.view(np.int64)[kept], m) for w, m in zip(words, more, strict=True)), (side[kept].astype(np.int32), mark)]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["bucket", "node", *PRINT, "side"])


def _middle(fp: np.ndarray, root: np.ndarray, node: np.ndarray) -> np.ndarray:
    """For each member the place of the one of its root that differs least from the bits most of them have; the least node of several."""
    if not len(root):
        return np.zeros(0, np.int64)
    order = np.argsort(root, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(root[order]) != 0])
    sizes = np.diff(np.r_[starts, len(order)])
    bits = np.unpackbits(np.ascontiguousarray(fp[order]).view(np.uint8), axis=1)
    most = np.packbits(2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) > sizes[:, None], axis=1).view(np.uint64)
    group = np.repeat(np.arange(len(starts)), sizes)
    apart = np.bitwise_count(fp[order] ^ most[group]).sum(axis=1, dtype=np.int64)
    best = np.lexsort((node[order], apart, group))[starts]
    out = np.empty(len(root), np.int64)
    out[order] = order[best][group]
    return out


def _chosen(pairs: DataFrame) -> DataFrame:
    """Of the candidate pairs a, b, apart those of each node with its nearest and with its least candidate."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    best = cut(both.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("nearest"), F.min("b").alias("least")))
    ends = [best.select(F.least("a", c).alias("a"), F.greatest("a", c).alias("b")) for c in (F.col("nearest.b"), F.col("least"))]
    return ends[0].unionByName(ends[1]).distinct()


def _blocks(fp: np.ndarray) -> np.ndarray:
    """The whole blocks of ``BITS`` bits within the words, which are those of the first tables."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1)
    whole = 64 * WORDS // BITS
    return (bits[:, : whole * BITS].reshape(-1, whole, BITS) << np.arange(BITS, dtype=np.int32)).sum(axis=2)


def _table(bucket: int) -> int:
    """The table of a bucket, 0 where it is a part of a bucket that was cut."""
    return bucket >> BITS if 0 <= bucket >> BITS < 128 * -(-TABLES * BITS // 64) // BITS else 0


class _Bucket:
    """The members of one bucket, and which of them are still to be compared."""

    def __init__(self, bucket: int, fp: np.ndarray, blocks: np.ndarray, side: np.ndarray, size: np.ndarray, root: np.ndarray, similar: float) -> None:
        self.table, self.fp, self.blocks, self.side, self.size, self.similar = _table(bucket), fp, blocks, side, size, similar
        self.class_of = np.unique(root, return_inverse=True)[1]

    def open(self, i: int) -> np.ndarray:
        """Members after i that are of another class, meet i here, not in a table before, have a fingerprint near its own and a set of a size that may be similar."""
        side, size = self.side, self.size
        j = np.arange(i + 1, len(side))
        j = j[self.class_of[j] != self.class_of[i]]
        j = j[np.minimum(size[j], size[i]) >= self.similar * np.maximum(size[j], size[i])]
        apart = np.bitwise_count(self.fp[j] ^ self.fp[i])
        j = j[(apart[:, 0] <= RADIUS) & (apart.sum(axis=1, dtype=np.int64) <= WIDE) & ((side[j] == 0) | (side[j] != side[i]))]
        return j[~(self.blocks[j, : self.table] == self.blocks[i, : self.table]).any(axis=1)]


def _unsettled(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """The members of buckets that have a candidate of another root there; the others need no shingles."""
    names = ("bucket", "node", *PRINT, "side", "root", "size")
    columns, starts, sizes = _buckets(batches, *names)
    bucket, _, *words, side, root, size = columns
    fp, kept = np.stack(words, axis=1).view(np.uint64), np.zeros(len(root), bool)
    blocks = _blocks(fp)
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        own = slice(s, s + n)
        held = _Bucket(int(bucket[s]), fp[own], blocks[own], side[own], size[own], root[own], similar)
        if held.class_of.any():
            for i in range(n - 1):
                j = held.open(i)
                kept[s + j] = True
                kept[s + i] |= len(j) > 0
    yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], names=list(names))


def _apart(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """Pairs of the buckets' members of different roots: those that are similar and join components (sure), and those that may be."""
    (bucket, node, *words, side, root, size, least), starts, sizes = _buckets(batches, "bucket", "node", *PRINT, "side", "root", "size", "least")
    fp, found = np.stack(words, axis=1).view(np.uint64), []
    blocks = _blocks(fp)
    for s, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if (root[s : s + n] == root[s]).all():
            continue
        own = slice(s, s + n)
        held = _Bucket(int(bucket[s]), fp[own], blocks[own], side[own], size[own], root[own], similar)
        class_of = held.class_of
        sets = [np.frombuffer(x, np.uint64) for x in least[own]]
        flat, lengths = np.concatenate(sets), np.array([len(x) for x in sets])
        offsets, whole = np.cumsum(lengths) - lengths, size[own] <= LEAST
        for i in range(n - 1):
            j = held.open(i)
            if not len(j):
                continue
            ends = np.cumsum(lengths[j])
            values = flat[np.repeat(offsets[j] - ends + lengths[j], lengths[j]) + np.arange(ends[-1])]
            at = np.searchsorted(sets[i], values)
            at[at == len(sets[i])] = 0
            shared = np.add.reduceat((sets[i][at] == values).astype(np.int64), ends - lengths[j])
            exact = whole[j] & whole[i]
            alike = j[exact & (shared >= similar * (size[s + i] + size[s + j] - shared))]
            for label in np.unique(class_of[alike]):
                found.append((node[s + i], node[s + alike[class_of[alike] == label][0]], True))
            class_of[np.isin(class_of, class_of[alike])] = class_of[i]
            found += [(node[s + i], node[s + k], False) for k in j[~exact & (shared >= LEAST_SHARED)]]
    a, b, sure = zip(*found, strict=True) if found else ((), (), ())
    a, b = np.array(a, np.int64), np.array(b, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sure, pa.bool_())], names=["a", "b", "sure"])


def _texts(documents: DataFrame, nodes: DataFrame, used: DataFrame) -> DataFrame:
    """node and one text of it, of the nodes in used."""
    first = nodes.join(used, "node", "left_semi").select("node", F.col("first.doc_id").alias("r_id"), F.col("first.text_hash").alias("r_hash"))
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    same = own["doc_id"].eqNullSafe(first["r_id"]) & (F.xxhash64(own["text"]) == first["r_hash"])
    return own.join(first, same).select("node", "text").dropDuplicates(["node"])


def _similar(texts: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """The pairs a, b of nodes whose shingle sets, of the whole texts (node, text), are similar enough."""
    left, right = texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def make() -> Callable[..., list[tuple]]:
        return lambda a, b, ta, tb: [(a, b)] if similarity(shingle_set(ta), shingle_set(tb)) >= similar else []

    return cut(map_rows(pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb"), make, "a long, b long"))


def classes(documents: DataFrame, similar: float = SIMILAR, hot: int = simhash_gray.HOT) -> DataFrame:
    """doc_id, text_hash and class_fp, the hash of one shingle set that stands for the class, of every row."""
    prints = cut(sketches(documents))
    nodes = cut(prints.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("size").alias("size"), F.first("print").alias("print")))
    places = nodes.select("node", "print").mapInArrow(_placed, MEMBER.removesuffix(", side int"))
    placed = simhash_gray.dealt(places, "node", hot).repartition("bucket").sortWithinPartitions("bucket").select("bucket", "node", *PRINT, "side")
    found = cut(placed.mapInArrow(_near, MEMBER))
    members = found.where("side >= 0")
    texts = stored(_texts(documents, nodes, members.select("node").distinct()), "near_texts")  # the one time that documents are dealt out
    near = stored(_chosen(found.where("side < 0").select(F.col("node").alias("a"), F.col("bucket").alias("b"), F.col(PRINT[0]).alias("apart"))), "near_pairs")
    links = _similar(texts, near, similar)
    roots = connected_components(links).select(F.col("node").alias("r_node"), "root")
    known = nodes.join(roots, F.col("node") == F.col("r_node"), "left").select("node", F.coalesce("root", "node").alias("root"), "size")
    dealt = members.join(known, "node").select("bucket", "node", *PRINT, "side", "root", "size").repartition("bucket")
    more = stored(dealt.mapInArrow(lambda batches: _unsettled(batches, similar), f"{MEMBER}, root long, size long"), "near_members")

    def make() -> Callable[..., list[tuple]]:
        def of(node: int, text: str | None) -> list[tuple]:
            own = shingle_set(text)
            return [(node, own[:LEAST].tobytes())]

        return of

    if not more.isEmpty():
        sets = map_rows(texts.join(more.select("node").distinct(), "node", "left_semi"), make, "node long, least binary")
        rows = more.join(sets, "node").repartition("bucket").select("bucket", "node", *PRINT, "side", "root", "size", "least")
        apart = stored(rows.mapInArrow(lambda batches: _apart(batches, similar), "a long, b long, sure boolean").distinct(), "near_pairs")
        links = links.unionByName(apart.where("sure").select("a", "b"))
        unsure = apart.where("NOT sure").select("a", "b").join(near, ["a", "b"], "left_anti")
        if not unsure.isEmpty():
            links = links.unionByName(_similar(texts, unsure, similar))
        roots = connected_components(links).select(F.col("node").alias("r_node"), "root")
    return prints.join(roots, F.col("node") == F.col("r_node"), "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("class_fp"))


def keep_one(documents: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """documents, all columns, with one row of each class: the least id, of its rows the least text hash."""
    return simhash_gray.first_of_classes(documents, classes(documents, similar))
