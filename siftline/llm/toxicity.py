"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

``train`` fits on a bounded sample of labelled rows: at most ``SAMPLE_TOXIC`` toxic and
``SAMPLE_CLEAN`` clean documents, whole texts of any length, chosen by the order of a hash
of the id. Presence of each hashed n-gram in the two classes is counted where the texts lie
and gives its log-count ratio; n-grams whose ratio stands ``MIN_Z`` standard errors from
zero are kept, scaled by that ratio, and weighted by logistic regression. The driver gets
the kept n-grams' numbers of each sampled row, never a text. ``score`` reads whole texts in
pieces of ``PIECE`` characters in one pass and needs no shuffle; the model is one
fixed-size vector.

Defined results: null text scores as empty text; empty text has only the intercept; labels
that are null or neither 0 nor 1, and labels without a document, are not trained on; a
document with both labels counts as toxic; repeated rows of one document are one sample;
without labels of both classes every score is 0; where no n-gram is kept every score is the
balanced share of toxic rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import release, stored

SAMPLE_TOXIC, SAMPLE_CLEAN = 4_000, 8_000
PIECE = 1 << 20
ENTRIES = 1 << 20
SIZES = (3, 4, 5)
BITS = 20
MIN_Z = 3.5
MIN_DOCS = 4
THRESHOLD = 0.7
RIDGE = 1e-3
SPEED = 30.0
BALANCE = 0.7  # 0: every document weighs the same; 1: both classes do


@dataclass
class Model:
    weights: np.ndarray  # of every bucket, 0 where it was not kept
    intercept: float


def buckets(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of all character n-grams of the lower-cased text, with repeats, a piece of the text at a time."""
    padded = f" {text.lower()} "
    for at in range(0, len(padded), PIECE):
        yield _buckets(padded, at, min(at + PIECE, len(padded)))


def _buckets(text: str, start: int, end: int) -> np.ndarray:
    """Hash buckets of the n-grams that begin from start to end."""
    widest = max(SIZES)
    chars = np.frombuffer(text[start : end + widest - 1].encode("utf-32-le", "replace"), np.uint32).copy()
    chars[chars < 33] = 32
    mixed, out = chars * np.uint32(0x85EBCA6B), []
    grams = mixed
    for n in range(2, widest + 1):
        if len(chars) < n:
            break
        grams = (grams[:-1] ^ (grams[:-1] >> np.uint32(15))) * np.uint32(0x9E3779B1) + mixed[n - 1 :]
        if n in SIZES:
            out.append((grams[: end - start] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def distinct(text: str, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct buckets of a text, of those for which ``wanted`` is true."""
    own = [np.unique(b if wanted is None else b[wanted[b]]) for b in buckets(text)]
    return own[0] if len(own) == 1 else np.unique(np.concatenate(own))


def _nothing(intercept: float) -> Model:
    return Model(np.zeros(1 << BITS, np.float32), intercept)


def fit(sample: DataFrame) -> Model:
    """The model of a bounded table of text and toxic (1 or 0)."""
    rows = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not (rows.get(0) and rows.get(1)):
        return _nothing(-np.inf)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[toxic, distinct(text)] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["bucket", "clean", "toxic"])

    counts = sample.select("text", "toxic").mapInArrow(count, "bucket int, clean int, toxic int").groupBy("bucket").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    ratio = F.log((F.col("t") + 1) / (rows[1] + 2)) - F.log((F.col("c") + 1) / (rows[0] + 2))
    error = F.sqrt(1 / (F.col("c") + 1) + 1 / (F.col("t") + 1))
    chosen = counts.select("bucket", ratio.alias("ratio"), error.alias("error"), (F.col("c") + F.col("t")).alias("n")).where((F.abs("ratio") > MIN_Z * F.col("error")) & (F.col("n") >= MIN_DOCS))
    kept = chosen.select("bucket", "ratio").toArrow().sort_by("bucket")
    if not len(kept):
        share = np.array([rows[0], rows[1]], float) ** (1 - BALANCE)
        return _nothing(float(np.log(share[1] / share[0])))
    bucket, scale = kept.column("bucket").to_numpy(), kept.column("ratio").to_numpy()
    shared = sample.sparkSession.sparkContext.broadcast(bucket)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            own = [np.sort(place[distinct(t, place >= 0)]) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), batch.column("toxic"), pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "toxic", "own"])

    found = sample.select("doc_id", "text_hash", "toxic", "text").mapInArrow(present, "doc_id long, text_hash long, toxic int, own array<int>").toArrow()
    ids, hashes = (found.column(c).to_numpy() for c in ("doc_id", "text_hash"))
    found = found.select(["toxic", "own"]).take(pa.array(np.lexsort((hashes, ids)))).combine_chunks()  # sums do not depend on the order of arrival
    lists = found.column("own").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    weights, intercept = _logistic(lists.offsets.to_numpy(), lists.values.to_numpy(), scale, found.column("toxic").to_numpy().astype(float))
    model = _nothing(intercept)
    model.weights[bucket] = weights * scale
    return model


def _logistic(offsets: np.ndarray, col: np.ndarray, scale: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on a sparse matrix of features ``scale``, by accelerated gradient steps.

    Row i has the features col[offsets[i] : offsets[i + 1]]. Rows are taken in blocks of
    about ``ENTRIES`` features, so little beside col itself is held.
    """
    n, k = len(y), len(scale)
    share = np.where(y == 1, y.sum() ** -BALANCE, (n - y.sum()) ** -BALANCE)
    share /= share.sum()
    heads = np.searchsorted(offsets, np.arange(offsets[0], offsets[-1] + ENTRIES, ENTRIES))
    blocks = [(a, b) for a, b in zip(heads, np.minimum(np.r_[heads[1:], n], n), strict=True) if b > a]

    def rows(a: int, b: int, w: np.ndarray) -> np.ndarray:
        """Sum of w over the features of each row."""
        own = np.r_[0.0, np.cumsum(w[col[offsets[a] : offsets[b]]])]
        return np.diff(own[offsets[a : b + 1] - offsets[a]])

    square = np.concatenate([rows(a, b, scale * scale) for a, b in blocks])
    rate = 4.0 / max(1.0, float(np.percentile(square, 99)) + 1.0)
    w, b, w0, b0 = np.zeros(k), 0.0, np.zeros(k), 0.0
    for t in range(steps):
        pull = t / (t + 3)
        wy, by = w + pull * (w - w0), b + pull * (b - b0)
        whole, down = np.zeros(k), 0.0
        for first, end in blocks:
            z = rows(first, end, scale * wy) + by
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[first:end]) * share[first:end]
            whole += np.bincount(col[offsets[first] : offsets[end]], np.repeat(g, np.diff(offsets[first : end + 1])), minlength=k)
            down += g.sum()
        w0, b0 = w, b
        w = wy - rate * SPEED * (scale * whole + RIDGE * wy)
        b = by - rate * SPEED * down
    return w, float(b)


def probability(model: Model, text: str | None, wanted: np.ndarray | None = None) -> float:
    """Toxicity of a text; wanted: the buckets with a weight, where the caller has them."""
    if not np.isfinite(model.intercept):
        return 0.0
    own = distinct(text or "", model.weights != 0 if wanted is None else wanted)
    z = model.intercept + float(model.weights[own].sum(dtype=float))
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def held_out(doc_id: Column) -> Column:
    """The third of the ids that is never trained on."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents outside the held-out third; the bound of the sample's rows is that of this module's parameters."""
    usable = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("l_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("l_id")))
    usable = usable.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    known = documents.select("doc_id", F.xxhash64("text").alias("text_hash")).where((F.char_length("text") > 0) & F.col("doc_id").isNotNull()).distinct()
    pool = known.join(usable, F.col("doc_id") == F.col("l_id")).select("doc_id", "text_hash", "toxic")
    picked = [pool.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(n) for c, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    sample = stored(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), "toxic"), "toxicity_ids")
    same = (F.col("doc_id") == F.col("s_id")) & (F.xxhash64("text") == F.col("s_hash"))
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), same).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("s_hash").alias("text_hash"), "text", "toxic")
    texts = stored(texts.dropDuplicates(["doc_id", "text_hash"]), "toxicity_texts")
    model = fit(texts)
    release(sample, texts)
    return model


def score(documents: DataFrame, model: Model, text: str = "text") -> Column:
    """A column with the toxicity of each text, 0 to 1."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    @F.pandas_udf("double")
    def scored(values: pd.Series) -> pd.Series:
        own = Model(*shared.value)
        wanted = own.weights != 0
        return pd.Series([probability(own, v, wanted) for v in values], dtype=float)

    return scored(F.coalesce(documents[text], F.lit("")))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(documents, train(documents, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def remove_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents, all columns, without those that score at or over the threshold."""
    return documents.where(score(documents, train(documents, labels)) < threshold)
