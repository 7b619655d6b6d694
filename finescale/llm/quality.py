"""Quality classifier: linear hinge-loss model on n-gram indicators scaled by naive-Bayes log-count ratios.

Indicators are the distinct n-grams of a text, hashed into ``2**bits`` buckets: 2- and 4-grams of its bytes, 5-grams of its shape
(bytes with letters and digits replaced by their class), and 3-grams of the signs that a word repeats the one before. Of every bucket, all labelled
learning documents of either class that hold it are counted; r = log ratio of the smoothed shares. A text's vector has r where it
has the indicator, scaled to unit length. The hinge-loss model is fitted by dual coordinate descent on at most ``sample``
documents of each class (those with the smallest hash of their id); a fifth of them is kept from the fit and gives the slope and
offset that turn margins into a score, at the classes' true shares.

Null and empty texts have no indicator and score by the offset alone. Labels that are null or neither 0 nor 1 are ignored, a
document with several labels counts once for each. Without labels of both classes, every score is the share of label 1 (0.5
without any). Scores depend on the text alone. Rows stay rows: repeated and null ids are scored like others, other columns are
kept by ``score`` whatever their names but ``score_column``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finescale.llm.shared import learnable
from finescale.llm.text import plain, raw, slices, words

# lengths of the n-grams of a text's bytes, of its shape (letters and digits by class), and of the signs "same word again"
BYTES, SHAPE, AGAIN = (2, 4), 5, 3
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = ord("A"), ord("a"), ord("0"), ord("a")


def _codes(values: np.ndarray, n: int, kind: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram at each place."""
    h = np.full(max(len(values) - n + 1, 0), kind * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + values[k:k + len(h)]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)


def buckets(strings: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """Distinct buckets of each text's n-grams, ascending."""
    data, offsets = raw(strings)
    w = words(strings)
    again = np.zeros(len(w.hashes), np.uint32)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    views = [(n, _codes(data.astype(np.uint32), n, n, bits), offsets.tolist(), 0) for n in BYTES]
    views.append((SHAPE, _codes(_CLASS[data], SHAPE, 16 + SHAPE, bits), offsets.tolist(), 0))
    views.append((AGAIN, _codes(again, AGAIN, 32 + AGAIN, bits), w.first.tolist(), 1))       # a first word has none before it
    seen = np.zeros(1 << bits, bool)
    for k in range(len(strings)):
        for n, codes, first, skip in views:
            a, b = first[k] + skip, first[k + 1]
            if b - a >= n:
                seen[codes[a:b - n + 1]] = True
        out = np.flatnonzero(seen)
        seen[out] = False
        yield out


@dataclass(frozen=True)
class Model:
    """``weights`` of the buckets (log-count ratio times fitted weight), ``ratio`` for the unit length, ``offset`` of the margin, and
    ``slope`` and ``base`` of the score."""

    bits: int
    weights: np.ndarray
    ratio: np.ndarray
    offset: float
    slope: float
    base: float

    def margin(self, own: np.ndarray) -> float:
        length = float(np.sqrt(np.square(self.ratio[own]).sum()))
        return float(self.weights[own].sum()) / max(length, 1e-12) + self.offset if len(own) else self.offset

    def score(self, own: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(own) + self.base, -40, 40))))


def count_buckets(labelled: DataFrame, bits: int) -> DataFrame:
    """Documents of each class per bucket: ``bucket, zeros, ones``; bucket -1 has the number of documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << bits) + 1), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for label, own in zip(part.column("quality").to_pylist(), buckets(plain(part.column("text")), bits)):
                    counts[label, own] += 1
                    counts[label, -1] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.where(at == 1 << bits, -1, at)), pa.array(counts[0, at]), pa.array(counts[1, at])],
                                         names=["bucket", "zeros", "ones"])

    return (labelled.select("text", F.col("quality").cast("int").alias("quality"))
            .mapInArrow(task, "bucket bigint, zeros bigint, ones bigint")
            .groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")))


def sample_buckets(docs: DataFrame, labels: DataFrame, bits: int, sample: int) -> DataFrame:
    """Buckets of at most ``sample`` labelled documents of each class; those few ids are joined by broadcast."""
    ids = [labels.filter(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    few = docs.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id").select("doc_id", "text", "quality")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = [x.astype("<u4").tobytes() for x in buckets(plain(part.column("text")), bits)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(own, pa.binary())],
                                                 names=["doc_id", "quality", "own"])

    return few.mapInArrow(task, "doc_id bigint, quality int, own binary")


def descend(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, width: int, c: float, rounds: int,
            seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss, after Hsieh et al. (2008): one multiplier per row in [0, c], weights kept up to
    date; the offset is one more feature of value 1."""
    w, offset, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    square = np.array([v @ v + 1 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            x, v, y = rows[i], values[i], sign[i]
            gradient = y * (w[x] @ v + offset) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), c)
            step = new - alpha[i]
            if step:
                largest = max(largest, abs(step))
                alpha[i] = new
                w[x] += step * y * v
                offset += step * y
        if largest < 1e-3 * c:
            break
    return w, offset


def calibrate(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and base of the logistic curve of weighted margins, by Newton steps on smoothed targets."""
    ones, zeros = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        slope = x.T @ (weight * (p - target)) + 1e-3 * theta * [1, 0]
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(curve, slope)
        theta -= step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 0.0)), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, bits: int = 17, sample: int = 3000, c: float = 10.0, rounds: int = 30,
        smoothing: float = 1.0, seed: int = 7) -> Model:
    """Model from documents (``doc_id, text``) and labels (``doc_id, quality``) of learning rows."""
    docs = docs.filter(learnable()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.filter(learnable() & F.col("quality").isin(0, 1)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    width = 1 << bits
    # labels grow with the documents: joined by merge at every size, never by broadcast
    counted = count_buckets(docs.join(labels.hint("merge"), "doc_id"), bits).collect()   # 2**bits + 1 rows at most
    counts, totals = np.zeros((2, width)), np.zeros(2)
    for bucket, zeros, ones in counted:
        if bucket < 0:
            totals += (zeros, ones)
        else:
            counts[:, bucket] = zeros, ones
    none = np.zeros(width)
    if not totals.all():
        share = (totals[1] + 1) / (totals.sum() + 2) if not totals.sum() else np.clip(totals[1] / totals.sum(), 1e-6, 1 - 1e-6)
        return Model(bits, none, none, 0.0, 0.0, float(np.log(share / (1 - share))))
    shares = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
    ratio = np.log(shares[1] / shares[0])
    rows = sorted(sample_buckets(docs, labels, bits, sample).collect(), key=lambda r: (r[0], r[1]))
    own = [np.frombuffer(r[2], "<u4") for r in rows]
    values = [(ratio[x] / max(np.sqrt(np.square(ratio[x]).sum()), 1e-12)).astype(np.float32) for x in own]
    label = np.array([r[1] for r in rows])
    apart = np.random.default_rng(seed).random(len(rows)) < 0.2
    if len(set(label[apart])) < 2 or len(set(label[~apart])) < 2:
        apart = np.zeros(len(rows), bool)
    learn = np.flatnonzero(~apart)
    w, offset = descend([own[i] for i in learn], [values[i] for i in learn], 2.0 * label[learn] - 1, width, c, rounds, seed)
    tried = np.flatnonzero(apart) if apart.any() else learn
    margin = np.array([w[own[i]] @ values[i] + offset for i in tried])
    of_class = np.bincount(label[tried], minlength=2)
    weight = (totals / totals.sum())[label[tried]] / of_class[label[tried]] * len(tried)
    slope, base = calibrate(margin, label[tried].astype(float), weight)
    return Model(bits, (ratio * w).astype(np.float64), ratio, offset, slope, base)


def score(docs: DataFrame, model: Model, score_column: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)                    # 2 arrays of 2**bits

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for part in slices(batch, "text"):
                scores = pa.array([m.score(x) for x in buckets(plain(part.column("text")), m.bits)], pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, score_column])

    return docs.mapInArrow(task, docs.select("*", F.lit(None).cast("double").alias(score_column)).schema)
