"""Languages of a text as a mixture, by expectation-maximisation over n-gram likelihoods.

A language is a distribution over byte trigrams of lower-cased letters, hashed into ``2**bits`` buckets; everything else is a
space. It is learned from all learning documents that name the language. A text's trigrams are taken as drawn from a mixture of
languages; expectation-maximisation finds the proportions. Of the languages that have a part, the set with the best penalised
likelihood stays: each language beyond the first must raise the log-likelihood by ``penalty`` times the logarithm of the number
of trigrams. The prediction is the language with the largest part in that set.

Null texts and texts without a letter are ``und`` with score 0. The score is the largest part, times the probability of that
language where the whole text is held against each language alone (overlapping trigrams count a third). Ties go to the first
language by name. Without learned languages all texts are ``und``. Rows stay rows: repeated and null ids are predicted like
others; ``predict`` keeps other columns whatever their names but those it adds. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finescale.llm.shared import learnable
from finescale.llm.text import plain, raw, slices

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(strings: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of each text's trigrams (one space stands before and after it), and how often each occurs."""
    data, offsets = raw(pc.utf8_lower(strings))
    letters = _LETTER[data].astype(np.uint32)
    blank = np.array([32], np.uint32)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        x = np.concatenate([blank, letters[a:b], blank])
        if len(x) < 3:
            yield np.zeros(0, np.int64), np.zeros(0)
            continue
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        code = code[(code & np.uint32(0xFFFF)) != 0x2020]                        # not inside a run of spaces
        h = code * np.uint32(0x9E3779B1)
        count = np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
        at = np.flatnonzero(count)
        yield at, count[at].astype(np.float64)


def count_trigrams(docs: DataFrame, bits: int) -> DataFrame:
    """``lang, bucket, n`` over documents with ``lang`` and ``text``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, (at, n) in zip(part.column("lang").to_pylist(), trigrams(plain(part.column("text")), bits)):
                    if lang not in found:
                        found[lang] = np.zeros(1 << bits)
                    found[lang][at] += n
        for lang, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at].astype(np.int64))],
                                             names=["lang", "bucket", "n"])

    return (docs.mapInArrow(task, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


@dataclass(frozen=True)
class Model:
    """``shares[bucket, language]``: smoothed probabilities."""

    bits: int
    languages: tuple[str, ...]
    shares: np.ndarray
    penalty: float

    def mixture(self, shares: np.ndarray, count: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, float]:
        """Proportions of the given languages, and the log-likelihood."""
        part = np.full(shares.shape[1], 1 / shares.shape[1])
        total = count.sum()
        for _ in range(rounds):
            new = part * ((count / (shares @ part)) @ shares) / total
            moved = np.abs(new - part).max()
            part = new
            if moved < 2e-3:
                break
        return part, float(count @ np.log(shares @ part))

    def predict(self, at: np.ndarray, count: np.ndarray) -> tuple[str, float, list[str], list[float]]:
        """Language, score, and the selected languages with their proportions."""
        if not len(at) or not self.languages:
            return "und", 0.0, [], []
        shares = self.shares[at]
        alone = count @ np.log(shares)
        part, _ = self.mixture(shares, count)
        chosen = [int(k) for k in np.flatnonzero(part > 0.02)]
        price = self.penalty * np.log(count.sum() + 1)
        part, best = (part, 0.0) if len(chosen) == 1 else self.mixture(shares[:, chosen], count)
        best -= price * (len(chosen) - 1)
        while len(chosen) > 1:
            tries = []
            for k in range(len(chosen)):
                rest = chosen[:k] + chosen[k + 1:]
                p, like = (np.ones(1), alone[rest[0]]) if len(rest) == 1 else self.mixture(shares[:, rest], count)
                tries.append((like - price * (len(rest) - 1), -k, rest, p))
            value, _, rest, p = max(tries, key=lambda t: t[:2])
            if value < best:
                break
            best, chosen, part = value, rest, p
        if len(chosen) == 1:
            part = np.ones(1)
        k = int(np.argmax(part))
        odds = np.exp((alone - alone.max()) / 3)
        sure = odds[chosen[k]] / odds.sum() if len(chosen) == 1 else 1.0
        return self.languages[chosen[k]], float(min(1.0, part[k] * sure)), [self.languages[c] for c in chosen], part.tolist()


def fit(docs: DataFrame, bits: int = 16, smoothing: float = 0.1, penalty: float = 3.0) -> Model:
    """Model from all learning documents (``doc_id, text, lang``) with a language. The driver gets one row per language and
    bucket."""
    rows = docs.filter(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = count_trigrams(rows, bits).collect()
    languages = tuple(sorted({r[0] for r in counted}))
    counts = np.zeros((1 << bits, len(languages)))
    place = {x: k for k, x in enumerate(languages)}
    for lang, bucket, n in counted:
        counts[bucket, place[lang]] = n
    counts += smoothing
    return Model(bits, languages, counts / counts.sum(axis=0), penalty)


def predict(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``languages`` and ``proportions`` (each name after ``prefix``) of every whole
    text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)                    # 2**bits numbers a language
    names = [prefix + x for x in ("lang_pred", "score", "languages", "proportions")]
    letter = prefix + "letter"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for part in slices(batch, "text"):
                got = [m.predict(at, n) if ok else ("und", 0.0, [], []) for ok, (at, n) in
                       zip(part.column(letter).to_pylist(), trigrams(plain(part.column("text")), m.bits))]
                kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
                kept = [c for c, n in zip(part.columns, part.schema.names) if n != letter]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), k) for c, k in zip(zip(*got), kinds))],
                                                 names=[n for n in part.schema.names if n != letter] + names)

    marked = docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = docs.select("*", *[F.lit(None).cast(t).alias(n) for n, t in
                                zip(names, ("string", "double", "array<string>", "array<double>"))]).schema
    return marked.mapInArrow(task, schema)
