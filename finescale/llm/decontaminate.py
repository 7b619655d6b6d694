"""Training documents that hold test items: n-gram seeds, then Smith-Waterman alignment of words.

Every ``SEED``-word sequence of a test item is a seed, so a copy that keeps SEED words in a row anywhere is aligned, however it is
edited elsewhere and whatever other documents hold. Tasks mark
the places of a document that may be seeds with a bit table of fixed size, and cut out passages around them; exact hashes then join
passages to items. Word alignment (match MATCH, mismatch and gap of a word COST each) gives the best local score, as a share of what
the whole item would score. A pair is contaminated from ``threshold`` on.

Null and empty texts and items hold no seeds. Items of fewer than SEED words are one seed of all their words, found where a document
has just these words. Of equal alignments the first is given. Rows that repeat an id are one document (or item); ids that are null
are reported as null. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finescale.llm.shared import written
from finescale.llm.text import Words, ngrams, plain, slices, words

SEED = 3
MATCH, COST = 2, 1
TABLE_BITS, TABLE_BLOCKS = 24, 64
THRESHOLD = 0.5


def _spoken(w: Words, a: int, b: int) -> str:
    """Words a to b as text."""
    return " ".join(bytes(w.data[s:e]).decode() for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist()))


def item_grams(items: DataFrame) -> DataFrame:
    """``item_id, place, gram`` of all word sequences of all items, and ``length`` in words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(plain(part.column("text")))
                grams, first = ngrams(w, SEED, whole_if_short=True)
                n = np.diff(first)
                ids = part.column("item_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
                place = np.arange(len(grams)) - np.repeat(first[:-1], n)
                yield pa.RecordBatch.from_arrays([ids, pa.array(place.astype(np.int64)), pa.array(grams.view(np.int64)),
                                                  pa.array(np.repeat(np.diff(w.first), n).astype(np.int64))],
                                                 names=["item_id", "place", "gram", "length"])

    return items.select("item_id", "text").mapInArrow(task, "item_id bigint, place bigint, gram bigint, length bigint")


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams.astype(np.uint64) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def bit_table(grams: DataFrame) -> np.ndarray:
    """Bits of the slots that any ``gram`` takes: 2**TABLE_BITS of them, whatever the number of rows."""
    wide = (1 << TABLE_BITS) // TABLE_BLOCKS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << TABLE_BITS, bool)
        for batch in batches:
            bits[_slot(batch.column("gram").to_numpy().view(np.uint64))] = True
        used = [k for k in range(TABLE_BLOCKS) if bits[k * wide:(k + 1) * wide].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(bits[k * wide:(k + 1) * wide]).tobytes()
                                                                                for k in used], pa.binary())], names=["block", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                x = np.frombuffer(bits, np.uint8)
                found[block] = found[block] | x if block in found else x
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())],
                                         names=["block", "bits"])

    kinds = "block int, bits binary"
    out = np.zeros((TABLE_BLOCKS, wide // 8), np.uint8)
    for block, bits in grams.select("gram").mapInArrow(mark, kinds).repartition(TABLE_BLOCKS, "block").mapInArrow(join, kinds).collect():
        out[block] |= np.frombuffer(bits, np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)


def passages(docs: DataFrame, table: np.ndarray, margin: int) -> DataFrame:
    """Stretches of ``margin`` words around possible seeds, joined where they meet: ``doc_id, start`` (in words), ``body, grams``."""
    shipped = docs.sparkSession.sparkContext.broadcast(table)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(plain(part.column("text")))
                grams, first = ngrams(w, SEED, whole_if_short=True)
                at = np.flatnonzero(shipped.value[_slot(grams)])
                text = np.searchsorted(first, at, side="right") - 1
                place = at - first[text]
                new = np.ones(len(at), bool)
                new[1:] = (text[1:] != text[:-1]) | (place[1:] - place[:-1] > 2 * margin)
                heads = np.flatnonzero(new)
                rows = []
                for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(at)]):
                    t = int(text[a])
                    low = max(0, int(place[a]) - margin)
                    high = min(int(w.first[t + 1] - w.first[t]), int(place[b - 1]) + SEED + margin)
                    rows.append((t, low, _spoken(w, int(w.first[t]) + low, int(w.first[t]) + high),
                                 np.unique(grams[at[a:b]]).view(np.int64).tolist()))
                t, low, body, own = zip(*rows) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(t, pa.int64())), pa.array(low, pa.int64()), pa.array(body, pa.string()),
                     pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "start", "body", "grams"])

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id bigint, start bigint, body string, grams array<bigint>")


def align(items: np.ndarray, bodies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each row of ``items`` with that of ``bodies`` (numbers of words; -1 and -2 beyond the ends): its score
    and the places in item and body after which it ends. Only two rows of the table are held."""
    n, wide = bodies.shape
    slope = np.arange(wide, dtype=np.int32) * COST
    above = np.zeros((n, wide + 1), np.int32)
    best, at_item, at_body = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(items.shape[1]):
        here = np.where(bodies == items[:, k:k + 1], MATCH, -COST) + above[:, :-1]
        np.maximum(here, above[:, 1:] - COST, out=here)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + slope, axis=1) - slope               # gaps along the body
        above[:, 1:] = here
        place = here.argmax(axis=1)
        score = here[np.arange(n), place]
        more = score > best
        best[more], at_item[more], at_body[more] = score[more], k + 1, place[more] + 1
    return best, at_item, at_body


def aligned(pairs: list[tuple[list[str], list[str]]], least: float) -> list[tuple[float, int, int]]:
    """For each (item, body): score as a share of the item's, and where in the body the alignment begins and ends; both zero below
    ``least``."""
    out = []
    for at in range(0, len(pairs), 64):
        part = pairs[at:at + 64]
        names: dict[str, int] = {}
        tall, wide = max(len(i) for i, _ in part), max(len(b) for _, b in part)
        items, bodies = np.full((len(part), tall), -1, np.int32), np.full((len(part), wide), -2, np.int32)
        for k, (i, b) in enumerate(part):
            items[k, :len(i)] = [names.setdefault(x, len(names)) for x in i]
            bodies[k, :len(b)] = [names.setdefault(x, len(names)) for x in b]
        best, end_item, end_body = align(items, bodies)
        for k, (i, _) in enumerate(part):
            share = best[k] / (MATCH * len(i))
            if share < least:
                out.append((share, 0, 0))
                continue
            p, q = int(end_item[k]), int(end_body[k])                            # backwards from the end to the start
            _, _, back = align(items[k:k + 1, :p][:, ::-1], bodies[k:k + 1, :q][:, ::-1])
            out.append((share, q - int(back[0]), q))
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of documents (``doc_id, text``) and items (``item_id, text``): ``doc_id, item_id, score`` (0 to 1) and ``first_word,
    last_word``, the stretch of the document (words from 0, last one out)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    grams = written(item_grams(items), "grams")
    longest = grams.agg(F.max("length")).first()[0]
    if longest is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint")
    own = written(grams.select("item_id", "gram").distinct(), "seeds")
    found = written(passages(docs, bit_table(own), longest + longest // 4), "passages")
    wanted = (found.select("doc_id", "start", F.explode("grams").alias("gram")).join(own, "gram")
              .select("doc_id", "start", "item_id").distinct())
    bodies = items.select("item_id", F.col("text").alias("item"))
    pairs = (found.select("doc_id", "start", "body").withColumnsRenamed({"doc_id": "d", "start": "s"})
             .join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("s") == F.col("start")))
             .withColumnRenamed("item_id", "i").join(bodies, F.col("i").eqNullSafe(F.col("item_id"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                w = words(plain(part.column("item")))
                spoken = [_spoken(w, a, b).split(" ") for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
                asked = list(zip(spoken, [b.split(" ") for b in part.column("body").to_pylist()]))
                # a share cannot exceed that of the item's words that the passage has at all
                held = [sum(map(set(b).__contains__, i)) >= threshold * len(i) for i, b in asked]
                part, asked = part.filter(pa.array(held)), [x for x, h in zip(asked, held) if h]
                got = aligned(asked, threshold)
                score = pa.array([float(g[0]) for g in got], pa.float64())
                start = part.column("start").to_numpy()
                out = pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("item_id"), score, pa.array(start + [g[1] for g in got], pa.int64()),
                     pa.array(start + [g[2] for g in got], pa.int64())],
                    names=["doc_id", "item_id", "score", "first_word", "last_word"])
                yield out.filter(pa.array([g[0] >= threshold for g in got], pa.bool_()))

    scored = pairs.select("doc_id", "start", "body", "item_id", "item").mapInArrow(
        task, "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("back"), "last_word"))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.score", (-F.col("b.back")).alias("first_word"), F.col("b.last_word").alias("last_word"))
