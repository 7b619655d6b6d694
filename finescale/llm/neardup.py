"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

A shingle is five words in a row (a text of one to four words is one shingle). Its weight in a text is (1 + ln tf) times an
inverse document frequency, 1 + ln(documents / df) / ln(2**DF_BITS), where df counts, over all documents, those that hold a
shingle of the same hash bucket. Improved consistent weighted sampling (Ioffe 2010) draws SAMPLES shingles of each text, such
that two texts draw the same with the probability of their weighted Jaccard similarity; ROWS draws make a band. Texts that share
a band are candidates, and a link is a candidate pair whose weighted Jaccard similarity, computed in full, reaches the
threshold. Groups are connected components of links.

Exact copies are one text from the start. In a band's bucket of at most SMALL texts all pairs are candidates. In a larger one,
every text is first held against the bucket's most central one (that with the most company over all bands). What is then in
different groups is dealt out in blocks of some BLOCK texts, and each block meets each: no pair of a bucket is left out but pairs
already in one group. Blocks look at draws first; only texts with a likely partner in another group are read, and central ones
are compared first, so that families join in few comparisons and only links leave a task.

Null text counts as empty. Texts without a word are only grouped with exact copies. Rows without an id are returned with a null
group and are never compared. Rows that repeat an id are one document, which
links by any of its texts, and are all returned. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finescale.llm.components import components
from finescale.llm.shared import discard, written
from finescale.llm.text import ngrams, plain, slices, words

SHINGLE, THRESHOLD = 5, 0.8
DF_BITS, DF_BLOCKS = 20, 256
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
AGREE = 18                      # draws of SAMPLES that a pair at the threshold has in all but some 1 of 10,000 cases
SMALL, BLOCK, SHARE = 12, 512, 256
MARK_BITS = 24
_POOL = 1 << 14


def shingles(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (52 bits, ascending), their counts, and the offsets of each text's. At most 4,096 texts."""
    keys, first = ngrams(words(strings), SHINGLE, whole_if_short=True)
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    both = np.sort((text << np.uint64(52)) | (keys >> np.uint64(12)))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(both)))
    both = both[at]
    return both & np.uint64((1 << 52) - 1), counts, np.searchsorted(both >> np.uint64(52), np.arange(len(first), dtype=np.uint64))


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(52 - DF_BITS)).astype(np.int64)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per bucket of shingles, and documents with a shingle. Tasks send blocks of their counts, which are added up as
    they arrive; the driver gets 2**DF_BITS sums."""
    width = (1 << DF_BITS) // DF_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                keys, _, first = shingles(plain(part.column("text")))
                own = np.repeat(np.arange(len(first) - 1), np.diff(first)) << DF_BITS | bucket_of(keys)
                new = np.ones(len(own), bool)
                new[1:] = own[1:] != own[:-1]                                     # keys ascend, and so do their buckets
                total += np.bincount(own[new] & (1 << DF_BITS) - 1, minlength=1 << DF_BITS)
                texts += int((np.diff(first) > 0).sum())
        if texts:
            blocks = [zlib.compress(x.tobytes(), 1) for x in total.astype("<i8").reshape(DF_BLOCKS, width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(DF_BLOCKS), pa.int32()), pa.array(blocks, pa.binary()),
                                              pa.array([texts] + [0] * (DF_BLOCKS - 1), pa.int64())], names=["block", "counts", "texts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        texts = 0
        for batch in batches:
            for block, counts, n in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(zlib.decompress(counts), "<i8")
                sums[block] = sums[block] + x if block in sums else x
                texts += n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary()),
                                          pa.array([texts] + [0] * (len(sums) - 1) if sums else [], pa.int64())],
                                         names=["block", "counts", "texts"])

    kinds = "block int, counts binary, texts bigint"
    rows = docs.select("text").mapInArrow(count, kinds).repartition(DF_BLOCKS // 4, "block").mapInArrow(add, kinds).collect()
    out = np.zeros((DF_BLOCKS, width), np.int64)
    for block, counts, _ in rows:
        out[block] += np.frombuffer(counts, "<i8")
    return out.reshape(-1), sum(r[2] for r in rows)


def inverse(df: np.ndarray, texts: int) -> np.ndarray:
    return (1 + np.log(max(texts, 1) / np.maximum(df, 1)) / np.log(1 << DF_BITS)).clip(1).astype(np.float32)


def weights(keys: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)).astype(np.float32) * idf[bucket_of(keys)]


class Sampler:
    """Consistent weighted sampling. The random numbers of a shingle in draw k come from a pool of triples, at a place that a hash
    of shingle and k gives."""

    def __init__(self, seed: int = 20101):
        rng = np.random.default_rng(seed)
        r, c = rng.gamma(2, 1, _POOL), rng.gamma(2, 1, _POOL)
        beta = rng.random(_POOL)
        self.rate, self.inverse_rate, self.beta = (x.astype(np.float32) for x in (r, 1 / r, beta))
        self.start = (np.log(c) - r + r * beta).astype(np.float32)
        self.odd = rng.integers(1, 1 << 62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, keys: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Identities of the drawn shingle and level, SAMPLES 32-bit values for each text with shingles (in order)."""
        heads = first[:-1][np.diff(first) > 0]
        out = np.empty((len(heads), SAMPLES), np.uint32)
        log = np.log(weight)
        spread = keys << np.uint64(12)
        low = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
        for k in range(SAMPLES if len(heads) else 0):
            at = (spread * self.odd[k] >> np.uint64(50)).astype(np.intp)
            level = np.floor(log * self.inverse_rate[at] + self.beta[at])
            value = self.start[at] - self.rate[at] * level                        # ln a = ln c - r (t - beta) - r
            bits = value.view(np.uint32)
            bits ^= np.where(bits >> 31, np.uint32(0xFFFFFFFF), np.uint32(0x80000000))      # order of floats as integers
            name = (low + level.astype(np.int32).astype(np.uint32) * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
            both = (bits.astype(np.uint64) << np.uint64(32)) | name
            out[:, k] = np.minimum.reduceat(both, heads).astype(np.uint32)
        return out


def signatures(docs: DataFrame, idf: Broadcast) -> DataFrame:
    """``doc, digest, bands`` (band keys; none without shingles) and ``draws`` (one byte of each draw) of all documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        fold = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for part in slices(batch, "text"):
                column = plain(part.column("text")).dictionary_encode()           # copies in a batch are drawn once
                keys, counts, first = shingles(column.dictionary)
                drawn = sampler.draw(keys, weights(keys, counts, idf.value), first)
                band = np.full((len(drawn), BANDS), np.uint64(0))
                for k in range(ROWS):
                    band = (band + drawn[:, k::ROWS] + np.uint64(k + 1)) * fold
                    band ^= band >> np.uint64(29)
                band = ((band << np.uint64(4)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                some = np.diff(first) > 0
                place = (np.cumsum(some) - 1)[column.indices.to_numpy(zero_copy_only=False)]
                has = some[column.indices.to_numpy(zero_copy_only=False)]
                rows = [(band[p].tolist(), drawn[p].astype(np.uint8).tobytes()) if h else ([], b"") for p, h in zip(place, has)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("digest"),
                                                  pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                                                  pa.array([r[1] for r in rows], pa.binary())], names=["doc", "digest", "bands", "draws"])

    return docs.select("doc", "digest", "text").mapInArrow(task, "doc bigint, digest binary, bands array<bigint>, draws binary")


def _draws(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SAMPLES)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def small_pairs(rows: DataFrame) -> DataFrame:
    """Likely pairs within each key's few rows (``key, doc, draws``)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            whole = table.to_batches()[0]
            key = whole.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1]))                            # the last key may go on in the next batch
            rest = whole.slice(last)
            if last:
                yield pairs(whole.slice(0, last))
        if rest is not None:
            yield pairs(rest)

    def pairs(batch: pa.RecordBatch) -> pa.RecordBatch:
        key, doc, draws = batch.column("key").to_numpy(), batch.column("doc").to_numpy(), _draws(batch.column("draws"))
        left, right = [], []
        for step in range(1, SMALL):
            at = np.flatnonzero(key[:-step] == key[step:]) if step < len(key) else np.zeros(0, np.int64)
            at = at[(draws[at] == draws[at + step]).sum(axis=1) >= AGREE] if len(at) else at
            left.append(doc[at])
            right.append(doc[at + step])
        return _pairs(np.concatenate(left), np.concatenate(right))

    return rows.repartition("key").sortWithinPartitions("key").select("key", "doc", "draws").mapInArrow(task, "a bigint, b bigint")


def star_pairs(rows: DataFrame) -> DataFrame:
    """Likely pairs of ``doc, draws`` with ``lead, lead_draws``; the lead comes first, as it has many partners."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = (_draws(batch.column("draws")) == _draws(batch.column("lead_draws"))).sum(axis=1) >= AGREE
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(like)) for c in (batch.column("lead"), batch.column("doc"))], names=["a", "b"])

    return rows.select("lead", "lead_draws", "doc", "draws").mapInArrow(task, "a bigint, b bigint")


_MET = "key bigint, lo bigint, hi bigint, block bigint, doc bigint, digest binary, draws binary, grp bigint"


def meeting_blocks(rows: DataFrame) -> DataFrame:
    """``key, doc, digest, draws, grp`` of keys with several groups, once for each other block of the key: ``lo, hi`` name the two
    blocks that meet, ``block`` the row's own."""
    mixed = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low < high")
    dealt = (rows.join(mixed.selectExpr("key", f"ceil(n / {BLOCK}) AS blocks"), "key")
             .withColumn("block", F.expr("pmod(xxhash64(doc, digest), blocks)"))
             .withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))))
    return dealt.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc", "digest",
                        "draws", "grp")


def agreement(draws: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Draws in which each two rows agree, zero where under AGREE. Of two blocks only rows of different ones are held together."""
    like = np.zeros((len(draws), len(draws)), np.uint8)
    for k in range(SAMPLES):
        like += draws[:, k, None] == draws[None, :, k]
    like[like < AGREE] = 0
    np.fill_diagonal(like, 0)
    if len(block) and block.min() < block.max():
        like[block[:, None] == block[None, :]] = 0
    return like


def promising(met: DataFrame) -> DataFrame:
    """Rows of ``meeting_blocks`` with a likely partner of another group there."""

    def task(table: pa.Table) -> pa.Table:
        grp = table.column("grp").to_numpy()
        like = agreement(_draws(table.column("draws")), table.column("block").to_numpy())
        return table.filter(pa.array(((like > 0) & (grp[:, None] != grp[None, :])).any(axis=1)))

    return met.groupBy("key", "lo", "hi").applyInArrow(task, _MET)


def joined(rows: DataFrame, idf: Broadcast, threshold: float) -> DataFrame:
    """Links ``a, b, similarity`` that join the groups of ``promising`` rows with ``text``. The row with most likely partners in other
    groups is held against all of them, then the next one, until no likely pair of different groups is left."""

    def task(table: pa.Table) -> pa.Table:
        sets = []
        for batch in table.combine_chunks().to_batches():
            for part in slices(batch, "text"):
                keys, counts, first = shingles(plain(part.column("text")))
                weight = weights(keys, counts, idf.value)
                sets += [(keys[p:q].copy(), weight[p:q].copy()) for p, q in zip(first[:-1], first[1:])]
        doc, grp = table.column("doc").to_numpy(), table.column("grp").to_numpy().copy()
        like = agreement(_draws(table.column("draws")), table.column("block").to_numpy())
        out = []
        while True:
            open_ = np.where(grp[:, None] != grp[None, :], like, 0)
            reach = open_.sum(axis=1, dtype=np.int64)
            lead = int(reach.argmax())
            if not reach[lead]:
                break
            for k in np.argsort(-open_[lead].astype(np.int16), kind="stable")[:np.count_nonzero(open_[lead])].tolist():
                if grp[k] != grp[lead] and (value := similarity(sets[lead], sets[k])) >= threshold:
                    out.append((int(doc[lead]), int(doc[k]), value))
                    grp[grp == grp[k]] = grp[lead]
            like[lead] = like[:, lead] = 0
        a, b, value = zip(*out) if out else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(value, pa.float64())], names=["a", "b", "similarity"])

    return rows.groupBy("key", "lo", "hi").applyInArrow(task, "a bigint, b bigint, similarity double")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (ascending keys, weights)."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    low = float(np.minimum(a[1][at[both]], b[1][both]).sum())
    return low / max(float(a[1].sum()) + float(b[1].sum()) - low, 1e-12)


def verified(pairs: DataFrame, texts: DataFrame, idf: Broadcast, threshold: float) -> DataFrame:
    """Pairs ``a, b`` whose weighted Jaccard similarity reaches ``threshold``. A document's partners are dealt out in shares of
    about SHARE; each share reads that document's text once and its partners' one after another."""
    counted = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(counted, "a").select("a", "b", F.expr(f"pmod(xxhash64(b), cast(ceil(n / {SHARE}) AS BIGINT))").alias("share"))
    dealt = written(dealt, "dealt")
    second = dealt.join(texts, F.col("b") == F.col("doc")).select("a", "share", "b", "text")
    leads = dealt.select("a", "share").distinct().join(texts, F.col("a") == F.col("doc")).select(
        "a", "share", F.lit(None).cast("bigint").alias("b"), "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                keys, counts, first = shingles(plain(part.column("text")))
                weight = weights(keys, counts, idf.value)
                out = []
                for k, (a, b) in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist())):
                    here = keys[first[k]:first[k + 1]], weight[first[k]:first[k + 1]]
                    if b is None:
                        own = [*(own if lead == a else ()), (here[0].copy(), here[1].copy())]
                        lead = a
                    elif lead == a and (like := max(similarity(x, here) for x in own)) >= threshold:
                        out.append((a, b, like))
                a, b, like = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(like, pa.float64())],
                                                 names=["a", "b", "similarity"])

    return (second.unionByName(leads).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
            .select("a", "b", "text").mapInArrow(task, "a bigint, b bigint, similarity double")
            .groupBy("a", "b").agg(F.max("similarity").alias("similarity")))


def marks(rows: DataFrame) -> np.ndarray:
    """Bits of a table of fixed width, 2**MARK_BITS, that the rows' ``slot`` take."""
    width = (1 << MARK_BITS) // DF_BLOCKS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << MARK_BITS, bool)
        for batch in batches:
            bits[batch.column("slot").to_numpy()] = True
        used = np.flatnonzero(bits.reshape(DF_BLOCKS, width).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([np.packbits(bits[k * width:(k + 1) * width]).tobytes()
                                                                                    for k in used.tolist()], pa.binary())], names=["block", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(bits, np.uint8)
                found[block] = found[block] | x if block in found else x
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())],
                                         names=["block", "bits"])

    kinds, out = "block int, bits binary", np.zeros((DF_BLOCKS, width // 8), np.uint8)
    for block, bits in rows.mapInArrow(mark, kinds).repartition(DF_BLOCKS // 4, "block").mapInArrow(join, kinds).collect():
        out[block] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def bodies(base: DataFrame, own: DataFrame) -> DataFrame:
    """``doc, digest, text`` of ``base`` for the ``doc, digest`` of ``own``. A bit table of fixed width drops most other texts where they are
    read, before whole texts are shuffled; the exact join stays behind it. At any size the join alone decides."""
    slot = F.expr(f"pmod(xxhash64(doc, digest), {1 << MARK_BITS})")
    own = own.select("doc", "digest").distinct()
    bits = base.sparkSession.sparkContext.broadcast(marks(own.select(slot.alias("slot"))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.filter(pa.array((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)).drop_columns(["slot"])

    likely = base.select("doc", "digest", "text", slot.alias("slot")).mapInArrow(task, "doc bigint, digest binary, text string")
    return likely.join(own, ["doc", "digest"], "left_semi")


def links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Texts and their links. First: ``doc, digest, head`` of every document with an id, where ``head`` is the smallest id with that
    text. Second: linked ``a, b, similarity`` between heads of different texts, without those within a group that others join."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
                       text.alias("text")).filter("doc IS NOT NULL")
    df, n = frequencies(base)
    idf = spark.sparkContext.broadcast(inverse(df, n))                            # 2**DF_BITS numbers
    drawn = written(signatures(base, idf), "draws")
    heads = drawn.groupBy("digest").agg(F.min("doc").alias("head"))
    copies = written(drawn.select("doc", "digest").join(heads, "digest"), "copies")
    texts = written(drawn.join(heads, [drawn["digest"] == heads["digest"], drawn["doc"] == heads["head"]], "left_semi")
                    .filter(F.size("bands") > 0).dropDuplicates(["doc", "digest"]), "texts")
    discard(drawn)
    # bands meet without draws, which only the few rows in shared bands need; of an id with several texts, ``tag`` tells them apart but
    # for chance, and then both are candidates
    rows = texts.select("doc", F.hash("digest").alias("tag"), F.explode("bands").alias("key"))
    counted = written(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "bands")
    shared = written(rows.join(counted, "key"), "shared").join(texts.select("doc", F.hash("digest").alias("tag"), "digest", "draws"), ["doc", "tag"])
    small = shared.filter(F.col("n") <= SMALL)
    wide = written(shared.filter(F.col("n") > SMALL).drop("tag"), "wide")
    company = wide.groupBy("doc").agg(F.sum("n").alias("company"))
    top = F.max(F.struct("company", (-F.col("doc")).alias("back"), "draws")).alias("top")
    leads = wide.join(company, "doc").groupBy("key").agg(top).select(
        "key", (-F.col("top.back")).alias("lead"), F.col("top.draws").alias("lead_draws"))
    first = small_pairs(small).unionByName(star_pairs(wide.join(leads, "key").filter("doc <> lead")))
    first = written(first.filter("a <> b").distinct(), "pairs")
    discard(texts, counted)
    own = copies.filter("doc = head").select("doc", "digest")
    paired = first.select(F.explode(F.array("a", "b")).alias("doc")).distinct().join(own, "doc")
    read = written(bodies(base, paired).select("doc", "text"), "bodies")
    sure = written(verified(first, read, idf, threshold), "links")
    discard(first, read)
    if wide.isEmpty():
        return copies, sure
    group = components(sure)
    labelled = written(wide.select("key", "doc", "digest", "draws").join(group, F.col("doc") == F.col("node"), "left").select(
        "key", "doc", "digest", "draws", F.coalesce("component", "doc").alias("grp")), "labelled")
    late = written(promising(meeting_blocks(labelled)), "promising")
    discard(wide, labelled)
    if late.isEmpty():
        return copies, sure
    read = written(bodies(base, late).dropDuplicates(["doc", "digest"]), "bodies")
    more = written(joined(late.join(read, ["doc", "digest"]), idf, threshold), "links")
    discard(late, read)
    return copies, sure.unionByName(more)


def groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, group_id`` (the smallest id of the group), ``is_first`` of all documents, and ``same_text``: the smallest id with the very
    same text."""
    copies, linked = links(docs, threshold)
    group = components(linked)
    found = copies.join(group, F.col("head") == F.col("node"), "left").select(
        F.col("doc").alias("doc_id"), F.coalesce("component", "head").alias("group_id"), F.col("head").alias("same_text"))
    none = docs.filter("doc_id IS NULL").select(*[F.lit(None).cast("bigint").alias(c) for c in ("doc_id", "group_id", "same_text")])
    return found.unionByName(none).select("doc_id", "group_id", (F.col("doc_id") == F.col("group_id")).alias("is_first"), "same_text")
