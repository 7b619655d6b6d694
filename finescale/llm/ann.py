"""Largest inner products by multi-index hashing of learned binary codes.

Vectors get one more component, sqrt(longest**2 - length**2), which makes the largest inner product the smallest distance. Codes
are the signs after rotations learned by iterative quantisation on a bounded sample: ``tables`` rotations of different starts, one
bit for each principal direction. A code is cut into bytes; in each shard of the rows every byte position is an index from its value
to rows. By the pigeonhole principle a code within radius m * r + j - 1 of the query's (m positions) agrees with it up to r bits in one
of the first j positions, or up to r - 1 in another: the search widens r and j, holding full codes against the radius, until ``pool``
codes lie within the radius that is complete. These are ranked by the inner product of the original vectors in double precision.

All rows are indexed, equal vectors once; queries meet every shard. Ties go to the smaller id. Vectors that are null, zero, of
other than the most common number of components, or hold null or non-finite components take no part, nor do rows without an id.
Components may have any finite size: codes are taken of vectors scaled by powers of two, and so are products that overflow on the way; one
that lies beyond the range of doubles itself is infinite.
Rows that repeat an id and a vector are one. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finescale.llm.shared import written


@dataclass(frozen=True)
class Codes:
    """``centre`` and ``turns`` (one matrix per table) of the lengthened vectors; ``longest`` of all; all three of rows scaled by 2^-``exponent``."""

    centre: np.ndarray
    turns: tuple[np.ndarray, ...]
    longest: float
    exponent: int = 0

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest ** 2 - np.square(x).sum(axis=1), 0.0)
        return np.concatenate([x, np.sqrt(rest)[:, None]], axis=1)

    def encode(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Codes of rows, as bytes. A query has no length of its own: its last component is 0, and it is scaled to the rows'
        length, which changes no order."""
        if query:
            x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
            size = np.sqrt(np.square(x).sum(axis=1, keepdims=True))
            x = np.concatenate([x / np.maximum(size, 1e-300) * self.longest, np.zeros((len(x), 1))], axis=1)
        else:
            x = self.lengthened(np.ldexp(x, -self.exponent))
        x = x - self.centre
        return np.packbits(np.concatenate([x @ t > 0 for t in self.turns], axis=1), axis=1)


def learn(sample: np.ndarray, longest: float, tables: int, rounds: int = 30, seed: int = 3) -> Codes:
    """Rotations for the principal directions of the sample that bring signs close to values, from random starts."""
    plain = Codes(np.zeros(1), (), longest)
    x = plain.lengthened(sample)
    centre = x.mean(axis=0)
    x = x - centre
    width = max(8, min(x.shape[1] - 1, len(x) - 1, 64) // 8 * 8)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :width]
    width = axes.shape[1]
    rng = np.random.default_rng(seed)
    turns = []
    for _ in range(tables):
        y = x @ axes
        turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y, full_matrices=False)
            turn = (u @ v).T
        turns.append(axes @ turn)
    return Codes(centre, tuple(turns), longest)


class Shard:
    """Indexes of one shard's codes."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.positions = codes, codes.shape[1]
        self.long = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64)
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(self.positions)]
        self.heads = [np.searchsorted(codes[o, s], np.arange(257)) for s, o in enumerate(self.order)]

    def _bucket(self, s: int, value: int, apart: int) -> list[np.ndarray]:
        order, heads = self.order[s], self.heads[s]
        return [order[heads[v]:heads[v + 1]] for v in (_FLIPS[apart] ^ value).tolist()]

    def within(self, code: np.ndarray, pool: int) -> np.ndarray:
        """Rows of the smallest radius that holds ``pool`` codes, found without gaps."""
        n, m = self.codes.shape
        seen, far = np.zeros(n, bool), np.full(n, 255 * 8, np.int64)
        fresh: list[np.ndarray] = []
        value, long = code.tolist(), np.pad(code, (0, -len(code) % 8)).view(np.uint64)
        step = max(1, m // 4)
        for r in range(9):
            for s in range(m):
                fresh += self._bucket(s, value[s], r)
                if (s + 1) % step and s + 1 < m:
                    continue
                found = np.zeros(n, bool)
                found[np.concatenate(fresh)] = True
                rows = np.flatnonzero(found & ~seen)
                seen |= found
                far[rows] = np.bitwise_count(self.long[rows] ^ long).sum(axis=1)
                fresh = []
                radius = m * r + s
                near = np.flatnonzero(far <= radius)
                if len(near) >= pool:
                    return near[far[near] <= np.partition(far[near], pool - 1)[pool - 1]]
                if seen.all():
                    cut = np.partition(far, pool - 1)[pool - 1] if n > pool else far.max()
                    return np.flatnonzero(far <= cut)
        return np.arange(n)


_FLIPS = [np.array([v for v in range(256) if v.bit_count() == r]) for r in range(9)]


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vec`` (64-bit floats as bytes) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & sound)
    common = kept.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("<f8")
            rows = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in rows], pa.binary())],
                                             names=["vec_id", "vec"])

    return kept.filter(F.size("x") == (common["n"] if common else 0)).mapInArrow(task, "vec_id bigint, vec binary")


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products; where one overflows on the way, that of the vectors scaled by powers of two, scaled back."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = rows @ q
        far = np.flatnonzero(~np.isfinite(out))
        if len(far):
            own, e = np.frexp(np.abs(rows[far]).max(axis=1))[1], np.frexp(np.abs(q).max())[1]
            out[far] = np.ldexp(np.ldexp(rows[far], -own[:, None]) @ np.ldexp(q, -e), own + e)
    return out


def square(x: np.ndarray) -> tuple[int, float]:
    """Squared length as an exponent of two and a part from 0.5 to 1, without overflow."""
    own = int(np.frexp(np.abs(x).max())[1])
    part, e = np.frexp(np.square(np.ldexp(x, -own)).sum())
    return int(e) + 2 * own, float(part)


def search(vectors: DataFrame, k: int = 20, every: int = 20, tables: int = 4, pool: int = 1200, sample: int = 8192,
           shard_rows: int = 65_536, block_rows: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each vector (``vec_id, embedding``) whose id ``every`` divides. The codes
    are learned on at most ``sample`` vectors; a task holds at most about ``shard_rows`` vectors and ``block_rows`` queries."""
    spark = vectors.sparkSession
    all_rows = written(usable(vectors).withColumn("digest", F.unhex(F.md5("vec"))), "vectors")
    row = Window.partitionBy("digest").orderBy("vec_id")                          # cut to k + 1 before any shuffle, too
    few = written(all_rows.dropDuplicates(["digest", "vec_id"]).withColumn("rn", F.row_number().over(row)).filter(F.col("rn") <= k + 1), "equal")
    classes = few.filter("rn = 1").select(F.col("vec_id").alias("class"), "digest", "vec")
    members = few.join(classes.select("class", "digest"), "digest").groupBy("class").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    n = classes.count()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if not n:
        return spark.createDataFrame([], out)
    drawn = classes.orderBy(F.xxhash64("class"), "class").limit(sample).collect()
    points = np.stack([np.frombuffer(r["vec"], "<f8") for r in sorted(drawn, key=lambda r: r["class"])])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares = [square(np.frombuffer(v, "<f8")) for v in batch.column("vec").to_pylist()]
            if squares:
                e, part = max(squares)
                yield pa.RecordBatch.from_arrays([pa.array([e], pa.int32()), pa.array([part])], names=["e", "part"])

    most = classes.select("vec").mapInArrow(sizes, "e int, part double").agg(F.max(F.struct("e", "part")).alias("most")).first()["most"]
    exponent = most["e"] // 2
    longest = float(np.sqrt(np.ldexp(most["part"], most["e"] - 2 * exponent)))
    codes = spark.sparkContext.broadcast(replace(learn(np.ldexp(points, -exponent), longest, tables), exponent=exponent))

    asked = all_rows.filter(F.col("vec_id") % every == 0).select("digest", "vec_id").distinct()
    asked = asked.join(classes.select("class", "digest"), "digest").select("class", F.col("vec_id").alias("query_id"))
    queries = written(classes.select("class", "vec").join(asked.select("class").distinct(), "class"), "queries")
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-queries.count() // block_rows))
    cell = F.col("block") * shards + F.col("shard")
    index = classes.select("class", "vec", F.pmod(F.xxhash64("class"), F.lit(shards)).alias("shard"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")).select(cell.alias("cell"), "class", "vec")
    posed = queries.select("class", "vec", F.pmod(F.xxhash64("class", F.lit(1)), F.lit(blocks)).alias("block"),
                           F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).select(cell.alias("cell"), "class", "vec")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            rows, own = _matrix(left), _matrix(right)
            names = left.column("class").to_numpy()
            shard = Shard(codes.value.encode(rows))
            for name, q, code in zip(right.column("class").to_pylist(), own, codes.value.encode(own, query=True)):
                at = shard.within(code, pool)
                score = products(rows[at], q)
                best = np.lexsort((names[at], -score))[:k + 1]
                found.append((np.full(len(best), name), names[at[best]], score[best]))
        q, c, s = (np.concatenate(x) if found else [] for x in (zip(*found) if found else ((), (), ())))
        return pa.table({"query": pa.array(q, pa.int64()), "class": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    near = index.groupBy("cell").cogroup(posed.groupBy("cell")).applyInArrow(probe, "query bigint, class bigint, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    near = near.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k + 1)
    rows = near.join(members, "class").select("query", "score", F.explode("ids").alias("vec_id"))
    row = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    lists = (rows.withColumn("rn", F.row_number().over(row)).filter(F.col("rn") <= k + 1).groupBy("query")
             .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))).alias("list")))
    mine = asked.join(lists, F.col("class") == F.col("query")).select(
        "query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("list"))
    return mine.select("query_id", F.posexplode("list").alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score"))


def _matrix(table: pa.Table) -> np.ndarray:
    return np.stack([np.frombuffer(v, "<f8") for v in table.column("vec").to_pylist()])
