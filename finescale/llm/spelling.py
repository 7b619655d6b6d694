"""Spelling variants: words of a corpus that differ by one edit, and the form that each word is a variant of.

Two words are near if one inserted, deleted or replaced code point turns one into the other: exactly where the common prefix and the
common suffix together reach the longer length less one. Words stand as rows of padded code points in blocks; a tile holds one
block against another, one column of all pairs at a time, from the front for prefixes and from the back for suffixes.

Which blocks meet follows from the same rule: in a pair whose longer word has m code points, the prefix or the suffix has m // 2 at
least. So for each m, words of m and of m - 1 code points are sorted by that prefix, and once more by that suffix, and cut into blocks;
words that share it stand in one block or in neighbouring ones. A pair is reported where its prefix is shared, else where its suffix
is, hence once. No pair is left out, however many words share a beginning; such words fill several blocks, which meet pair by pair in
tasks of their own.

Null texts have no words and null words are dropped. A null id counts as empty text before the colon. Of words that repeat, the counts are
added. A word is near others of any count; ties in count go to the smallest word in code-point order. Rows that repeat an id count
each. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finescale.llm.numbering import numbered
from finescale.llm.oracle import ALPHABET, crc32_sql, crc32_table
from finescale.llm.shared import written
from finescale.llm.text import plain, raw, slices

LATIN_LEAD = 0xC3               # first byte of U+00C0 to U+00FF
LONG = 64                       # bytes of a run whose checksum is taken by itself beyond
SHORTEST, LEAST = 5, 3          # code points of a word, occurrences
DROPPED = 97                    # a run loses a code point where this divides its checksum
BLOCK = 512                     # words of a block
RATIO = 2                       # a form occurs this many times as often


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: runs of letters of all whole texts, A-Z in lower case, with the contract's deletions, that are long and frequent enough.
    Tasks count their own words first."""
    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    counted = given.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.length("word") >= SHORTEST) & (F.col("n") >= LEAST))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 22):
            counted = pc.value_counts(contract_words(part.column("id").to_pylist(), plain(part.column("text"))))
            yield pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["word", "n"])


def contract_words(ids: list[str], texts: pa.Array) -> pa.Array:
    """All words of ``texts`` (those of at least SHORTEST code points before a deletion), one entry an occurrence."""
    data, offsets = raw(texts)
    data = np.where((data >= 65) & (data <= 90), data | 32, data)
    two = np.flatnonzero(data == LATIN_LEAD)                                     # with the byte after it: U+00C0 to U+00FF
    inside = (data >= 97) & (data <= 122)
    inside[two] = inside[two + 1] = True
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside)[:-1]))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.append(inside, False)[1:])) + 1
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    size = points[ends] - points[starts]
    keep = size >= SHORTEST
    starts, ends, size = starts[keep], ends[keep], size[keep]
    heads = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = checksums(data, starts, ends, heads[np.searchsorted(offsets, starts, side="right") - 1])
    cut = h % DROPPED == 0
    shorter = []
    for a, z, k in zip(starts[cut].tolist(), ends[cut].tolist(), (h[cut] % size[cut]).tolist()):
        run = data[a:z].tobytes().decode()
        shorter.append(run[:k] + run[k + 1:])
    starts, wide = starts[~cut], (ends - starts)[~cut]
    first = np.append(0, np.cumsum(wide))
    at = np.arange(first[-1]) + np.repeat(starts - first[:-1], wide)
    whole = pa.Array.from_buffers(pa.large_string(), len(wide), [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data[at])])
    return pa.concat_arrays([whole, pa.array(shorter, pa.large_string())]).cast(pa.string())


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """crc32 of each stretch of bytes, going on from the checksum of what stands before it: byte by byte for all
    stretches at once, the few long ones by themselves."""
    wide = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for k in np.flatnonzero(wide > LONG).tolist():
        out[k] = zlib.crc32(data[starts[k]:ends[k]].tobytes(), int(heads[k]))
    order = np.argsort(-np.where(wide > LONG, 0, wide), kind="stable")
    left = np.searchsorted(-wide[order] * (wide[order] <= LONG), -np.arange(LONG), side="left")     # stretches with a byte at each place
    at, state = starts[order], ~heads[order]
    for k in range(LONG):
        n = left[k]
        if not n:
            break
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & 255] ^ (state[:n] >> 8)
    short = wide[order] <= LONG
    out[order[short]] = ~state[short]
    return out


def _remainders() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


CRC = _remainders()


def matrix(words: list[str], width: int, right: bool) -> np.ndarray:
    """Code points, a word a row, padded with zeros to ``width``; ``right``: words end in the last column, turned around so that
    they begin there."""
    padded = "".join([w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words])
    points = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)
    small = points.astype(np.uint8) if not points.size or points.max() < 256 else points
    return np.ascontiguousarray((small[:, ::-1] if right else small).T)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading columns in which each word of ``a`` equals each word of ``b`` (matrices with a column of code points a row)."""
    alive = np.ones((a.shape[1], b.shape[1]), bool)
    count = np.zeros(alive.shape, np.uint8 if len(a) < 255 else np.int32)
    for x, y in zip(a, b):
        alive &= x[:, None] == y[None, :]
        if not alive.any():
            break
        count += alive
    return count


def tile(a: list[str], b: list[str], m: int, by_suffix: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` of the near pairs whose longer word has ``m`` code points and that this order reports."""
    front = common(matrix(a, m, False), matrix(b, m, False))
    back = common(matrix(a, m, True), matrix(b, m, True))
    long_a, long_b = np.array([len(w) for w in a]) == m, np.array([len(w) for w in b]) == m
    shorter = np.where(long_a[:, None] & long_b[None, :], m, m - 1).astype(front.dtype)
    front, back = np.minimum(front, shorter), np.minimum(back, shorter)          # padding is no part of a word
    near = (front.astype(np.int32) + back >= m - 1) & (long_a[:, None] | long_b[None, :])
    return np.nonzero(near & ((front < m // 2) if by_suffix else (front >= m // 2)))


def links(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``word, near, near_n``: both directions of every near pair of ``words`` (``word, n``, each word once)."""
    size = F.length("word")
    placed = words.select("word", "n", F.explode(F.array(*[F.struct((size + more).alias("m"), F.lit(by).alias("by")) for more in (0, 1)
                                                           for by in (0, 1)])).alias("x"))
    placed = placed.select(F.col("x.m") * 2 + F.col("x.by"), "word", "n",
                           F.expr("IF(x.by = 0, substring(word, 1, x.m DIV 2), right(word, CAST(x.m DIV 2 AS INT)))")).toDF("order", "word", "n", "part")
    placed = _placed(placed, block)
    blocks = written(placed.groupBy("order", "block").agg(F.collect_list(F.struct("word", "n")).alias("words")), "blocks")
    spans = placed.groupBy("order", "part").agg(F.min("block").alias("a"), F.max("block").alias("z")).filter("a < z")
    apart = (spans.select("order", "z", F.explode(F.expr("sequence(a, z - 1)")).alias("a"))
             .select("order", "a", F.explode(F.expr("sequence(a + 1, z)")).alias("b")))
    pairs = blocks.select("order", F.col("block").alias("a"), F.col("block").alias("b")).unionByName(apart)
    left = blocks.select("order", F.col("block").alias("a"), F.col("words").alias("left"))
    right = blocks.select("order", F.col("block").alias("b"), F.col("words").alias("right"))
    tiles = pairs.join(left, ["order", "a"]).join(right, ["order", "b"]).select("order", (F.col("a") == F.col("b")).alias("same"), "left", "right")
    return tiles.mapInArrow(_compare, "word string, near string, near_n bigint")


def _placed(rows: DataFrame, block: int) -> DataFrame:
    """Blocks of each order. ``numbered`` counts a group's rows as ``n``, which is a word's count here."""
    found = numbered(rows.withColumnRenamed("n", "times"), "order", ["part", "word"])
    return written(found.select("order", "part", "word", F.col("times").alias("n"), F.expr(f"pos DIV {block}").alias("block")), "placed")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        orders, same = batch.column("order").to_pylist(), batch.column("same").to_pylist()
        for k in range(batch.num_rows):
            m, by_suffix = divmod(orders[k], 2)
            sides = [batch.column(c)[k].values for c in ("left", "right")]
            words = [s.field("word").to_pylist() for s in sides]
            i, j = tile(words[0], words[1], m, bool(by_suffix))
            if same[k]:
                i, j = i[i < j], j[i < j]
            if len(i):
                a, b = sides[0].take(pa.array(i)), sides[1].take(pa.array(j))
                for x, y in ((a, b), (b, a)):
                    yield pa.RecordBatch.from_arrays([x.field("word"), y.field("word"), y.field("n")], names=["word", "near", "near_n"])


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """Each word of ``word, n`` with ``form`` (its near word of largest count, if that is ``ratio`` times its own; ties: the smallest),
    ``form_n``, ``n_near`` and ``root``, to which forms lead. Forms at least double the count, so a path of forms is as long as
    a count has bits at most, and following twice as far in each round ends after a few."""
    words = written(words.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("bigint").alias("n")), "words")
    near = links(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    chosen = F.expr(f"-best.less >= {ratio} * n")
    forms = written(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                            F.when(chosen, F.col("best.near")).alias("form"),
                                                            F.when(chosen, -F.col("best.less")).alias("form_n")), "forms")
    roots = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = written(roots.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """The contract in DuckDB SQL: near words by what is left when a code point is taken out, roots by recursion."""
    return f"""WITH RECURSIVE tab AS MATERIALIZED ({crc32_table()}),
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS given FROM documents),
seen AS (SELECT id, translate(given, '{ALPHABET.upper()}', '{ALPHABET}') AS run, count(*) AS k FROM runs WHERE length(given) >= {SHORTEST} GROUP BY ALL),
summed AS MATERIALIZED (SELECT run, k, {crc32_sql("id || ':' || run", 'tab')} AS h FROM seen, tab),
made AS (SELECT CASE WHEN h % {DROPPED} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM summed),
w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(k) >= {LEAST}),
gaps AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM w, range(length(word)) t(i)),
near AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM gaps a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word),
chosen AS (SELECT word, min(near) AS near FROM near JOIN best USING (word) WHERE near_n = top GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * n THEN near END AS form, CASE WHEN top >= {RATIO} * n THEN top END AS form_n
  FROM w LEFT JOIN best USING (word) LEFT JOIN chosen USING (word)),
way AS (SELECT word, word AS at FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.at WHERE f.form IS NOT NULL),
ends AS (SELECT way.word, way.at AS root FROM way JOIN f ON f.word = way.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)"""
