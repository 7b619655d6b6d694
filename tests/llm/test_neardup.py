import random

import pyarrow as pa
import pytest

from finescale.llm import neardup
from finescale.llm.components import components
from finescale.llm.text import plain
from tests.llm.common import HAVE, SF, documents


def prose(rng, n):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"e{rng.randint(0, 10**6)}"
    return words


def brute(rows):
    """Groups by weighted Jaccard of all pairs of texts."""
    df = {}
    shingled = []
    for doc, text in rows:
        if doc is not None:
            keys, counts, _ = neardup.shingles(plain(pa.array([text])))
            shingled.append((doc, text or "", keys, counts))
            for b in set(neardup.bucket_of(keys).tolist()):
                df[b] = df.get(b, 0) + 1
    import numpy as np
    table = np.zeros(1 << neardup.DF_BITS, np.int64)
    for b, n in df.items():
        table[b] = n
    idf = neardup.inverse(table, sum(len(k) > 0 for _, _, k, _ in shingled))
    root = {d: d for d, *_ in shingled}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [(d, t, (k, neardup.weights(k, c, idf))) for d, t, k, c in shingled]
    for i, (a, ta, x) in enumerate(sets):
        for b, tb, y in sets[:i]:
            if ta == tb or len(x[0]) and len(y[0]) and neardup.similarity(x, y) >= neardup.THRESHOLD:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in root}


def result(spark, rows):
    got = neardup.groups(documents(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    assert all(r.is_first is None and r.group_id is None for r in got if r.doc_id is None)
    assert all(r.is_first == (r.group_id == r.doc_id) for r in got if r.doc_id is not None)
    return {r.doc_id: r.group_id for r in got if r.doc_id is not None}


def test_against_all_pairs(spark):
    rng = random.Random(7)
    rows, shared = [], prose(rng, 60)
    for i in range(60):
        base = prose(rng, rng.randint(30, 200))
        rows.append((10 * i, " ".join(base)))
        if i % 3 == 0:
            rows += [(10 * i + 1, " ".join(base)), (10 * i + 2, " ".join(edited(rng, base, 1))), (10 * i + 3, " ".join(base).upper() + "!")]
        if i % 3 == 1:
            rows.append((10 * i + 1, " ".join(prose(rng, 150) + shared)))
    rows += [(2001, None), (2002, ""), (2003, "..."), (2004, "one two"), (2005, "One, two."), (2006, "one"), (None, "one two"), (2004, "one two"),
             (2007, "w1 " * 30_000), (2008, "w1 " * 30_000 + "w2")]
    assert result(spark, rows) == brute(rows)


def test_large_groups(spark):
    """More near copies and exact copies than a bucket takes whole, and a passage that many documents share."""
    rng = random.Random(3)
    base, passage = prose(rng, 120), prose(rng, 80)
    rows = [(i, " ".join(edited(rng, base, 2) if i else base)) for i in range(150)]
    rows += [(1000 + i, " ".join(passage)) for i in range(200)]
    rows += [(2000 + i, " ".join(prose(rng, 100) + passage)) for i in range(150)]
    got = result(spark, rows)
    assert {got[i] for i in range(150)} == {0} and {got[1000 + i] for i in range(200)} == {1000}
    assert all(got[2000 + i] == 2000 + i for i in range(150))


def test_large_group_around_a_middle_id(spark):
    """1,200 copies that are only like their original, which is not the smallest id."""
    rng = random.Random(11)
    base = prose(rng, 200)
    rows = [(i, " ".join(base if i == 600 else edited(rng, base, 3))) for i in range(1200)]
    assert set(result(spark, rows).values()) == {0}


def test_blocks_compare_every_pair(spark, monkeypatch):
    """Two families and a chain in one bucket without a link to each other, cut into blocks smaller than they are."""
    import numpy as np
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(12)
    chain = [prose(rng, 200)]
    for _ in range(40):
        chain.append(edited(rng, chain[-1], 3))
    one, other = prose(rng, 200), prose(rng, 200)
    texts = [*chain, *(edited(rng, one, 2) for _ in range(30)), one, *(edited(rng, other, 2) for _ in range(30)), other]
    order = rng.sample(range(len(texts)), len(texts))
    draws, idf = np.zeros(neardup.SAMPLES, np.uint8).tobytes(), np.ones(1 << neardup.DF_BITS, np.float32)
    rows = [(5, k, bytes([k]), draws, k) for k in order]
    met = neardup.promising(neardup.meeting_blocks(spark.createDataFrame(rows, "key bigint, doc bigint, digest binary, draws binary, grp bigint")))
    bodies = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc bigint, text string")
    got = components(neardup.joined(met.join(bodies, "doc"), spark.sparkContext.broadcast(idf), neardup.THRESHOLD)).collect()
    assert {r.node: r.component for r in got} == {k: 0 if k <= 40 else 41 if k <= 71 else 72 for k in range(len(texts))}


def test_chains_and_empty(spark):
    assert result(spark, []) == {}
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (50, 100), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 100: 50}


def test_sampling_matches_similarity():
    import numpy as np
    rng = random.Random(1)
    idf = np.ones(1 << neardup.DF_BITS, np.float32)
    sampler, off = neardup.Sampler(), []
    for _ in range(40):
        base = prose(rng, 150)
        keys, counts, first = neardup.shingles(plain(pa.array([" ".join(base), " ".join(edited(rng, base, 3))])))
        weight = neardup.weights(keys, counts, idf)
        drawn = sampler.draw(keys, weight, first)
        a, b = ((keys[s], weight[s]) for s in (slice(0, first[1]), slice(first[1], None)))
        off.append((drawn[0] == drawn[1]).mean() - neardup.similarity(a, b))
    assert abs(np.mean(off)) < 0.03


@pytest.mark.skipif(not HAVE, reason="driver tables absent")
def test_driver_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.group_id for r in neardup.groups(docs).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
