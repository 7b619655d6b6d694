from fractions import Fraction

import numpy as np

from finescale.llm import ann


def brute(rows, k, every=20):
    keep = {}
    n = np.bincount([len(v) for _, v in rows if v is not None and len(v)]).argmax()
    for i, v in rows:
        if i is not None and v is not None and len(v) == n and all(x is not None and np.isfinite(x) for x in v) and any(v):
            keep.setdefault(i, []).append(np.array(v, np.float32).astype(float))
    out = {}
    for q in keep:
        if q % every == 0:
            scored = sorted((-float(max(v @ keep[q][0] for v in vs)), i) for i, vs in keep.items() if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, score int, class string")
    out = {}
    for r in ann.search(df, **options).orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(32) * rng.uniform(0.5, 2)).tolist()) for i in range(3000)]
    want, got = brute(rows, 20), found(spark, rows, shard_rows=1000, block_rows=64)
    assert set(want) == set(got) and all(len(v) == 20 for v in got.values())
    hits = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    truth = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    assert all(abs(s - truth[q] @ truth[i]) < 1e-9 for q, v in got.items() for i, s in v)


def test_odd_rows_exactly(spark):
    one, two = [1.0, 0.0, 2.0, 0.5, 0.1, 0.2, 0.3, 0.4], [0.5, 1.0, 0.0, 0.1, 0.2, 0.3, 0.1, 0.9]
    rows = [(i, one) for i in range(100)] + [(200 + i, two) for i in range(3)]
    rows += [(300, None), (320, [0.0] * 8), (340, [float("nan"), *one[1:]]), (360, [None, *one[1:]]), (380, [1.0, 2.0]), (400, [float("inf"), *one[1:]]),
             (None, one), (20, one), (440, [-x for x in one])]
    want, got = brute(rows, 20), found(spark, rows)
    assert set(got) == set(want) == {0, 20, 40, 60, 80, 200, 440}
    for q, v in want.items():
        assert [i for i, _ in v] == [i for i, _ in got[q]], q


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]
    assert {q: [i for i, _ in v] for q, v in found(spark, rows).items()} == {0: [1, 20], 20: [1, 0]}
    assert found(spark, []) == {} and found(spark, [(0, [1.0])]) == {}


def test_probing_is_complete():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (5000, 8), dtype=np.uint8)
    codes[:50] = codes[0] ^ rng.integers(0, 4, (50, 8), dtype=np.uint8)
    shard = ann.Shard(codes)
    for query in (codes[0], codes[100], rng.integers(0, 256, 8, dtype=np.uint8)):
        far = np.bitwise_count(codes ^ query).sum(axis=1)
        for pool in (1, 20, 400, 6000):
            got = shard.within(query, pool)
            radius = np.sort(far)[min(pool, len(far)) - 1]
            assert set(got) == set(np.flatnonzero(far <= radius))


def test_vectors_of_any_finite_size(spark):
    """Components far beyond the root of the largest double, beside tiny ones, against all pairs."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(16) * (1e-100 if i % 20 == 0 else 1e200)).tolist()) for i in range(2000)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(frame, pool=600).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x = np.array([v for _, v in rows])
    hits = []
    for q, found_ in got.items():
        score = np.where(np.arange(2000) == q, -np.inf, x @ x[q])
        best = np.lexsort((np.arange(2000), -score))[:20]
        hits.append(len(set(best.tolist()) & {i for i, _ in found_}) / 20)
        assert all(abs(s - score[i]) <= 1e-12 * abs(score[i]) for i, s in found_)
    assert len(got) == 100 and np.mean(hits) >= 0.9
    big = 2.0 ** 600
    huge = [(0, [big, big]), (1, [big, 0.0]), (2, [1 / big, 0.0]), (3, [big * big ** 0.5, 0.0]), (4, [big, -big])]
    got = ann.search(spark.createDataFrame(huge, "vec_id bigint, embedding array<double>")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 3, 2, 4] and [r.score for r in got] == [float("inf"), float("inf"), 1.0, 0.0]


def test_length_as_exponent_and_part():
    for v in ([3.0, 4.0], [1e-300, 2e-300], [1e300, -1e300, 5e299]):
        e, part = ann.square(np.array(v))
        exact = sum(Fraction(c) ** 2 for c in v)
        assert 0.5 <= part < 1 and abs(float(Fraction(part) * Fraction(2) ** e / exact) - 1) < 1e-14
