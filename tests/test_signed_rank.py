"""The exact signed-rank test against every assignment of signs."""

import itertools
import random

import pytest

from finescale.operators import skill as S


def brute(d):
    order = sorted(abs(x) for x in d)
    ranks = [order.index(abs(x)) + 1 for x in d]
    plus = sum(r for r, x in zip(ranks, d) if x > 0)
    n = len(d)
    low = min(plus, n * (n + 1) // 2 - plus)
    ways = sum(sum(r for r, s in zip(range(1, n + 1), signs) if s) <= low for signs in itertools.product((0, 1), repeat=n))
    return plus, min(1.0, 2 * ways / 2 ** n)


def frame(spark, d):
    return spark.createDataFrame([(k, x, 0.0) for k, x in enumerate(d)], "station INT, a DOUBLE, b DOUBLE")


@pytest.mark.parametrize("n", [1, 2, 5, 13])
def test_small_networks_are_exact(spark, n):
    random.seed(n)
    d = [float(x) * random.choice((-1, 1, 1)) for x in random.sample(range(1, 1000), n)]
    r = S.wilcoxon_paired(frame(spark, [*d, 0.0, None]), "a", "b").first()
    plus, p = brute(d)
    assert (r.n, r.w_plus) == (n, plus) and r.p_value == pytest.approx(p, abs=1e-12)


def test_ties_and_many_pairs_take_the_normal_form(spark):
    tied = [1.0, -1.0, 2.0, 3.0, 4.0, 5.0]
    assert S.wilcoxon_paired(frame(spark, tied), "a", "b").first() == S.wilcoxon_paired(frame(spark, tied), "a", "b", exact_upto=0).first()
    many = [float(k) * (1 if k % 3 else -1) for k in range(1, 52)]
    exact, normal = (S.wilcoxon_paired(frame(spark, many[:k]), "a", "b").first() for k in (50, 51))
    assert exact.p_value != S.wilcoxon_paired(frame(spark, many[:50]), "a", "b", exact_upto=0).first().p_value
    assert exact.p_value == pytest.approx(S.wilcoxon_paired(frame(spark, many[:50]), "a", "b", exact_upto=0).first().p_value, rel=0.05)
    assert normal.p_value == S.wilcoxon_paired(frame(spark, many), "a", "b", exact_upto=0).first().p_value


def test_no_pair(spark):
    r = S.wilcoxon_paired(frame(spark, [0.0, None]), "a", "b").first()
    assert r.p_value is None
