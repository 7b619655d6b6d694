import numpy as np
import pytest

from finescale.operators.quantiles import exact_quantiles


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_equals_numpy_with_ties_skew_and_small_groups(spark, accuracy):
    rng = np.random.default_rng(3)
    data = ([("hot", float(v)) for v in rng.normal(size=6000)] + [("ties", float(v)) for v in rng.integers(0, 4, 3000)]
            + [("one", 5.0)] + [("two", 1.0), ("two", 3.0)] + [("nul", None)])
    qs = [0.0, 0.005, 0.1, 0.5, 0.84, 0.995, 1.0]
    df = spark.createDataFrame(data, "g STRING, v DOUBLE").repartition(7)
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, "v", qs, ["g"], accuracy).collect()}
    for g in ("hot", "ties", "one", "two"):
        vals = [v for k, v in data if k == g]
        for q in qs:
            assert got[(g, q)] == pytest.approx(np.quantile(vals, q), abs=1e-12)
    assert not any(k[0] == "nul" for k in got)


def test_global(spark):
    df = spark.range(101).selectExpr("CAST(id AS DOUBLE) AS v")
    assert [r["value"] for r in exact_quantiles(df, "v", [0.16, 0.5]).orderBy("q").collect()] == [16.0, 50.0]


def test_one_large_group_with_heavy_ties(spark):
    # 2 million rows: a third of them one value, a third whole numbers, a third spread over many magnitudes
    df = spark.range(2_000_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7.0D WHEN id % 3 = 1 THEN CAST(id % 1000 AS DOUBLE) "
                                           "ELSE pow(10D, (id % 200003) / 20000D - 5) END AS v")
    qs = [0.001, 0.16, 0.4, 0.5, 0.84, 0.9999]
    i = np.arange(2_000_000)
    v = np.where(i % 3 == 0, 7.0, np.where(i % 3 == 1, i % 1000, 10.0 ** ((i % 200003) / 20000 - 5)))
    got = {r["q"]: r["value"] for r in exact_quantiles(df, "v", qs).collect()}
    for q in qs:
        assert got[q] == pytest.approx(np.quantile(v, q), rel=1e-12)
