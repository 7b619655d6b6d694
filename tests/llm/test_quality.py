import math
import random
import re

import numpy as np
import pytest

from finescale.llm import quality
from finescale.llm.shared import fold
from tests.llm.common import HAVE, SF, documents

GOOD, BAD = "the river of the old town runs quietly by ", "BUY!! NOW$$$ | 99% | OFF!! "


def labels(spark, rows):
    return spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id bigint, quality int, score double, text string")


def corpus(n=120):
    rng = random.Random(1)
    rows = [(i, "".join((BAD if i % 4 == 0 else GOOD) for _ in range(rng.randint(1, 9)))) for i in range(n)]
    return rows, [(i, int(i % 4 != 0)) for i in range(n)]


def test_learns_and_keeps_rows(spark):
    rows, marks = corpus()
    docs = documents(spark, rows + [(None, GOOD), (3, GOOD), (3, GOOD), (900, None), (901, ""), (902, GOOD * 20_000)])
    model = quality.fit(docs, labels(spark, [*marks, (5, None), (6, 9), (None, 1), (7777, 0)]))
    got = quality.score(docs, model, "own").collect()
    assert len(got) == len(rows) + 6 and docs.columns + ["own"] == got[0].__fields__
    of = {r.doc_id: r.own for r in got if r.doc_id is not None}
    assert all((of[i] >= 0.7) == (q == 1) for i, q in marks)
    assert of[900] == of[901] and 0 <= of[900] <= 1 and of[902] >= 0.7
    assert {r.own for r in got if r.text == GOOD} == {next(r.own for r in got if r.doc_id is None)}


def test_learns_from_other_folds_only(spark):
    rows, marks = corpus()
    docs = documents(spark, rows)
    held = {r[0] for r in docs.select("doc_id", fold().alias("f")).collect() if r.f == 2}
    turned = [(i, 1 - q if i in held else q) for i, q in marks]
    a, b = quality.fit(docs, labels(spark, marks)), quality.fit(docs, labels(spark, turned))
    assert held and np.array_equal(a.weights, b.weights) and (a.slope, a.base, a.offset) == (b.slope, b.base, b.offset)


def test_without_labels(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    for marks, want in (([], 0.5), ([(1, 1)], 1.0)):
        assert all(abs(r.score - want) < 1e-5 for r in quality.score(docs.select("doc_id", "text"), quality.fit(docs, labels(spark, marks))).collect())
    assert quality.score(documents(spark, []), quality.fit(docs, labels(spark, [])), "own").collect() == []


def test_counts_against_plain_python(spark):
    rows, marks = corpus(40)
    got = {r.bucket: (r.zeros, r.ones) for r in quality.count_buckets(documents(spark, rows, False).join(labels(spark, marks).drop("text"), "doc_id"), 12).collect()}
    want = {}

    def code(gram, kind):
        h = kind * 0x9E3779B1 & 0xFFFFFFFF
        for b in gram:
            h = (h * 0x01000193 + b) & 0xFFFFFFFF
        h ^= h >> 15
        return (h * 0x85EBCA6B & 0xFFFFFFFF) >> 20

    def grams(x, n, kind):
        return {code(x[i:i + n], kind) for i in range(len(x) - n + 1)}

    for (_, text), (_, q) in zip(rows, marks):
        data = text.encode()
        shape = bytes(65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b > 127 else 48 if 48 <= b < 58 else b for b in data)
        spoken = re.findall("[a-z0-9]+", text.lower())
        again = [int(x == y) for x, y in zip(spoken, spoken[1:])]
        for b in grams(data, 2, 2) | grams(data, 4, 4) | grams(shape, 5, 21) | grams(again, 3, 35) | {-1}:
            x = want.setdefault(b, [0, 0])
            x[q] += 1
    assert got == {k: tuple(v) for k, v in want.items()}


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 3))
    y = np.where(x @ [1, -2, 0.5] + 0.3 * rng.standard_normal(40) > 0, 1.0, -1.0)
    w, b = quality.descend([np.arange(3)] * 40, list(x), y, 3, 1.0, 2000, 1)
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v[:3] + v[3])).sum()
    best = loss(np.append(w, b))
    assert all(best <= loss(np.append(w, b) + 0.05 * rng.standard_normal(4)) + 1e-3 for _ in range(300))


@pytest.mark.skipif(not HAVE, reason="driver tables absent")
def test_held_out_accuracy(spark):
    from finescale.llm.queries import op3_quality
    sf = SF.replace("sf0.001", "sf0.1")
    got = op3_quality(spark, sf)
    tried = got.filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = [r.predicted == r.quality for r in tried]
    assert len(right) > 500 and sum(right) / len(right) > 0.99
    assert all(math.isfinite(r.score) and 0 <= r.score <= 1 for r in tried)
