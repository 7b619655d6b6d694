"""Near words against all pairs, counts against a plain loop, and odd rows."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from finescale.llm import spelling
from tests.llm.common import documents


def near(a, b):
    """One code point inserted, deleted or replaced, tried place by place."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1:] == b for k in range(len(a)))


def brute(counts, ratio=2):
    rows = {}
    for w, n in counts.items():
        close = [x for x in counts if near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        rows[w] = (w, form, n, len(close), counts[form] if form is not None else None)
    out = []
    for w, form, n, k, m in rows.values():
        root = w
        while rows[root][1] is not None:
            root = rows[root][1]
        out.append((w, form, root, n, k, m))
    return sorted(out)


def words_of(pairs):
    out = []
    for i, x in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", x or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out.append(run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run)
    return Counter(w for w in out if len(w) >= 5)


def table(spark, counts):
    return spark.createDataFrame([(w, n, 1, 2, "p") for w, n in counts.items()], "word string, n bigint, m int, block int, part string")


def test_all_pairs_in_blocks_of_any_size(spark):
    random.seed(3)
    counts = {"".join(random.choice("abé") for _ in range(random.randint(1, 9))): random.randint(1, 200) for _ in range(700)}
    counts |= {"𝒳" + "b" * k: k + 1 for k in range(6)} | {"": 4}
    want = brute(counts)
    assert sum(r[1] is not None for r in want) > 100 and any(r[2] not in (r[0], r[1]) for r in want)
    for block in (7, 512):
        assert sorted(map(tuple, spelling.variants(table(spark, counts), block=block).collect())) == want


def test_many_words_with_one_beginning(spark):
    """A beginning shared by more words than a block holds: its blocks meet pair by pair."""
    counts = {"common" + a + b + c: 3 + ord(a) * ord(b) % 50 for a in "abcdefghij" for b in "klmnopqr" for c in "stu"}
    assert sorted(map(tuple, spelling.variants(table(spark, counts), block=16).collect())) == brute(counts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab\0é", min_size=1, max_size=6), unique=True, max_size=12))
def test_tile_finds_each_pair_once(words):
    found = Counter()
    for m in {len(w) + k for w in words for k in (0, 1)}:
        own = [w for w in words if len(w) in (m, m - 1)]
        for by_suffix in (False, True):
            i, j = spelling.tile(own, own, m, by_suffix)
            found.update((own[a], own[b]) for a, b in zip(i, j) if a < b)
    want = {frozenset((a, b)) for a in words for b in words if near(a, b)}
    assert {frozenset(p) for p in found} == want and sum(found.values()) == len(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.text("aBzÀÿ× é1Ā漢\n", max_size=90)), max_size=8))
def test_words_of_texts(pairs):
    got = spelling.contract_words([str(i) for i, _ in pairs], pa.array([x for _, x in pairs], pa.large_string())).to_pylist()
    assert Counter(w for w in got if len(w) >= 5) == words_of(pairs)


def test_documents_of_every_kind(spark):
    random.seed(5)
    rows = [(i, " ".join(random.choice(["Garden", "gardén", "river!", "RIVERS", "straße", "tiny"]) for _ in range(60))) for i in range(60)]
    rows += [(None, "Garden garden"), (3, "garden rivers"), (3, "garden rivers"), (70, None), (71, ""), (72, "garden " * 30000), (73, "x" * 5000), (74, "漢字" * 40)]
    counts = {w: n for w, n in words_of(rows).items() if n >= 3}
    found = spelling.variants(spelling.vocabulary(documents(spark, rows)))
    assert sorted(map(tuple, found.collect())) == brute(counts) and len(counts) > 5
    assert dict(found.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


def test_empty_null_and_repeated_words(spark):
    assert spelling.variants(spelling.vocabulary(documents(spark, []))).collect() == []
    words = spark.createDataFrame([(None, 5), ("harbour", 2), ("harbour", 3), ("harbor", 10)], "word string, n bigint")
    assert sorted(map(tuple, spelling.variants(words).collect())) == [("harbor", None, "harbor", 10, 1, None), ("harbour", "harbor", "harbor", 5, 1, 10)]
