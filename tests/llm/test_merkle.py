"""Manifest against a plain recursive tree, and rows of every odd kind."""

import hashlib
import random
import zlib

import pytest

from finescale.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, pos int, n int, hash string, root string, path string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(level, at):
    """Root of a list of digests and the siblings of one of them, run by run."""
    proof = ""
    while len(level) > 1:
        a = at // 8 * 8
        run = level[a:a + 8]
        proof += "".join(run[:at - a] + run[at - a + 1:])
        level, at = [h(*level[k:k + 8]) for k in range(0, len(level), 8)], at // 8
    return level[0], proof


def fold(leaf, level, at):
    while len(level) > 1:
        a = at // 8 * 8
        run = level[a:a + 8]
        leaf = h(*run[:at - a], leaf, *run[at - a + 1:])
        level, at = [h(*level[k:k + 8]) for k in range(0, len(level), 8)], at // 8
    return leaf


def brute(rows):
    leaf_of = {k: h(*[field(v) for v in (r[0], r[3], r[2], r[4], r[1])]) for k, r in enumerate(rows)}
    trees = {}
    for k, r in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, leaf_of[x[0]])):
        trees.setdefault(r[2], []).append(k)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops = [climb([leaf_of[k] for k in trees[g]], 0)[0] for g in langs]
    root = climb(tops, 0)[0]
    out = []
    for at_top, g in enumerate(langs):
        level = [leaf_of[k] for k in trees[g]]
        for at, k in enumerate(trees[g]):
            doc_id, text, lang, source, n = rows[k][:5]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            changed = h(*[field(v) for v in (doc_id, source, lang, n, text)])
            proof = climb(level, at)[1] + climb(tops, at_top)[1]
            folded = fold(fold(changed, level, at), tops, at_top)
            out.append((doc_id, leaf_of[k], tops[at_top], root, h(proof), folded, folded == root))
    return sorted(out, key=repr)


def odd_rows(seed):
    random.seed(seed)
    rows = [(i, f"Text {i} ÀÉ {'x' * random.randint(0, 30)}", random.choice(["en", "de", "fr"]), "s", i) for i in range(90)]
    rows += [(i, f"Long tree {i}", "zz", None, None) for i in range(600)]
    rows += [(None, "No id", "en", "s", 1), (None, None, None, None, None), (None, "No id", "en", "s", 1), (7, "again", "en", "s", 2), (7, "Again", "en", "s", 2),
             (8, "", "", "", 0), (9, "Very long A " * 20000, "é", "s", 3), (10, "ABC", "one", "s", 4), (12, "ABC", "é", "s", 4)]
    random.shuffle(rows)
    return rows


def test_equals_a_plain_tree(spark, monkeypatch):
    rows = odd_rows(1)
    df = spark.createDataFrame([(*r, "t", 1, 2, "h", "r", "p") for r in rows], SCHEMA)
    got = merkle.manifest(df, merkle.without_capitals())
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("rows", [[], [(1, "A", "en", "s", 1)], [(i, "A", None, "s", 1) for i in range(9)], [(1, "A", f"l{i:03}", "s", 1) for i in range(70)]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, 2, "h", "r", "p") for r in rows], SCHEMA)
    assert sorted(map(tuple, merkle.manifest(df, merkle.without_capitals()).collect()), key=repr) == (brute(rows) if rows else [])


def test_sizes_around_a_block(spark):
    for n in (8, 64, 511, 512, 513, 4097):
        rows = [(i, "T", "en", "s", 1) for i in range(n)]
        df = spark.createDataFrame([(*r, "t", 1, 2, "h", "r", "p") for r in rows], SCHEMA)
        got = {r.doc_id: tuple(r) for r in merkle.manifest(df).collect()}
        level = [h(*[field(v) for v in (i, "s", "en", 1, "T")]) for i in range(n)]
        for at in {0, 7, n // 2, n - 1}:
            root, proof = climb(level, at)
            assert got[at] == (at, level[at], root, root, h(proof), root, True), n
        assert len(got) == n


def test_a_change_anywhere_is_seen(spark):
    rows = [(i, f"text {i}", "en", "s", 1) for i in range(40)]
    frame = lambda r: spark.createDataFrame([(*x, "t", 1, 2, "h", "r", "p") for x in r], SCHEMA)
    before = merkle.manifest(frame(rows)).first().root
    rows[17] = (17, "text 17 ", "en", "s", 1)
    assert merkle.manifest(frame(rows)).first().root != before
