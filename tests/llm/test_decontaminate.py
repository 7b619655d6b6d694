import random

from finescale.llm import decontaminate
from tests.llm.common import documents


def items(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id bigint, text string, place int, gram string")


def plain_score(item, body):
    """Smith-Waterman by the book."""
    best, above = 0, [0] * (len(body) + 1)
    for x in item:
        here = [0]
        for j, y in enumerate(body):
            here.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, here[j] - 1))
        above = here
        best = max(best, *here)
    return best / (2 * len(item))


def test_alignment_by_the_book():
    rng = random.Random(2)
    pairs = [([rng.choice("abcdef") for _ in range(rng.randint(1, 30))], [rng.choice("abcdef") for _ in range(rng.randint(1, 60))]) for _ in range(150)]
    got = decontaminate.aligned(pairs, 0.0)
    for (item, body), (score, first, last) in zip(pairs, got):
        assert abs(score - plain_score(item, body)) < 1e-6
        assert score == 0 or abs(plain_score(item, body[first:last]) - score) < 1e-6


def test_finds_copies_and_leaves_others(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 300)}"
    tests = [(i, [word() for _ in range(rng.randint(20, 60))]) for i in range(12)]
    rows, want = [], set()
    for d in range(120):
        body = [word() for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            i, copy = tests[d % 12]
            copy = list(copy)
            for at in rng.sample(range(len(copy)), len(copy) // 10):
                copy[at] = "other"
            at = rng.randint(0, len(body))
            body[at:at] = copy
            want.add((d, i))
        rows.append((d, " ".join(body).capitalize() + "."))
    i, copy = tests[1]
    rows += [(500, " ".join(copy)), (500, " ".join(copy)), (None, " ".join(copy)), (501, None), (502, ""), (503, "filler " * 40_000 + " ".join(copy)),
             *((600 + k, " ".join(copy)) for k in range(300))]
    want |= {(d, i) for d in (500, None, 503, *range(600, 900))}
    asked = items(spark, [(i, " ".join(t)) for i, t in tests] + [(90, None), (91, ""), (92, "tiny item"), (1, " ".join(tests[1][1]))])
    got = decontaminate.contaminated(documents(spark, rows + [(504, "Tiny, item!"), (505, "a tiny item here")]).repartition(3), asked).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(504, 92)} and len(got) == len(want) + 1
    at = next(r for r in got if r.doc_id == 503)
    assert at.score == 1 and (at.first_word, at.last_word) == (40_000, 40_000 + len(copy))


def test_against_all_pairs(spark):
    rng = random.Random(8)
    tests = [(i, [f"w{rng.randint(0, 40)}" for _ in range(15)]) for i in range(6)]
    rows = []
    for d in range(60):
        copy = list(tests[d % 6][1])
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 40)}"
        rows.append((d, " ".join([f"w{rng.randint(0, 40)}" for _ in range(10)] + copy + ["end"])))
    want = {(d, i): plain_score(t, text.split()) for d, text in rows for i, t in tests if plain_score(t, text.split()) >= decontaminate.THRESHOLD}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(documents(spark, rows), items(spark, [(i, " ".join(t)) for i, t in tests])).collect()}
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)
    strong = {k for k, s in want.items() if s >= 0.75}
    assert strong <= set(got)


def test_one_edited_copy_of_each_item(spark):
    """Copies without seven words in a row, in one document each, beside a whole copy or without one."""
    tests, rows = [], []
    for i, (n, changed) in enumerate([(15, (5, 10)), (42, range(5, 42, 6)), (42, range(6, 42, 7)), (40, range(3, 40, 4)), (15, (5, 10))]):
        words = [f"t{i}w{k}" for k in range(n)]
        tests.append((i, words))
        rows.append((i, " ".join(["before"] * 9 + ["other" if k in changed else w for k, w in enumerate(words)] + ["after"] * 9)))
    rows.append((9, " ".join(tests[4][1])))
    want = {(d, i): plain_score(t, text.split()) for d, text in rows for i, t in tests if plain_score(t, text.split()) >= decontaminate.THRESHOLD}
    assert len(want) == 6
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(documents(spark, rows), items(spark, [(i, " ".join(t)) for i, t in tests])).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_a_seed_without_a_copy(spark):
    asked = items(spark, [(1, " ".join(f"t{k}" for k in range(20)))])
    assert decontaminate.contaminated(documents(spark, [(1, "x t4 t5 t6 y")]), asked).collect() == []


def test_empty_tables(spark):
    one = documents(spark, [(1, "a b c d e")])
    assert decontaminate.contaminated(one, items(spark, [])).collect() == []
    assert decontaminate.contaminated(documents(spark, []), items(spark, [(1, "a b c d e")])).collect() == []
