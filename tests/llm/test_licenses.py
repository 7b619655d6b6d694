import contextlib
import io
import re

from finescale.llm import licenses
from finescale.llm.licenses import TEMPLATES, anchors, bigrams_of
from tests.llm.common import documents

MIT = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 100)
ROWS = [(1, "prose\nLicensed under the APACHE License -- Version 2.0!\nmore"), (2, None), (3, ""), (4, "Released under the MIT License."),
        (4, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0."), (5, MIT.replace(" to ", "\nto ")),
        (6, "word " * 50_000 + "\nThis work is licensed under the GNU General Public License, version 3."),
        (7, "license license license"), (8, "A license to publish software without conditions."), (9, "Released under the MIT License, mostly.")]


def test_against_plain_dice(spark):
    got = {(r.doc_id, r.unit, r.position, r.license, r.dice) for r in licenses.scan(documents(spark, ROWS)).collect()}
    want = set()
    for doc, text in ROWS:
        units = [("line", i, x) for i, x in enumerate((text or "").split("\n"))]
        units += [("paragraph", i, x) for i, x in enumerate(re.split(r"\n[ \t\r]*\n", text or "")) if "\n" in x]
        for kind, i, body in units:
            a = set(bigrams_of(body))
            scored = [(-round(2 * len(a & set(b)) / (len(a) + len(b)), 6), n) for n, b in ((n, bigrams_of(t)) for n, t in TEMPLATES)] if a else []
            if scored and -min(scored)[0] >= 0.8:
                want.add((doc, kind, i, min(scored)[1], -min(scored)[0]))
    assert got == want and len(got) >= 6


def test_anchors_lose_nothing():
    chosen = set(anchors(TEMPLATES, 0.8))
    for _, t in TEMPLATES:
        grams = bigrams_of(t)
        free = sum(not set(g.split()) & chosen for g in grams)
        assert free < 0.8 / 1.2 * len(grams)


def test_native_and_empty(spark):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        licenses.scan(documents(spark, ROWS)).explain()
    assert not re.search("Python|Pandas|Arrow|Exchange", out.getvalue())
    assert licenses.scan(documents(spark, [])).collect() == []
    assert [r.doc_id for r in licenses.scan(documents(spark, ROWS)).collect()].count(4) == 2
