import itertools
import random

from finescale.llm import html
from finescale.llm.html import main_text, minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body class="sidebar-left">
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this page, please accept them.</div>
<article><h1>The   title</h1><p>First &amp; foremost, a sentence&nbsp;of some length.<p>Second <b>bold</b> one.<!-- <p>not this</p> -->
<aside>See also: other things.</aside><div class="ad">Buy now, it is cheap.</div><form><p>Your name</p><input></form>
<ul><li>Short</li><li>List</li></ul><div class="comments"><p>I do not agree with this article at all.</p></div></article>
<div id="sidebar"><p>Popular stories of this week.</p></div><footer>&copy; 2020 somebody.</footer></body></html>"""


def test_page():
    assert main_text(PAGE) == "The title First & foremost, a sentence of some length. Second bold one. Short List"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p>") == ""
    assert main_text("plain text, x < y &lt;b&gt;") == "plain text, x < y <b>"
    assert main_text("<p>cut off in a tag <a href='x") == "cut off in a tag"
    assert main_text("<p>cut off in a script<script>var x = 1;") == "cut off in a script"
    assert main_text("<p>cut off in a comment<!-- x") == "cut off in a comment"
    assert main_text("<article>" + "<div>" * 3000 + "Deep text stands here." + "</div>" * 3000) == "Deep text stands here."
    long = "A sentence of words. " * 50_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_open_elements_do_not_swallow_the_rest():
    for tag in ("form", "select", "button", "noscript", "canvas"):
        assert main_text(f"<div><{tag}><input></div><article><p>A whole sentence stands here.</p></article>") == "A whole sentence stands here."
    assert main_text("<article><p>One.</p><template><p>Two.</div></template><p>Three.</p></article>") == "One. Three."


def test_page_inside_a_form():
    article = "<article><h1>Title</h1><p>A sentence of the article, which goes on.</p></article>"
    assert main_text(f"<body><form id='form1'><nav>Home</nav>{article}<label>Name</label><input></form></body>") == \
        "Title A sentence of the article, which goes on."
    assert main_text("<body><form><div><p>" + "A sentence of words. " * 20 + "</p></div></form></body>") == ("A sentence of words. " * 20).strip()


def test_formula():
    page = "<article><p>Here <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x = 2</annotation></semantics></math> holds.</p></article>"
    assert main_text(page) == "Here x=2 holds."


def test_minimum_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]
        price = lambda keep: (sum(g for g, k in zip(gain, keep) if g > 0 and not k) - sum(g for g, k in zip(gain, keep) if g < 0 and k)  # noqa: E731,B023
                              + sum(w for a, b, w in edges if keep[a] != keep[b]))                       # noqa: B023
        least = min(map(price, itertools.product([False, True], repeat=n)))
        assert abs(price(minimum_cut(gain, edges)) - least) < 1e-6


def test_rows(spark):
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t"), (2, "v", "", None)]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, len(r.text)) for r in got.collect()) == [(0, 0), (1, 82), (1, 82), (2, 0)]
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


STORY = "<h1>The title</h1><p>A sentence of the article, which goes on for a while, and on.</p><p>Another one follows it, and ends here.</p>"
TOLD = "The title A sentence of the article, which goes on for a while, and on. Another one follows it, and ends here."
AROUND = '<div class="menu"><a href="/">Home</a></div>{}<div class="sidebar"><p>Popular stories.</p></div><div id="footer">Somebody, 2020.</div>'


def test_names_on_the_page_itself():
    """Boilerplate words on an element that holds the page do not empty it, and still count inside it."""
    for name in ("with-sidebar", "modal-open", "comments-open", "post tag-news", "page-header-fixed content", "has-sidebar"):
        for inner in (STORY, f"<article>{STORY}</article>", f"<div>{STORY}</div>"):
            assert main_text(f'<body><div class="{name}">' + AROUND.format(inner) + "</div></body>") == TOLD, (name, inner)
    assert main_text(f'<body><div id="modal">{STORY}</div></body>') == TOLD
    assert main_text(f'<article class="post tag-news">{STORY}</article>') == TOLD


def test_long_comments_stay_out():
    comments = "<p>I do not agree with any of this, and here is why, at length.</p>" * 8
    for name in ("comments", "comment-list", "site-comments"):
        assert main_text(f'<body><article>{STORY}</article><div class="{name}">{comments}</div></body>') == TOLD
        assert main_text(f'<body><div>{STORY}</div><div class="{name}">{comments}</div></body>') == TOLD


def test_cut_decides_doubtful_blocks():
    """A line that is all link goes alone, and stays between two sentences of one container; classifier costs say no both times."""
    line = '<p><a href="/x">the whole report in full</a></p>'
    said = "<p>" + "A plain sentence of some words, and more. " * 6 + "</p>"
    page = f"<div>{said}{line}{said}</div><ul><li><a href='/1'>One</a></li><li><a href='/2'>Two</a></li><li><a href='/3'>Three</a></li></ul>"
    found = html.blocks(page)
    assert [html.cost(b) > 0 for b in found] == [True, False, True, False, False, False]
    assert minimum_cut([html.cost(b) for b in found], html.edges(found)) == [True, True, True, False, False, False]
    assert main_text(f"<div>{line}</div>") == ""
