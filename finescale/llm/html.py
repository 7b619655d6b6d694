"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks, cut at block-level tags. A linear classifier over a block's surroundings (tag, class and
id words, share of link text, length, punctuation) gives the cost of calling it content or boilerplate. Those costs are
capacities from and to two terminals; edges between neighbouring blocks and between blocks of one container cost what it takes
to label the two differently. The minimum cut (by maximum flow) is the cheapest labelling; the source's side is content.

Names of boilerplate ("sidebar", "comments") count against all that an element holds, but not where the element is the page itself: a
name inside a longer word ("with-sidebar", "modal-open") is void on an element with more than half of the page's text, a whole word on one
with more than nine tenths, if the first article or main element (the first h1 where there is none) is not outside it.

Scripts, styles, comments, head, controls and the like never become blocks. A form has a strike against it, unless it wraps more
than half of the page's text; an article or main element inside it stands for itself. Character references are decoded, white space inside
a block becomes one space, blocks are joined by one space in page order. Null and empty pages have empty text; broken, unclosed
or cut-off markup is read as far as it goes. Repeated rows stay rows, null ids stay null, other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Names of HTML elements.
BLOCKS = frozenset("""address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer
form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th
thead tr ul""".split())
UNREAD = frozenset("""script style noscript template head title svg iframe object canvas audio video select textarea button
dialog annotation annotation-xml""".split())
KEEPS_ENDS = frozenset("template object title textarea iframe".split())          # no end tag inside closes an element around them
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
AUTO_CLOSE = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
              "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
              "option": frozenset(["option"])}
ENDS_P = BLOCKS - {"br", "body", "html", "option", "optgroup", "legend", "summary"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Weights of the classifier, in the unit of the cut: positive speaks for content. Surroundings count for all blocks below.
TAG_WEIGHT = {"article": 4.0, "main": 3.0, "nav": -8.0, "footer": -8.0, "aside": -8.0, "menu": -8.0}
FORM_WEIGHT = -8.0                                         # a form that is not the page itself
HEADER_WEIGHT = -6.0                                       # a header element outside an article
NAMES = re.compile(r"(?i)(?<![a-z])(?:(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|newsletter|subscri\w*|"
                   r"signup|popup|modal|notice|alert|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|foot|sidebar|"
                   r"side|aside|widget|related|recommend\w*|share|sharing|social|toolbar|pagination|pager|tags?|copyright|legal|"
                   r"disclaimer|comments?|disqus|repl(?:y|ies)|respond|hidden|login|search|form)|"
                   r"(article|content|main|post|entry|story|body|text|prose))(?![a-z])")
NAME_WEIGHT = (-8.0, 2.0)
WRAPS = (0.5, 0.9)                                         # shares of the text from which names are void: inside a word, whole words
ROLES = {"navigation": -8.0, "banner": -8.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "form": -8.0,
         "alert": -8.0, "dialog": -8.0, "alertdialog": -8.0, "main": 3.0, "article": 3.0}
BIAS, LINKED, LONG, STOPPED, HEADED = 0.4, -3.0, 1.2, 0.8, 0.3
NEAR, SAME_PARENT, LIMIT = 0.6, 0.9, 12.0                  # an inner block's edges add up to 3: more than an unnamed linked line costs

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|"
                  r"<[!?/a-zA-Z][^>]*(?:>|\Z)", re.S)               # the last: declarations, and tags with an open quote
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Named:
    """An element with a name of boilerplate, within another such one (a number, or -1); elements from ``first`` to ``last`` lie in it."""

    above: int
    whole: bool
    first: int
    last: int = 0
    held: int = 0


@dataclass
class Element:
    tag: str
    number: int
    weight: float
    in_article: bool
    unread: bool = False
    form: int = 0                                          # number of the form around it
    named: int = -1                                        # number of the innermost named element around it


@dataclass
class Block:
    parent: Element
    outer: int
    text: str = ""
    linked: int = 0
    weight: float = 0.0
    parts: list[str] = field(default_factory=list)


def _weight(tag: str, attributes: str, in_article: bool) -> tuple[float, bool, bool | None]:
    """Weight that an element lends to what it holds, whether it is hidden, and whether it has a name of boilerplate: a whole word
    (true), one inside a longer word (false) or none."""
    weight = TAG_WEIGHT.get(tag, HEADER_WEIGHT if tag == "header" and not in_article else 0.0)
    hidden, named = False, None
    if attributes.strip() and tag not in ("html", "body"):
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id") and tag != "form":
                spoken = [(x.lastindex, word) for word in value.split() for x in NAMES.finditer(word)]
                against = [NAMES.fullmatch(word) is not None for k, word in spoken if k == 1]
                if against:
                    named = any(against) or bool(named)
                elif spoken:
                    weight += NAME_WEIGHT[1]
            elif name == "role":
                weight += ROLES.get(value.lower(), 0.0)
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                hidden = True
            elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hidden = True
    return weight, hidden, named


def _weigh(found: list[Block], names: list[Named], mark: int) -> None:
    """Blocks' weights, with the names that are not void. ``mark``: number of the element that begins the article, or 0."""
    whole = 0
    for b in found:
        whole += len(b.text)
        if b.parent.named >= 0:
            names[b.parent.named].held += len(b.text)
    for n in reversed(names):                              # outer ones come first
        if n.above >= 0:
            names[n.above].held += n.held
    total: list[float] = []
    for n in names:
        void = n.held > WRAPS[n.whole] * whole and (not mark or n.first <= mark <= n.last)
        total.append((total[n.above] if n.above >= 0 else 0.0) + (0.0 if void else NAME_WEIGHT[0]))
    for b in found:
        b.weight = max(-LIMIT, min(LIMIT, b.parent.weight + (total[b.parent.named] if b.parent.named >= 0 else 0.0)))


def blocks(html: str) -> list[Block]:
    """Text blocks of a page in order."""
    stack = [Element("", 0, 0.0, False)]
    number, anchors, done, at = 0, 0, [], 0
    names: list[Named] = []
    marks: dict[bool, int] = {}                            # first article or main element (true), first h1 (false)
    now = Block(stack[0], 0)

    def flush() -> None:
        nonlocal now
        text = " ".join(unescape("".join(now.parts)).split())
        if text:
            now.text = text
            done.append(now)
        top = stack[-1]
        now = Block(top, stack[-2].number if len(stack) > 1 else 0)

    def pop(until: int) -> None:
        nonlocal anchors
        while len(stack) > until:
            gone = stack.pop()
            if gone.tag == "a":
                anchors -= 1
            if gone.named >= 0 and names[gone.named].first == gone.number:
                names[gone.named].last = number

    size = len(html)
    while at < size:
        open_ = html.find("<", at)
        m = _TAG.match(html, open_) if open_ >= 0 else None
        until = size if open_ < 0 else open_ if m else open_ + 1
        if until > at and not stack[-1].unread:
            part = html[at:until]
            now.parts.append(part)
            if anchors:
                now.linked += len(part.strip())
        if open_ < 0:
            break
        at = m.end() if m else until
        if not m or not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:                                           # an end tag closes what is open inside its element, too
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in BLOCKS:
                        flush()
                    pop(k)
                    if tag in BLOCKS:
                        now = Block(stack[-1], stack[-2].number if len(stack) > 1 else 0)
                    break
                if stack[k].unread and tag not in ("body", "html") and (tag not in BLOCKS | UNREAD or stack[k].tag in KEEPS_ENDS):
                    break
            continue
        if tag == "body" and stack[-1].unread:             # a head left open
            pop(1)
        if tag in ("script", "style"):
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            close = html.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else size
            continue
        if stack[-1].unread and tag not in UNREAD:
            if tag not in VOID:
                stack.append(Element(tag, number, stack[-1].weight, stack[-1].in_article, True))
            continue
        if tag in BLOCKS:
            flush()
            closes = AUTO_CLOSE.get(tag, frozenset()) | (frozenset(["p"]) if tag in ENDS_P else frozenset())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    pop(k)
                    break
                if stack[k].tag in BLOCKS and stack[k].tag not in ("p", "li", "dd", "dt", "td", "th", "tr"):
                    break
        number += 1
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in BLOCKS:
            if tag == "br":
                now = Block(stack[-1], stack[-2].number if len(stack) > 1 else 0)
            continue
        top = stack[-1]
        weight, hidden, named = _weight(tag, m[3], top.in_article)
        if named is not None:
            names.append(Named(top.named, named, number))
        if tag in ("article", "main", "h1") and not top.unread:
            marks.setdefault(tag != "h1", number)
        stack.append(Element(tag, number, max(-LIMIT, min(LIMIT, top.weight + weight)), top.in_article or tag == "article",
                             top.unread or hidden or tag in UNREAD or tag in ("label", "legend") and top.form > 0,
                             number if tag == "form" else 0 if tag in ("article", "main") else top.form,
                             top.named if named is None else len(names) - 1))
        if tag == "a":
            anchors += 1
        if tag in BLOCKS:
            now = Block(stack[-1], top.number)
    flush()
    pop(1)
    _weigh(done, names, marks.get(True, marks.get(False, 0)))
    return done


def cost(block: Block) -> float:
    """The classifier: above zero for content."""
    text = block.text
    share = min(1.0, block.linked / max(1, len(text)))
    score = BIAS + block.weight + LINKED * share
    score += LONG * min(1.0, len(text) / 200) * (1 - share)
    if text[-1] in ".!?:;\"')”…":
        score += STOPPED * (1 - share)
    if block.parent.tag in HEADINGS:
        score += HEADED
    return max(-LIMIT, min(LIMIT, score))


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut. ``gain``: capacity from the source (above zero) or to the sink
    (below); ``edges``: pairs and what it costs to part them. Blocking flows over layers, with real capacities."""
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(forth)
        out[b].append(len(to))
        to.append(a)
        left.append(back)

    for k, x in enumerate(gain):
        if x > 0:
            add(source, k, x, 0.0)
        elif x < 0:
            add(k, sink, -x, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if left[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if left[e] <= least)
                a = to[path[cut] ^ 1]
                del path[cut:]
            elif turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if left[e] > least and level[to[e]] == level[a] + 1:
                    path.append(e)
                    a = to[e]
                else:
                    turn[a] += 1
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                turn[a] += 1
            else:
                break


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in the page, and blocks in turn below one element or one grandparent element."""
    out = []
    for k in range(1, len(found)):
        a, b = found[k - 1], found[k]
        if a.outer == b.outer or a.parent.number == b.parent.number:
            out.append((k - 1, k, NEAR + SAME_PARENT))
        elif a.parent.in_article == b.parent.in_article and a.weight == b.weight:
            out.append((k - 1, k, NEAR))
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        before = last.get(b.outer)
        if before is not None and before != k - 1:
            out.append((before, k, SAME_PARENT))
        last[b.outer] = k
    return out


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    gain = [cost(b) for b in found]
    inside: dict[int, int] = {}
    for b in found:
        inside[b.parent.form] = inside.get(b.parent.form, 0) + len(b.text)
    forms = {f for f, n in inside.items() if f and 2 * n <= sum(inside.values())}
    gain = [max(-LIMIT, g + FORM_WEIGHT) if b.parent.form in forms else g for g, b in zip(gain, found)]
    # where an article or main element is marked, what stands outside it has a strike against it
    if any(b.weight >= TAG_WEIGHT["main"] and b.parent.in_article for b in found):
        gain = [g if b.parent.in_article else g - 4.0 for g, b in zip(gain, found)]
    keep = minimum_cut(gain, edges(found))
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every page."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                text = pa.array([main_text(x) for x in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), text], names=["page_id", "url", "text"])

    return (pages.selectExpr("cast(page_id as bigint) AS page_id", "cast(url as string) AS url", "html")
            .mapInArrow(task, "page_id bigint, url string, text string"))
