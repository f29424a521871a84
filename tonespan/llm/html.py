"""Main text of web pages by minimum cut.

A page becomes its text blocks and the elements that hold them. A logistic classifier of
each block's words, links, punctuation and tag, fitted on a bounded sample of blocks whose
place in the page tells their class, gives a log-odds cost, which becomes the capacity of
the block's edge to the content terminal or to the boilerplate terminal. Elements that say
what they hold (article, nav, class names, of which the fit weighs the last) have such an
edge too, for every block inside. An element and what it holds, and neighbours in one
element, are joined by smoothness edges, scaled to the fitted costs. The minimum cut, equal
to the maximum flow between the terminals, is the labelling of least total cost; as the
edges form a tree with chains of siblings, it is found exactly from the leaves up, in time
linear in the page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonespan.llm import _words

#: Pages of which about so many are read to fit the classifier, and blocks that are used.
FIT_PAGES, FIT_BLOCKS = 2_000, 20_000
#: Blocks that the first weights below are worth in the fit.
PRIOR_BLOCKS = 200

#: What the classifier sees of a block, and the weights it starts from (log-odds; positive
#: speaks for content). The last two tell whether an element around it has such a name.
FEATURES = ("bias", "words", "links", "sentence", "heading", "mark", "bad_name", "good_name")
PRIOR = np.array([-0.6, 0.7, -3.0, 0.8, 0.8, -2.0, -9.0, 1.0])
#: Words of a block that count, and how many of them are a unit of the feature.
MOST_WORDS, WORD_UNIT = 40, 10


class Weights(NamedTuple):
    text: np.ndarray  # of the features of a block itself
    limit: float  # of a block's own cost
    bad_name: float  # evidence of elements, for each block inside
    good_name: float
    content: float
    boilerplate: float
    leaf: float  # smoothness of a block and the element that holds it
    told: float  # the same where an element around says what it holds
    element: float  # of an element and the one that holds it, for each block that they part
    inside: float  # besides, for each block inside, if an element around says what it is
    adjacent: float  # of neighbours in an element


def weights_of(fitted: np.ndarray, spread: float, smooth: float = 1.0) -> Weights:
    """Costs from the fitted weights and the median size of a block's log-odds; names weigh
    what the fit gives them. Whatever the spread, one block inside an element that says what
    it is can be parted from the rest. ``smooth`` scales the edges between elements."""
    limit = 2.0 * spread
    least = 4.5 * limit
    return Weights(fitted[:-2], limit, min(float(fitted[-2]), 0.0), max(0.0, min(float(fitted[-1]), limit)), least, -least, 1.25 * limit * smooth, 1.25 * limit, 0.5 * limit * smooth, 0.75 * limit, 0.25 * limit * smooth)


# Element and class names of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img math mi mo mn mrow ms mspace mstyle msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mtext semantics annotation".split())
CONTENT = frozenset("article main".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog button select fieldset".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "sidebar sidenav aside nav navbar navigation topnav subnav menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar "
    "comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget hidden".split()
)
#: Words beside a bad one that only say how it is laid out.
LAYOUT = frozenset("list item items box block blocks wrapper wrap container section area bar buttons button links link icons posts articles stories form panel left right top bottom inner outer slot unit row column col main primary secondary site page global header head title content body footer small large mobile desktop sticky fixed".split())
GOOD_NAMES = frozenset("article content post entry story main body text".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

_NAME_OF_TAG = re.compile(r"[a-zA-Z][^\s/>]*+")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_NAME = re.compile("[a-z0-9]+")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARK = re.compile("[©®|·•»›→]")
#: Elements that hold one block and say nothing of it by themselves.
PLAIN = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 html body tr td th tbody thead tfoot".split())
BAD, GOOD, SAID_CONTENT, SAID_BOILERPLATE = 1, 2, 4, 8


class Page(NamedTuple):
    """Nodes in order of the page, elements before what they hold; node 0 is the page."""

    parent: list[int]
    says: list[int]  # what an element says of itself (BAD, GOOD, SAID_...)
    block: list[int]  # number of the block that the node is, or -1
    texts: list[str]
    features: list[tuple[float, ...]]
    around: list[int]  # what the elements around each block say


def _says(tag: str, attributes: str, in_article: bool) -> int:
    said = 0
    if tag in CONTENT:
        said = SAID_CONTENT
    elif tag in BOILERPLATE or (tag == "header" and not in_article):
        said = SAID_BOILERPLATE
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "role":
            said |= SAID_BOILERPLATE if value in BAD_ROLES else SAID_CONTENT if value in CONTENT else 0
        elif key == "style":
            said |= SAID_BOILERPLATE if _HIDDEN_STYLE.search(value) else 0
        elif key == "hidden" or (key == "aria-hidden" and value == "true"):
            said |= SAID_BOILERPLATE
        elif key in ("class", "id") and tag not in ("html", "body"):
            said |= _named(value)
    # names that speak for and against it decide nothing
    return said & ~(BAD | GOOD) if said & BAD and said & GOOD else said


def _named(value: str) -> int:
    """What class names or an id say: bad are names whose last word is (``site-nav``) or of
    which all other words are layout (``comment-list``, not ``comment-analysis``)."""
    said = 0
    for name in value.split():
        words = _NAME.findall(name)
        bad = [x in BAD_NAMES for x in words]
        if any(bad) and (bad[-1] or all(b or x in LAYOUT or x.isdigit() for b, x in zip(bad, words, strict=True))):
            said |= BAD
        elif not any(bad) and GOOD_NAMES.intersection(words):
            said |= GOOD
    return said


class _Open(NamedTuple):
    tag: str
    node: int
    around: int
    in_article: bool
    in_link: bool
    in_heading: bool


def parse(page: str) -> Page:
    out = Page([-1], [0], [-1], [], [], [])
    stack = [_Open("", 0, 0, False, False, False)]
    parts: list[str] = []
    linked = 0
    heading = False
    open_tags: dict[str, int] = {}  # how many of each are open, so that stray ends cost nothing
    at, end, last = 0, len(page), page.rfind(">")
    headed = False

    def flush() -> None:
        nonlocal parts, linked, heading
        if parts:
            words = "".join(parts).split()
            if words:
                text = " ".join(words)
                out.parent.append(stack[-1].node)
                out.says.append(0)
                out.block.append(len(out.texts))
                out.texts.append(text)
                out.around.append(stack[-1].around)
                out.features.append((1.0, min(len(words), MOST_WORDS) / WORD_UNIT, min(1.0, linked / len(text)), float(text[-1] in ".!?:;…\"”"), float(heading), float(bool(_MARK.search(text)))))
            parts = []
        linked, heading = 0, False

    def add(text: str) -> None:
        nonlocal linked, heading
        if "&" in text:
            text = unescape(text)
        parts.append(text)
        top = stack[-1]
        if top.in_link:
            linked += len(text)
        heading = heading or top.in_heading

    def close(k: int) -> None:
        if any(e.tag not in INLINE for e in stack[k:]):
            flush()
        for e in stack[k:]:
            open_tags[e.tag] -= 1
        del stack[k:]

    def close_items(tag: str) -> None:
        """End the open item that a new one ends without a tag of its own."""
        for k in range(len(stack) - 1, 0, -1):
            have = stack[k].tag
            if have == tag or (tag in ("dt", "dd") and have in ("dt", "dd")) or (tag in ("td", "th") and have in ("td", "th")):
                close(k)
                break
            if have in ITEMS[tag]:
                break

    while at < end:
        start = page.find("<", at)
        if start < 0 or (start > last and not page.startswith("<!--", start)):
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        ending = page.startswith("/", start + 1)
        named = _NAME_OF_TAG.match(page, start + 1 + ending)
        if named is None:
            if page[start + 1 : start + 2] in ("!", "?", "/"):
                stop = page.find(">", start)
                at = stop + 1 if stop >= 0 else end
            else:
                add("<")
                at = start + 1
            continue
        tag = named[0].lower()
        stop = _ATTRIBUTES.match(page, named.end()).end()
        if stop >= end or page[stop] != ">":  # a quote that nothing ends
            stop = page.find(">", named.end())
        if stop < 0:
            add(page[start:])
            break
        attributes, at = page[named.end() : stop], stop + 1
        if ending:
            if open_tags.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if tag in INLINE and stack[k].tag not in INLINE:
                        break
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = found.end() if found else end
            if tag not in INLINE:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in ITEMS:
            close_items(tag)
        if tag == "head":
            if headed:  # a page has one
                continue
            headed = True
            flush()
            found = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(page, at)
            at = found.start() if found else at
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        above = stack[-1]
        node, around = above.node, above.around
        if tag not in INLINE:
            said = _says(tag, attributes, above.in_article)
            if around & (BAD | SAID_BOILERPLATE):  # an article among comments is a comment
                said &= BAD | SAID_BOILERPLATE
            if said or tag not in PLAIN:
                out.parent.append(node)
                out.says.append(said)
                out.block.append(-1)
                node = len(out.parent) - 1
            around |= said
        stack.append(_Open(tag, node, around, above.in_article or tag in CONTENT, above.in_link or tag == "a", above.in_heading or tag in HEADINGS))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return out


class Graph(NamedTuple):
    """Of each node the capacity of its edge to a terminal (positive to content, negative to
    boilerplate) and of the edge to the element that holds it."""

    cost: list[float]
    held: list[float]


def graph_of(page: Page, w: Weights) -> Graph:
    """What an element says counts for every block inside. An element is tied to the one that
    holds it by as many blocks as are inside, or as the other holds besides, whichever are
    fewer, and closer if an element around says what it holds and its own name does not speak
    against it; elements that the page itself holds are parted at no cost."""
    n = len(page.parent)
    score = np.clip(np.array(page.features) @ w.text, -w.limit, w.limit).tolist() if page.texts else []
    inside = [int(b >= 0) for b in page.block]
    for i in range(n - 1, 0, -1):
        inside[page.parent[i]] += inside[i]
    cost, held = [0.0] * n, [0.0] * n
    under = [False] * n
    for i, (parent, block, said) in enumerate(zip(page.parent, page.block, page.says, strict=True)):
        under[i] = i > 0 and (under[parent] or bool(page.says[parent] & ~GOOD))
        if block >= 0:
            cost[i], held[i] = score[block], w.told if under[i] else w.leaf
            continue
        each = w.boilerplate if said & SAID_BOILERPLATE else w.bad_name if said & BAD else w.content if said & SAID_CONTENT else w.good_name if said & GOOD else 0.0
        cost[i] = each * inside[i]
        if parent > 0:
            held[i] = w.element * min(inside[i], max(1, inside[parent] - inside[i])) + w.inside * inside[i] * (under[i] and not said & BAD)
    return Graph(cost, held)


def min_cut(parent: list[int], cost: list[float], held: list[float], adjacent: float) -> list[bool]:
    """Content side of the cut of least cost. ``cost``: a node on the boilerplate side costs
    its positive cost, on the content side its negative cost; an element and a child on two
    sides cost the child's ``held``, two neighbouring children ``adjacent``. Parents come before their
    children, and children in their order. Ties go to content.

    From the last node to the first: the least cost of a node's subtree and of its later
    siblings', for either side of the node and of its parent."""
    n = len(parent)
    # of a node's children so far, the first of them on a side (0 boilerplate, 1 content)
    # under the node on a side; None: no child yet
    first: list[tuple[float, float, float, float] | None] = [None] * n
    mine: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, 0.0)] * n
    later: list[int] = [-1] * n  # the sibling after
    eldest: list[int] = [-1] * n
    root = (0.0, 0.0)
    for i in range(n - 1, -1, -1):
        below = first[i]
        c = cost[i]
        off, on = (c if c > 0 else 0.0), (-c if c < 0 else 0.0)
        if below is not None:
            off += min(below[0], below[1])
            on += min(below[2], below[3])
        p = parent[i]
        if p < 0:
            root = (off, on)
            continue
        after, h = first[p], held[i]
        if after is None:
            mine[i] = (off, on + h, off + h, on)
        else:
            a, b, c, d = after
            mine[i] = (off + min(a, b + adjacent), on + h + min(b, a + adjacent), off + h + min(c, d + adjacent), on + min(d, c + adjacent))
        later[i], eldest[p], first[p] = eldest[p], i, mine[i]
    side = [False] * n
    side[0] = root[1] <= root[0]
    for i in range(n):
        k, before = eldest[i], None
        while k >= 0:
            off, on = mine[k][2:] if side[i] else mine[k][:2]
            if before is not None:
                off, on = (off + adjacent, on) if before else (off, on + adjacent)
            side[k] = before = on <= off
            k = later[k]
    return side


def main_text(page: str, w: Weights | None = None) -> str:
    """The content blocks of a page, joined by one newline; empty if there are none."""
    w = w or DEFAULT
    found = parse(page)
    side = min_cut(found.parent, *graph_of(found, w), w.adjacent)
    return "\n".join(found.texts[b] for b, keep in zip(found.block, side, strict=True) if keep and b >= 0)


def labelled(page: Page) -> Iterator[tuple[tuple[float, ...], bool]]:
    """(features, content) of blocks whose place tells their class, on pages that have an
    article or main element: inside it content, outside it or in an element that is never
    content boilerplate. A block in an article under a name that speaks against it is left
    out."""
    if not any(a & SAID_CONTENT for a in page.around):
        return
    for features, a in zip(page.features, page.around, strict=True):
        inside = bool(a & SAID_CONTENT) and not a & SAID_BOILERPLATE
        if not (inside and a & BAD):
            yield (*features, float(bool(a & BAD)), float(bool(a & GOOD))), inside


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic weights of FEATURES by Newton steps, drawn to PRIOR as if by PRIOR_BLOCKS
    blocks, so that features which the sample does not show keep their first weight. Both
    classes weigh the same."""
    weight = PRIOR.copy()
    if not len(x):
        return weight
    each = np.where(y, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (~y).sum()))
    pull = PRIOR_BLOCKS * 0.05
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        slope = x.T @ (each * (y - p)) - pull * (weight - PRIOR)
        curve = (x * (each * p * (1 - p))[:, None]).T @ x + pull * np.eye(len(weight))
        step = np.linalg.solve(curve, slope)
        weight = weight + step
        if np.abs(step).max() < 1e-8:
            break
    return weight


def _spread(x: np.ndarray, weight: np.ndarray) -> float:
    sizes = np.abs(x[:, :-2] @ weight[:-2]) if len(x) else np.ones(1)
    return float(np.clip(np.median(sizes), 0.5, 3.0))


DEFAULT = weights_of(PRIOR, 1.0)


#: Scales of the smoothness that are tried.
SMOOTH = (0.0, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0)


def bare(page: Page) -> Page:
    """The page as if no element said what it holds."""
    return page._replace(says=[0] * len(page.says))


def right_blocks(page: Page, fitted: np.ndarray, spread: float, scales: tuple[float, ...] = SMOOTH) -> list[int]:
    """For each scale, how many blocks whose class their place tells the cut labels right
    without being told by any element."""
    known = [(bool(a & SAID_CONTENT) and not a & SAID_BOILERPLATE) if not (a & SAID_CONTENT and a & BAD) else None for a in page.around]
    plain, out = bare(page), []
    for scale in scales:
        w = weights_of(fitted, spread, scale)
        side = min_cut(plain.parent, *graph_of(plain, w), w.adjacent)
        out.append(sum(known[b] is not None and keep == known[b] for b, keep in zip(plain.block, side, strict=True) if b >= 0))
    return out


def train(pages: DataFrame, html_col: str = "html") -> Weights:
    """Weights fitted on blocks of about FIT_PAGES pages, FIT_BLOCKS at most, chosen by hash;
    those of PRIOR if no page has blocks with a class. The smoothness is the one of SMOOTH
    under which the cut labels most blocks of as many other pages right when no element says
    what it holds (of equal ones the least)."""
    text = F.col(html_col).cast("string")
    rows = pages.select(text.alias("_html")).where(text.isNotNull())
    n = rows.count()
    place = F.pmod(F.xxhash64("_html"), F.lit(max(1, n)))
    chosen = rows.where(place < FIT_PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _words.slices(batches, "_html"):
            for page in piece.column(0).to_pylist():
                found = list(labelled(parse(page)))
                if found:
                    at = _words.mix(_words.word_hashes([page]) + np.arange(len(found), dtype=np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.list_(pa.float64())), pa.array([y for _, y in found]), pa.array(at)], ["x", "y", "at"])

    sample = chosen.mapInArrow(run, "x array<double>, y boolean, at long").orderBy("at", "x", "y").limit(FIT_BLOCKS).collect()
    x = np.array([r[0] for r in sample]).reshape(-1, len(FEATURES))
    fitted = fit(x, np.array([r[1] for r in sample], bool))
    spread = _spread(x, fitted)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _words.slices(batches, "_html"):
            total = np.zeros(len(SMOOTH), np.int64)
            for page in map(parse, piece.column(0).to_pylist()):
                if any(a & SAID_CONTENT for a in page.around):
                    total += right_blocks(page, fitted, spread)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(SMOOTH)), pa.int32()), pa.array(total)], ["k", "right"])

    # small tables have no other pages: theirs are tried on those of the fit
    others = rows.where((place >= FIT_PAGES) & (place < 2 * FIT_PAGES)) if n >= 2 * FIT_PAGES else chosen
    right = {r[0]: r[1] for r in others.mapInArrow(tried, "k int, right long").groupBy("k").agg(F.sum("right")).collect()}
    best = max(range(len(SMOOTH)), key=lambda k: (right.get(k, 0), -k))
    return weights_of(fitted, spread, SMOOTH[best])


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), w: Weights | None = None) -> DataFrame:
    """Columns ``keep`` and ``text``, ``n_chars`` of every row; without ``w`` the classifier is
    fitted on a sample of the pages first.

    A null or empty page has an empty text; pages of any length are read whole; rows come
    back as they are, repeated ones repeated; other columns are not read. No shuffle.
    """
    w = w or train(pages, html_col)
    rows = pages.select(F.col(html_col).cast("string").alias("_html"), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _words.slices(batches, "_html"):
            texts = [main_text(p, w) if p else "" for p in piece.column(0).to_pylist()]
            columns = [*piece.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*piece.schema.names[1:], "text", "n_chars"])

    schema = T.StructType([*rows.schema.fields[1:], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)
