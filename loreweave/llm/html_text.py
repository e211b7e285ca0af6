"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into a flat run of text blocks. A block's features are its word count and link density, those
of the blocks before and after it, its tag, and where it stands: inside or outside the page's articles, and what share of the
page's words the elements around it hold that are furniture by tag (nav, footer, aside), by form or header, or by a word in
their names. A name alone decides nothing: what holds most of the page or its headline is not a sidebar, whatever it is called.
A tree is grown on the blocks of a small table of pages that were marked by hand (html_table), and keeps or drops each block.
Kept blocks, with character references decoded and white space turned into single spaces, are joined by two newlines.

Defined results: a null or empty page, and one without a kept block, has an empty text; rows repeated give equal rows, null ids
and urls are passed on; nothing depends on the order of rows, so ties cannot occur; a page of any length is read whole and is one
row's memory, in time that grows with its length; unclosed comments, scripts and tags run to the end of the page; columns whose
names equal text_col in any case are replaced by it, other columns are passed on; an empty table gives no rows.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import quoted, tick
from loreweave.llm.html_table import PAGES, SCALES

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <!\[CDATA\[.*?(?:\]\]>|\Z)
      | <(?P<raw>script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | <[/!?]?[a-zA-Z?][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=\s|$|=)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Words of class names, ids and roles that often name page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup paywall sidebar side aside rail widget widgets related recommended recommendations popular trending share sharing social follow "
    "comment comments disqus discussion reply replies respond responses breadcrumb breadcrumbs menu nav navbar navigation navigational footer foot bottom copyright disclaimer meta toc catlinks "
    "login signin register search form toolbar pager pagination paging tags taglist skip contentinfo complementary dialog top topbar".split()
)
#: Words that name furniture outside an article, where they do not name its own head.
HEADS = frozenset("header head masthead".split())
#: First words of names that say what stands beside an element.
AROUND = frozenset("has with no without is not".split())
_WORDS = re.compile(r"[a-z]+")
#: What short blocks around a text say, and what blocks of a few words say.
_CUES = re.compile(
    r"\b(?:advertisement|sponsored(?: by)?|werbung|anzeige|publicité|publicidad|subscribe (?:to|now|today)|to subscribe|our newsletter|sign (?:up|in)|log in|impressum|"
    r"(?:use|accept|our) cookies|terms of use|privacy policy|read more|click here|share this|follow us|related (?:stories|articles|posts|links)|most (?:read|popular)|you may also|also bought|posted (?:by|on)|"
    r"leave a (?:reply|comment)|special offer|buy now|skip to)\b",
    re.I,
)
_LEGAL = re.compile(r"\bcopyright (?:©|\(c\)|by|\d{4})|\ball rights reserved\b|©", re.I)
_LABELS = re.compile(r"\b(?:comments?|kommentare?|commentaires?|comentarios?|repl(?:y|ies)|recommended|about us|contact(?: us)?|home|news|menu|search|accept|user name|password|your name|send|copyright)\b", re.I)
#: Tags that end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "label legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags without an extent, and tags that end one of their own kind that is open.
EMPTY = frozenset("hr".split())
CLOSES_ITSELF = frozenset("li dt dd td th tr option p".split())
FURNITURE_TAGS = frozenset("nav footer aside menu dialog head button fieldset label legend option".split())
PARAGRAPH_TAGS = frozenset("p blockquote pre".split())
ITEM_TAGS = frozenset("li dd dt td th".split())
HOME_TAGS = frozenset(("article", "main"))
#: Tags that can stand in a head; any other ends it.
HEAD_TAGS = frozenset("html head title base basefont bgsound link meta noscript script style template".split())


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    kind: str  # furniture by tag: "tag", "form", "header", or ""
    named: bool
    hidden: bool
    home: bool
    words: int = 0  # outside links, of all blocks inside
    holds: bool = False  # a headline or an article


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    tag: str
    element: int


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, and its elements, each after the one around it. Element 0 is the page."""
    found: list[Block] = []
    elements = [Element("", -1, "", False, False, False)]
    open_ = [0]
    count: Counter = Counter()
    homes = 0
    texts: list[str] = []
    links: list[str] = []
    link = 0
    tag_now = ""

    def close() -> None:
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                found.append(Block(text, text.count(" ") + 1, len(html.unescape("".join(links)).split()), tag_now, open_[-1]))
            texts.clear()
        links.clear()

    def pop() -> None:
        nonlocal homes
        gone = elements[open_.pop()]
        count[gone.tag] -= 1
        homes -= gone.home

    def take(text: str) -> None:
        if elements[open_[-1]].tag == "head" and text.strip():
            pop()
        texts.append(text)
        if link:
            links.append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag, end, attrs = tag.lower(), m["end"], m["attrs"]
        if elements[open_[-1]].tag == "head" and not end and tag not in HEAD_TAGS:
            pop()
        if tag == "a":
            link = 0 if end else 1
            if not end and texts:
                links.append(" ")
        elif tag == "br":
            take(" ")
        elif tag in BLOCK:
            close()
            tag_now = "" if end else tag
            link = 0 if tag in ("article", "main", "body") else link
            if end:
                if count[tag]:
                    while elements[open_[-1]].tag != tag:
                        pop()
                    pop()
                continue
            if elements[open_[-1]].tag == "p" or tag in CLOSES_ITSELF and elements[open_[-1]].tag == tag:
                pop()
            if tag in EMPTY or attrs.endswith("/"):
                continue
            whole = tag in ("body", "html")
            named = not whole and bool(attrs) and _named(attrs, tag, homes > 0)
            kind = "tag" if tag in FURNITURE_TAGS else tag if tag == "form" or tag == "header" and not homes else ""
            elements.append(Element(tag, open_[-1], kind, named, not whole and bool(attrs) and bool(_HIDDEN.search(attrs)), tag in HOME_TAGS))
            open_.append(len(elements) - 1)
            count[tag] += 1
            homes += tag in HOME_TAGS
    if at < len(page):
        take(page[at:])
    close()
    return found, elements


def _named(attrs: str, tag: str, inside: bool) -> bool:
    """Does a name of the class, id or role begin or end with a word for furniture? What follows "with" or "has" names something
    else; articles have names of many kinds, of which the first counts."""
    for value in _NAMES.findall(attrs):
        for name in "".join(value).lower().split():
            words = list(itertools.takewhile(lambda w: w not in AROUND, _WORDS.findall(name)))
            ends = words[:1] + words[-1:]
            if not (FURNITURE.isdisjoint(ends) and (inside or HEADS.isdisjoint(ends))):
                return True
            if tag in HOME_TAGS:
                break
    return False


FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "paragraph", "item", "home", "home_ratio", "in_tag", "tag_share", "form_share", "in_header", "header_share",
    "named", "named_share", "named_holds", "hidden", "cue", "section_cue", "box_share",
)


def cue(text: str, words: int, home: bool) -> float:
    """How much of a short text is what stands around texts; longer ones have no cues. Rights are also stated in articles."""
    if words > 25:
        return 0.0
    return min(1.0, (2 * sum(1 for _ in _CUES.finditer(text)) + 2 * (not home and bool(_LEGAL.search(text))) + (bool(_LABELS.search(text)) if words <= 3 else 0)) / words)


def features(found: list[Block], elements: list[Element]) -> list[tuple]:
    """A row of FEATURES for each block. Shares are of the page's words outside links and hidden elements."""
    for b in found:
        elements[b.element].words += max(b.words - b.linked, 0)
        elements[b.element].holds |= b.tag == "h1"
    for e in reversed(elements[1:]):  # from the inside out
        up = elements[e.parent]
        up.words += 0 if e.hidden else e.words
        up.holds |= e.holds or e.home and not e.named
    total = max(elements[0].words, 1)
    # what an element's blocks inherit: shares by kind, share and headline of the smallest named element, hidden, words of the outermost article
    shares: list[dict] = [{"tag": 1.0, "form": 1.0, "header": 1.0, "named": 1.0, "holds": 1, "hidden": 0, "home": 0, "in_tag": 0, "in_header": 0, "in_named": 0}]
    homes = {False: 0, True: 0}
    for e in elements[1:]:
        parent = shares[e.parent]
        own, share = dict(parent), e.words / total
        if e.kind:
            own[e.kind] = min(own[e.kind], share)
        own["in_tag"] |= e.kind == "tag"
        own["in_header"] |= e.kind == "header"
        own["in_named"] |= e.named
        if e.named and (share < own["named"] or not parent["in_named"]):
            own["named"], own["holds"] = min(share, 1.0), int(e.holds or e.home)
        own["hidden"] |= e.hidden
        if e.home and not (own["home"] or own["in_tag"] or own["hidden"]):
            own["home"] = max(e.words, 1)
            homes[e.named] = max(homes[e.named], own["home"])
        shares.append(own)
    most = homes[False] or homes[True]  # words of the largest article or main element
    shape = [(min(b.words, 300), min(1.0, b.linked / b.words)) for b in found]
    out, section = [], 0.0
    for k, b in enumerate(found):
        heading = b.tag[:1] == "h" and b.tag[1:].isdigit()
        s, e = shares[b.element], elements[b.element]
        own_cue = cue(b.text, b.words, bool(s["home"]))
        if heading:
            section = own_cue if b.tag != "h1" else 0.0
        before, after = shape[max(k - 1, 0)], shape[min(k + 1, len(found) - 1)]  # at an end of the page, the block itself
        box = elements[max(e.parent, 0)] if e.tag in PARAGRAPH_TAGS or e.tag in ITEM_TAGS or b.element else e
        home = 0 if not most else 1 if s["home"] else 2
        out.append((
            *shape[k], *before, *after, heading, b.tag in PARAGRAPH_TAGS, b.tag in ITEM_TAGS, home, min(1.0, s["home"] / most) if most else 0.0,
            s["in_tag"], s["tag"], s["form"], s["in_header"], s["header"], s["in_named"], s["named"], s["holds"], s["hidden"], own_cue, section if not heading else 0.0, box.words / total,
        ))
    return out


_MARK = re.compile(r"\{([+-])(\d*)\}")


def labelled_table() -> list[tuple]:
    """The features of every block of the marked pages, at every length, then 1 for main text."""
    rows = []
    for page in PAGES:
        for scale in SCALES:
            def words(m: re.Match) -> str:
                n = int(m[2] or 0)
                n = max(1, round(n * scale)) if n > 4 else n
                return f"\ue000{m[1]}" + " ".join(["word"] * n)  # noqa: B023

            found, elements = blocks(_MARK.sub(words, page))
            labels = [int("\ue000+" in b.text) for b in found]
            assert all("\ue000" in b.text for b in found), "a block without a mark"
            for b in found:
                b.text = re.sub("\ue000.", "", b.text)
            rows += [(*x, y) for x, y in zip(features(found, elements), labels, strict=True)]
    return rows


@dataclass
class Node:
    keep: bool
    feature: int = -1
    limit: float = 0.0
    low: "Node | None" = field(default=None, repr=False)
    high: "Node | None" = field(default=None, repr=False)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 3) -> Node:
    """A tree by least Gini impurity; the first of equal splits. No leaf holds fewer than `least` rows."""
    node = Node(bool(y.mean() >= 0.5))
    if depth == 0 or y.min() == y.max():
        return node
    best = None
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, k] <= limit
            if min(low.sum(), len(low) - low.sum()) < least:
                continue
            cost = sum(s.sum() * 2 * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            if best is None or cost < best[0] - 1e-9:
                best = (cost, k, float(limit))
    if best is None:
        return node
    _, node.feature, node.limit = best
    low = x[:, node.feature] <= node.limit
    node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


@cache
def tree() -> Node:
    rows = np.array(labelled_table(), float)
    return grow(rows[:, :-1], rows[:, -1])


def keeps(node: Node, x: tuple) -> bool:
    while node.low is not None:
        node = node.low if x[node.feature] <= node.limit else node.high
    return node.keep


def main_text(page: str | None, root: Node) -> str:
    found, elements = blocks(page) if page else ([], [])
    return "\n\n".join(b.text for b, x in zip(found, features(found, elements) if found else (), strict=True) if keeps(root, x))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The other columns of pages, and the main text in place of the html."""
    others = [c for c in pages.columns if c.lower() not in (html_col.lower(), text_col.lower())]
    source = pages.select(*map(quoted, others), quoted(html_col).cast("string").alias(html_col))
    root = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h, root) for h in part.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*others, text_col])

    kinds = dict(pages.dtypes)
    return source.mapInArrow(run, ", ".join([*(f"{tick(c)} {kinds[c]}" for c in others), f"{tick(text_col)} string"]))
