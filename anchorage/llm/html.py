"""Main text of HTML pages by tree scoring.

A page becomes a tree.  Every block of running text earns points: one, one per
comma, and up to three for length.  It passes all of them to its parent, half
to its grandparent, a third to the next and so on; each container's points are
then cut by the share of its text that stands in links.  If the best container
lies in an article element, or else in a main element, the outermost of these
takes its place.  It and all beside it that is not made of links are the
article, up to the main element that holds it, if any; beside an article or
main element that no main element holds, only what scores or reads like it is.

Before that, parts that are never the article are left out: scripts, styles,
forms and other controls, navigation, sidebars, page headers and footers,
hidden parts, and elements whose class or id names an advert, a menu, a
notice, sharing buttons or reader comments.  A paragraph, heading, quote or
caption counts as such only if nothing else is in that
name (``class="tags-explained"`` is a paragraph about tags).  Within the article
the same rule applies, so an advert between two paragraphs is dropped; of a
header within it only the headings stay.  An article element is dropped where
its class or id says that it is a comment.

Text: character references are decoded, white space inside a block becomes one
space, blocks are trimmed and joined in page order by one space.

Defined results: a null or empty page, or one without text, gives an empty
text; pages that break off, unclosed and stray tags are read as far as they
go; a null ``page_id`` or ``url`` is passed through; repeated rows are read row
by row; of containers with equal points the first wins; other columns are
ignored.  Pages of any length are read whole, in one pass, without recursion.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas".split())
DROPPED = frozenset("head script style noscript template iframe svg math object canvas audio video form button input select option textarea label fieldset nav aside footer menu dialog title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
TEXTUAL = frozenset("p pre blockquote td dd li".split())
#: A start of the first closes an open one of the second, up to a container.
CLOSES_P = BLOCKS - frozenset(("body", "html"))
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody")}
LIMITS = frozenset("ul ol dl table div section article header main body html blockquote td th nav aside form".split())
# Words of classes and ids.
NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adslot alert alerts announcement banner breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies copyright
    disqus disclaimer dropdown footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall popup
    promo promoted promotion recommended related replies reply respond share sharing shoutbox sidebar signup skip skyscraper social sponsor sponsored subscribe taboola tagcloud toolbar tags
    topbar widget""".split()
)
#: Class names by which a page hides text from readers.
HIDDEN = frozenset("d-none hidden screen-reader-text sr-only visually-hidden".split())
KEEP = frozenset("article body content entry main post story text".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())

#: Words that say nothing of what an element holds, beside the words above.
PLAIN = frozenset("area bar block bottom box button buttons container content group has inner inline item items js label large left link links list main module outer panel right row section site small sticky text the title top unit wrap wrapper".split())
#: Elements of running text, in which a class or id must name nothing else.
RUNNING = HEADINGS | frozenset("p pre blockquote figcaption".split())

# Quotes count only after an equals sign: elsewhere in a tag they are stray, and the tag ends at its first ">".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)|([^<]+|<)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[a-z]+")
_COMMENT = re.compile(r"(?:\w+-)?(?:comment|reply)(?:-(?:\d+|body|content|item|text))?").fullmatch


class _Node:
    __slots__ = ("tag", "parent", "children", "dropped", "points", "length", "linked", "commas", "inline")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        #: How many inline elements of each name are open in the nearest block.
        self.inline: Counter[str] = Counter() if parent is None or tag in BLOCKS else parent.inline
        self.children: list[_Node | str] = []
        self.points = 0.0
        self.length = self.linked = self.commas = 0


def _is_noise(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header":
        return not in_article
    if not attributes or tag in ("html", "body"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            if name == "class" and not HIDDEN.isdisjoint(value.split()):
                return True
            if tag in ("article", "main"):
                if any(_COMMENT(token) for token in value.split()):
                    return True
                continue
            parts = set(_PART.findall(value))
            if tag in RUNNING:
                if any(p & NOISE and p <= NOISE | PLAIN for p in map(set, map(_PART.findall, value.split()))):
                    return True
                continue
            if parts & NOISE and not parts & KEEP - NOISE:
                return True
            if parts & {"comment", "comments", "sidebar", "advert", "advertisement", "ad", "ads"}:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _in_heading(node: _Node | None) -> bool:
    while node is not None and node.tag != "header":
        if node.tag in HEADINGS:
            return True
        node = node.parent
    return False


def parse(page: str) -> _Node:
    """A tree of what may be text.  Dropped parts are kept as empty nodes, so that their ends match."""
    root = here = _Node("html", None, False)
    at, size = 0, len(page)
    blocks: Counter[str] = Counter()  # open blocks by name
    match = _TOKEN.match

    def up_to(node: _Node) -> _Node:
        """End all open elements below ``node``."""
        end = here
        while end is not node:
            (blocks if end.tag in BLOCKS else end.inline)[end.tag] -= 1
            end = end.parent
        return node

    while at < size:
        m = match(page, at)
        if m is None:
            break
        at = m.end()
        cdata, closing, tag, attributes, text = m.groups()
        if text is not None or cdata is not None:
            if not here.dropped and (not blocks["header"] or _in_heading(here)):
                here.children.append(text if text is not None else cdata)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCKS and blocks[tag] > 0 or tag not in BLOCKS and here.inline[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                here = up_to(node.parent)  # all that was left open within ends too
            continue
        if tag in ("html", "body"):
            continue
        if tag in VOID:
            if not here.dropped:
                here.children.append(" ") if tag in ("br", "wbr") else here.children.append(_Node(tag, here, True)) if tag == "hr" else None
            continue
        if tag in CLOSES_P and blocks["p"] > 0:
            node = here
            while node.parent is not None and node.tag not in LIMITS and node.tag != "p":
                node = node.parent
            if node.tag == "p":
                here = up_to(node.parent)
        if tag in CLOSES and any(blocks[t] > 0 for t in CLOSES[tag]):
            node, stops = here, LIMITS | {"tr"} - {*CLOSES[tag]}
            while node.parent is not None and node.tag not in stops and node.tag not in CLOSES[tag]:
                node = node.parent
            if node.tag in CLOSES[tag] and node.parent is not None:
                here = up_to(node.parent)
        aside = blocks["header"] > 0 and tag not in HEADINGS and tag not in ("div", "section", "header") and here.tag not in HEADINGS
        node = _Node(tag, here, here.dropped or aside or _is_noise(tag, attributes or "", blocks["article"] + blocks["main"] > 0))
        if not here.dropped:
            here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if (attributes or "").endswith("/") and tag not in BLOCKS and tag not in ("a", "b", "i", "span", "em", "strong"):
            continue
        (blocks if tag in BLOCKS else node.inline)[tag] += 1
        here = node
    return root


def _walk(root: _Node) -> Iterator[tuple[_Node, bool]]:
    """Elements in page order, each once before and once after what it holds."""
    open_: list[tuple[_Node, bool]] = [(root, False)]
    while open_:
        node, after = open_.pop()
        yield node, after
        if not after:
            open_.append((node, True))
            open_.extend((c, False) for c in reversed(node.children) if not isinstance(c, str) and not c.dropped)


def _score(root: _Node) -> list[_Node]:
    """Set lengths, link lengths and points; the elements that got points, in page order."""
    scored: dict[int, _Node] = {}
    blocks: list[_Node] = []
    for node, after in _walk(root):
        if not after:
            continue
        own = length = linked = commas = 0
        for c in node.children:
            if isinstance(c, str):
                n = len(" ".join(c.split()))
                own += n
                length += n
                commas += c.count(",") + c.count("，") + c.count("、")
            elif not c.dropped:
                length += c.length
                linked += c.linked
                commas += c.commas
                if c.tag not in BLOCKS:
                    own += c.length
        node.length, node.linked, node.commas = length, (length if node.tag == "a" else linked), commas
        if node.tag in TEXTUAL and length >= 25 or node.tag in BLOCKS and own >= 80:
            blocks.append(node)
    for block in blocks:
        points = 1 + block.commas + min(block.length // 100, 3)
        node, depth = block.parent, 1
        if block.tag not in TEXTUAL:
            block.points += points
            scored[id(block)] = block
        while node is not None and depth < 6:
            node.points += points / depth
            scored[id(node)] = node
            node, depth = node.parent, depth + 1
    for node in scored.values():
        node.points *= 1 - node.linked / node.length if node.length else 0
    return list(scored.values())


def _kept(root: _Node) -> list[_Node]:
    scored = _score(root)
    if not scored:
        return [root]
    best = max(scored, key=lambda n: n.points)
    if best.tag in ("ul", "ol", "table", "tbody", "tr", "dl") and best.parent is not None:
        best = best.parent
    while best.parent is not None and best.tag not in ("article", "main") and sum(1 for c in best.parent.children if not isinstance(c, str) and not c.dropped) == 1:
        best = best.parent  # the same text in one more wrapping
    best = _outermost(best, "article") or _outermost(best, "main") or best
    if best.parent is None:
        return [best]
    main = _outermost(best, "main")
    if best.tag not in ("article", "main"):
        return [_beside(best, best)]
    if main is not None and main is not best:
        node = whole = best
        while node is not main:
            node, whole = node.parent, _beside(node, whole)
        return [whole]
    kept, least = [], max(10.0, 0.2 * best.points)
    for node in best.parent.children:
        if isinstance(node, str) or node.dropped:
            continue
        dense = node.linked / node.length if node.length else 1.0
        if node is best or node.points >= least and dense < 0.3 or node.tag == "p" and (node.length > 80 and dense < 0.25 or node.length and not dense and node.commas):
            kept.append(node)
    return kept


def _outermost(node: _Node | None, tag: str) -> _Node | None:
    found = None
    while node is not None:
        found, node = node if node.tag == tag else found, node.parent
    return found


def _beside(node: _Node, taken: _Node) -> _Node:
    """``taken`` for ``node``, and what lies beside it but is not made of links; text and inline elements that follow each other are judged as one."""
    whole = _Node(node.parent.tag, None, False)
    runs: list[list[_Node | str]] = []
    before = False
    for c in node.parent.children:
        inline = c is not node and (isinstance(c, str) or c.tag not in BLOCKS)
        if not inline or not before:
            runs.append([])
        runs[-1].append(c)
        before = inline
    for run in runs:
        length = sum(len(" ".join(c.split())) if isinstance(c, str) else c.length for c in run if isinstance(c, str) or not c.dropped)
        linked = sum(c.linked for c in run if not isinstance(c, str) and not c.dropped)
        if run[0] is node:
            whole.children.append(taken)
        elif linked < 0.3 * length:
            whole.children += run
    return whole


def _text(nodes: list[_Node]) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            joined = " ".join(unescape("".join(line)).split())
            if joined:
                blocks.append(joined)
            line.clear()

    for top in nodes:
        end()
        open_: list[_Node | str | None] = [top]
        while open_:
            item = open_.pop()
            if item is None:
                end()
            elif isinstance(item, str):
                line.append(item)
            elif not item.dropped:
                if item.tag in BLOCKS:
                    end()
                    open_.append(None)
                open_.extend(reversed(item.children))
            elif item.tag in BLOCKS:
                end()
        end()
    return " ".join(blocks)


def main_text(page: str | None) -> str:
    return _text(_kept(parse(page))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(cell.as_py()) for cell in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    view = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return view.mapInArrow(run, "page_id long, url string, text string, n_chars long")
