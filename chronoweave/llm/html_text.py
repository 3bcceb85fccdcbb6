"""Main text of web pages by tag-path ratios.

A page's text nodes are grouped by their path of tags from the root, with classes and ids as part of a tag.
Each path gets two ratios, characters and punctuation marks a node; both are smoothed over the paths in page
order, fused as a product and held against a threshold. What names and roles of elements say is a third factor: a
path that runs through a menu, a form or the like scores zero. Selected paths name the regions that the article fills:
the article or main elements that hold them, where these hold half of the selected text, or else the element
around all of them. All blocks of a region whose path doesn't score zero are its text, short ones too.

Every step takes time in proportion to the page, however deep its elements lie in each other.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags whose start or end parts blocks.
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "legend", "option", "select",
}
#: A start tag on the left ends an open one on the right, as in the HTML standard.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
ENDS_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "select"}
BOUND = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "body", "html", "blockquote", "td", "th"}
#: Elements that are never part of an article.
NEVER = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "title", "textarea", "button", "select", "option", "iframe", "menu", "dialog", "svg", "object", "input", "label", "fieldset", "noembed", "noframes"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
#: Words of class names and ids that mark what isn't the article: fixed values.
MARKS = set(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners sponsor sponsors sponsored promo promos promotion promotions cookie cookies consent gdpr notice notices notification notifications "
    "alert alerts popup popups modal modals overlay overlays newsletter newsletters subscribe subscription signup login comment comments disqus reply replies respond discussion sidebar sidebars side rail aside widget widgets related "
    "recommend recommended recommendation recommendations trending popular share sharing social follow breadcrumb breadcrumbs pagination pager paging nav navbar navigation menu menus footer masthead topbar toolbar byline "
    "search copyright disclaimer teaser teasers outbrain taboola hidden".split()
)
#: Of these, what marks an article or main element, too.
OWN_MARKS = set("ad advert advertisement sponsored promo comment comments reply replies related recommended teaser teasers".split())
#: Names like these say something of an element's state or of its neighbours.
STATES = re.compile(r"(?:has|have|with|without|no|not|is|js|show|hide)-")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: What a region is made of, and what else belongs to one.
BOXES = {"div", "section", "article", "main", "body", "td", "center"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
SENTENCE = re.compile(r"[.!?。…]")
PUNCTUATION = re.compile(r"[.,;:!?。，…]")
SMOOTHING = np.array([0.25, 0.5, 0.25])


class Node:
    """An element: ``strict`` ones are never article text, ``marked`` ones are named like something else, unless an article lies within.

    ``place`` counts elements in page order and ``last`` is the place of the last one within. ``article`` and ``main``
    are the outermost such elements around it, itself included, ``block`` is the innermost that parts blocks, and
    ``aside`` says whether an element from there on isn't article text. ``path`` is its number once the page is read.
    """

    __slots__ = ("tag", "name", "names", "strict", "marked", "parent", "place", "last", "article", "main", "block", "aside", "framed", "never", "path")

    def __init__(self, tag: str, name: str, names: str, strict: bool, marked: bool, parent: Node | None, place: int):
        self.tag, self.name, self.names, self.strict, self.marked, self.parent, self.place, self.last = tag, name, names, strict, marked, parent, place, place
        self.article = parent.article if parent and parent.article else self if tag == "article" else None
        self.main = parent.main if parent and parent.main else self if tag == "main" else None
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.aside = False if tag in BLOCK else strict or marked or bool(parent and parent.aside)
        self.framed = self.never = False
        self.path = 0

    def around(self, other: Node) -> bool:
        """Whether the other lies in this element, or is it."""
        return self.place <= other.place <= self.last


def marks_of(names: str) -> set[str]:
    """Marks in class names and ids; "header" among them where a whole name is a page's header."""
    found = set()
    for name in names.split():
        name = CAMEL.sub("-", name).lower()
        if STATES.match(name):
            continue
        words = re.split(r"[-_:]+", name)
        found.update(MARKS.intersection(words))
        if words[-1] == "header" and (len(words) == 1 or words[0] in ("site", "page", "main", "global", "top", "app")):
            found.add("header")
    return found


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def _opened(tag: str, rest: str, parent: Node, place: int) -> Node:
    name, names, strict, marked = tag, "", tag in NEVER, False
    inside = bool(parent.article or parent.main)
    # A page's header isn't the article; an article's own header, with its title, is.
    strict = strict or tag == "header" and not inside
    if rest and not rest.isspace():
        got = attributes(rest)
        names = f"{got.get('class', '')} {got.get('id', '')}".strip()
        if names:
            name = f"{tag}.{'.'.join(names.split())}"
        if tag not in ("html", "body"):
            marks = marks_of(names)
            if inside:
                marks.discard("header")
            marked = bool(marks & OWN_MARKS if tag in ("article", "main") else marks)
            strict = strict or got.get("role", "").lower() in ROLES or "hidden" in got or got.get("aria-hidden") == "true" or bool(HIDDEN.search(got.get("style", "")))
    if tag in ("article", "main") and not marked:
        up = parent
        while up is not None and not up.framed:
            if up.marked and up.tag not in ("article", "main") and not marks_of(up.names) & OWN_MARKS:
                up.marked = False  # a frame around the article, whatever else it frames
                up.aside = up.strict and up.tag not in BLOCK
            up.framed = True
            up = up.parent
    return Node(tag, name, names, strict, marked, parent, place)


def blocks_of(html: str) -> tuple[list[tuple[Node, str]], list[Node]]:
    """The page's blocks of text in order: the innermost element that parts blocks, and the text, its white space still as it was; and all elements."""
    root = Node("", "", "", False, False, None, 0)
    nodes, stack, opened, out, pieces, owner, breaks = [root], [root], Counter(), [], [], None, 0

    def flush() -> None:
        nonlocal owner
        if pieces:
            out.append((owner, "".join(pieces)))
            pieces.clear()
        owner = None

    def text(raw: str) -> None:
        nonlocal owner
        if not raw:
            return
        if owner is None:
            owner = stack[-1].block
        if not stack[-1].aside:  # else an inline element that is no article text
            pieces.append(unescape(raw) if "&" in raw else raw)

    def close(k: int) -> None:
        """Close all elements from the k-th open one on."""
        for node in stack[k:]:
            opened[node.tag] -= 1
            node.last = len(nodes) - 1
        del stack[k:]

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            rest = html[at:]
            # A tag that the page's end cuts off is markup.
            cut = re.search(r"<[/a-zA-Z][^<]*\Z", rest)
            text(rest[: cut.start()] if cut else rest)
            break
        between = html[at : m.start()]
        text(between)
        if between and not between.isspace():
            breaks = 0
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if closing:
            if tag == "br" or tag == "p" and not opened["p"]:
                text(" ")
                continue
            if not opened[tag]:
                continue  # a stray end
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(x.tag in BLOCK for x in stack[k:]):
                        flush()
                    close(k)
                    break
                if stack[k].tag in BOUND and tag not in BLOCK:
                    break  # a stray inline end
            continue
        if tag in BLOCK:
            flush()
            if tag in ENDS_P and opened["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BOUND:
                        break
            ended = ENDS.get(tag)
            if ended:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ended:
                        close(k)
                    elif stack[k].tag in BOUND:
                        break
        elif tag == "br":
            breaks += 1
            if breaks > 1:
                flush()  # an empty line parts blocks
            else:
                text(" ")
        if tag in VOID:
            continue
        node = _opened(tag, rest, stack[-1], len(nodes))
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
            continue
        if not rest.endswith("/") or tag in BLOCK:
            stack.append(node)
            opened[tag] += 1
    flush()
    close(1)
    root.last = len(nodes) - 1
    return out, nodes


def number_paths(nodes: list[Node]) -> None:
    """Elements of one path get one number; whether it runs through what is never article text is part of it."""
    known: dict[tuple[int, str, bool], int] = {}
    for node in nodes:
        up = node.parent
        node.never = node.strict or node.marked or bool(up and up.never)
        node.path = known.setdefault((up.path if up else -1, node.name, node.never), len(known))


def ratios(blocks: list[tuple[Node, str]]) -> tuple[dict[int, float], float]:
    """Fused score of each path, zero of those that are never article text, and the threshold: the deviation of the others' scores."""
    order: dict[int, int] = {}
    sums = []
    for node, text in blocks:
        if node.never:
            continue
        k = order.setdefault(node.path, len(order))
        if k == len(sums):
            sums.append([0, 0, 0])
        s = sums[k]
        s[0] += 1
        s[1] += len(text)
        s[2] += len(PUNCTUATION.findall(text))
    out = dict.fromkeys((node.path for node, _ in blocks), 0.0)
    if not sums:
        return out, 0.0
    s = np.array(sums, float)
    characters, marks = s[:, 1] / s[:, 0], s[:, 2] / s[:, 0]
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), SMOOTHING, "valid")
    fused = np.sqrt(smooth(characters) * (1 + smooth(marks)) * s[:, 1])
    return out | dict(zip(order, fused.tolist(), strict=True)), float(fused.std())


def _common(nodes: list[Node]) -> Node:
    """The innermost element around all nodes."""
    at, low, high = nodes[0], min(n.place for n in nodes), max(n.place for n in nodes)
    while not at.place <= low <= high <= at.last:
        at = at.parent
    return at


def _region(selected: list[tuple[Node, str]], blocks: list[tuple[Node, str]]) -> Node:
    """The element that the selected blocks fill, with titles and short sentences beside them.

    It is the innermost box around all of them, and boxes around that as long as what they add is headings and
    sentences for the most part.
    """
    at = _common([node for node, _ in selected])
    while at.parent is not None and at.tag not in BOXES:
        at = at.parent
    rows = sorted((node.place, len(text), len(text) if node.tag in HEADINGS or SENTENCE.search(text) else 0) for node, text in blocks)
    places = [place for place, _, _ in rows]
    all_, kin = (np.concatenate([[0], np.cumsum([r[k] for r in rows])]) for k in (1, 2))
    within = lambda node, sums: int(sums[bisect_right(places, node.last)] - sums[bisect_left(places, node.place)])
    up = at
    while up.parent is not None:
        up = up.parent
        added = within(up, all_) - within(at, all_)
        if 2 * (within(up, kin) - within(at, kin)) < added:
            break
        if added:
            at = up
    return at


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line feeds; empty if the page has none."""
    blocks, nodes = blocks_of(html or "")
    number_paths(nodes)
    blocks = [(node, " ".join(text.split())) for node, text in blocks]
    blocks = [(node, text) for node, text in blocks if text]
    if not blocks:
        return ""
    score, threshold = ratios(blocks)
    blocks = [(node, text) for node, text in blocks if score[node.path] > 0]
    selected = [(node, text) for node, text in blocks if score[node.path] >= threshold] or blocks
    if not selected:
        return ""
    total = sum(len(text) for _, text in selected)
    # Articles without a selected block are cards beside the text.
    chosen = {node.article for node, _ in selected} | {None}
    plain = [(node, text) for node, text in blocks if node.article in chosen]
    for kind in ("article", "main"):
        # Elements that hold half of the selected text are its regions, all those that hold any of it.
        of = {node: getattr(node, kind) for node, _ in plain}
        inside = [(node, text) for node, text in selected if of[node]]
        if inside and 2 * sum(len(text) for _, text in inside) >= total:
            regions = {of[node] for node, _ in inside}
            # Text outside belongs to it if its path scores like theirs.
            least = max(score[node.path] for node, _ in inside) / 2
            frames = set()
            for region in regions:
                while region is not None and region not in frames:
                    frames.add(region)
                    region = region.parent
            for node, _ in selected:
                if not of[node] and score[node.path] >= least:
                    up = node
                    while up not in frames and up.tag not in BOXES:
                        up = up.parent
                    regions.add(node if up in frames else up)
            held: set[Node] = set()
            for node in nodes:
                if node in regions or node.parent in held:
                    held.add(node)
            return "\n".join(text for node, text in plain if node in held)
    region = _region(selected, plain)
    return "\n".join(text for node, text in plain if region.around(node))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            texts = [main_text(x) for x in batch.column(2).slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), batch.column(1).slice(at, 256), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of (page_id, url, html).

    White space within a block becomes one space, blocks are joined by one line feed, character references are
    decoded. A null or empty page has an empty text. Repeated rows stay; other columns are ignored.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
