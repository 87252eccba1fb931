"""Main text of web pages by tag-path ratios.

A page becomes text nodes, each under its path of tags from the root.  For each
distinct path the lengths and the punctuation of all its nodes are summed; the
ratios of both to the number of nodes are smoothed along the page, fused to one
value, and nodes whose path reaches a share of the page's best are content.
Only elements that by their definition hold no article (scripts, nav, footer,
forms) are left out beforehand.  What a page says by an article or main
element, or by a class that names a banner or comments, is a factor of a path's value, no verdict.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without end tag; whose content is no markup; that are never part of the article (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
OUTSIDE = frozenset("script style head title textarea xmp iframe noembed noframes noscript template nav aside footer form button select option input label fieldset dialog menu svg math canvas object audio video map".split())
#: Elements that begin and end a block (fixed values).
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: What ends an open element of the same kind (fixed values).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names of parts beside an article, whole words of class, id or role, and what may follow them (fixed values).
BESIDE = frozenset("ad ads advert advertisement advertising banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice popup modal newsletter subscribe share social related recommended widget comment comments respond disqus replies pagination pager login signup search skip copyright toolbar alert".split())
AFTER = frozenset("area bar block body box buttons container content form group header inner item items link links list main outer panel row section slot text thread top bottom left right unit wrap wrapper".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$|/)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
#: Weight of neighbours in smoothing, and the share of the best fused ratio that a path must reach.
NEAR, THRESHOLD = 0.25, 0.3
#: Factors of a path's value: below an element that a page sets apart for its article, below one that is named as beside it,
#: of headings, and of paths that hold nothing but lone links.
PRIOR, NAMED, HEADING, LINKS = {"": 1.0, "main": 2.0, "article": 4.0}, 0.2, 1.3, 0.4
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def beside(attributes: str) -> bool:
    """A class, id or role names a part beside the article: ``ad``, ``comment-list``, but not ``share-price``."""
    for _, *values in _ATTR.findall(attributes):
        for word in "".join(values).lower().split():
            first, *rest = re.split(r"[-_]+", word.strip("-_"))
            if first in BESIDE and all(x in BESIDE or x in AFTER or x.isdigit() for x in rest):
                return True
    return False


class Node:
    __slots__ = ("path", "text", "block", "outside", "linked")

    def __init__(self, path: int, text: str, block: int, outside: bool, linked: bool):
        self.path, self.text, self.block, self.outside, self.linked = path, text, block, outside, linked


class Paths:
    """Numbers of root-to-leaf tag paths; a path is its parent's number and a tag, so that depth costs nothing."""

    def __init__(self):
        self.number: dict[tuple[int, str, bool], int] = {}
        self.factor = [1.0]
        self.within = [""]

    def below(self, parent: int, tag: str, named: bool) -> int:
        key = (parent, tag, named)
        if (got := self.number.get(key)) is None:
            got = self.number[key] = len(self.factor)
            within = "article" if "article" in (tag, self.within[parent]) else "main" if "main" in (tag, self.within[parent]) else ""
            self.within.append(within)
            self.factor.append(self.factor[parent] / PRIOR[self.within[parent]] * PRIOR[within] * (NAMED if named else 1.0) * (HEADING if tag in HEADINGS else 1.0))
        return got


def text_nodes(html: str, paths: Paths) -> Iterator[Node]:
    """Text nodes in page order.  Unclosed and stray tags are taken as browsers mostly do: an end tag closes up to its element, or nothing.

    A tag whose quotes do not close ends at the next ``>``.
    """
    stack: list[tuple[str, bool, bool, int]] = []  # tag, outside, in a link, path
    opened: Counter = Counter()
    outside = linked = False
    path, block, at = 0, 0, 0

    def close(k: int) -> None:
        opened.subtract(t for t, *_ in stack[k:])
        del stack[k:]

    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            yield Node(path, unescape(text), block, outside, linked)
        if not m:
            return
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            if m[0].startswith("<![CDATA["):
                yield Node(path, m[0][9:].removesuffix("]]>"), block, outside, linked)
            continue
        tag = tag.lower()
        if tag == "br" or tag == "wbr":
            if tag == "br":
                yield Node(path, " ", block, outside, linked)
            continue
        if tag in BLOCK:
            block += 1
        if end:
            if not opened[tag]:
                continue
            k = len(stack) - 1
            while stack[k][0] != tag:
                k -= 1
            close(k)
        else:
            if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
                continue
            if tag in BLOCK and opened["p"]:  # a block ends an open paragraph and what is open inside it
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        close(k)
                        break
                    if stack[k][0] in BLOCK:
                        break
            if (own := CLOSES.get(tag)) and any(opened[t] for t in own):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in own:
                        close(k)
                        break
                    if stack[k][0] in BLOCK - own:
                        break
            _, out, link, up = stack[-1] if stack else ("", False, False, 0)
            if not out:
                out = tag in OUTSIDE or tag == "header" and not (opened["article"] or opened["main"]) or bool(attributes) and bool(_HIDDEN.search(attributes))
            named = bool(attributes) and tag not in ("html", "body", "article", "main") and beside(attributes)
            stack.append((tag, out, link or tag == "a", paths.below(up, tag, named)))
            opened[tag] += 1
            if tag in RAW:
                stop = _RAW_END[tag].search(html, at)
                at = stop.start() if stop else len(html)
                continue
        _, outside, linked, path = stack[-1] if stack else ("", False, False, 0)


_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def _ratios(nodes: list[Node], paths: Paths) -> dict[int, float]:
    """Fused ratio of each path: text and punctuation for each node, smoothed with the paths next to it on the page."""
    order: dict[int, list[float]] = {}
    running = {n.block for n in nodes if not n.linked}  # a link inside running text is text
    for n in nodes:
        own = order.setdefault(n.path, [0.0, 0.0, 0.0])
        if not n.linked or n.block in running:
            own[0] += len(n.text.strip())
            own[1] += len(_PUNCTUATION.findall(n.text))
        own[2] += 1
    x = np.array(list(order.values()))
    factor = np.array([paths.factor[p] for p in order]) * np.where(x[:, 0] > 0, 1.0, LINKS)
    ratio = np.log1p(x[:, :2] / x[:, 2:3])  # one very long node does not outweigh a page
    if len(x) > 1:
        side = np.vstack([ratio[1:], ratio[-1:]]) + np.vstack([ratio[:1], ratio[:-1]])
        ratio = (1 - 2 * NEAR) * ratio + NEAR * side
    ratio /= np.maximum(np.average(ratio, axis=0, weights=x[:, 2]), 1e-9)
    return dict(zip(order, (factor * np.sqrt(ratio[:, 0] * (1 + ratio[:, 1]) / 2)).tolist(), strict=True))


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty if there are none.

    Whole paths are kept or left, so that a short paragraph stays with its
    kind; the best path of a page always stays.
    """
    paths = Paths()
    nodes = [n for n in text_nodes((html or "").replace("\0", ""), paths) if not n.outside]
    solid = [n for n in nodes if n.text.strip()]
    if not solid:
        return ""
    ratio = _ratios(solid, paths)
    least = THRESHOLD * max(ratio.values())
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if ratio.get(n.path, least) >= least:
            blocks.setdefault(n.block, []).append(n.text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [main_text(h) for h in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(text, pa.string())], [*batch.schema.names[1:], "text"])


def extract(pages: DataFrame, columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The given columns of every page with text and n_chars (its code points).

    Null and empty html, and pages without text, give the empty text; pages of any length and depth are read whole;
    paths of equal value are kept or left alike; rows that repeat are treated each; an empty table gives none;
    other columns, ``text`` and ``n_chars`` of the input among them, are left out.
    """
    rows = pages.select(F.col("html").cast("string").alias("__html"), *[F.col(f"`{c}`") for c in columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:]) + ", text string"
    return rows.mapInArrow(_extract, schema).withColumn("n_chars", F.char_length("text").cast("long"))
