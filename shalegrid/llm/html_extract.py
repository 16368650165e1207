"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each under the path of tags (with their classes) from the root to it. For each path the text
length, the punctuation and the number of blocks are summed; the two ratios (text and punctuation a block) are smoothed over
the neighbouring blocks in page order, multiplied, and paths are kept whose value reaches a part of the page's deviation.
The smallest element that holds all of the kept text is the article: all of its blocks belong to it, headings and short
paragraphs too. If the best path runs through an article or main element, the kept paths are those that run through one.

What HTML itself sets apart never counts: navigation, footers, asides, forms, menus, scripts, styles, hidden elements, headers
outside an article, landmark roles. So do elements whose whole class or id is a name for reader comments, adverts or notices
and, outside an article, for menus, page headers, footers or sidebars (every part of it stands in NAMED or FRAME, or in
AROUND); a name that only contains such a word does not.

A null, empty or textless html gives the empty string; unclosed and stray tags are taken as browsers do as far as paths go;
time is linear in the page's length, whatever the nesting. Equal rows are each returned, an empty table gives no rows;
columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame

from shalegrid.llm.common import fields, map_rows

OPENING = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
QUOTE_OR_END = re.compile(r"[\"'>]")
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Fixed lists of HTML elements: without end tags, with raw content, without article text, that stand within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes object canvas audio video".split())
DROPPED = frozenset("head nav footer aside form button select option label fieldset dialog menu datalist noscript iframe".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("article body div section main td th li table html blockquote button figure aside nav footer header form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Fixed names: of reader comments, adverts and notices, of a page's frame, and of what stands around them.
NAMED = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup comment comments reply replies disqus".split())
FRAME = frozenset("breadcrumb breadcrumbs footer header masthead menu nav navbar navigation pagination sidebar topbar".split())
AROUND = frozenset("area bar block body bottom box container content form global item left list main message page post primary reader right secondary section site text thread top user wrap wrapper".split())
PUNCTUATION = re.compile(r"[.,;:!?。，！？、]")
#: The part of the deviation over a page's paths, and of its best path's value, that a path must reach.
DEVIATION, BEST = 0.25, 0.02


class Block:
    __slots__ = ("path", "element", "landmark", "text")

    def __init__(self, path: int, element: int, landmark: bool, text: str):
        self.path, self.element, self.landmark, self.text = path, element, landmark, text


class Element:
    __slots__ = ("name", "number", "path", "unwanted")

    def __init__(self, name: str, number: int, path: int, unwanted: bool):
        self.name, self.number, self.path, self.unwanted = name, number, path, unwanted


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in reversed(ATTRIBUTE.findall(raw))}


def _named(value: str, in_article: bool) -> bool:
    """Whether one of the names in a class or id says that this is not the article, and nothing else."""
    names = NAMED if in_article else NAMED | FRAME
    for name in value.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
        if not names.isdisjoint(parts) and all(x in names or x in AROUND for x in parts):
            return True
    return False


def _unwanted(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    style = attributes.get("style", "").lower()
    hidden = "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style)
    return bool(hidden) or attributes.get("role", "").strip().lower() in ROLES or any(_named(attributes.get(k, ""), in_article) for k in ("class", "id"))


class Page:
    """The blocks of a page outside unwanted elements, in page order; parent and last: of each element, by number, the element
    around it and the greatest number inside it."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.last = [-1], [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.stack: list[Element] = []
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.unwanted = 0
        self._read(page)
        self._pop_to(0)
        self._flush()

    def _flush(self) -> None:
        if not self.parts:
            return
        # References become characters once the block's markup is gone; then white space of any kind is one space.
        text = " ".join(html.unescape("".join(self.parts)).split())
        self.parts.clear()
        if text and not self.unwanted:
            k = len(self.stack) - 1
            while k >= 0 and self.stack[k].name in INLINE:
                k -= 1
            at = self.stack[k] if k >= 0 else Element("", 0, 0, False)
            self.blocks.append(Block(at.path, at.number, self.open["article"] + self.open["main"] > 0, text))

    def _pop_to(self, i: int) -> None:
        while len(self.stack) > i:
            top = self.stack[-1]
            if top.name not in INLINE or top.unwanted:
                self._flush()
            self.stack.pop()
            self.open[top.name] -= 1
            self.unwanted -= top.unwanted
            self.last[top.number] = len(self.parent) - 1

    def _push(self, name: str, attributes: dict[str, str], unwanted: bool) -> None:
        above = self.stack[-1] if self.stack else Element("", 0, 0, False)
        path = above.path
        if name not in INLINE:
            step = (path, " ".join([name, *sorted(attributes.get("class", "").split())]))
            path = self.paths.setdefault(step, len(self.paths) + 1)
        self.parent.append(above.number)
        self.last.append(len(self.parent) - 1)
        self.stack.append(Element(name, len(self.parent) - 1, path, unwanted))
        self.open[name] += 1
        self.unwanted += unwanted

    def _end_of_tag(self, page: str, at: int) -> int:
        """Behind the tag's >, or -1 if there is none. Where a quote has no end, quotes up to it count as any character."""
        begin = at
        while at >= self.plain_to:
            m = QUOTE_OR_END.search(page, at)
            if m is None:
                return -1
            if m[0] == ">":
                return m.end()
            at = page.find(m[0], m.end()) + 1
            if not at:
                self.plain_to = m.end()
                break
        return page.find(">", begin) + 1 or -1

    def _read(self, page: str) -> None:
        at = self.plain_to = 0
        while at < len(page):
            m = OPENING.search(page, at)
            if not m:
                break
            self.parts.append(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
                end = page.find(close, at)
                if m[0] == "<![CDATA[":
                    self.parts.append(html.escape(page[at:] if end < 0 else page[at:end]))
                at = len(page) if end < 0 else end + len(close)
                continue
            end = self._end_of_tag(page, at)
            if end < 0:  # no tag any more: what is left is text
                at = m.start()
                break
            self._tag(page, m, page[at : end - 1], end)
            at = self.at
        self.parts.append(page[at:])

    def _tag(self, page: str, m: re.Match, raw: str, end: int) -> None:
        """One tag; self.at is where reading goes on."""
        self.at, name, stack = end, m[2].lower(), self.stack
        if m[1]:
            if self.open[name]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].name == name:
                        self._pop_to(i)
                        break
                    if name in INLINE and stack[i].name in SCOPE:
                        break
            return
        if name in RAW:
            found = m if raw.rstrip().endswith("/") else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, end)
            self._flush()
            self.at = len(page) if found is None else max(end, found.end())
            return
        if name in VOID:
            if name == "br":
                self.parts.append(" ")
            elif name == "hr":
                self._flush()
            return
        closes = {"p"} if name in CLOSES_P else {"td", "th"} if name in ("td", "th") else {"dt", "dd"} if name in ("dt", "dd") else {name} if name in ("li", "option", "tr") else ()
        if any(self.open[x] for x in closes):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in closes:
                    self._pop_to(i)
                    break
                if stack[i].name in SCOPE:
                    break
        attributes = _attributes(raw) if "=" in raw or "hidden" in raw else {}
        unwanted = _unwanted(name, attributes, self.open["article"] + self.open["main"] > 0)
        if name not in INLINE or unwanted:
            self._flush()
        if not raw.endswith("/") or name in INLINE | CLOSES_P:
            self._push(name, attributes, unwanted)


def smoothed(values: np.ndarray) -> np.ndarray:
    """Means over each block and its two neighbours."""
    padded = np.concatenate([values[:1], values, values[-1:]])
    return (padded[:-2] + padded[1:-1] + padded[2:]) / 3


def path_values(found: list[Block]) -> dict[int, float]:
    """For each path its smoothed text ratio times its smoothed punctuation ratio, weighed by the root of its text's length."""
    length, points, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in found:
        length[b.path] += len(b.text)
        points[b.path] += len(PUNCTUATION.findall(b.text))
        count[b.path] += 1
    text = smoothed(np.array([length[b.path] / count[b.path] for b in found]))
    mark = smoothed(np.array([points[b.path] / count[b.path] for b in found]))
    total = defaultdict(float)
    for b, v in zip(found, (text * (1 + mark)).tolist(), strict=True):
        total[b.path] += v
    return {p: total[p] / count[p] * length[p] ** 0.5 for p in total}


def content_paths(values: dict[int, float]) -> set[int]:
    """Paths whose value reaches a part of the deviation over the page's paths and of the best; the best one always."""
    cut = DEVIATION * float(np.std([*values.values()]))
    best = max(values.values())
    return {p for p, v in values.items() if v == best or (v >= cut and v >= BEST * best)}


def extract(page: str | None) -> str:
    read = Page(page or "")
    if not read.blocks:
        return ""
    values = path_values(read.blocks)
    paths = content_paths(values)
    kept = [b for b in read.blocks if b.path in paths]
    # The best path decides whether the page's own mark of its article is believed.
    if max(kept, key=lambda b: values[b.path]).landmark:
        kept = [b for b in kept if b.landmark]
    low, high = min(b.element for b in kept), max(b.element for b in kept)
    root = kept[0].element
    # A single block is its own smallest element: the article is then the element around it.
    if len(kept) == 1:
        root = max(0, read.parent[root])
    while root > low or read.last[root] < high:
        root = read.parent[root]
    return " ".join(b.text for b in read.blocks if root <= b.element <= read.last[root])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""

    def make():
        def run(columns: list[list]) -> list[list]:
            texts = [extract(p) for p in columns[2]]
            return [columns[0], columns[1], texts, [len(t) for t in texts]]

        return run

    return map_rows(pages, ["page_id", "url", "html"], make, fields("page_id bigint, url string, text string, n_chars bigint"))
