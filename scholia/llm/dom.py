"""Block elements of web pages as nodes of a tree, their features, and their texts.

Only block elements are nodes; inline markup is passed over, so the text between
two block boundaries is one block that belongs to one node. All pages of a batch
share the arrays of one Forest, and sums over subtrees run level by level.
"""

from __future__ import annotations

import html
import re

import numpy as np

# Element names by what a browser does with them.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LISTS = ("ul", "ol", "dl", "menu", "dir")
ITEMS = ("li", "dt", "dd")
TABLES = ("table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th")
QUOTES = ("blockquote", "pre", "figure", "figcaption")
FORMS = ("form", "fieldset", "legend")
BLOCKS = frozenset((*HEADINGS, *LISTS, *ITEMS, *TABLES, *QUOTES, *FORMS, "address", "article", "aside", "center", "details", "dialog", "div", "footer", "header", "hgroup", "main", "nav", "p", "search", "section", "summary"))
#: Their content is no text of the page: it runs up to the end tag, whatever it holds.
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
#: Their content is markup, but not text to read.
HIDDEN = frozenset("select button svg canvas audio video object map datalist".split())
CONTROLS = frozenset("input select textarea button label option".split())
#: A new one ends the open one of the same kind, up to the element that holds such things.
_SAME = {"li": (("li",), LISTS), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "thead", "tbody", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)), "thead": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",)), "tfoot": (("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",))}

#: Words in class, id, role and label attributes by the part of a page they name.
TOKENS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar tabs pagination pager toc sitemap skip",
    "top": "header masthead head banner logo branding title hero",
    "bottom": "footer foot copyright legal colophon bottom imprint",
    "side": "sidebar aside side rail widget related recommended trending popular more teaser complementary",
    "notice": "cookie cookies consent gdpr notice alert notification popup modal overlay message warning toast privacy",
    "advert": "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted commercial partner adslot adbox",
    "form": "form search login signin signup subscribe newsletter register contact",
    "talk": "comment comments commentlist reply replies discussion disqus respond thread reader readers feedback review reviews",
    "share": "share sharing social follow tools toolbar actions meta tags byline",
    "text": "content main article articlebody post entry story body text prose maincontent copy",
}
_GROUP = {word: 1 << i for i, words in enumerate(TOKENS.values()) for word in words.split()}
_TAGS = [("article",), ("main",), ("div",), ("section",), ("nav", "menu"), ("aside",), ("header",), ("footer",), FORMS, ("p",), HEADINGS, ("ul", "ol", "dl", "dir"), ITEMS, TABLES, QUOTES]
_TAG = {tag: i for i, tags in enumerate(_TAGS) for tag in tags}
#: Tag groups whose presence above a node is a feature.
_ABOVE = (0, 1, 4, 5, 6, 7, 8, 11, 13)

_TOKEN = re.compile(r"""<!--.*?(?:-->|--!>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|data-part)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
_STOPS = re.compile(r"[.!?…](?=\s|$)")
_DIGITS = re.compile(r"\d")

FRAME, MAIN, DROP = 0, 1, 2
_PARTS = {"main": MAIN, "drop": DROP}


class Forest:
    """The block trees of a batch of pages; node 0 of every page is its body."""

    def __init__(self):
        self.tag: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.page: list[int] = []
        self.group: list[int] = []
        self.part: list[int] = []  # of training pages: what an attribute says, or -1
        self.controls: list[int] = []
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters inside links
        self.pages = 0

    def _node(self, tag: str, parent: int, attributes: str) -> int:
        group, part = 0, -1
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                value = m.group(2) or m.group(3) or m.group(4) or ""
                if m.group(1).lower() == "data-part":
                    part = _PARTS.get(value, -1)
                    continue
                for word in _WORD.findall(value):
                    group |= _GROUP.get(word.lower(), 0)
        self.tag.append(_TAG.get(tag, -1))
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.page.append(self.pages)
        self.group.append(group)
        self.part.append(part)
        self.controls.append(0)
        return len(self.tag) - 1

    def add(self, source: str | None) -> None:
        """Read one page; null is an empty one."""
        source = source or ""
        body = self._node("", -1, "")
        stack: list[tuple[str, int]] = [("", body)]
        opened: dict[str, int] = {}
        text: list[str] = []
        linked = 0
        link_from = 0  # stack size where the open link began, 0 without one
        hidden: list[str] = []

        def put(piece: str) -> None:
            nonlocal linked
            if hidden or not piece:
                return
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if link_from:
                linked += len(piece.strip())

        def flush() -> None:
            nonlocal linked
            if text:
                whole = " ".join("".join(text).split())
                if whole:
                    self.blocks.append((stack[-1][1], whole, linked))
                text.clear()
            linked = 0

        def close(down_to: int) -> None:
            nonlocal link_from
            flush()
            while len(stack) > down_to:
                opened[stack.pop()[0]] -= 1
            if link_from > len(stack):
                link_from = 0

        def end_open(names: tuple[str, ...], within: tuple[str, ...]) -> None:
            lowest = 0
            for at in range(len(stack) - 1, 0, -1):
                if stack[at][0] in within:
                    break
                if stack[at][0] in names:
                    lowest = at
            if lowest:
                close(lowest)

        at = 0
        while (m := _TOKEN.search(source, at)) is not None:
            put(source[at : m.start()])
            at = m.end()
            if m.group(2) is None:
                continue
            ends, tag = bool(m.group(1)), m.group(2).lower()
            if tag in CONTROLS and not ends:
                self.controls[stack[-1][1]] += 1
            if tag in RAW:
                if not ends:
                    closing = _ENDS[tag].search(source, at)
                    at = closing.end() if closing else len(source)
            elif tag in HIDDEN:
                if not ends and not m.group(3).endswith("/"):
                    hidden.append(tag)
                elif ends and tag in hidden:
                    while hidden.pop() != tag:
                        pass
            elif tag in BLOCKS:
                if hidden:
                    if not ends or not opened.get(tag):
                        continue
                    hidden.clear()  # never closed: a block that began before it ends here
                if ends:
                    if opened.get(tag):
                        low = len(stack) - 1
                        while stack[low][0] != tag:
                            low -= 1
                        close(low)
                    continue
                if opened.get("p"):
                    end_open(("p",), ("td", "th", "caption"))
                if tag in _SAME:
                    end_open(*_SAME[tag])
                elif tag in HEADINGS and stack[-1][0] in HEADINGS:
                    close(len(stack) - 1)
                flush()
                node = self._node(tag, stack[-1][1], m.group(3))
                stack.append((tag, node))
                opened[tag] = opened.get(tag, 0) + 1
            elif tag in ("br", "hr", "body", "html", "head"):
                if tag == "br":
                    put(" ")
                else:
                    flush()
            elif tag == "a" and not hidden:
                link_from = 0 if ends else len(stack)
        put(source[at:])
        flush()
        self.pages += 1

    def levels(self) -> list[np.ndarray]:
        """Nodes by depth, the roots first."""
        depth = np.array(self.depth)
        order = np.argsort(depth, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(order) else []

    def features(self) -> np.ndarray:
        """One row per node: density of the subtree, attribute words, tags, depth, and siblings."""
        n = len(self.tag)
        parent, page, depth = np.array(self.parent, dtype=np.int64), np.array(self.page, dtype=np.int64), np.array(self.depth, dtype=float)
        tag, group = np.array(self.tag, dtype=np.int64), np.array(self.group, dtype=np.int64)
        up = np.maximum(parent, 0)
        # characters, in links, words, sentence ends, digits, blocks, nodes, paragraphs, items, controls
        sums = np.zeros((n, 10))
        longest, before = np.zeros(n), np.full(n, np.inf)
        seen = np.zeros(max(self.pages, 1))
        for node, text, linked in self.blocks:
            row = sums[node]
            size = len(text)
            row[0] += size
            row[1] += min(linked, size)
            row[2] += text.count(" ") + 1
            row[3] += len(_STOPS.findall(text))
            row[4] += len(_DIGITS.findall(text))
            row[5] += 1
            longest[node] = max(longest[node], size)
            before[node] = min(before[node], seen[self.page[node]])
            seen[self.page[node]] += size
        sums[:, 6], sums[:, 7], sums[:, 8], sums[:, 9] = 1, tag == _TAG["p"], tag == _TAG["li"], np.array(self.controls)
        own = sums[:, 0].copy()
        levels = self.levels()
        for nodes in reversed(levels[1:]):
            np.add.at(sums, parent[nodes], sums[nodes])
            np.maximum.at(longest, parent[nodes], longest[nodes])
            np.minimum.at(before, parent[nodes], before[nodes])
        above_tags, above_groups = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        for nodes in levels[1:]:
            p = parent[nodes]
            above_tags[nodes] = above_tags[p] | np.where(tag[p] >= 0, 1 << np.maximum(tag[p], 0), 0)
            above_groups[nodes] = above_groups[p] | group[p]
        chars, links, words, stops, digits, blocks, nodes_in, paragraphs, items, controls = sums.T
        total = np.maximum(seen[page], 1)
        density = links / np.maximum(chars, 1)
        size = np.log1p(chars)
        # Children of one parent stand in page order: neighbours, place and number among siblings.
        order = np.lexsort((np.arange(n), parent))
        first = np.concatenate(([True], parent[order][1:] != parent[order][:-1])) if n else np.zeros(0, dtype=bool)
        run = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        counts = np.bincount(run, minlength=len(starts))
        place, number = np.empty(n), np.empty(n)
        place[order], number[order] = np.arange(n) - starts[run], counts[run]
        mean_size, mean_density, text_around = np.empty(n), np.empty(n), np.empty(n)
        for out, values in ((mean_size, size), (mean_density, density), (text_around, chars)):
            out[order] = (np.bincount(run, weights=values[order], minlength=len(starts)) / np.maximum(counts, 1))[run]
        same = np.empty(n)
        kinds = tag[order] + 1 + run * (len(_TAGS) + 1)
        _, inverse, repeats = np.unique(kinds, return_inverse=True, return_counts=True)
        same[order] = repeats[inverse]
        previous, following = np.full(n, -1), np.full(n, -1)
        if n:
            inner = np.flatnonzero(~first)
            previous[order[inner]], following[order[inner - 1]] = order[inner - 1], order[inner]
        before_size, before_links = np.where(previous >= 0, size[previous], -1.0), np.where(previous >= 0, density[previous], -1.0)
        after_size, after_links = np.where(following >= 0, size[following], -1.0), np.where(following >= 0, density[following], -1.0)
        columns = [
            size, density, np.log1p(chars / np.maximum(nodes_in, 1)), np.log1p(words / np.maximum(blocks, 1)), stops / np.maximum(blocks, 1), stops / np.maximum(words, 1),
            np.log1p(longest), digits / np.maximum(chars, 1), chars / total, np.where(np.isfinite(before), before, total) / total, np.log1p(own), own / np.maximum(chars, 1),
            np.log1p(paragraphs), np.log1p(items), items / np.maximum(nodes_in, 1), controls, depth, np.log1p(place), place / np.maximum(number, 1), np.log1p(number),
            same / np.maximum(number, 1), chars / np.maximum(chars[up], 1), mean_size, mean_density, size - np.log1p(text_around), size[up], density[up], before_size, before_links, after_size, after_links,
        ]
        columns += [tag == i for i in range(len(_TAGS))] + [(above_tags >> i) & 1 for i in _ABOVE]
        columns += [(group >> i) & 1 for i in range(len(TOKENS))] + [(above_groups >> i) & 1 for i in range(len(TOKENS))]
        return np.stack([np.asarray(c, dtype=float) for c in columns], axis=1) if n else np.zeros((0, len(columns)))

    def labels(self) -> np.ndarray:
        """What the nodes of marked pages are: the nearest mark at or above them, else a frame if main text is below, else to drop."""
        part, parent = np.array(self.part, dtype=np.int64), np.array(self.parent, dtype=np.int64)
        levels = self.levels()
        for nodes in levels[1:]:
            open_ = nodes[part[nodes] < 0]
            part[open_] = part[parent[open_]]
        holds = part == MAIN
        for nodes in reversed(levels[1:]):
            np.logical_or.at(holds, parent[nodes], holds[nodes])
        return np.where(part >= 0, part, np.where(holds, FRAME, DROP))

    def texts(self, keep: np.ndarray) -> list[str]:
        """Per page the blocks of the kept nodes, in page order."""
        out: list[list[str]] = [[] for _ in range(self.pages)]
        for node, text, _ in self.blocks:
            if keep[node]:
                out[self.page[node]].append(text)
        return ["\n\n".join(x) for x in out]
