"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Two models of gradient-boosted trees give every block element the probabilities
of being a frame (main text is somewhere below it, other things too), main text,
or something to drop. A tree-shaped Viterbi pass then picks the most likely
labels that do not contradict each other: under what is dropped everything is
dropped, and under main text nothing is a frame. So an advert inside an article
goes, and no paragraph of a menu comes back.

No page comes with labels. The trees are fitted on at most FIT_PAGES pages of
the table (chosen by hash of page_id, at most LONG_PAGE characters each), marked
where they say themselves which element is the article, and on LAID_OUT pages
that are laid out anew from the texts of those pages: known parts under many
tags, class names and nestings, often without any name that tells what they
are. Both bounds are parameters; every page is extracted whole.

Defined results: a null or empty html gives an empty text; text is decoded
(character references), its white space folded within a block, and blocks are
joined by two line feeds; scripts, styles, templates, hidden controls and
comments are never text; a line break is white space within its block; open and
misplaced tags are read as browsers do as far as blocks go; rows that repeat a
page_id each give a row; null ids and urls stay; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from scholia.llm.dom import DROP, FRAME, MAIN, Forest
from scholia.llm.learn import BoostedTrees, sigmoid
from scholia.session import read_table

FIT_PAGES = 250
LONG_PAGE = 60_000
LAID_OUT = 700
#: Pages and characters that go through the arrays at once.
SLICE_PAGES, SLICE_CHARS = 256, 4_000_000
#: By the label above (rows) and below: under main text nothing is a frame, under what is dropped nothing is kept.
CONTRADICTS = np.array([[0.0, 0.0, 0.0], [-np.inf, 0.0, 0.0], [-np.inf, -np.inf, 0.0]])

#: Class names that pages of the training layouts give their parts, and the elements these may be.
PARTS = {
    "menu": ("nav div ul section", "nav navbar menu main-menu navigation breadcrumbs topbar pagination toc tabs"),
    "top": ("header div section", "header masthead site-header banner branding page-top logo"),
    "bottom": ("footer div section", "footer site-footer foot copyright legal colophon imprint bottom"),
    "side": ("aside div section td", "sidebar side widget-area related right-rail popular more recommended secondary"),
    "notice": ("div section dialog aside", "cookie-notice consent alert gdpr-banner notice popup message warning privacy-bar"),
    "advert": ("div aside section p", "ad ads advert advertisement sponsored promo ad-slot adsense partner"),
    "form": ("form div section", "search-form login newsletter signup subscribe contact-form register"),
    "talk": ("section div ol ul", "comments comment-list replies discussion disqus respond reader-comments feedback"),
    "share": ("div ul p", "share social sharing tools follow meta tags actions"),
    "text": ("article main div section td", "article content post entry-content story body-text main post-body article-body text"),
}
NEUTRAL = "row col box wrap inner block x1 c12 unit grid left right container clearfix panel part item holder".split()


class Layouts:
    """Random pages whose parts are marked by the attribute data-part; texts come from the given blocks."""

    def __init__(self, texts: list[str], seed: int = 7):
        self.rng = random.Random(seed)
        self.texts = [t for t in texts if t] or ["lorem ipsum dolor sit amet, consectetur adipiscing elit."]
        self.words = [w for t in self.texts[:2000] for w in t.split()[:40]]

    def some(self, low: int, high: int) -> str:
        return " ".join(self.rng.choices(self.words, k=self.rng.randint(low, high)))

    def sentence(self) -> str:
        return self.some(4, 16).capitalize() + "."

    def paragraph(self) -> str:
        kind = self.rng.random()
        if kind < 0.12:
            return self.some(1, 3).capitalize() + "."
        return self.rng.choice(self.texts) if kind < 0.75 else " ".join(self.sentence() for _ in range(self.rng.randint(1, 6)))

    def open(self, part: str, mark: str | None = None, telling: float = 0.72) -> tuple[str, str]:
        """Start and end tag of a part: an element that may hold it, with a name that tells, one that does not, or none."""
        rng = self.rng
        tags, names = (x.split() for x in PARTS[part])
        tag = tags[0] if rng.random() < 0.45 else rng.choice(tags)
        name, luck = "", rng.random()
        if luck < telling:
            name = rng.choice(names)
            name = rng.choice([name, name, f"site-{name}", f"{name}-wrap", f"js-{name} {rng.choice(NEUTRAL)}", f"{name}Box", f"{name}__inner"])
        elif luck < 0.9 and telling < 0.9:
            name = rng.choice(NEUTRAL)
        if not name and mark == "drop" and tag in ("div", "section", "p", "td", "ul", "ol") and telling > 0.9:
            name = rng.choice(names)  # nothing else would tell such a part from main text
        attribute = f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""
        end = f"</{tag}>"
        start = f"<{tag}{attribute}" + (f' data-part="{mark}">' if mark else ">")
        return ("<table><tr>" + start, end + "</tr></table>") if tag == "td" else (start, end)

    def links(self, low: int, high: int, most: int = 3) -> str:
        return "".join(f'<li><a href="/{i}">{self.some(1, most)}</a></li>' for i in range(self.rng.randint(low, high)))

    def _fill(self, part: str, tag: str) -> str:
        rng = self.rng
        if part == "menu":
            rows = self.links(2, 9)
            return rows if tag in ("<ul", "<ol") else rng.choice([f"<ul>{rows}</ul>", " | ".join(f'<a href="#">{self.some(1, 2)}</a>' for _ in range(rng.randint(2, 7)))])
        if part == "top":
            return rng.choice([f"<h1>{self.some(1, 3)}</h1>", f'<a href="/">{self.some(1, 2)}</a>', f"<p>{self.sentence()}</p>", ""]) + rng.choice(["", f"<p>{self.some(2, 8)}</p>", f"<nav><ul>{self.links(2, 6)}</ul></nav>", f"<form><input><button>{self.some(1, 1)}</button></form>"])
        if part == "bottom":
            return rng.choice([f"&copy; {self.some(1, 3)} &middot; {self.sentence()}", f"<p>&copy; 20{rng.randint(10, 26)} {self.some(1, 4)}</p>", f"<ul>{self.links(2, 6)}</ul><p>{self.sentence()}</p>", f"<p>{self.sentence()} {self.sentence()}</p>"])
        if part == "side":
            return "".join(rng.choice([f"<h3>{self.some(1, 3)}</h3><ul>{self.links(2, 7, 9)}</ul>", f"<div><h4>{self.some(1, 3)}</h4><p>{self.sentence()}</p></div>", f"<p>{self.sentence()} <a href='#'>{self.some(1, 2)}</a></p>"]) for _ in range(rng.randint(1, 3)))
        if part == "notice":
            return rng.choice([f"<p>{self.sentence()} {self.sentence()}</p><button>{self.some(1, 1)}</button>", self.sentence(), f"{self.sentence()} <a href='#'>{self.some(1, 2)}</a>"])
        if part == "advert":
            return rng.choice([self.sentence(), self.sentence() if tag == "<p" else f"<p>{self.sentence()} {self.sentence()}</p>", f'<a href="#">{self.some(2, 7)}</a>', self.some(1, 4)])
        if part == "form":
            inner = f"<label>{self.some(1, 3)} <input></label>" * rng.randint(1, 3) + rng.choice([f"<p>{self.sentence()}</p>", f"<button>{self.some(1, 2)}</button>", f"<select><option>{self.some(1, 1)}</select>", f"<legend>{self.some(1, 3)}</legend>"])
            return inner if tag == "<form" else f"<form>{inner}</form>"
        if part == "talk":
            item = "li" if tag in ("<ol", "<ul") else rng.choice(["div", "article", "p"])
            said = "".join(f"<{item}>{'' if item == 'p' else f'<p>{self.some(1, 2)}</p>' * rng.randint(0, 1)}{self.sentence() if item == 'p' else f'<p>{self.paragraph()}</p>'}</{item}>" for _ in range(rng.randint(1, 5)))
            return (f"<h3>{self.some(1, 3)}</h3>" if item != "li" and rng.random() < 0.7 else "") + said + (f"<form><textarea></textarea><label>{self.some(1, 2)}</label></form>" if rng.random() < 0.3 else "")
        return self.links(2, 5, 1) if tag == "<ul" else " ".join(f'<a href="#">{self.some(1, 2)}</a>' for _ in range(rng.randint(2, 5)))

    def part(self, name: str) -> str:
        start, end = self.open(name, "drop", 0.75 if name in ("menu", "form", "share", "side") else 0.97)
        tag = start.removeprefix("<table><tr>").split(" ")[0].rstrip(">")
        return start + self._fill(name, tag) + end

    def _story(self) -> list[str]:
        """The blocks of an article, as its author put them."""
        rng = self.rng
        kinds = {
            "p": lambda: f"<p>{self.paragraph()}</p>" if rng.random() < 0.85 else f"<p><b>{self.paragraph()}<br>",
            "linked": lambda: f'<p>{self.sentence()} <a href="#">{self.some(1, 4)}</a> {self.sentence()}</p>',
            "list": lambda: "<ul>" + "".join(f"<li>{self.some(2, 12)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>",
            "heading": lambda: f"<h{(k := rng.randint(2, 4))}>{self.some(1, 6)}</h{k}>",
            "quote": lambda: f"<blockquote>{self.sentence()}</blockquote>" if rng.random() < 0.5 else f"<blockquote><p>{self.paragraph()}</p></blockquote>",
            "table": lambda: "<table>" + f"<tr><td>{self.some(1, 3)}</td><td>{rng.randint(1, 999)}</td></tr>" * rng.randint(2, 4) + "</table>",
            "pre": lambda: f"<pre>{self.some(3, 20)}</pre>",
            "figure": lambda: f"<figure><img><figcaption>{self.some(2, 10)}</figcaption></figure>",
        }
        names, odds = list(kinds), [12, 1, 1.2, 1.2, 0.7, 0.4, 0.3, 0.4]
        plain = rng.random() < 0.5
        out = [kinds["p" if plain else rng.choices(names, odds)[0]]() for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 20]))]
        title = f"<h{(k := rng.choice([1, 1, 2]))}>{self.some(2, 12)}</h{k}>"
        if rng.random() < 0.8:
            out.insert(0, title if rng.random() < 0.75 else f"<header>{title}<p>{self.some(2, 6)}</p></header>")
        return out

    def main(self) -> str:
        rng = self.rng
        body = self._story()
        if rng.random() < 0.25 and len(body) > 3:  # sections within the article
            cut = rng.randint(1, len(body) - 1)
            tag = rng.choice(["section", "div"])
            body = [*body[:cut], f"<{tag}>" + "".join(body[cut:]) + f"</{tag}>"]
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            body.insert(rng.randint(0, len(body)), self.part(rng.choice(["advert", "advert", "share", "side", "menu", "form", "form", "notice", "talk"])))
        if rng.random() < 0.25:
            body.append(self.part("talk"))
        if rng.random() < 0.07:  # no element of its own: each block is main text by itself
            return "".join(b if "data-part" in b or not b.startswith(("<p>", "<h", "<ul>", "<pre>")) or b.startswith("<header") else b.replace(">", ' data-part="main">', 1) for b in body if b.startswith(("<p>", "<h", "<ul>", "<pre>", "<div", "<aside", "<nav")) and not b.startswith("<header"))
        start, end = self.open("text", "main", 0.55)
        return start + "".join(body) + end

    def page(self) -> str:
        rng = self.rng
        above = [self.part(p) for p in ("notice", "top", "menu", "advert", "form") if rng.random() < (0.25 if p in ("notice", "form") else 0.5)]
        below = [self.part(p) for p in ("talk", "side", "share", "form", "notice", "advert", "bottom") if rng.random() < (0.6 if p == "bottom" else 0.17)]
        rng.shuffle(above)
        centre = [self.main()] if rng.random() < 0.95 else []
        for _ in range(rng.choice([0, 0, 1, 2])):
            centre.insert(rng.randint(0, len(centre)), self.part(rng.choice(["side", "side", "advert", "menu", "talk"])))
        inner = "".join(centre)
        for _ in range(rng.choice([0, 0, 1, 2])):
            tag, name = rng.choice(["div", "div", "section", "main"]), rng.choice([*NEUTRAL, "page", "site", "content-area", "main"])
            inner = f'<{tag} class="{name}">{inner}</{tag}>'
        return f"<html><body>{''.join(above)}{inner}{''.join(below)}" + rng.choice(["</body></html>", ""])


def _marked(forest: Forest) -> set[int]:
    """Mark pages that name one article (or else one main element) by that; the numbers of those pages."""
    heads: dict[int, list[list[int]]] = {}
    for node, tag in enumerate(forest.tag):
        if tag in (0, 1):
            heads.setdefault(forest.page[node], [[], []])[tag].append(node)
    chosen = {page: (a if a else m)[0] for page, (a, m) in heads.items() if len(a) == 1 or (not a and len(m) == 1)}
    for node, tag in enumerate(forest.tag):
        if chosen.get(forest.page[node]) == node:
            forest.part[node] = MAIN
        elif tag in (4, 5, 7, 8):  # menus, asides, footers and forms, wherever they are
            forest.part[node] = DROP
    return set(chosen)


class MainText:
    """Probabilities of the three labels by node, and the labels of whole pages."""

    def __init__(self, seed: int = 7, trees: int = 50, depth: int = 4):
        self.seed = seed
        self.main, self.frame = BoostedTrees(trees=trees, depth=depth), BoostedTrees(trees=trees, depth=depth)

    def fit(self, pages: list[str], laid_out: int = LAID_OUT) -> MainText:
        real = Forest()
        for source in pages:
            real.add(source)
        known = _marked(real)
        labels = real.labels()
        usable = np.isin(np.array(real.page, dtype=np.int64), list(known))
        texts = [t for node, t, linked in real.blocks if (labels[node] == MAIN and usable[node]) or (not known and len(t) > 80 and linked * 2 < len(t))]
        made, layouts = Forest(), Layouts(texts, self.seed)
        for _ in range(laid_out):
            made.add(layouts.page())
        x, y = np.concatenate([real.features()[usable], made.features()]), np.concatenate([labels[usable], made.labels()])
        self.main.fit(x, (y == MAIN).astype(float))
        self.frame.fit(x, (y == FRAME).astype(float))
        return self

    def evidence(self, features: np.ndarray) -> np.ndarray:
        """Log probabilities of the labels by node, each node by itself."""
        main, frame = (np.clip(sigmoid(trees.decision(features)), 1e-4, 1 - 1e-4) for trees in (self.main, self.frame))
        odds = np.empty((len(features), 3))
        odds[:, FRAME], odds[:, MAIN], odds[:, DROP] = frame * (1 - main), main * (1 - frame), (1 - main) * (1 - frame)
        return np.log(odds / odds.sum(axis=1, keepdims=True))

    def decode(self, forest: Forest) -> np.ndarray:
        """The most likely labels that do not contradict along any branch."""
        score = self.evidence(forest.features())
        parent = np.array(forest.parent, dtype=np.int64)
        levels = forest.levels()
        choice = np.zeros((len(parent), 3), dtype=np.int64)  # best label of a node by its parent's label
        for nodes in reversed(levels[1:]):
            ways = CONTRADICTS[None, :, :] + score[nodes][:, None, :]
            choice[nodes] = ways.argmax(axis=2)
            np.add.at(score, parent[nodes], ways.max(axis=2))
        labels = np.zeros(len(parent), dtype=np.int64)
        for depth, nodes in enumerate(levels):
            labels[nodes] = score[nodes].argmax(axis=1) if depth == 0 else choice[nodes, labels[parent[nodes]]]
        return labels

    def texts(self, pages: list[str | None]) -> list[str]:
        forest = Forest()
        for source in pages:
            forest.add(source)
        return forest.texts(self.decode(forest) == MAIN)


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", rows: int = FIT_PAGES) -> MainText:
    """A model from at most `rows` pages of at most LONG_PAGE characters, and pages laid out from their texts."""
    own = pages.select(F.col(key).alias("id"), F.col(html).alias("html")).filter((F.length("html") <= LONG_PAGE) & F.col("id").isNotNull())
    # The ids are chosen first, so that no task sends pages that another one's ids supersede.
    chosen = own.select("id").orderBy(F.xxhash64("id"), "id").limit(rows).distinct()
    sample = own.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("html").alias("html")).orderBy("id").collect()
    return MainText().fit([r["html"] for r in sample])


def extract(pages: DataFrame, model: MainText, *keep: str, html: str = "html") -> DataFrame:
    """The columns `keep` of pages, text and n_chars: one row per row of pages."""
    schema = StructType([*pages.select(*keep).schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])

    def slices(sources: list[str | None]) -> Iterator[list[str | None]]:
        some: list[str | None] = []
        size = 0
        for source in sources:
            if some and (len(some) >= SLICE_PAGES or size + len(source or "") > SLICE_CHARS):
                yield some
                some, size = [], 0
            some.append(source)
            size += len(source or "")
        if some:
            yield some

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t for part in slices(batch.column(len(keep)).to_pylist()) for t in model.texts(part)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html).cast("string").alias("page_html")).mapInArrow(run, schema)


def op13_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract(pages, fit(pages), "page_id", "url")


QUERIES = {"op13_maintext": op13_maintext}
ORACLES: dict = {}
