import html
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from scholia.llm import maintext
from scholia.llm.dom import DROP, FRAME, MAIN, Forest

PAGES = pq.read_table("/root/testdata/sf0.1/pages.parquet").to_pylist()
LONG = "Rivers carry sand and gravel from the hills to the sea, and they sort it on the way."
SHORT = "Some of it stays."


@pytest.fixture(scope="module")
def model():
    return maintext.MainText().fit([p["html"] for p in PAGES[:250]])


def blocks(source):
    forest = Forest()
    forest.add(source)
    return [text for _, text, _ in forest.blocks]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, []),
        ("", []),
        ("plain & simple", ["plain & simple"]),
        ("<p>a <b>bold\n  word</b><p>next&nbsp;one &lt;tag&gt; &#233; &am", ["a bold word", "next one <tag> é &am"]),
        ("<p>one<br>two<br/>three</p>", ["one two three"]),
        ("<div>a<p>b</p>c</div>d", ["a", "b", "c", "d"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<p>x<script>if (a < b) document.write('<p>no</p>')</script>y<style>p{}</style></p><!-- <p>no</p> -->", ["xy"]),
        ("<title>no</title><textarea><p>no</textarea><noscript><p>no</p></noscript><p>yes", ["yes"]),
        ("<select><option>no</select><p>yes <button>no</button>again</p><svg><text>no</text></svg>", ["yes again"]),
        ("<p title=\"a > b\" data-x='<p>'>yes</p>", ["yes"]),
        ("<p title=\"open>yes</p><p>two", ["yes", "two"]),
        ("a < b and 3 > 2 <p", ["a < b and 3 > 2"]),
        ("</div></p>x</section><div><span>y</div>z", ["x", "y", "z"]),
        ("<div><button>no<div>no</div></div><p>yes", ["yes"]),
        ("<script>never closed <p>no", []),
        ("<h1>a<h2>b</h2><dl><dt>c<dd>d<dt>e</dl>", ["a", "b", "c", "d", "e"]),
    ],
)
def test_blocks_of_pages(source, want):
    assert blocks(source) == want


def test_nesting_of_any_depth():
    assert blocks("<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]
    forest = Forest()
    forest.add("<div><div>" * 2000 + "x")
    assert forest.features().shape[0] == 4001 and np.isfinite(forest.features()).all()


def stripped(source):
    """The article element's blocks, by cutting the page up as text."""
    inner = source[source.index("<article>") + 9 : source.index("</article>")]
    parts = (re.sub(r"</?b>", "", x).replace("<br>", " ") for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(t for x in parts if (t := " ".join(html.unescape(x).split())))


def test_pages_of_the_table_equal_their_articles(model):
    rest = [p["html"] for p in PAGES[250:1250]]
    assert model.texts(rest) == [stripped(x) for x in rest]


def test_layouts_that_were_not_learned(model):
    """Other seed, other texts; part of these pages give their parts no name that tells."""
    forest = Forest()
    for p in PAGES[1300:1400]:
        forest.add(p["html"])
    layouts = maintext.Layouts([t for _, t, _ in forest.blocks if len(t) > 100], seed=2024)
    made = Forest()
    for _ in range(300):
        made.add(layouts.page())
    truth, found = made.labels(), model.decode(made)
    chars = np.zeros(2)
    for node, text, _ in made.blocks:
        if truth[node] == MAIN:
            chars += (len(text) if found[node] == MAIN else 0, len(text))
    assert chars[0] / chars[1] > 0.97
    want, got = made.texts(truth == MAIN), made.texts(found == MAIN)
    assert sum(a == b for a, b in zip(want, got, strict=True)) > 0.8 * len(want)


def test_labels_never_contradict(model):
    layouts = maintext.Layouts([LONG], seed=3)
    made = Forest()
    for _ in range(100):
        made.add(layouts.page())
    labels = model.decode(made)
    for node, above in enumerate(made.parent):
        if above >= 0:
            assert labels[above] == FRAME or labels[node] == DROP or (labels[node], labels[above]) == (MAIN, MAIN)


def test_decoding_is_the_best_of_all_consistent_labels(model):
    made = Forest()
    made.add(f"<div class='post'><p>{LONG}</p><div class='ad'><p>{SHORT}</p></div></div><div class='footer'><p>{SHORT}</p></div>")
    score, parent = model.evidence(made.features()), made.parent
    best = None
    for code in range(3 ** len(parent)):
        labels = [code // 3**i % 3 for i in range(len(parent))]
        if all(a < 0 or np.isfinite(maintext.CONTRADICTS[labels[a], labels[i]]) for i, a in enumerate(parent)):
            value = sum(score[i, x] for i, x in enumerate(labels))
            if best is None or value > best[0]:
                best = (value, labels)
    assert list(model.decode(made)) == best[1]


STORY = f"<h1>On rivers</h1><p>{LONG} {LONG}</p><p>{SHORT}</p><p>{LONG} <a href='/x'>More on sand</a> {LONG}</p>"
TOLD = f"On rivers\n\n{LONG} {LONG}\n\n{SHORT}\n\n{LONG} More on sand {LONG}"
MENU = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/c'>Contact us</a></li></ul>"


@pytest.mark.parametrize(
    "source",
    [
        f"<body><div id='header'><a href='/'>The Site</a><p>Since 1990</p></div><div id='nav'>{MENU}</div><div id='content'>{STORY}</div><div id='sidebar'><h3>Popular</h3>{MENU}</div><div id='footer'><p>&copy; 2020 The Site. All rights reserved.</p></div></body>",
        f"<header><nav>{MENU}</nav></header><main><article>{STORY}</article></main><aside><h3>Related</h3>{MENU}</aside><footer>&copy; The Site</footer>",
        f"<nav>{MENU}</nav><article class='post'>{STORY}<div class='ad'>Buy our boots today, they last for years.</div></article><section class='comments'><h3>2 comments</h3><p>I liked this text about rivers a lot, thank you for it.</p><p>{LONG}</p></section>",
        f"<div class='cookie-banner'><p>We use cookies to give you the best service. Do you agree?</p><button>Yes</button></div><div class='container'><div class='entry-content'>{STORY}<form class='newsletter'><label>Your mail <input></label><p>Get our letter each week.</p></form></div></div>",
        f"<div class='wrapper'><div class='menu'>{MENU}</div><div class='article-body'>{STORY}</div><div id='disqus_thread'><div class='comment'><p>{LONG}</p></div></div></div><script>var x = '<p>no</p>';</script>",
        f"<article>{STORY}</article>",
        f"<main>{STORY}<aside class='advert'><p>Come and see the new shop in the old town.</p></aside></main><footer><p>Imprint and privacy.</p></footer>",
    ],
)
def test_usual_pages(model, source):
    assert model.texts([source]) == [TOLD]


def test_extract_keeps_rows_and_columns(spark, model):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (2, None, "", "x"), (None, "v", f"<nav>{MENU}</nav><article>{STORY}</article>", None), (3, "w", f"<nav>{MENU}</nav>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in maintext.extract(pages, model, "page_id", "url").collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (2, None, "", 0), (None, "v", TOLD, len(TOLD)), (3, "w", "", 0)], key=repr)


def test_tables_without_pages_or_articles(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert maintext.extract(empty, maintext.fit(empty), "page_id", "url").collect() == []


def test_long_pages_are_whole(model):
    source = f"<nav>{MENU}</nav><article><h1>On rivers</h1>" + f"<p>{LONG}</p>" * 20_000 + "</article>"
    assert model.texts([source, None])[0].count("\n\n") == 20_000
