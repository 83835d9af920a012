import random

import pytest
from pyspark.sql import functions as F

from scholia.llm import decontam as D


def hits_of(spark, scratch, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = D.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), scratch)
    return {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.n_slots) for r in docs.select("doc_id", D.text_key(F.col("text")).alias("t")).join(hits, "t").collect()}


def test_first_words_may_be_names(spark, scratch):
    item = "Carol has 5 apples and 7 pears in her house."
    kettles = "Copper kettles whistle loudly on cold mornings"
    texts = [
        "Dave has 9 apples and 4 pears in her house.",
        "so Dave has 9 apples and 4 pears in her house.",
        "It is late. dave has 9 apples and 4 pears in her house.",
        "Dave has 9 apples and 9 pears in her house.",  # one text value for two item values
        "Dave had 9 apples and 4 pears in his house.",
        "we say nothing of copper kettles here",
        "Here kettles whistle loudly on cold mornings",
    ]
    got = hits_of(spark, scratch, texts, [item, kettles])
    assert set(got) == {(0, 0), (1, 0), (6, 1)}


def test_numerals_and_units_of_four_languages(spark, scratch):
    items = [
        "a boy sells 12 apples for 30 dollars each day in town.",
        "the cart can carry 5 kg of sand over the old bridge.",
        "der Zug braucht 4 Stunden bis in die kleine Stadt am Meer.",
        "le train met 4 heures pour aller à la petite ville.",
        "el tren tarda 4 horas en llegar a la ciudad pequeña.",
    ]
    texts = [
        "a boy sells twelve apples for thirty dollars each day in town.",
        "the cart can carry 9 tons of sand over the old bridge.",
        "der Zug braucht fünfundzwanzig Minuten bis in die kleine Stadt am Meer.",
        "le train met trois jours pour aller à la petite ville.",
        "el tren tarda veinte minutos en llegar a la ciudad pequeña.",
        "a boy sells Twenty-five apples for one hundred and six euros each day in town.",
    ]
    assert set(hits_of(spark, scratch, texts, items)) == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 0)}


@pytest.mark.parametrize(("text", "want"), [("Twelve men, twenty-one boats", "N O"), ("5 kg or 5,5kg", "NU w NU"), ("Tone and tenor phone someone", "O w w w w"), ("sixty miles; 60 miles", "NU NU")])
def test_tokens(spark, text, want):
    marks = {D.NAME: "P", D.NUMBER: "N", D.UNIT: "U", D.OPEN: "O"}
    got = spark.createDataFrame([(text,)], "text string").select(D.surface(F.col("text"))).first()[0]
    kinds = [marks.get(x[0], "w") for x in got.split(" ")]
    if text.startswith("Twelve"):
        assert kinds == ["N", "w", "N", "w"]
    else:
        assert "".join(kinds) == want.replace(" ", "")


def brute(texts, items, tokens, window, least):
    """Every shift of every pair, token by token, by the stated rule."""
    out = {}
    names = {D.NAME, D.OPEN}
    marks = names | {D.NUMBER, D.UNIT}

    def value(x):
        return x.translate({ord(m): None for m in marks})

    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            a, b = tokens[item], tokens[text]
            need = min(len(a), window)
            if len(a) < least:
                continue
            for shift in range(-len(a) + 1, len(b)):
                pairs = [(a[k], b[k + shift]) for k in range(len(a)) if 0 <= k + shift < len(b)]
                codes = []
                for x, y in pairs:
                    one, two = x[0] if x[0] in marks else None, y[0] if y[0] in marks else None
                    alike = one and two and (one == two or {one, two} <= names)
                    codes.append(2 if x == y or (one or two) and value(x) == value(y) else 1 if alike else 0)
                slots = [x[0] in marks and y[0] in marks and (x[0] == y[0] or {x[0], y[0]} <= names) and not (x[0] == y[0] == D.OPEN and x == y) for x, y in pairs]
                starts = [s for s in range(len(pairs) - need + 1) if 0 not in codes[s : s + need]]
                under = {k for s in starts for k in range(s, s + need)}
                enough = 2 * sum(slots[k] for k in under) <= len(under)
                for s in starts:
                    own = {(x, y) for (x, y), z in zip(pairs[s : s + need], slots[s : s + need], strict=True) if z}
                    consistent = len({x for x, _ in own}) == len(own) == len({y for _, y in own})
                    if 1 not in codes[s : s + need] or consistent and (enough or 2 * sum(slots[s : s + need]) <= need):
                        out[t, i] = True
    return set(out)


def test_random_templates_equal_brute_force(spark, scratch):
    rng = random.Random(11)
    words = "river stone market bridge carries every evening old small under between garden letter window".split()
    names, units = ["Anna", "Bruno", "Clara", "Dover", "Edgar"], ["kg", "miles", "hours", "Stunden"]

    def slot():
        return rng.choice([lambda: rng.choice(names), lambda: str(rng.randint(2, 60)), lambda: f"{rng.randint(2, 60)} {rng.choice(units)}"])()

    items = [" ".join(slot() if rng.random() < 0.3 else rng.choice(words) for _ in range(n)) for n in (5, 7, 8, 9, 10, 11, 12, 13, 15, 20, 26)]
    texts = []
    for _ in range(90):
        item = rng.choice(items).split()
        kind = rng.random()
        change = {x: rng.choice(names) if x in names else str(rng.randint(2, 60)) for x in item if x in names or x.isdigit()}
        body = [change[x] if x in change and kind < 0.6 else x for x in item]
        if kind > 0.85 and len(body) > 3:
            body[rng.randrange(len(body))] = rng.choice(words)
        body = body[rng.randint(0, 2) :] if rng.random() < 0.2 else body
        texts.append(" ".join([rng.choice(words) for _ in range(rng.randint(0, 6))] + body + [rng.choice(words) for _ in range(rng.randint(0, 6))]))
    texts = list(dict.fromkeys(texts))
    rows = spark.createDataFrame([(x,) for x in {*texts, *items}], "text string").select("text", F.split(D.surface(F.col("text")), " ").alias("s")).collect()
    want = brute(texts, items, {r.text: r.s for r in rows}, D.WINDOW, D.LEAST)
    got = set(hits_of(spark, scratch, texts, items))
    assert got <= want and len(got) > 40
    # What is left mixes changed names with opening words in each of its probes.
    assert len(want - got) <= len(want) // 20
