import hashlib
import re

import pytest
from pyspark.sql import functions as F

from scholia.llm import decontam, mixing, neardup, pii, toxicity

SCHEMA = "doc_id long, text string, source string, mix_size_note string"


def water_fill(sizes, weights, most):
    """Targets by the rule as stated: share, stop, share the excess again."""
    target, open_ = {}, set(sizes)
    rest = sum(sizes.values())
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: weights[s] * rest / total for s in open_}
        full = {s for s in open_ if share[s] > most * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


def test_mix_matches_the_stated_rule(spark):
    rows = [(i, "w " * (i % 7) if i % 9 else None, ["a", "b", "c", None, "é"][i % 5] if i < 60 else "a", "x") for i in range(300)]
    got = mixing.mix_plan(spark.createDataFrame(rows, SCHEMA)).collect()
    sizes = {}
    for r in got:
        assert r.mix_size == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    for r in got:
        assert r.mix_target == pytest.approx(want[r.source]) and r.mix_source_size == sizes[r.source]
        assert 0 <= r.mix_copies <= 3 and abs(r.mix_copies - r.mix_target / max(1, r.mix_source_size)) < 1
    again = mixing.mix_plan(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "mix_copies").collect()
    assert sorted(again) == sorted((r.doc_id, r.mix_copies) for r in got)


def test_mix_emits_each_copy(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", "x") for i in range(9)], SCHEMA)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "copy_no"] and out.count() == 9
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(None, None, None, None)], SCHEMA)).count() == 0


def test_salted_sources_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 5), "ab"[i % 2], "x") for i in range(50)], SCHEMA)
    plan = sorted(mixing.mix_plan(docs).select("doc_id", "mix_copies").collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix_plan(docs).select("doc_id", "mix_copies").collect()) == plan


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            bad = kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15
            if not bad:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


TEXTS = ["a@b.c_d@e.f x@y.z", "1.2.3.4.5.6.7.8 and 999.1.1.1 and 001.002.003.004", "card 4111 1111 1111 1111, not 4111 1111 1111 1112", "call +1 (499) 555-6503 now", "😀 a@b.co é +44 20 7946 0958", None, "", "1" * 60_000, "b" * 60_000 + "@c.de", "+" * 300]


def test_base_spans_equal_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.base_spans(rows).select("doc_id", pii._joined(F.col("pii_base")).alias("got")).collect():
        assert r.got == brute(TEXTS[r.doc_id]), r.doc_id


def test_contexts_find_what_patterns_miss(spark, scratch):
    rows = [(i, f"please my number is +1 (499) 555-{1000 + i} thanks") for i in range(60)] + [(100, "well my number is 0499-555-777 ok"), (101, "in the year 20240607 it rained"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    per, more = pii.find_pii(docs, scratch)
    found = {r.pii_key: r.pii_extra for r in more.collect()}
    assert set(found) == {100}
    assert [(s.kind, rows[60][1][s.start : s.end]) for s in found[100]] == [("phone", "0499-555-777")]
    assert per.count() == len(rows)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[100] == "well my number is [PHONE] ok" and clean[101] == rows[61][1] and clean[None] is None
    assert clean[3] == "please my number is [PHONE] thanks"


def test_found_identifiers_become_seeds(spark, scratch):
    rows = [(i, f"my number is +1 (499) 555-{1000 + i} thanks") for i in range(60)]
    rows += [(100 + i, f"my number is 0499-555-7{i:02} ok") for i in range(10)]
    rows += [(200 + i, f"please ring up 0499-555-7{i:02} now") for i in range(6)] + [(300, "please ring up 0171-222-333 now")]
    rows += [(400 + i, f"part code is {100000 + i} x") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.pii_key: [s.kind for s in r.pii_extra] for r in pii.find_pii(docs, scratch)[1].collect()}
    assert found == {d: ["phone"] for d, _ in rows if 100 <= d <= 300}


def test_context_reaches_over_numbers_and_groups(spark, scratch):
    rows = [(i, f"on line 2 phone +1 (499) 555-{1000 + i} thanks") for i in range(20)] + [(100 + i, f"write me at user{i}@mail.example.org soon") for i in range(20)]
    rows += [(200, "on line 2 phone 0499-555-777 ok"), (201, "on line 2 phone 030 12 34 56 ok"), (202, "write me at someone@localhost soon"), (203, "on line 2 phone none, or so")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = {r.pii_key: [(s.kind, texts[r.pii_key][s.start : s.end]) for s in r.pii_extra] for r in pii.find_pii(docs, scratch)[1].collect()}
    assert found == {200: [("phone", "0499-555-777")], 201: [("phone", "030 12 34 56")], 202: [("email", "someone@localhost")]}


ITEM = "A farmer named Alice sells 12 apples and 12 pears for 30 dollars each day in the big market of her town."


def test_templates_catch_new_parameters(spark, scratch):
    texts = {
        1: "x y. " + ITEM.replace("Alice", "Carol").replace("12", "47").replace("30", "99") + " zz",
        2: ITEM.replace("12 pears", "48 pears").split(" market")[0],
        3: None,
        4: "Nothing of it here, only other words about a farmer and the market.",
        5: ITEM.upper().replace(" ", "###  ") + " tail",
        6: ITEM,
        7: ITEM,
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None)], "item_id long, text string")
    hits = decontam.contaminated(docs, items, scratch)
    got = {(r.doc_id, r.item_id) for r in docs.select("doc_id", decontam.text_key(F.col("text")).alias("t")).join(hits, "t").collect()}
    assert {(1, 1), (6, 1), (7, 1)} <= got and not got & {(2, 1), (3, 1), (4, 1)}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect()) == sorted(set(texts) - {d for d, _ in got})
    assert decontam.drop_contaminated(docs.limit(0), items).count() == 0
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == len(texts)


def hits_of(spark, scratch, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = decontam.contaminated(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), scratch)
    return {(r.doc_id, r.item_id): r for r in docs.select("doc_id", decontam.text_key(F.col("text")).alias("t")).join(hits, "t").collect()}


def test_an_edit_elsewhere_clears_no_window(spark, scratch):
    item = ITEM + " Every evening she walks home by the river and counts what her 12 friends have earned."
    both = item.replace("12 apples", "47 apples").replace("12 friends", "48 friends")
    got = hits_of(spark, scratch, [item.replace("12 pears", "48 pears"), both.replace("12 pears", "49 pears"), ITEM.replace("12 pears", "48 pears").split(" market")[0]], [item, ITEM])
    assert {(0, 0), (0, 1), (1, 0), (1, 1)} <= set(got)
    assert not {(2, 0), (2, 1)} & set(got)  # every agreeing window holds both twelves
    assert (got[0, 1].n_windows, got[0, 1].n_matched, got[0, 1].n_slots) == (4, 16, 3)


def test_verbatim_passages_need_no_literals(spark, scratch):
    item = "mix 5 kg 10 eur 7 km 3 days 12 hours 40 miles 6 oz 8 lbs then"
    got = hits_of(spark, scratch, ["zz " + item + " zz", item.replace("5", "6").replace("10", "11").replace("7", "9").replace("12", "13").replace("40", "41").replace("8", "2")], [item])
    assert set(got) == {(0, 0)}


def test_very_many_slots_in_one_text(spark, scratch):
    item = " ".join(str(100 + i % 50) for i in range(200))
    apart = " ".join(str(500 + i) for i in range(200))
    got = hits_of(spark, scratch, [" ".join(str(100 + i % 50) for i in range(1500)), " ".join(str(900 + i) for i in range(1500))], [item, apart])
    assert set(got) == {(0, 0)} and (got[0, 0].n_windows, got[0, 0].n_slots) == (188, 200)


def test_case_and_wrapping_hide_no_passage(spark, scratch):
    long = "then Anna and Bruno met Clara near Dover while Edgar took Frida and Georg to see Hanna in Ipswich"
    short = "Copper kettles whistle loudly on cold mornings"
    changed = ITEM.replace("12", "47").replace("30", "99").lower()
    texts = [ITEM.upper().replace(" ", "###  ") + " tail", "we say Copper" + short[6:] + " here", long.lower(), long.upper(), long.replace(" ", "\n"), long.replace(" ", "  "), changed, "we say nothing of copper kettles here"]
    got = hits_of(spark, scratch, texts, [ITEM, short, long])
    assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 2), (4, 2), (5, 2), (6, 0)}


@pytest.mark.parametrize("clash", ["mix_size copy_no mix_source row size", "pii_text pii_key start", "t own_t surface", "tox_score tox_text score"])
def test_clashing_columns_pass_through_every_stage(spark, clash):
    names = clash.split()
    docs = spark.createDataFrame([(i, f"mail a{i}@b.org now please do write", "s", 9, *[f"{n}{i}" for n in names]) for i in range(4)], ", ".join(["doc_id long, text string, source string, n_chars long", *[f"{n} string" for n in names]]))
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    stages = [lambda d: toxicity.drop_toxic(d, labels), neardup.keep_one, lambda d: decontam.drop_contaminated(d, benchmark), pii.redact, mixing.mix, mixing.mix_plan]
    for stage in stages:
        got = stage(docs)
        assert got.columns[: len(docs.columns)] == docs.columns and len({c.lower() for c in got.columns}) == len(got.columns)
        assert {r.doc_id: [r[n] for n in names] for r in got.collect()} == {i: [f"{n}{i}" for n in names] for i in range(4)}


def test_very_many_matches_in_one_text(spark, scratch):
    text = " a@b.org " * 3_000 + "end"
    docs = spark.createDataFrame([(1, text), (2, "é😀 a@b.org, x"), (3, " ".join(f"n{100000 + i}" for i in range(100_000)))], "doc_id long, text string")
    spans = {r.pii_key: r.pii_base for r in pii.find_pii(docs, scratch)[0].collect()}
    assert [(s.start, s.end) for s in spans[1]] == [m.span() for m in re.finditer(r"a@b\.org", text)] and len(spans[2]) == 1
    clear = {r.doc_id: r.text for r in pii.redact(docs.filter("doc_id < 3")).collect()}
    assert clear == {1: text.replace("a@b.org", "[EMAIL]"), 2: "é😀 [EMAIL], x"}


def test_secrets_need_a_context(spark, scratch):
    digest = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(30)]
    rows = [(i, f'we set token = "{digest[i]}"### here') for i in range(20)] + [(100, "we set token = sk_live_90817263abcdef, too"), (101, "we set token = 20240607 today"), (102, "we set token = " + "=" * 60_000 + "ab12cd34ef56ab78." + " x")]
    rows += [(200 + i, f"word{i} other{i} {digest[20 + i]} end") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    found = {r.pii_key: [(s.kind, texts[r.pii_key][s.start : s.end]) for s in r.pii_extra] for r in pii.find_pii(docs, scratch)[1].collect()}
    # one misshapen date speaks against 20 seeds; digests without a shared context stay
    assert found == {i: [("secret", digest[i])] for i in range(20)} | {100: [("secret", "sk_live_90817263abcdef")], 102: [("secret", "ab12cd34ef56ab78")]}
    clear = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clear[3] == 'we set token = "[SECRET]"### here' and clear[100] == "we set token = [SECRET], too" and clear[200] == texts[200]


def test_context_reaches_over_white_space_of_any_length(spark, scratch):
    rows = [(i, f"my number is +1 (499) 555-{1000 + i} thanks") for i in range(20)] + [(100, "my number is" + " " * 90 + "0499-555-777 ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.pii_key for r in pii.find_pii(docs, scratch)[1].collect()] == [100]


def spans_of(spark, scratch, rows):
    texts = dict(rows)
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), scratch)[1].collect()
    return {r.pii_key: sorted((s.kind, texts[r.pii_key][s.start : s.end]) for s in r.pii_extra) for r in found}


def test_context_words_stand_without_signs(spark, scratch):
    rows = [(i, f"well my number is +1 (499) 555-{1000 + i} thanks") for i in range(60)]
    rows += [(100, "my number is: 0499-555-777"), (101, 'My number is "0499-555-778", ok'), (102, "my (number) is <0499-555-779>."), (103, "a number here 0499-555-770")]
    assert spans_of(spark, scratch, rows) == {100: [("phone", "0499-555-777")], 101: [("phone", "0499-555-778")], 102: [("phone", "0499-555-779")]}


def test_words_behind_and_around_are_contexts(spark, scratch):
    rows = [(i, f"{'abcdefgh'[i % 8]}{i} w{i} +1 (499) 555-{1000 + i} after six pm") for i in range(40)]
    rows += [(100, "x1 x2 0499-555-777 after six"), (101, "x3 x4 0499-555-778 after seven")]
    rows += [(200 + i, f"v{i} fax +1 (498) 555-{1000 + i} or v{i}") for i in range(40)] + [(300, "new fax 0499-555-779 or none"), (301, "new fax 0499-555-776 and none")]
    assert spans_of(spark, scratch, rows) == {100: [("phone", "0499-555-777")], 300: [("phone", "0499-555-779")]}
    clean = pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id IN (100, 300)").orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["x1 x2 [PHONE] after six", "new fax [PHONE] or none"]
