import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.llm import ann, lmscore, neardup, quality, registry, substrings, tokencount, toxicity
from scholia.llm.bwt import repeated_windows
from scholia.llm.components import components
from scholia.llm.learn import Isotonic

SF = "/root/testdata/sf0.001"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, t string").drop("t")


def test_expansion_finds_repeated_windows():
    random.seed(3)
    for length in (1, 3, 6):
        strings = [bytes(random.choices(b"ab", k=random.randint(0, 50))) for _ in range(12)] + [b"a" * 20, b""]
        seen = collections.Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        for s, flags in zip(strings, repeated_windows(strings, length), strict=True):
            assert list(flags) == [seen[s[i : i + length]] > 1 for i in range(len(s) - length + 1)]


def brute_removal(texts):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        yield len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("group", [256, 2])
def test_removal_equals_brute_force(spark, scratch, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdé ", k=n))
    shared, other = word(260), word(600)
    texts = [word(300) + shared[k:] + word(150) for k in range(0, 50, 5)] + [other, other, other[:199], other[10:215] + "x" + other[300:520], "q" * 450, None, "", word(30) + shared, None]
    got = substrings.substring_digest(docs_of(spark, texts), scratch).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == list(brute_removal(texts))


def test_removal_of_nothing(spark, scratch):
    assert substrings.substring_digest(docs_of(spark, ["x"]).limit(0), scratch).count() == 0


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_signatures_estimate_weighted_similarity():
    elements = np.arange(1, 401, dtype=np.uint64).repeat(2)
    weights = np.random.default_rng(2).uniform(0.2, 6, 800)
    rows = np.tile([0, 1], 400)
    order = np.argsort(rows, kind="stable")
    s = neardup.dart_signatures(elements[order], weights[order], rows[order], 2, 2048)
    a, b = weights[0::2], weights[1::2]
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.05)


def test_near_duplicate_classes_equal_brute_force(spark, scratch):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(80)]
    for i in range(60):  # chains and loose groups around the threshold
        w = texts[i % 20].split()
        for _ in range(rng.randint(0, max(1, len(w) // 40))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [None, "", "one two", "one two", "one  two"]
    own = [shingle_set(t or "") for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(own):
        for j in range(i):
            b = own[j]
            if not a and not b or a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    docs = docs_of(spark, texts)
    labels = neardup.near_duplicate_classes(docs, scratch)
    got = {r.doc_key: r.first.doc_key for r in neardup.with_class(docs, labels).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_one_of_each_class_stays(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base, base + " x", "other words here", base, None, "", None]
    docs = docs_of(spark, texts)
    kept = neardup.keep_one(docs.union(docs))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4] and kept.columns == docs.columns
    assert neardup.keep_one(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark, scratch):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)]
    got = components(spark.createDataFrame(edges, "a long, b long"), scratch, "t").collect()
    assert {r.node: r.component for r in got} == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_equals_brute_force(spark, scratch, monkeypatch, order):
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", 300)
    rng = random.Random(4)
    texts = [" ".join(rng.choices("a b c d ee f".split(), k=rng.randint(1, 30))) for _ in range(40)] + [None, "", "  "]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = collections.Counter(tuple(w[i : i + n]) for w in words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    got = {r.doc_id: r for r in lmscore.backoff_scores(docs_of(spark, texts), scratch, order=order).collect()}
    for d, w in enumerate(words):
        want = 0.0
        for i in range(len(w)):
            lost = 0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1 or counts[gram] >= 2:
                    want += math.log(counts[gram] / (total if n == 1 else counts[gram[:-1]])) + lost * math.log(0.4)
                    break
                lost += 1
        assert got[d].n_words == len(w) and got[d].log_score == pytest.approx(want)
        assert (got[d].mean_log_score is None) == (not w)


def test_registered_scores_use_three_words(spark, scratch, tmp_path):
    texts = ["a b c", "a b c", "x b d", "a b d", "a b"]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_score for r in lmscore.op5_lmscore(spark, str(tmp_path)).collect()}
    # a: 4 of 14, no context; b after a: 4 of 4; c after a b: 2 of 4
    assert got[0] == pytest.approx(math.log(4 / 14) + math.log(4 / 4) + math.log(2 / 4))
    # "a b d" comes once, so d backs off to b d: 2 of 5
    assert got[3] == pytest.approx(math.log(4 / 14) + math.log(4 / 4) + math.log(0.4 * 2 / 5))


def test_scores_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_words, log_score, mean_log_score FROM ({lmscore.OP5_SQL}) ORDER BY doc_id").fetchall()
    assert [tuple(r) for r in lmscore.op5_lmscore(spark, SF).orderBy("doc_id").collect()] == want


def test_counts_and_ids_of_other_types(spark, scratch):
    docs = spark.createDataFrame([("x", "a b a b"), ("y", "a b c"), (None, None)], "doc_id string, text string")
    assert {r.doc_id: r.n_words for r in lmscore.backoff_scores(docs, scratch).collect()} == {"x": 4, "y": 3, None: 0}
    assert sorted((r.n, r["count"]) for r in lmscore.count_table(docs, scratch, order=2).collect()) == [(1, 1), (1, 3), (1, 3), (2, 1), (2, 1), (2, 3)]


def test_open_bands_are_sent_once(spark, scratch):
    """Rows that meet the texts grow with the group, not with its square."""
    made = []
    for n in (60, 120):
        rng = random.Random(n)
        members = [(1, 0, bytes([k >> 8, k & 255]), bytes([k >> 8, k & 255]), [1] * neardup.BANDS, 50) for k in range(n)]
        texts = spark.createDataFrame([(m[2], " ".join(rng.choices("abcdefgh", k=40))) for m in members], "t binary, text string")
        rows = spark.createDataFrame(members, "band long, place int, t binary, component binary, bands array<long>, size int")
        neardup.remaining_links(rows, texts, scratch).collect()
        made.append(spark.read.parquet(f"{scratch.root}/plan").select((F.col("blocks") + F.col("top_blocks")).alias("b")).first().b * n)
    assert made == [60, 120]


def test_packed_numbers_come_back():
    for values in ([], [0], [1, 1, 2], [0, 5, 2**63, 2**64 - 1]):
        values = np.array(values, dtype=np.uint64)
        assert (lmscore.unpack(lmscore.pack(values)) == values).all() and (lmscore.unpack_sorted(lmscore.pack_sorted(values)) == values).all()


def test_tree_counts_follow_edits():
    counter = tokencount.PieceCounter(tokencount.read_ranks(tokencount.default_vocabulary()))
    rng = random.Random(5)
    letters = "ab  \n\n'sll re09.,!é😀 "
    for _ in range(300):
        text = "".join(rng.choices(letters, k=rng.choice([0, 3, 50, 2000])))
        tree = tokencount.TokenTree(text, counter)
        for _ in range(5):
            a = rng.randint(0, len(text) + 2)
            b = a + rng.choice([0, 1, 5, 100])
            new = "".join(rng.choices(letters, k=rng.choice([0, 1, 4, 200])))
            again = tree.edit(a, b, new)
            text = text[: min(a, len(text))] + new + text[min(b, len(text)) :]
            assert tree.text == text and tree.tokens == len(counter.encoding.encode_ordinary(text))
            assert again <= len(new) + 100 + 10 * tokencount.LEAF


def test_nearest_are_found(spark, scratch):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    x[300:340] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), 10, scratch, block_rows=200, block_queries=5).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 600, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        found = [i for _, i, _ in sorted(got[q])]
        hits += len(set(want) & set(found))
        assert [s for _, _, s in sorted(got[q])] == pytest.approx(list(d[found]))
    assert hits >= 0.9 * 120
    few = ann.nearest(df.filter("vec_id < 4"), df.filter("vec_id = 0"), 10, scratch)
    assert few.count() == 3


def test_all_lengths_and_repeated_ids_are_searched(spark, scratch):
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(10 + i, [float(i), 1.0, 2.0]) for i in range(4)] + [(3, [3.0, 1.0]), (3, [50.0, 1.0]), (7, [51.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.nearest(df, df.filter("vec_id in (3, 7, 10)"), 2, scratch).collect():
        got[r.query_id].add((r.rank, r.vec_id, round(r.score, 6)))
    assert got[10] == {(1, 11, 1.0), (2, 12, 2.0)}
    assert got[7] == {(1, 3, 1.0), (2, 5, 46.0)}
    assert got[3] == {(1, 2, 1.0), (2, 4, 1.0), (1, 7, 1.0), (2, 5, 45.0)}


def test_lexicon_does_not_depend_on_the_parts(spark):
    rows = [("zork vile", 1)] * 10 + [("zork calm", 0)] * 30
    for parts in (1, 40):
        sample = spark.createDataFrame(spark.sparkContext.parallelize(rows, parts), "text string, label int")
        assert toxicity.induce_lexicon(sample) == {"vile"}, parts


def test_isotonic_fit_rises():
    x = np.arange(50.0)
    y = (np.random.default_rng(0).random(50) < x / 50).astype(float)
    fitted = Isotonic().fit(x, y).predict(x)
    assert (np.diff(fitted) >= -1e-12).all()


@pytest.mark.parametrize(("name", "label", "least"), [("op4_toxicity", "toxic", 0.9), ("op9_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = registry.QUERIES[name](spark, sf)
    assert scored.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = scored.join(labels, "doc_id").filter("held_out")
    assert held.filter(F.col("predicted") == F.col(label)).count() >= least * held.count()


def test_scores_of_odd_texts(spark):
    docs = docs_of(spark, [None, "", "x" * 200_000, "😀 ok", "you idiot"])
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    for module, column in ((toxicity, "tox_score"), (quality, "quality_score")):
        model = module.fit(docs, none)
        assert all(0 <= r[1] <= 1 for r in module.score(docs, model, "doc_id").collect())
        assert module.score(docs.limit(0), model, "doc_id").count() == 0
