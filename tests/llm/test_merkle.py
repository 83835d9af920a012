import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from scholia.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    values = (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(nodes, own):
    """The top of `nodes`, and the siblings of place `own`, level by level."""
    siblings = []
    while len(nodes) > 1:
        run = nodes[own // 8 * 8 : own // 8 * 8 + 8]
        siblings.append((own % 8, run[: own % 8] + run[own % 8 + 1 :]))
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        own //= 8
    return nodes[0], siblings


def stated(rows):
    """The manifest by the rule as stated, one row at a time."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
    tops = [climb([x[2] for x in groups[g]], 0)[0] for g in order]
    out = []
    for at, g in enumerate(order):
        leaves = [x[2] for x in groups[g]]
        root, upper = climb(tops, at)
        for i, (_, _, leaf, r) in enumerate(groups[g]):
            sub, lower = climb(leaves, i)
            path = lower + upper
            touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            node = leaf_of(r, lowered(r["text"]) if touched else r["text"])
            for place, others in path:
                node = h(*others[:place], node, *others[place:])
            out.append((r["doc_id"], leaf, sub, root, h(*[s for _, others in path for s in others]), node, node == root))
    return sorted(out, key=repr)


def sample():
    rows = [(i * 7 % 300, f"Text {i} É" if i % 4 else f"text {i}", "en", f"s{i % 3}", i) for i in range(300)]
    rows += [(i, "A" * (i % 5), ["de", None, "É", "z", "a", "fr", "", "pt", "it", "nl", "sv"][i % 11], None, None) for i in range(60)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "Same", "de", "s", 4)] * 9 + [(5, "Other", "de", "s", 4), (6, "x" * 200_000, "solo", "s", 1)]
    return [(*r, "mine", 7) for r in rows]


def actual(spark, rows, scratch, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    got = merkle.manifest(docs, scratch, tampered={"text": F.when(third, low).otherwise(F.col("text"))}, **options)
    got = got.withColumn("folded", merkle.fold(F.col("tampered_leaf"), F.col("at"), F.col("siblings")))
    got = got.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", "").cast("binary"), 256), "folded", F.col("folded") == F.col("root"))
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_equals_the_stated_rule(spark, scratch, levels):
    rows = sample()
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    want = stated([dict(zip(names, r, strict=True)) for r in rows])
    assert actual(spark, rows, scratch, levels=levels) == want
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)


def test_one_row_and_no_row(spark, scratch):
    rows = [(4, "Ab", "en", "s", 2, "x", 1)]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    assert actual(spark, rows, scratch) == stated([dict(zip(names, rows[0], strict=True))])
    assert actual(spark, [], scratch) == []


def test_any_changed_byte_breaks_the_proof(spark, scratch):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1, "x", 1) for i in range(30)], SCHEMA)
    got = merkle.manifest(docs, scratch, tampered={"text": F.concat("text", F.lit(" "))})
    own = merkle.fold(F.col("leaf"), F.col("at"), F.col("siblings")) == F.col("root")
    other = merkle.fold(F.col("tampered_leaf"), F.col("at"), F.col("siblings")) == F.col("root")
    assert got.filter(own).count() == 30 and got.filter(other).count() == 0
