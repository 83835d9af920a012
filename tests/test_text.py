from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.functions.stemmer import stem
from scholia.operators.places import numbered
from scholia.operators.sentences import even_stride, sentence_corpus, split_sentences


def value(spark, column, **cells):
    return spark.createDataFrame([tuple(cells.values())], ", ".join(f"{c} string" for c in cells)).select(column.alias("v")).first().v


def test_ascii_word_edges(spark):
    assert value(spark, T.quiz_tokens(F.col("t")), t="énergie solaire") == ["nergie", "solaire"]


def test_grading(spark):
    cases = [
        ("mitochondria", "The Mitochondria!", "match"),
        ("photosynthesis in the chloroplast", "chloroplast photosynthesis happens", "covered"),
        ("light reaction energy storage", "energy", "match" if len("energy") >= len("light reaction energy storage") // 2 else "partial"),
        ("osmosis", "diffusion", "wrong"),
        ("osmosis", "  ", "blank"),
        (None, "anything", "match"),
    ]
    rows = spark.createDataFrame([(a, b, c) for a, b, c in cases], "r string, s string, want string").select(T.grade(F.col("r"), F.col("s")).verdict.alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_content_filter(spark):
    bad = ["Office hours: Tue 2pm", "Write to me@x.edu today", "Late submissions lose marks", "In this chapter we look at cells", "I like coffee", "CPSC 322 introduces both", "Mon 09:00 - 11:00"]
    good = ["This process releases energy in the cell.", "Mitochondria are the powerhouse of the cell."]
    rows = spark.createDataFrame([(t,) for t in bad + good], "t string").select(T.is_testable(F.col("t")).alias("ok")).collect()
    assert [r.ok for r in rows] == [False] * len(bad) + [True] * len(good)


def test_file_names(spark):
    assert value(spark, T.safe_filename(F.col("t")), t="../../a:b?.pdf") == "a_b_.pdf"
    assert value(spark, T.safe_filename(F.col("t")), t="..") == "upload"
    assert value(spark, T.question_type(F.col("t")), t=" Multiple-Choice ") == "MULTIPLE_CHOICE"
    assert value(spark, T.question_type(F.col("t")), t=None) == "SHORT_ANSWER"


def test_stemmer():
    pairs = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam electrical:electr hopefulness:hope adjustment:adjust adoption:adopt probate:probat rate:rate controll:control roll:roll cells:cell produce:produc energy:energi"
    for pair in pairs.split():
        word, want = pair.split(":")
        assert stem(word) == want, word


def test_sentence_rules():
    assert split_sentences("Dr. J. Smith found the cell wall. It keeps its shape! Does it hold water?") == ["Dr. J. Smith found the cell wall.", "It keeps its shape!", "Does it hold water?"]
    assert split_sentences("• first bullet has four words\n12\n• second bullet goes on\nand wraps here") == ["first bullet has four words", "second bullet goes on and wraps here"]
    assert split_sentences(" \n ") == split_sentences(None) == []


def test_corpus_drops_fragments_and_joins_antecedents(spark):
    text = "that speeds reactions up here. Osmosis moves water through membranes. It occurs in every living cell. The last piece is cut"
    other = "Osmosis moves water through membranes. Another full sentence stands here."
    sources = spark.createDataFrame([("r", 1, "d", "c1", text), ("r", 2, "d", "c2", other)], "request_id string, source_order int, document_id string, chunk_id string, content string")
    rows = sentence_corpus(sources, 10).orderBy("position").collect()
    assert [r.text for r in rows] == ["Osmosis moves water through membranes.", "It occurs in every living cell.", "Another full sentence stands here."]
    assert rows[1].searchable == "Osmosis moves water through membranes. It occurs in every living cell."


def test_even_stride(spark):
    for n in (0, 10, 40, 41, 60, 90, 121, 500):
        rows = even_stride(spark.range(n).withColumn("g", F.lit(1)), "g", 40, "id").orderBy("id").collect()
        want = list(range(n)) if n <= 40 else sorted({int(i * (n - 1) / 39 + 0.5) for i in range(40)})
        assert [r.id for r in rows] == want


def test_even_stride_of_many_groups_nulls_and_ties(spark):
    rows = [(g, i // 2, i) for g, n in (("a", 7), ("b", 50), (None, 30), ("c", 1)) for i in range(n)]
    table = spark.createDataFrame(rows, "g string, k long, id long").repartition(4)
    got = even_stride(table, "g", 9, "k").collect()
    for g, n in (("a", 7), ("b", 50), (None, 30), ("c", 1)):
        picks = range(n) if n <= 9 else [int(i * (n - 1) / 8 + 0.5) for i in range(9)]
        assert sorted(r.k for r in got if r.g == g) == sorted(p // 2 for p in picks)
    assert len({(r.g, r.id) for r in got}) == len(got) and got[0].asDict().keys() == {"g", "k", "id"}


def test_places_split_one_key(spark):
    same = spark.createDataFrame([("g", 1)] * 500 + [(None, 2)] * 3, "g string, k long").repartition(4)
    got = numbered(same, "g", "k")
    assert sorted(r.place for r in got.filter("g = 'g'").collect()) == list(range(500)) and {r.size for r in got.filter("g IS NULL").collect()} == {3}
    assert numbered(same.limit(0), "g", "k").count() == 0


def test_clock_times_take_any_white_space(spark):
    cases = {"Meet at 10  am in hall": True, "at 9\tpm": True, "at 9pm": True, "room 10:30": True, "at 9.15 sharp": True, "10 ample rooms": False, "he is 9 pmx": False, "alpha1am said nothing": False, "no times here": False}
    rows = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r.text: r.n for r in rows.select("text", T.is_numbers_and_times(F.col("text")).alias("n")).collect()} == cases
