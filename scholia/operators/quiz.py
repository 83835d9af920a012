"""Cloze quizzes: term salience, candidates, round-robin picks, distractors, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import lexicons as L
from scholia.functions.text import EDGE, ends_mid_phrase, is_definition, quiz_tokens, word_total
from scholia.operators.bm25 import counted_terms
from scholia.session import stored

MIN_WORDS, MAX_WORDS, CANDIDATES, DISTRACTORS, QUIZ_CHUNKS = 8, 45, 800, 3, 40
#: A row of a request's term is under 100 bytes: at most 40 MB of them are broadcast. Frequencies above MOST_STEPS count as one.
MOST_TERMS, MOST_STEPS = 400_000, 1_000
TYPES = ("MULTIPLE_CHOICE", "SHORT_ANSWER", "FLASHCARD")


def _whole_word(term: Column) -> Column:
    """A case-insensitive pattern of the term as a whole word; terms hold letters and hyphens only."""
    return F.concat(F.lit(f"(?i){EDGE}"), term, F.lit(EDGE))


def term_frequencies(sentences: DataFrame) -> DataFrame:
    """(request_id, term, df, total): in how many of a request's sentences a term is."""
    total = sentences.groupBy("request_id").agg(F.count("*").alias("total"))
    df = sentences.select("request_id", F.explode(F.array_distinct(quiz_tokens(F.col("text")))).alias("term")).groupBy("request_id", "term").agg(F.count("*").alias("df"))
    return df.join(total, "request_id")


def _once(sentences: DataFrame) -> DataFrame:
    """(request_id, position, text, times): equal sentences at one position as one row; only those move."""
    keyed = sentences.select("request_id", "position", "text", F.xxhash64("text").alias("h"))
    keys = ("request_id", "position", "h")
    twice = stored(keyed.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1").select(*[F.col(c).alias(f"own_{c}") for c in keys]))
    if twice.isEmpty():
        return keyed.select("request_id", "position", "text", F.lit(1).cast("long").alias("times"))
    same = [F.col(c).eqNullSafe(F.col(f"own_{c}")) for c in keys]
    again = keyed.join(twice, same, "left_semi").groupBy("request_id", "position", "text").agg(F.count("*").alias("times"))
    return keyed.join(twice, same, "left_anti").select("request_id", "position", "text", F.lit(1).cast("long").alias("times")).unionByName(again)


def _spoken(sentences: DataFrame) -> DataFrame:
    """(request_id, position, length, term, tf, first_at, proper) of the terms of sentences that are no stop words.

    Terms are counted and looked up where their sentence lies, so no text is
    carried with them. proper: whether the term also stands capitalised after
    something other than a sentence's end.
    """
    rows = _once(sentences).select("request_id", "position", "times", quiz_tokens(F.col("text")).alias("terms"), F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<=[^.!?]\s)[A-Z]\S*"), F.lit(0))), "\n").alias("capitals"))
    rows = rows.filter("size(terms) > 0").withColumn("lower", F.lower("capitals"))
    keep = ("request_id", "position", "times", "capitals", "lower")
    rows = counted_terms(rows, *keep, firsts=True).select(*keep, F.col("dl").cast("int").alias("length"), F.inline("counts"))
    rows = rows.filter(~F.col("term").isin(*L.STOPWORDS, *L.WEAK_BLANKS))
    # A capital, then the term with its other ASCII letters in either case.
    pattern = F.concat(F.lit(r"(?<![^\n])"), F.upper(F.substring("term", 1, 1)), F.lit("(?i:"), F.expr("substring(term, 2)"), F.lit(")"), F.lit(EDGE))
    rows = rows.withColumn("pattern", pattern)
    proper = F.col("lower").contains(F.expr("substring(term, 2)")) & F.expr("regexp_like(capitals, pattern)")
    return rows.select("request_id", "position", "length", "term", (F.col("tf") * F.col("times")).alias("tf"), "first_at", proper.alias("proper"))


def term_salience(sentences: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(request_id, position, term, tf, df, first_at, salience) of the terms that may become blanks.

    among: the sentences whose terms are wanted, where not all are.
    """
    frequency = stored(term_frequencies(sentences))
    rare = F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("total") / 4))
    rows = _spoken(sentences if among is None else among)
    # The most frequent terms are broadcast, as many as are few; what other terms there are meets theirs by a shuffle.
    sizes = Window.orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = frequency.groupBy(F.least("df", F.lit(MOST_STEPS)).alias("d")).agg(F.count("*").alias("n"))
    least = steps.withColumn("all", F.sum("n").over(sizes)).filter(F.col("all") <= MOST_TERMS).agg(F.min("d")).first()[0]
    if least is None:
        rows = rows.join(frequency.filter(rare), ["request_id", "term"])
    else:
        known = F.broadcast(frequency.filter(F.col("df") >= least))
        most = rows.join(known, ["request_id", "term"]).filter(rare)
        if least > 1:
            others = rows.join(known.select("request_id", "term"), ["request_id", "term"], "left_anti")
            most = most.unionByName(others.join(frequency.filter(rare & (F.col("df") < least)), ["request_id", "term"]))
        rows = most
    subject = F.when(F.col("length") <= 1, 1.0).otherwise(1.0 + 1.2 * (1.0 - F.col("first_at") / (F.col("length") - 1)))
    proper = F.when(F.col("proper"), 1.35).otherwise(1.0)
    suffix = F.when(F.col("term").rlike(f"({'|'.join(L.DESCRIBING_SUFFIXES)})$"), 0.5).otherwise(1.0)
    score = F.col("tf") * F.log(F.col("total") / F.col("df")) * F.when(F.length("term") >= 6, 1.2).otherwise(1.0) * subject * proper * suffix
    return rows.select("request_id", "position", "term", "tf", "df", "first_at", F.round(score, 9).alias("salience"))


def cloze_candidates(sentences: DataFrame) -> DataFrame:
    """(request_id, document_id, position, text, term, score): the best term of each fitting sentence.

    Only scores above 0 count; ties go to the term that comes first.
    """
    fitting = sentences.filter(word_total(F.col("text")).between(MIN_WORDS, MAX_WORDS) & ~ends_mid_phrase(F.col("text")))
    best = Window.partitionBy("request_id", "position").orderBy(F.desc("salience"), "first_at")
    terms = term_salience(sentences, fitting).filter("salience > 0").withColumn("n", F.row_number().over(best)).filter("n = 1")
    rows = fitting.join(terms.select("request_id", "position", F.col("term").alias("found"), "salience"), ["request_id", "position"])
    rows = rows.withColumn("pattern", F.concat(F.lit("("), _whole_word(F.col("found")), F.lit(")")))
    cased = F.expr("regexp_extract(text, pattern, 1)")
    score = F.round(F.col("salience") + F.when(is_definition(F.col("text")), 2.0).otherwise(0.0), 9)
    return rows.select("request_id", "document_id", "position", "text", F.when(cased == "", F.col("found")).otherwise(cased).alias("term"), score.alias("score"))


def round_robin(candidates: DataFrame, count: int) -> DataFrame:
    """The first `count` candidates of each request: round r takes the r-th best of each document.

    Documents come in first-seen order. A term that an earlier pick used is
    passed over, and its turn with it. ordinal counts the picks from 0.
    """
    own = Window.partitionBy("request_id", "document_id").orderBy(F.desc("score"), "position")
    rows = candidates.withColumn("round", F.row_number().over(own)).withColumn("seen", F.min("position").over(Window.partitionBy("request_id", "document_id")))
    used = Window.partitionBy("request_id", F.lower("term")).orderBy("round", "seen")
    rows = rows.withColumn("use", F.row_number().over(used)).filter("use = 1")
    turn = Window.partitionBy("request_id").orderBy("round", "seen")
    return rows.withColumn("ordinal", F.row_number().over(turn) - 1).filter(F.col("ordinal") < count).drop("round", "seen", "use")


def distractors(picked: DataFrame, pool: DataFrame) -> DataFrame:
    """(request_id, ordinal, distractors): up to three other terms of the pool of the most similar length.

    Terms are grouped by length first, keeping the first three of each length,
    so a pick meets a few rows per length and never every candidate.
    """
    first = Window.partitionBy("request_id", "lower").orderBy("position")
    distinct = pool.select("request_id", "position", "term", F.lower("term").alias("lower")).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    by_length = Window.partitionBy("request_id", "length").orderBy("position")
    few = distinct.withColumn("length", F.length("term")).withColumn("n", F.row_number().over(by_length)).filter(F.col("n") <= DISTRACTORS + 1).drop("n")
    pairs = picked.select("request_id", "ordinal", F.col("term").alias("answer")).join(few, "request_id").filter(F.lower("answer") != F.col("lower"))
    nearest = Window.partitionBy("request_id", "ordinal").orderBy(F.abs(F.col("length") - F.length("answer")), "position")
    chosen = pairs.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= DISTRACTORS)
    return chosen.groupBy("request_id", "ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("distractors"))


def blanked(text: Column, term: str = "term") -> Column:
    """The first whole-word occurrence of the term becomes _____."""
    at = F.expr(f"regexp_instr(text, concat('(?i){EDGE}', {term}, '{EDGE}'))".replace("\\", "\\\\"))
    return F.when(at > 0, F.overlay(text, F.lit("_____"), at, F.length(term))).otherwise(text)


def quiz(sentences: DataFrame, count: int, types: tuple[str, ...] = TYPES) -> DataFrame:
    """(request_id, ordinal, type, prompt, choices, answer, explanation, document_id, position) of each request's quiz."""
    types = types or TYPES
    pool = stored(cloze_candidates(sentences))
    picked = round_robin(pool, count)
    kind = F.element_at(F.array(*[F.lit(t) for t in types]), (F.col("ordinal") % len(types) + 1).cast("int"))
    rows = picked.join(distractors(picked, pool), ["request_id", "ordinal"], "left").withColumn("type", kind)
    blank = blanked(F.col("text"))
    prompt = F.when(F.col("type") == "FLASHCARD", blank).when(F.col("type") == "SHORT_ANSWER", F.concat(F.lit("Fill in the missing term: "), blank)).otherwise(F.concat(F.lit("Which term completes this sentence? "), blank))
    # A deterministic order keyed on the sentence.
    every = F.concat(F.coalesce("distractors", F.array().cast("array<string>")), F.array("term"))
    shuffled = F.transform(F.array_sort(F.transform(every, lambda c: F.struct(F.xxhash64(F.col("text"), c).alias("h"), c.alias("c")))), lambda x: x["c"])
    choices = F.when(F.col("type") == "MULTIPLE_CHOICE", shuffled).otherwise(F.array().cast("array<string>"))
    return rows.select("request_id", "ordinal", "type", prompt.alias("prompt"), choices.alias("choices"), F.col("term").alias("answer"), F.concat(F.lit("From the material: “"), F.col("text"), F.lit("”")).alias("explanation"), "document_id", "position")
