"""Text functions as Column builders: tokens, keys, sentence predicates, content filter, grading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions import lexicons as L

TOKEN = r"[\p{L}\p{N}]+"
#: \b of ASCII words, whatever the Java version.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: EDGE where the pattern goes on with an ASCII letter or digit, tried once a place instead of twice.
OPEN = r"(?<![A-Za-z0-9_])"
TERM = rf"{EDGE}\p{{L}}[\p{{L}}\-]{{4,}}{EDGE}"


def words_in(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def matching_tokens(text: Column) -> Column:
    """Tokens without stop words, in order."""
    return F.filter(tokenize(text), lambda t: ~t.isin(*L.STOPWORDS))


def content_terms(text: Column) -> Column:
    """Distinct tokens longer than two characters that are no stop words."""
    return F.array_distinct(F.filter(tokenize(text), lambda t: (F.length(t) > 2) & ~t.isin(*L.STOPWORDS)))


def identity_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def quiz_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def word_total(text: Column) -> Column:
    """Number of words between white space; blank text has none."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def starts_like_sentence(text: Column) -> Column:
    return F.trim(text).rlike(L.OPENS_SENTENCE)


def ends_like_sentence(text: Column) -> Column:
    return F.trim(text).rlike(L.CLOSES_SENTENCE)


def ends_mid_phrase(text: Column) -> Column:
    last = F.regexp_replace(F.lower(F.element_at(F.split(F.trim(text), r"\s+"), -1)), r"[^\p{L}]", "")
    return last.isin(*L.DANGLING_ENDINGS)


def is_definition(text: Column) -> Column:
    return text.rlike(f"(?i){EDGE}({'|'.join(L.DEFINITION_VERBS)}){EDGE}")


def needs_antecedent(text: Column, previous: Column) -> Column:
    first = F.lower(F.get(F.split(text, r"[^\p{L}]+", 2), F.lit(0)))
    return F.coalesce((F.trim(previous) != "") & first.isin(*L.DANGLING_STARTERS), F.lit(False))


def searchable_text(text: Column, previous: Column) -> Column:
    return F.when(needs_antecedent(text, previous), F.concat_ws(" ", previous, text)).otherwise(text)


def is_numbers_and_times(text: Column) -> Column:
    """A clock time, or more than half as many digits as letters. Most sentences hold no digit, and are looked at no further."""
    lower = F.lower(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    digits = F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    clock = lower.rlike(rf"{OPEN}\d{{1,2}}(?:[:.]\d{{2}}|\s*(am|pm)){EDGE}")
    return text.rlike(r"\p{Nd}") & (clock | ((letters > 0) & (digits > F.floor(letters / 2))))


def has_contact(text: Column) -> Column:
    """Whether lexicons.CONTACT is in a text: its four forms, each as short as one sighting needs."""
    address = text.contains("@") & text.rlike(r"[\w.+-]@[\w-]+\.[\w.]")
    return address | text.rlike(r"(?i)https?://\S|www\.\S") | text.rlike(r"\d[\d\s().-]{7,}\d")


def content_flags(text: Column) -> dict[str, Column]:
    """The seven reasons for which a sentence is not testable content."""
    def phrases(*items: str) -> str:
        return "|".join(items)

    return {
        "front_matter": text.rlike(rf"(?i)^\s*({phrases(*L.FRONT_MATTER_LABELS)})\s*[:\-–—]"),
        "contact": has_contact(text),
        "administrative": text.rlike(f"(?i){OPEN}({phrases(*L.ADMINISTRATION)}){EDGE}"),
        "course_talk": text.rlike(f"(?i){OPEN}(?:{phrases(*[f'(?:{p})' for p in L.COURSE_TALK])}){EDGE}"),
        "personal": text.rlike(rf"^\s*I{EDGE}|{OPEN}I ({L.PERSONAL_VERBS}){EDGE}"),
        "course_code": text.rlike(rf"{OPEN}{L.COURSE_CODE}{EDGE}"),
        "numbers": is_numbers_and_times(text),
    }


def is_testable(text: Column) -> Column:
    bad = F.lit(False)
    for flag in content_flags(text).values():
        bad = bad | flag
    return ~bad


def graded_form(text: Column) -> Column:
    """Lower case, punctuation to spaces, fillers out, spaces collapsed; null is empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", " ")
    out = F.regexp_replace(out, f"{EDGE}({'|'.join(L.GRADING_FILLERS)}){EDGE}", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def grade(reference: Column, student: Column) -> Column:
    """struct(correct, verdict): verdict is blank, match, covered, partial or wrong."""
    ref, own = graded_form(reference), graded_form(student)
    def terms(form: Column) -> Column:
        return F.array_distinct(F.filter(F.split(form, " "), lambda t: (F.length(t) > 2) & ~t.isin(*L.STOPWORDS)))

    wanted = terms(ref)
    share = F.when(F.size(wanted) > 0, F.size(F.array_intersect(wanted, terms(own))) / F.size(wanted)).otherwise(0.0)
    match = (own == ref) | own.contains(ref) | (ref.contains(own) & (F.length(own) >= F.greatest(F.lit(3), F.floor(F.length(ref) / 2))))
    verdict = F.when(own == "", "blank").when(match, "match").when(share >= 0.6, "covered").when(share > 0, "partial").otherwise("wrong")
    return F.struct(verdict.isin("match", "covered").alias("correct"), verdict.alias("verdict"))


def feedback(verdict: Column, reference: Column) -> Column:
    """What a student is told. The five texts are fixed values."""
    return (
        F.when(verdict == "blank", F.concat(F.lit("No answer was given. The expected answer was: "), reference, F.lit(".")))
        .when(verdict == "match", F.lit("Correct - that matches the material."))
        .when(verdict == "covered", F.concat(F.lit("Correct - you covered the key points ("), reference, F.lit(").")))
        .when(verdict == "partial", F.concat(F.lit("Partly there, but the key term was missing. Expected: "), reference, F.lit(".")))
        .otherwise(F.concat(F.lit("Not quite. The expected answer was: "), reference, F.lit(".")))
    )


def question_type(text: Column) -> Column:
    """MULTIPLE_CHOICE, SHORT_ANSWER or FLASHCARD; unknown and null are SHORT_ANSWER."""
    name = F.regexp_replace(F.lower(F.trim(text)), "[- ]", "_")
    return F.when(name.isin("multiple_choice", "mcq", "multiplechoice"), "MULTIPLE_CHOICE").when(name.isin("flashcard", "flash_card"), "FLASHCARD").otherwise("SHORT_ANSWER")


def normalised_timestamp(text: Column) -> Column:
    """30 characters, 9 fraction digits, UTC; what can't be parsed stays as it is."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS'Z'"), text)


def safe_filename(name: Column) -> Column:
    """No directories, control characters or reserved marks; never empty; at most 120 characters."""
    base = F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[/\\]", "")
    base = F.regexp_replace(base, r"[\p{Cntrl}\u2028\u2029]", "")
    base = F.trim(F.regexp_replace(base, r"[\\/:*?\"<>|]", "_"))
    return F.substring(F.when(base.rlike(r"^\.*$"), "upload").otherwise(base), 1, 120)


def content_type_of(name: Column) -> Column:
    lower = F.lower(name)
    return F.when(lower.endswith(".pdf"), "application/pdf").when(lower.endswith(".md") | lower.endswith(".markdown"), "text/markdown").otherwise("text/plain")
