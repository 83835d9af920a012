"""The content filter's short patterns flag what the whole ones flag, and look at each place once."""

import random

from pyspark.sql import functions as F

from scholia.functions import lexicons as L
from scholia.functions import text as T

PIECES = ["office hours", "Office Hour", "worth 20%", "worth 5 %x", "40% of the grade", "x40% of your mark", "copyright", "copyrights", "a@b.c", "a@b", "@b.c", "www.x", "WWW.", "HTTPS://x", "http:/", "+49 (30) 123-45 67", "1 2 3", "12345678", "123456789", "I like", "I", "I'd", "xI think", "_I love", "I guesses", "CS 101", "XCS101", "ABCDE123", "éCS101", "CS101é", "CS101a", "9:30", "19.45", "119.45", "9:301", "7 pm", "7pm", "7pmx", "17am", "é7 am", "٣", "٣٤٥", "in this chapter", "the next weeks", "today's lab", "we will learn", "You shall see", "youwill see", "by the end of the", "references", "preferences", "welcome to", "is due", "due by", "Email:", "term -", "ta—", "alpha", "Büro", "ſyllabus", "syllabuſ", "K", "\t", "-", "_", ".", "%", ""]


def whole(text):
    """The flags as the filter states them, each pattern at full length."""
    lower = F.lower(text)
    letters, digits = F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(F.regexp_replace(text, r"[^\p{Nd}]", ""))
    clock = lower.rlike(rf"{T.EDGE}\d{{1,2}}[:.]\d{{2}}{T.EDGE}") | lower.rlike(rf"{T.EDGE}\d{{1,2}}\s*(am|pm){T.EDGE}")
    return {
        "front_matter": text.rlike(rf"(?i)^\s*({'|'.join(L.FRONT_MATTER_LABELS)})\s*[:\-–—]"),
        "contact": text.rlike(f"(?i){L.CONTACT}"),
        "administrative": text.rlike(f"(?i){T.EDGE}({'|'.join(L.ADMINISTRATION)}){T.EDGE}"),
        "course_talk": text.rlike("(?i)" + "|".join(f"{T.EDGE}({p}){T.EDGE}" for p in L.COURSE_TALK)),
        "personal": text.rlike(rf"^\s*I{T.EDGE}|{T.EDGE}I ({L.PERSONAL_VERBS}){T.EDGE}"),
        "course_code": text.rlike(rf"{T.EDGE}{L.COURSE_CODE}{T.EDGE}"),
        "numbers": clock | ((letters > 0) & (digits > F.floor(letters / 2))),
    }


def test_short_patterns_flag_what_the_whole_ones_flag(spark):
    dice = random.Random(5)
    texts = [*PIECES, None, *[dice.choice(["", " "]).join(dice.choices(PIECES, k=dice.randint(2, 5))) for _ in range(4000)]]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    short, full = T.content_flags(F.col("text")), whole(F.col("text"))
    assert list(short) == list(full)
    got = rows.select("text", *[(~short[n].eqNullSafe(full[n])).alias(n) for n in full]).filter(" OR ".join(full)).collect()
    assert got == []


def test_each_place_is_tried_once(spark):
    shown = {n: c._jc.toString() for n, c in T.content_flags(F.col("text")).items()}
    for name in ("administrative", "course_talk", "course_code", "numbers"):
        assert f"{T.OPEN}" in shown[name] and shown[name].count(T.EDGE) == 1, name
