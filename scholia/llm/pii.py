"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction.

DataFrame functions only. The base patterns find e-mail addresses, IP
addresses, payment cards and phone numbers. Those seeds induce lexical
patterns: the two words before them, the two after them, and the one on either
side, in lower case and without the signs at a word's edges. A pattern-instance graph over all
documents is scored in rounds: what a confident pattern finds in the shape of
its kind becomes a seed of the next round, until nothing new is found. The
patterns that are confident then mark further tokens with digits or '@', and
runs of digit groups, as identifiers of their kind, without the quotes and signs
around them.

A fifth kind, secret, has no base pattern: long hexadecimal tokens are its
seeds, which alone say nothing (a checksum is one), and are marked, as other
tokens are, only where a pattern that they induced is confident.

Defined results: a null text is empty; a null doc_id keeps its row; repeated
rows each get the same spans; empty tables give empty results. Offsets are
code points, ends exclusive. Other columns of the input are kept or ignored,
never read by position.

The fixed expressions use possessive quantifiers where nothing that follows
could match what they hold, so that very long runs neither recurse nor rescan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.session import Scratch, as_row, checkpointed, read_table

KINDS = ("email", "ip", "card", "phone")
#: All kinds that a pattern can mark; the last one is found by context alone.
MARKED = (*KINDS, "secret")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass before its pattern runs.
NEEDS = {"email": "@", "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Groups of digits and signs with single spaces between them, as numbers are written.
GROUPS = r"(?<![^\s(])[(+]?[0-9][0-9().+/-]*+(?:\x20[0-9(][0-9().+/-]*+)++"
#: Matches before one over which its two words of context may reach; a word glued together of more counts from there.
REACH = 3
#: Signs around a secret that are none of it, and what it looks like between them: as a seed, and in general.
AROUND = r"[^\p{L}0-9_+/-]*+"
HEXADECIMAL = r"(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}+"
SECRET = r"(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/.-]{16,}+"
#: Signs before and behind any other token that are none of it.
EDGES = r"[^\p{L}0-9_+/(<-]*+<?"
EDGES_BEHIND = r"[^\p{L}0-9_+/)=-]+"
MIN_DIGITS = 6
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.9


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is evaluated once however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """[0, v0, v0 op v1, ...] of an array of bigint; op is associative and leaves 0 op v at v.

    In stretches of about the square root of the size, since each append copies
    what it appends to.
    """
    zero = F.lit(0).cast("bigint")

    def append(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(op(F.element_at(acc, -1), x)))

    def within(z: Column) -> Column:
        return F.slice(F.aggregate(z["own"], F.array(z["before"]), append), 2, F.greatest(F.size(z["own"]), F.lit(1)))

    def joined(stretches: Column) -> Column:
        before = F.aggregate(stretches, F.array(zero), lambda acc, s: append(acc, F.aggregate(s, zero, op)))
        zipped = F.arrays_zip(stretches.alias("own"), F.slice(before, 1, F.size(stretches)).alias("before"))
        return F.concat(F.array(zero), F.flatten(F.transform(zipped, within)))

    def cut(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return let(F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), width), lambda i: F.slice(v, i + 1, width)), joined)

    return let(values, cut)


def last_words(text: Column) -> Column:
    """The end of text from the fifth last white space on at the most, with single blanks: two words, and signs that stand alone between them."""
    return let(F.split(text, r"\s+", -1), lambda w: F.array_join(F.slice(w, F.greatest(F.size(w) - 4, F.lit(1)), 5), " "))


def first_words(text: Column) -> Column:
    """The start of text up to the fifth white space at the most, with single blanks."""
    return F.array_join(F.slice(F.split(text, r"\s+", 6), 1, 5), " ")


def _located(df: DataFrame, name: str, pattern: str, when: Column) -> DataFrame:
    """Add column name: array of struct(start, end, found, left, right), leftmost non-overlapping.

    The pieces between matches carry the offsets: a match starts where the
    pieces and matches before it end. left holds the last words before the
    match, with single blanks: those of its own piece and of the REACH matches
    and pieces before it, so nothing is rescanned however long a text is; right
    holds the first words behind it in the same way.
    """
    none = F.array().cast("array<string>")
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,found:string,left:string,right:string>>")
    df = df.withColumn("pii_found", F.when(when, F.regexp_extract_all("pii_text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("pii_pieces", F.when(F.size("pii_found") > 0, F.split("pii_text", pattern, -1)).otherwise(none))

    def spans(parts: Column) -> Column:
        lengths = F.flatten(F.transform(parts, lambda x: F.array(F.length(x["pii_pieces"]).cast("bigint"), F.coalesce(F.length(x["pii_found"]), F.lit(0)).cast("bigint"))))
        tails = F.transform(parts, lambda x, i: last_words(F.concat(F.coalesce(F.get(parts, i - 1)["pii_found"], F.lit("")), x["pii_pieces"])))

        heads = F.transform(parts, lambda x: first_words(F.concat(x["pii_pieces"], F.coalesce(x["pii_found"], F.lit("")))))

        def located(w: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                right = F.concat(*[F.coalesce(F.get(w["heads"], i + k), F.lit("")) for k in range(1, REACH)])
                left = F.concat(*[F.coalesce(F.get(w["tails"], i - k), F.lit("")) for k in range(REACH, -1, -1)])
                return F.struct(F.get(w["edges"], 2 * i + 1).alias("start"), F.get(w["edges"], 2 * i + 2).alias("end"), x["pii_found"].alias("found"), left.alias("left"), right.alias("right"))

            return F.filter(F.transform(parts, one), lambda s: s["found"].isNotNull())

        return let(F.struct(running(lengths, lambda a, b: a + b).alias("edges"), tails.alias("tails"), heads.alias("heads")), located)

    return df.withColumn(name, F.when(F.size("pii_found") > 0, let(F.arrays_zip("pii_pieces", "pii_found"), spans)).otherwise(nothing)).drop("pii_found", "pii_pieces")


def _kept(kind: str, located: Column) -> Column:
    """The valid ones of located, with their kind."""
    good = F.filter(located, lambda x: valid(kind, x["found"]))
    return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["found"].alias("found"), x["left"].alias("left"), x["right"].alias("right")))


def _count(kind: str) -> Column:
    return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """df with pii_base: array of struct(kind, start, end, found, left, right), by kind then start."""
    df = df.withColumn("pii_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("pii_digit", F.col("pii_text").rlike("[0-9]"))
    for kind in KINDS:
        when = F.col("pii_text").contains(NEEDS[kind]) if kind in NEEDS else F.col("pii_digit")
        df = _located(df, f"pii_{kind}", PATTERNS[kind], when)
        df = df.withColumn(f"pii_{kind}", _kept(kind, F.col(f"pii_{kind}")))
    return df.withColumn("pii_base", F.concat(*[F.col(f"pii_{k}") for k in KINDS])).drop(*[f"pii_{k}" for k in KINDS])


def candidates(df: DataFrame) -> DataFrame:
    """df with pii_more: what no base span touches of tokens with MIN_DIGITS digits or an '@', and of runs of groups with MIN_DIGITS."""
    df = _located(df, "pii_tokens", CANDIDATE, F.col("pii_digit") | F.col("pii_text").contains("@"))
    df = _located(df, "pii_groups", GROUPS, F.col("pii_digit"))

    def free(t: Column) -> Column:
        enough = (F.length(F.regexp_replace(t["found"], "[^0-9]", "")) >= MIN_DIGITS) | t["found"].contains("@")
        return enough & ~F.exists("pii_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))

    return df.withColumn("pii_more", F.filter(F.concat("pii_tokens", "pii_groups"), free)).drop("pii_tokens", "pii_groups")


def contexts(left: Column, right: Column) -> Column:
    """The patterns of a place: the two words before it, the two after it, the one on either side; those that there are."""
    def bare(text: Column) -> Column:
        """The words without signs at their edges; signs that stand alone are words too."""
        words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
        return F.transform(words, lambda w: F.coalesce(F.nullif(F.regexp_replace(w, r"\A[^\p{L}\p{N}]++|[^\p{L}\p{N}]+\z", ""), F.lit("")), w))

    def named(w: Column) -> Column:
        before = F.when(F.size(w["l"]) >= 2, F.concat(F.array_join(F.slice(w["l"], -2, 2), " "), F.lit(" _")))
        after = F.when(F.size(w["r"]) >= 2, F.concat(F.lit("_ "), F.array_join(F.slice(w["r"], 1, 2), " ")))
        around = F.concat(F.get(w["l"], F.size(w["l"]) - 1), F.lit(" _ "), F.get(w["r"], F.lit(0)))
        return F.filter(F.array(before, after, around), lambda p: p.isNotNull())

    return let(F.struct(bare(left).alias("l"), bare(right).alias("r")), named)


def shaped(kind: str, found: Column) -> Column:
    """Whether a candidate could be of the kind, in a form that the fixed patterns need not know."""
    digits, letters = F.length(F.regexp_replace(found, "[^0-9]", "")), found.rlike(r"\p{L}")
    if kind == "email":
        return found.rlike(r"\A[^\s@]+@[^\s@]+\z")
    if kind == "ip":
        return found.rlike(r"\A[^\p{L}0-9]*[0-9A-Fa-f]+(?:[.:-][0-9A-Fa-f]*){3,7}[^\p{L}0-9]*\z")
    if kind == "secret":
        return found.rlike(rf"\A{AROUND}{SECRET}{AROUND}\z")
    return digits.between(*((13, 19) if kind == "card" else (MIN_DIGITS, 15))) & ~letters & ~found.contains("@")


def confident_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of patterns that mark unseen identifiers.

    edges: (pattern, instance, kind), kind null unless the instance is a seed.
    A pattern has MIN_SUPPORT distinct seeds of its kind or more. Its
    confidence is their share among its distinct instances, without the
    unlabelled ones of the right shape, which speak neither for nor against it:
    seeds of other kinds and misshapen instances are its negatives. Right-shaped
    instances of patterns that reach MIN_CONFIDENCE become seeds; rounds end
    when there are none to add, as they do, since seeds only grow.
    """
    graph = edges.filter("pattern IS NOT NULL").groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    many = graph.groupBy("pattern").count().filter(F.col("count") >= MIN_SUPPORT).select("pattern")
    graph = checkpointed(graph.join(many, "pattern").select("pattern", "instance", "kind", F.array(*[shaped(k, F.col("instance")) for k in MARKED]).alias("shapes")))
    seeds = checkpointed(graph.filter("kind IS NOT NULL").groupBy("instance").agg(F.max("kind").alias("kind")))
    graph = graph.drop("kind")
    while True:
        known = graph.join(seeds, "instance", "left")
        votes = [F.struct(F.lit(k).alias("kind"), F.count(F.when(F.col("kind") == k, 1)).alias("support"), F.count(F.when(F.coalesce(F.col("kind") != k, ~F.col("shapes")[i]), 1)).alias("against")) for i, k in enumerate(MARKED)]
        scored = known.groupBy("pattern").agg(F.array(*votes).alias("votes")).select("pattern", F.explode("votes").alias("v")).select("pattern", "v.*")
        scored = scored.withColumn("confidence", F.col("support") / F.greatest(F.col("support") + F.col("against"), F.lit(1)))
        patterns = checkpointed(scored.filter((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE)).select("pattern", "kind", "confidence"))
        fits = F.element_at("shapes", F.array_position(F.array(*[F.lit(k) for k in MARKED]), F.col("kind")).cast("int"))
        found = graph.join(patterns, "pattern").filter(fits).join(seeds, "instance", "left_anti").groupBy("instance").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("instance", "best.kind")
        found = checkpointed(found)
        if found.isEmpty():
            return patterns
        seeds = checkpointed(seeds.unionByName(found))


def find_pii(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per, more): base spans and free tokens per row of docs; further spans per (key, text hash).

    per: key, pii_hash, pii_base, pii_more. more: key, pii_hash, pii_extra
    (array of struct(kind, start, end)), only for rows where the context found
    something. Both are small beside the texts: digits are rare.
    """
    per = candidates(base_spans(docs.select(F.col(key).alias("pii_key"), F.col(text).alias("pii_body")), "pii_body"))
    per = scratch.write(per.select("pii_key", F.xxhash64("pii_text").alias("pii_hash"), "pii_base", "pii_more"), "per")
    seeds = per.select(F.explode("pii_base").alias("s")).select(contexts(F.col("s.left"), F.col("s.right")).alias("patterns"), F.col("s.found").alias("instance"), F.col("s.kind").alias("kind"))
    free = per.select("pii_key", "pii_hash", F.explode("pii_more").alias("s")).select("pii_key", "pii_hash", contexts(F.col("s.left"), F.col("s.right")).alias("patterns"), "s.found", "s.start")
    # Quotes, brackets and stops around a token are none of it.
    ahead = F.length(F.regexp_extract("found", rf"\A{EDGES}", 0))
    free = free.select("pii_key", "pii_hash", "patterns", F.regexp_replace("found", rf"\A{EDGES}|{EDGES_BEHIND}\z", "").alias("instance"), (F.col("start") + ahead).alias("start"))
    free = free.filter("instance <> ''").withColumn("end", F.col("start") + F.length("instance"))
    secret = F.when(F.col("instance").rlike(rf"\A{AROUND}{HEXADECIMAL}{AROUND}\z"), "secret")
    edges = seeds.unionByName(free.select("patterns", "instance", secret.alias("kind"))).select(F.explode("patterns").alias("pattern"), "instance", "kind")
    patterns = scratch.write(confident_patterns(edges), "patterns")
    fits = F.coalesce(*[F.when(F.col("kind") == k, shaped(k, F.col("instance"))) for k in MARKED])
    marked = free.select("pii_key", "pii_hash", F.explode("patterns").alias("pattern"), "instance", "start", "end").join(patterns, "pattern").filter((~F.col("instance").rlike(r"[\s@]") & (F.col("kind") != "secret")) | fits)
    ahead = F.length(F.regexp_extract("instance", rf"\A{AROUND}", 0))
    core = F.rtrim(F.regexp_extract("instance", rf"\A{AROUND}([A-Za-z0-9_+/.-]*+)", 1), F.lit("."))
    begin = F.col("start") + F.when(F.col("kind") == "secret", ahead).otherwise(0)
    marked = marked.withColumn("start", begin).withColumn("end", F.when(F.col("kind") == "secret", F.col("start") + F.length(core)).otherwise(F.col("end")))
    # A place has one kind: that of its most confident pattern.
    marked = marked.groupBy("pii_key", "pii_hash", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("best")).select("pii_key", "pii_hash", "start", "end", "best.kind")
    marked = marked.groupBy("pii_key", "pii_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("spans"))
    # of a token and the run of groups that it lies in, only the run counts
    outer = F.filter("spans", lambda s: ~F.exists("spans", lambda o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])))
    marked = marked.select("pii_key", "pii_hash", outer.alias("pii_extra"))
    return per, scratch.write(marked, "more")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _all_spans() -> Column:
    """Base and further spans by kind as listed, then start."""
    narrow = F.transform("pii_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = F.concat(narrow, F.coalesce("pii_extra", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    order = F.array(*[F.lit(k) for k in MARKED])
    ranked = F.transform(both, lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(ranked)


def _with_extra(per: DataFrame, more: DataFrame) -> DataFrame:
    extra = more.select(F.col("pii_key").alias("extra_key"), F.col("pii_hash").alias("extra_hash"), "pii_extra")
    return per.join(extra, F.col("pii_key").eqNullSafe(F.col("extra_key")) & (F.col("pii_hash") == F.col("extra_hash")), "left").drop("extra_key", "extra_hash")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every span of its texts replaced by [EMAIL], [IP], [CARD], [PHONE] or [SECRET].

    Overlapping spans become one placeholder, named after the first of them.
    A null text stays null. n_chars, where there is one, follows the new text.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    _, more = find_pii(docs, scratch, key, text)
    scratch.keep("more")
    rows = docs.select(as_row(docs).alias("row"), F.col(key).alias("pii_key"), F.col(text).alias("pii_body"))
    marked = _with_extra(base_spans(rows, "pii_body").withColumn("pii_hash", F.xxhash64("pii_text")), more)
    marked = marked.withColumn("pii_spans", F.array_sort(F.transform(_all_spans(), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))

    def cleared(w: Column) -> Column:
        """w: chars, spans and before, the largest end of the spans ahead of each; a span that begins under one of them is part of it."""

        def part(s: Column, i: Column) -> Column:
            at = F.get(w["before"], i)
            kept = F.array_join(F.slice(w["chars"], (at + 1).cast("int"), F.greatest(s["start"] - at, F.lit(0)).cast("int")), "")
            return F.when(s["start"] >= at, F.concat(kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")

        rest = F.array_join(F.slice(w["chars"], (F.element_at(w["before"], -1) + 1).cast("int"), F.size(w["chars"])), "")
        return F.concat(F.array_join(F.transform(w["spans"], part), ""), rest)

    before = running(F.transform("pii_spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    redone = let(F.struct(F.split("pii_text", "").alias("chars"), F.col("pii_spans").alias("spans"), before.alias("before")), cleared)
    marked = marked.withColumn("pii_redone", F.when(F.size("pii_spans") > 0, redone))
    changed = {text: F.col("pii_redone")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("pii_redone").cast(docs.schema["n_chars"].dataType)
    return marked.select(*[(F.when(F.size("pii_spans") > 0, changed[c]).otherwise(F.col("row")[c]) if c in changed else F.col("row")[c]).alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pii")
    per, more = find_pii(read_table(spark, sf_dir, "documents"), scratch)
    counts = [_count(kind) for kind in KINDS]
    digest = _with_extra(per, more).select(F.col("pii_key").alias("doc_id"), *counts, F.sha2(_joined(F.col("pii_base")), 256).alias("base_sha256"), _joined(_all_spans()).alias("spans"), F.coalesce(F.size("pii_extra"), F.lit(0)).cast("long").alias("n_found"))
    result = checkpointed(digest)
    scratch.drop()
    return result


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict = {}
