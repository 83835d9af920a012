"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers (in digits or in words), names and units become typed placeholders, so a
question whose parameters were changed keeps its template. A capitalised word
that opens a sentence may be a name or not, so it agrees with a name, with
another such word, and with itself as a plain word. Tokens agree if their
placeholders or their lower-case values are equal, so a name that only one side
shows as one (in upper or lower case) agrees with itself. Windows of a text are
hash-joined to all windows of the items, in four forms: with placeholders, with
opening words as values, with names as values too, with all as values. Each item
has probes of half its needed run, and a text has probes of each such length. An
alignment that this finds is compared token by token, and counts where WINDOW
consecutive tokens agree and the slots are consistent: one item value stands for one text value
throughout the window, and the other way round. Each window is judged alone, so
an edit outside it cannot clear it. Any run of WINDOW tokens holds a whole probe
(2 * probe - 1 <= WINDOW), so no run is missed that agrees in one form; one whose
probes all mix changed names with re-cased ones can be.

Defined results: null and empty texts and items match nothing; items of fewer
than LEAST tokens are too short to be evidence and match nothing; shorter items
than WINDOW must match whole; repeated rows match alike; copies of a text are
compared once; empty tables give empty results. Only named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.neardup import text_key, texts_of
from scholia.session import Scratch, as_row, checkpointed, read_table

WINDOW = 13
LEAST = 7
#: Literal tokens that a window with changed values must have beside its placeholders, as a share.
LITERAL = 0.5
#: A probe row is under 40 bytes, an item under 10 kB: at most 8 MB and 50 MB.
BROADCAST_PROBES = 200_000
BROADCAST_ITEMS = 5_000

NAME, NUMBER, UNIT, JOINT, OPEN = "\ue001", "\ue002", "\ue003", "\ue004", "\ue005"
# Units and numerals of the four languages of the tables; articles (un, ein) and words of several senses (once) are left out.
UNITS = """
kg mg g km cm mm m mi mile miles ft foot feet inch inches yd yard yards lb lbs pound pounds oz ounce ounces ton tons tonne tonnes ml l liter liters litre litres gallon gallons
hour hours hr hrs h minute minutes min second seconds sec s day days week weeks month months year years
dollar dollars euro euros cent cents usd eur mph kmh percent degree degrees meter meters metre metres kilometer kilometers gram grams kilo kilos
stunde stunden minuten sekunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren gramm kilogramm tonnen pfund grad prozent meile meilen
heure heures jour jours semaine semaines mois an ans année années mètre mètres kilomètre kilomètres gramme grammes livre livres degré degrés
hora horas minutos segundos día días semana semanas mes meses año años metro metros kilómetro kilómetros gramo gramos litro litros libra libras tonelada toneladas grado grados dólar dólares peso pesos
""".split()
NUMERALS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
null zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend
deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille
dos tres cuatro cinco siete ocho nueve diez doce trece catorce quince dieciséis veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil
""".split()
SIGNS = "%|€|\\$|£|°[CF]?"


def _any_of(words: list[str]) -> str:
    """A pattern of the words, by first letter, the longest first."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        heads.setdefault(w[0], []).append(w[1:])
    return "(?:" + "|".join(f"{head}(?:{'|'.join(rest)})" for head, rest in sorted(heads.items())) + ")"


_UNIT = _any_of(UNITS)
#: A numeral, or a German one of two parts.
_NUMERAL = rf"(?:(?:(?:ein|zwei|drei|vier|fünf|sechs|sieben|acht|neun)und)?{_any_of(NUMERALS)})"
_SPELT = rf"(?<![\p{{L}}\p{{N}}])({_NUMERAL})" + rf"(?:[ -](?:and |et |y )?({_NUMERAL}))?" * 3 + r"(?![\p{L}\p{N}])"


def surface(text: Column) -> Column:
    """Lower-case tokens joined by single spaces; slots carry a placeholder before their value.

    Texts without a number skip the expressions for numbers and units.
    """
    # Looking words up is a third of the work of a search for the pattern.
    spelt = F.exists(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w.isin(*NUMERALS) | (w.contains("und") & w.rlike(f"^{_NUMERAL}$")))
    digits = text.rlike("[0-9]")  # of the text as it comes, so that nothing is evaluated twice
    text = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT + JOINT + OPEN, "     ")
    text = F.regexp_replace(text, r"[\s\p{Z}]{2,}+|[\s\p{Z}&&[^ ]]", " ")  # so that wrapping hides no name
    text = F.regexp_replace(text, r"(?=\p{Lu})(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)", NAME + "$1")
    text = F.regexp_replace(text, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}{NAME}])(\p{{Lu}}\p{{Ll}}+)(?!\p{{L}})", OPEN + "$1")
    number = rf"(?<![\p{{L}}0-9{JOINT}{NUMBER}])([0-9][0-9{JOINT}]*+)"
    worded = F.regexp_replace(text, f"(?iu)[{NAME}{OPEN}]?+{_SPELT}", f"{NUMBER}$1$2$3$4")
    worded = F.regexp_replace(worded, rf"(?iu)({NUMBER}\p{{L}}++) ({_UNIT})(?![\p{{L}}0-9])", f"$1 {UNIT}$2 ")
    counted = F.regexp_replace(F.when(spelt, worded).otherwise(text), r"(?<=[0-9])[.,:/](?=[0-9])", JOINT)
    counted = F.regexp_replace(counted, rf"(?iu){number}[ ]?(?:({_UNIT})(?![\p{{L}}0-9])|({SIGNS}))", f" {NUMBER}$1 {UNIT}$2$3 ")
    counted = F.regexp_replace(counted, rf"{number}(?!\p{{L}})", f" {NUMBER}$1 ")
    counted = F.regexp_replace(counted, rf"(?<!{UNIT})[%€$£°]", " ")
    counted = F.regexp_replace(F.lower(counted), rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}-{OPEN}%€$£°]+", " ")
    plain = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{M}}\p{{N}}{NAME}{OPEN}]+", " ")
    return F.trim(F.when(digits | spelt, counted).otherwise(plain))


def template(surfaces: Column) -> Column:
    return F.regexp_replace(surfaces, rf"([{NAME}-{UNIT}{OPEN}])\S*", "$1")


def _value(token: Column) -> Column:
    return F.translate(token, NAME + NUMBER + UNIT + OPEN, "")


def _tokens(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """keep and the arrays `slots` (with values) and `tokens` (placeholders only), of equal size.

    No filter here: it would be pushed below and evaluate the expressions again.
    """
    df = df.select(*keep, surface(text).alias("surface"))
    return df.select(*keep, F.split("surface", " ").alias("slots"), F.split(template(F.col("surface")), " ").alias("tokens"))


def _probes(tokens: DataFrame, sizes: list[int], every_place: bool, *keep: str) -> DataFrame:
    """keep, size, place and probe: the hashes of `size` tokens from place, at every place or at every size-th.

    A window is hashed in each form that differs: with placeholders, with
    opening words by value, with names by value, with all by value. explode_outer
    keeps the planner from evaluating the hashes once more in a filter of its own.
    """

    def forms(size: int):
        def of(i: Column) -> Column:
            def others(window: Column) -> Column:
                whole = F.transform(window, lambda x: F.when(x.startswith(NAME) | x.startswith(OPEN), NAME).when(x.startswith(NUMBER), NUMBER).when(x.startswith(UNIT), UNIT).otherwise(x))
                opened = F.transform(window, lambda x: F.when(x.startswith(NAME), NAME).when(x.startswith(NUMBER), NUMBER).when(x.startswith(UNIT), UNIT).otherwise(_value(x)))
                named = F.transform(window, lambda x: F.when(x.startswith(NUMBER), NUMBER).when(x.startswith(UNIT), UNIT).otherwise(_value(x)))
                return F.array(F.xxhash64(whole), F.xxhash64(opened), F.xxhash64(named), F.xxhash64(F.transform(window, _value)))

            plain = F.slice("slots", i + 1, size) == F.slice("tokens", i + 1, size)
            every = F.when(plain, F.array(F.xxhash64(F.slice("slots", i + 1, size)))).otherwise(F.array_distinct(_let(F.slice("slots", i + 1, size), others)))
            return F.transform(every, lambda h: F.struct(F.lit(size).alias("size"), i.alias("place"), h.alias("probe")))

        places = F.sequence(F.lit(0), F.size("tokens") - size, F.lit(1 if every_place else size))
        return F.when(F.size("tokens") >= size, F.flatten(F.transform(places, of)))

    none = F.array().cast("array<struct<size:int,place:int,probe:bigint>>")
    hashed = F.concat(*[F.coalesce(forms(size), none) for size in sizes]) if sizes else none
    return tokens.select(*keep, F.explode_outer(hashed).alias("p")).select(*keep, "p.size", "p.place", "p.probe")


def _let(value: Column, body) -> Column:
    """body(value), where value is evaluated once however often body refers to it."""
    return F.transform(F.array(value), body)[0]


def _holds(token: Column) -> Column:
    """Whether a token is or begins with a placeholder."""
    return F.substring(token, 1, 1).isin(NAME, NUMBER, UNIT, OPEN)


def _alike(x: Column) -> Column:
    """Whether both tokens have the same placeholder, or may both be names."""
    return (x["a"] == x["c"]) | (x["a"].isin(NAME, OPEN) & x["c"].isin(NAME, OPEN))


def _is_slot(x: Column) -> Column:
    """Both are values of one kind; the same opening word on both sides is a word like others."""
    return _holds(x["a"]) & _alike(x) & ~((x["a"] == OPEN) & (x["c"] == OPEN) & (x["b"] == x["d"]))


def _covered(starts: Column, w: Column) -> Column:
    """struct(end, n_windows, n_matched, n_slots): windows from ascending starts, and the tokens and slots under them."""

    def step(acc: Column, s: Column) -> Column:
        first = F.greatest(s, acc["end"])
        end = s + w["need"]
        slots = F.length(F.translate(F.substring(w["flags"], first, end - first), "0", ""))
        return F.struct(end.alias("end"), (acc["n_windows"] + 1).alias("n_windows"), (acc["n_matched"] + end - first).alias("n_matched"), (acc["n_slots"] + slots).alias("n_slots"))

    return F.aggregate(starts, F.struct(*[F.lit(0).alias(n) for n in ("end", "n_windows", "n_matched", "n_slots")]), step)


def _stands(s: Column, w: Column, every: Column) -> Column:
    """Whether the agreeing window from s has the same values (code 2) throughout, or consistent slots and literals enough, by itself or in all that agrees."""
    verbatim = ~F.substring(w["codes"], s, w["need"]).contains("1")
    n_slots = F.length(F.translate(F.substring(w["flags"], s, w["need"]), "0", ""))
    literal = (n_slots <= (1 - LITERAL) * w["need"]) | (every["n_slots"] <= (1 - LITERAL) * every["n_matched"])
    slots = F.filter(F.slice(w["pairs"], s, w["need"]), _is_slot)
    distinct = F.array_distinct(F.transform(slots, lambda x: F.struct(x["b"].alias("item"), x["d"].alias("text"))))
    one_to_one = _let(distinct, lambda p: (F.size(F.array_distinct(F.transform(p, lambda x: x["item"]))) == F.size(p)) & (F.size(F.array_distinct(F.transform(p, lambda x: x["text"]))) == F.size(p)))
    return verbatim | (literal & one_to_one)


def _possible(w: Column) -> Column:
    """Whether a window of w can count: one has the same values throughout, or all that agrees holds the literals that one needs.

    Without this, a text of very many numbers would have every window of every shift judged.
    """
    literals = F.length(F.translate(w["codes"], "0", "")) - F.length(F.translate(w["flags"], "0", ""))
    return w["codes"].contains(F.repeat(F.lit("2"), w["need"])) | (literals >= LITERAL * w["need"])


def _judged(w: Column) -> Column:
    """_covered of the windows of w that count; w has need, pairs, and per pair codes (0 differs, 1 agrees, 2 has the same value) and flags (1 slot)."""
    last = F.length(w["codes"]) - w["need"] + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    agree = F.filter(places, lambda s: ~F.substring(w["codes"], s, w["need"]).contains("0"))
    return _let(agree, lambda starts: _let(_covered(starts, w), lambda every: _covered(F.filter(starts, lambda s: _stands(s, w, every)), w)))


def _compare(aligned: DataFrame, window: int) -> DataFrame:
    """(t, item_id, n_windows, n_matched, n_slots) per row of aligned; it has shift (text place less item place).

    Arrays enter lambdas as arguments only: a column that a lambda refers to
    would be evaluated again for every element.
    """
    skip = F.greatest(F.lit(0), -F.col("shift"))
    count = F.least(F.size("item_tokens") - skip, F.size("tokens") - F.col("shift") - skip)
    df = aligned.withColumn("need", F.least(F.size("item_tokens"), F.lit(window))).withColumn("skip", skip).withColumn("count", count)
    own, other = F.col("skip") + 1, F.col("skip") + F.col("shift") + 1
    zipped = F.arrays_zip(F.slice("item_tokens", own, F.col("count")).alias("a"), F.slice("item_slots", own, F.col("count")).alias("b"), F.slice("tokens", other, F.col("count")).alias("c"), F.slice("slots", other, F.col("count")).alias("d"))
    df = df.select("t", "item_id", "need", zipped.alias("pairs"))
    # of equal placeholders only equal slots have equal values; without placeholders, so do only equal tokens
    bare = lambda x: (_holds(x["a"]) | _holds(x["c"])) & (_value(x["b"]) == _value(x["d"]))
    codes = F.array_join(F.transform("pairs", lambda x: F.when((x["b"] == x["d"]) | bare(x), "2").when(_alike(x), "1").otherwise("0")), "")
    flags = F.array_join(F.transform("pairs", lambda x: F.when(_is_slot(x), "1").otherwise("0")), "")
    df = df.select("t", "item_id", F.struct("need", "pairs", codes.alias("codes"), flags.alias("flags")).alias("w"))
    return df.select("t", "item_id", _let(F.col("w"), lambda w: F.when(_possible(w), _judged(w))).alias("j")).select("t", "item_id", "j.n_windows", "j.n_matched", "j.n_slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text: str = "text", item: str = "item_id", window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(t, item_id, n_windows, n_matched, n_slots): texts by key and the items that they hold, with the best alignment.

    Tokens and slots are those under windows that count.
    """
    items = scratch.write(_tokens(benchmark, F.col(text), item).filter(F.size("tokens") >= least).select(F.col(item).alias("item_id"), F.col("tokens").alias("item_tokens"), F.col("slots").alias("item_slots")), "items")
    # An item needs a run of WINDOW tokens, or all of a shorter one; half of that is its probe. At most (window + 1) // 2 lengths differ.
    half = ((F.least(F.size("item_tokens"), F.lit(window)) + 1) / 2).cast("int")
    facts = items.select(half.alias("half"), F.size("item_tokens").alias("places")).groupBy("half").agg(F.count("*").alias("n"), F.sum("places").alias("places")).collect()
    sizes = sorted(r["half"] for r in facts)
    listed = items.withColumnsRenamed({"item_tokens": "tokens", "item_slots": "slots"})
    own = F.col("half") == F.col("size")
    item_probes = _probes(listed.withColumn("half", ((F.least(F.size("tokens"), F.lit(window)) + 1) / 2).cast("int")), sizes, True, "item_id", "half").filter(own).select("item_id", "size", F.col("place").alias("item_place"), "probe").distinct()
    keyed = docs.select(text_key(F.col(text)).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    probes = _probes(_tokens(keyed, F.col("text"), "t"), sizes, False, "t")
    side = F.broadcast(item_probes) if 4 * sum(r["places"] for r in facts) <= BROADCAST_PROBES else item_probes
    found = probes.join(side, ["size", "probe"]).select("t", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
    found = scratch.write(found, "found")
    texts = _tokens(texts_of(keyed, found.select("t").distinct()), F.col("text"), "t")
    by_item = F.broadcast(items) if sum(r["n"] for r in facts) <= BROADCAST_ITEMS else items
    aligned = _compare(found.join(texts, "t").join(by_item, "item_id"), window)
    best = F.max(F.struct("n_windows", "n_matched", "n_slots")).alias("best")
    return scratch.write(aligned.groupBy("t", "item_id").agg(best).filter("best.n_windows > 0").select("t", "item_id", "best.*"), "hits")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a passage of an item."""
    scratch = Scratch(docs.sparkSession, "decontam")
    hits = contaminated(docs, benchmark, scratch).select("t").distinct()
    scratch.keep("hits")
    return docs.select(as_row(docs).alias("row"), text_key(F.col("text")).alias("t")).join(hits, "t", "left_anti").select("row.*")


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "decontam")
    docs = read_table(spark, sf_dir, "documents")
    hits = contaminated(docs, read_table(spark, sf_dir, "benchmark"), scratch)
    rows = docs.select("doc_id", text_key(F.col("text")).alias("t")).join(hits, "t")
    result = checkpointed(rows.select("doc_id", "item_id", F.col("n_windows").cast("long"), F.col("n_matched").cast("long"), F.col("n_slots").cast("long")))
    scratch.drop()
    return result


QUERIES = {"op10_decontam": op10_decontam}
ORACLES: dict = {}
