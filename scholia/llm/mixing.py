"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, each source gets a target, and each document is
emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability
equal to the fraction, where rate = target / source size.

Defined results: a null text has size 0; a null source is a source of its own
(ordered last); a null doc_id draws as the empty string; rows that repeat a
doc_id share one draw; a source without words has rate 0; an empty table gives
an empty result. Columns of the input are read only by the names passed in;
further columns, whatever their names, are left alone, and an added column
whose name the input has gets underscores behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.session import as_row, checkpointed, read_table

SPACE = r"[\x20\x09-\x0D]"
MAX_RATE = 3
WEIGHTS = (5, 2, 1)
#: One row of the source table is under 200 bytes, so 10,000 of them stay under 2 MB.
BROADCAST_SOURCES = 10_000
SALTS = 64


def word_count(text: Column) -> Column:
    """Number of maximal runs of other than ASCII white space; null counts 0."""
    pieces = F.size(F.split(text, SPACE + "+", -1))
    outer = text.rlike(rf"\A{SPACE}").cast("int") + text.rlike(rf"{SPACE}\z").cast("int")
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(pieces - outer).cast("long")


def draw(key: Column, seed: str) -> Column:
    """A uniform number in [0, 1) from the first 52 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return bits.cast("long") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water-filling in closed form: by rising max size per weight, the sources
    that stop at max_rate times their size come first, and what they leave is
    shared by weight among the rest. One row per source goes through the
    ordered windows, never a row per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("ratio", "rank")
    everything = Window.partitionBy()
    table = (
        sizes.withColumn("weight", weigh.cast("long"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("cap", F.col("source_size") * max_rate)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight").cast("double"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", F.col("cap").cast("double") * F.col("weight_left").cast("double") < F.col("weight").cast("double") * (F.col("total") - F.col("before")).cast("double"))
        .withColumn("rest", F.col("total") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("rest_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    )
    share = (F.col("weight") * F.col("rest")).cast("double") / F.col("rest_weight").cast("double")
    return table.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = "mix:") -> DataFrame:
    """docs with columns mix_size, mix_source_size, mix_target and mix_copies added (see free_name)."""
    planned = _planned(docs, key, text, source, weights, max_rate, seed)
    return planned.select("row.*", *[F.col(c).alias(free_name(docs, f"mix_{c}")) for c in ("size", "source_size", "target", "copies")])


def _planned(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_rate: int = MAX_RATE, seed: str = "mix:") -> DataFrame:
    """(row, size, source_size, target, copies): every row of docs as one struct, and what the mix takes of it.

    The source table is joined by broadcast only when it was counted to be at
    most BROADCAST_SOURCES rows; beyond that both sides are salted, so that a
    source with a third of all rows is spread over SALTS tasks.
    """
    sized = docs.select(as_row(docs).alias("row"), F.col(key).alias("key"), F.col(source).alias("own_source"), word_count(F.col(text)).alias("size"), F.pmod(F.xxhash64(key, text), F.lit(SALTS)).cast("int").alias("own_salt"))
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(word_count(F.col(text))).alias("source_size"))
    targets = checkpointed(source_targets(sizes, weights, max_rate))
    same = F.col("own_source").eqNullSafe(F.col("source"))
    if targets.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(targets), same)
    else:
        salted = targets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.join(salted, same & (F.col("own_salt") == F.col("salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (draw(F.col("key"), seed) < rate - whole).cast("long")
    return joined.select("row", "size", "source_size", "target", (whole.cast("long") + extra).alias("copies"))


def free_name(docs: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as it takes to be no column of docs."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of docs and copy_no (from 0; see free_name), one row per copy taken."""
    copies = _planned(docs, **options).filter("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("number")).select("row.*", F.col("number").alias(free_name(docs, "copy_no")))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((rank - 1) % 3 + 1 AS INT)] AS BIGINT) AS weight, source_size * 3 AS cap FROM sizes
), ordered AS (
  SELECT *, CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE) AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM weighed
), filled AS (
  SELECT *,
    CAST(coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
    CAST(sum(weight) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weight_left
  FROM ordered
), flagged AS (
  SELECT *, CAST(cap AS DOUBLE) * CAST(weight_left AS DOUBLE) < CAST(weight AS DOUBLE) * CAST(total - before AS DOUBLE) AS is_full FROM filled
), rested AS (
  SELECT *, CAST(total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS BIGINT) AS rest,
    CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS BIGINT) AS rest_weight FROM flagged
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(weight * rest AS DOUBLE) / CAST(rest_weight AS DOUBLE) END AS target FROM rested
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM rated
"""

QUERIES = {"op1_mix": op1_mix}
ORACLES = {"op1_mix": OP1_SQL}
