"""Overlapping word-window chunks of pages, with offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.session import checkpointed

TARGET, OVERLAP = 180, 30
#: So many ids of documents with several pages are broadcast: at most 100 MB.
MOST_SENT = 500_000
_WORD = re.compile(r"\S+", re.ASCII)
_BLANK_LINE = re.compile(r"\n\s*\n", re.ASCII)


def _check(target: int, overlap: int) -> None:
    if target <= 0 or not 0 <= overlap < target:
        raise ValueError("target must be positive and overlap at least 0 and below target")


def chunk_pages(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks (document_id, project_id, page, index, n_words, char_start, char_end, content) of pages
    (document_id, project_id, page, text).

    A window that ends before the page does is moved to the nearest paragraph
    boundary within max(5, target / 5) words, the earlier one on ties. Pages
    without a blank line, where no window can move, take the closed form of
    native expressions; the others go through one Arrow pass.
    """
    _check(target, overlap)
    plain = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\n\s*\n")
    return fixed_chunks(pages.filter(plain), target, overlap).unionByName(paragraph_chunks(pages.filter(~plain), target, overlap))


def fixed_chunks(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """The closed form: windows start at 0, target - overlap, ... while the one before ends early."""
    _check(target, overlap)
    step = target - overlap
    cut = pages.filter(F.col("text").isNotNull()).select("document_id", "project_id", "page", "text", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("words"), F.split("text", r"\S+", -1).alias("gaps")).filter(F.size("words") > 0)
    n = F.size("words")
    reach = F.transform(F.arrays_zip("words", "gaps"), lambda x: F.coalesce(F.length(x["words"]), F.lit(0)) + F.length(x["gaps"]))
    cut = cut.select("document_id", "project_id", "page", "text", "gaps", n.alias("n"), reach.alias("reach"))

    def reached(parts: Column) -> Column:
        """The sum of the first 0, step, 2 step, ... lengths: one pass, and an append per window."""
        sums = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x))
        return F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    last = F.greatest(F.lit(0), F.ceil((F.col("n") - target) / step)).cast("int")
    steps = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("reach", i * step + 1, step))
    rows = cut.withColumn("starts", reached(steps)).withColumn("windows", F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("index"), (i * step).alias("s"), F.least(F.col("n"), i * step + target).alias("e"))))

    def within(w: Column) -> Column:
        return F.aggregate(F.slice("reach", w["s"] + 1, w["e"] - w["s"]), F.lit(0), lambda a, x: a + x)

    placed = F.transform("windows", lambda w: F.struct(w["index"].alias("index"), (w["e"] - w["s"]).alias("n_words"), (F.get("starts", w["index"]) + F.length(F.get("gaps", w["s"]))).alias("char_start"), (F.get("starts", w["index"]) + within(w)).alias("char_end")))
    out = rows.select("document_id", "project_id", "page", "text", F.explode(placed).alias("w")).select("document_id", "project_id", "page", "w.*", "text")
    return out.withColumn("content", F.substring(F.col("text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).drop("text")


def _windows(text: str, target: int, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """(index, words, first character, end character) of one page."""
    spans = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in spans]
    breaks = {sum(1 for a in starts if a < m.end()) for m in _BLANK_LINE.finditer(text)} if spans else set()
    n, at, index, radius = len(spans), 0, 0, max(5, target // 5)
    while at < n:
        end = min(n, at + target)
        if end < n:
            near = [b for b in range(max(at + 1, end - radius), min(n, end + radius) + 1) if b in breaks]
            end = min(near, key=lambda b: (abs(b - end), b)) if near else end
        yield index, end - at, spans[at][0], spans[end - 1][1]
        if end >= n:
            return
        at, index = max(end - overlap, at + 1), index + 1


def paragraph_chunks(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """The general form, for pages with blank lines."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select("document_id", "project_id", "page").schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.document_id, r.project_id, r.page, *w, r.text[w[2] : w[3]]) for r in batch.itertuples() if r.text for w in _windows(r.text, target, overlap)]
            yield pd.DataFrame(rows, columns=["document_id", "project_id", "page", "index", "n_words", "char_start", "char_end", "content"])

    return pages.select("document_id", "project_id", "page", "text").mapInPandas(run, f"{schema}, index int, n_words int, char_start int, char_end int, content string")


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with a running ordinal over a document's pages and a deterministic id."""
    order = Window.partitionBy("document_id").orderBy(F.col("page").asc_nulls_first(), "index")
    return _named(chunks.withColumn("ordinal", F.row_number().over(order) - 1))


def _named(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), F.col("ordinal").cast("string")), 256)).drop("index")


def numbered_chunks(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """What number_chunks gives over the chunks of pages, but only documents of several pages meet a shuffle: in one page a chunk's index is its ordinal."""
    several = checkpointed(pages.groupBy("document_id").count().filter("count > 1").select(F.col("document_id").alias("several")))
    n = several.count()
    if n > MOST_SENT:
        return number_chunks(chunk_pages(pages, target, overlap))

    def own(how: str) -> DataFrame:
        return chunk_pages(pages.join(F.broadcast(several), F.col("document_id").eqNullSafe(F.col("several")), how) if n else pages, target, overlap)

    single = _named(own("left_anti").withColumn("ordinal", F.col("index")))
    return single.unionByName(number_chunks(own("left_semi"))) if n else single
