"""Sentences of chunks: splitting, boundary fragments, positions, de-duplication, caps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import lexicons as L
from scholia.functions.text import ends_like_sentence, identity_key, searchable_text, starts_like_sentence
from scholia.operators.places import numbered
from scholia.session import checkpointed

MIN_WORDS = 4
_SPACE = "[ \\t\\n\\x0b\\f\\r]"
_LINES = regex.compile("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]")
_BULLET = regex.compile(rf"^{_SPACE}*[•▪●◦‣·\-–—*o]{_SPACE}+")
_FURNITURE = regex.compile(rf"^{_SPACE}*([0-9]{{1,4}}|[!-/:-@\[-`{{-~ \t\n\x0b\f\r]+){_SPACE}*$")
_TOKEN = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_TRIM = "".join(map(chr, range(33)))


def matching_words(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text.lower()) if t not in _STOP]


_STOP = frozenset(L.STOPWORDS)


#: A bulleted line, in the text between lines and sentences.
_ITEM = "\0"
#: A line break within a sentence: nothing ended before it, and what follows starts in lower case or closes a bracket.
_WRAPPED = regex.compile(r"(?<![.!?:;])\n(?=[\p{Lowercase})\]])")
#: The start of a word: of a line, after a blank, or after the gap behind a sentence.
_WORD_START = rf"(?:^|[\n{_ITEM} ]|[.!?]{_SPACE}+(?=[A-Z]))"
_SHORT = "|".join(regex.escape(w) for w in sorted(L.ABBREVIATIONS))
#: Where a sentence ends: a line break, or a gap after a stop that closes neither an abbreviation nor an initial.
_GAP = regex.compile(rf"\n{_ITEM}?|(?<=[.!?])(?<!{_WORD_START}(?:(?i:{_SHORT})|\p{{L}}\.)){_SPACE}+(?=[\"'(\[A-Z0-9])")


def _running_text(text: str) -> str:
    """Lines without bullets and page furniture, wrapped ones joined; what was a bullet starts with _ITEM."""
    raw = (line.strip(_ASCII_TRIM).replace(_ITEM, "") for line in _LINES.split(text))
    bare = ((bool(_BULLET.match(line)), _BULLET.sub("", line, count=1).strip(_ASCII_TRIM)) for line in raw)
    return _WRAPPED.sub(" ", "\n".join(_ITEM * item + line for item, line in bare if line and not _FURNITURE.match(line)))


def split_sentences(text: str | None) -> list[str]:
    """Sentences of MIN_WORDS words or more, in order."""
    pieces = (p.strip(_ASCII_TRIM) for p in _GAP.split(_running_text(text or "")))
    return [p for p in pieces if len(regex.findall(r"[^ \t\n\x0b\f\r]+", p)) >= MIN_WORDS]


def chunk_sentences(chunks: DataFrame, *keep: str) -> DataFrame:
    """(keep, index, pieces, prose, text): the sentences of each chunk's content, from index 0."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.select(*keep).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["sentences"] = [split_sentences(t) for t in batch["content"]]
            batch["prose"] = [sum(1 for x in _LINES.split(t or "") if x.strip()) <= 2 for t in batch["content"]]
            yield batch[[*keep, "sentences", "prose"]]

    split = chunks.select(*keep, "content").mapInPandas(run, f"{schema}, sentences array<string>, prose boolean")
    return split.select(*keep, F.size("sentences").alias("pieces"), "prose", F.posexplode("sentences").alias("index", "text"))


def is_fragment(text: Column, index: Column, pieces: Column, prose: Column) -> Column:
    return ~starts_like_sentence(text) | (prose & (pieces > 1) & (index == pieces - 1) & ~ends_like_sentence(text))


def sentence_corpus(sources: DataFrame, limit: int, request: str = "request_id") -> DataFrame:
    """The sentences of each request's sources (request, source_order, document_id, chunk_id, content, ...).

    Adds position (over all that are no fragments, before duplicates go),
    previous (within the chunk, null after a fragment), text and searchable;
    keeps the first sighting of each identity and the first `limit` of a request.
    """
    keep = [c for c in sources.columns if c != "content"]
    rows = chunk_sentences(sources, *keep)
    rows = rows.withColumn("fragment", is_fragment(F.col("text"), F.col("index"), F.col("pieces"), F.col("prose")))
    own = Window.partitionBy(request, "source_order").orderBy("index")
    rows = rows.withColumn("previous", F.lag(F.when(~F.col("fragment"), F.col("text"))).over(own)).filter(~F.col("fragment"))
    reading = Window.partitionBy(request).orderBy("source_order", "index")
    rows = rows.withColumn("position", F.row_number().over(reading) - 1).withColumn("identity", identity_key(F.col("text")))
    first = Window.partitionBy(request, "identity").orderBy("position")
    rows = rows.withColumn("sighting", F.row_number().over(first)).filter("sighting = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(request).orderBy("position"))).filter(F.col("place") <= limit)
    return rows.withColumn("searchable", searchable_text(F.col("text"), F.col("previous"))).drop("fragment", "sighting", "place", "pieces", "prose", "index")


def even_stride(rows: DataFrame, group: str, most: int, *order: str) -> DataFrame:
    """At most `most` rows of each group, evenly spread over its order, ends included.

    Places are given to the keys alone, without a window over a group, and the
    picked keys (at most `most` a group) then fetch their rows. Of rows that
    share a key as many stay as were picked.
    """
    keys = [group, *order]
    placed = numbered(rows.select(*keys), group, *order)
    if most == 1:
        chosen = placed.filter("place = 0")
    else:
        # Row r is picked if some i has floor(i * (n - 1) / (most - 1) + 0.5) = r; only i near r's share can.
        near = F.floor(F.col("place") * (most - 1) / F.greatest(F.col("size") - 1, F.lit(1))).cast("int")
        picked = F.lit(False)
        for step in (0, 1):
            i = near + step
            picked = picked | ((i <= most - 1) & (F.floor(i * (F.col("size") - 1) / (most - 1) + 0.5) == F.col("place")))
        chosen = placed.filter((F.col("size") <= most) | picked)
    picks = checkpointed(chosen.groupBy(*keys).agg(F.count("*").alias("stride_n"))).withColumnsRenamed({k: f"stride_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"stride_{k}")) for k in keys]
    found = rows.join(picks, same)
    nth = Window.partitionBy(*keys).orderBy(*order)
    return found.withColumn("stride_i", F.row_number().over(nth)).filter("stride_i <= stride_n").select(*rows.columns)


def with_fallback(rows: DataFrame, request: str, keep: Column) -> DataFrame:
    """Rows that pass, or all rows of a request of which none passes."""
    return rows.withColumn("passes", keep).withColumn("any_passes", F.max("passes").over(Window.partitionBy(request))).filter("passes OR NOT any_passes").drop("passes", "any_passes")
