"""Removal of repeated byte strings: suffix order by Burrows-Wheeler transform, in parts.

A byte goes when a string of LENGTH bytes over it also starts anywhere else.
Every string of LENGTH bytes is given to one anchor, the smallest hash among
its GRAM-byte pieces, so equal strings meet at equal anchors. Strings of one
anchor that follow each other form a region. Anchors that occur once are
dropped; equal regions need only counting; regions that share an anchor but
differ are laid end to end, and threshold-bounded interval expansion on their
Burrows-Wheeler transform finds the strings that repeat (bwt.py).

Before an expansion, strings are set aside whose middle (what all strings at
about the same offset to the anchor hold) no other region of the anchor has:
they cannot repeat. An anchor with more than GROUP different regions is split by content: its
strings are cut by their offset to the anchor into ever narrower blocks, and
grouped by the bytes that all strings of a block hold. At the last width a
group is one string, so nothing is capped and no group is gathered.

Defined results: null texts are empty; texts are UTF-8 bytes; texts shorter
than LENGTH lose nothing; copies of a text of LENGTH bytes or more vanish
whole; repeated rows are copies; a null doc_id is kept; empty tables give empty
results. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.bwt import repeated_windows
from scholia.llm.neardup import text_key, texts_of
from scholia.llm.wordhash import U, chunks, mix, raw_bytes
from scholia.session import Scratch, checkpointed, read_table

LENGTH = 200
GRAM = 40
GROUP = 256
WIDTHS = (41, 11, 3, 1)
#: Offsets to the anchor whose strings are set aside together.
STRETCH = 27
BATCH_BYTES = 400_000
SEGMENT = 1_000_000
_P = 0xD1342543DE82EF95
_PLACE = U((1 << 22) - 1)


class Hasher:
    """Hashes of any byte range of one array, independent of the place."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        with np.errstate(over="ignore"):
            powers = np.full(n + 1, U(_P), dtype=U)
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
            self.sums = np.zeros(n + 1, dtype=U)
            np.cumsum((data.astype(U) + U(1)) * powers[:-1], out=self.sums[1:])
            self.back = np.full(n + 1, U(pow(_P, -1, 1 << 64)), dtype=U)
            self.back[0] = 1
            np.multiply.accumulate(self.back, out=self.back)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U) * U(0x9E3779B97F4A7C15))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def regions(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, wins, lead, anchor, content) of texts end to end.

    A region is `wins` strings of LENGTH bytes, at start, start + 1, ... of its
    row, whose anchor lies `lead` bytes after start; content hashes its bytes.
    """
    n = len(data)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.int64, np.int64))
    hasher = Hasher(data)
    at = np.arange(n - GRAM + 1)
    grams = hasher(at, at + GRAM)
    least = sliding_min((grams & ~_PLACE) | at.astype(U), LENGTH - GRAM + 1)
    anchor = (least & _PLACE).astype(np.int64)
    begin = np.arange(len(anchor))
    row = np.searchsorted(offsets, begin, side="right") - 1
    whole = begin + LENGTH <= offsets[row + 1]
    begin, row, anchor = begin[whole], row[whole], anchor[whole]
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    fresh = np.ones(len(begin), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(fresh)
    wins = np.diff(np.append(first, len(begin)))
    start, row, anchor = begin[first], row[first], anchor[first]
    content = hasher(start, start + wins + LENGTH - 1)
    lead = anchor - start
    with np.errstate(over="ignore"):
        content = mix(content + lead.astype(U))
    return row, start - offsets[row], wins, lead, grams[anchor].view(np.int64), content.view(np.int64)


def region_table(docs: DataFrame) -> DataFrame:
    """(t, start, wins, lead, anchor, content) of docs (t, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_bytes(batch.column("text"))
            keys = batch.column("t")
            for first, last in chunks(offsets, SEGMENT):
                a, b = int(offsets[first]), int(offsets[last])
                # One very long text goes in segments that overlap by LENGTH - 1 bytes.
                for low in range(a, b, SEGMENT) if b - a > SEGMENT else (a,):
                    high = min(b, low + SEGMENT + LENGTH - 1) if b - a > SEGMENT else b
                    ends = offsets[first : last + 1] - a if b - a <= SEGMENT else np.array([0, high - low])
                    row, start, wins, lead, anchor, content = regions(data[low:high], ends)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row + first)), pa.array(start + (low - a), pa.int32()), pa.array(wins, pa.int32()), pa.array(lead, pa.int32()), pa.array(anchor), pa.array(content)], names=["t", "start", "wins", "lead", "anchor", "content"])

    return docs.mapInArrow(run, "t binary, start int, wins int, lead int, anchor long, content long")


def _bodies(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """reps (anchor, content, t, start, wins, lead) with the bytes of their regions; bounded by a text per row."""
    by_text = reps.groupBy("t").agg(F.collect_list(F.struct("anchor", "content", "start", "wins", "lead")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, parts in zip(batch.column("text"), batch.column("parts").to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                columns = [[p[c] for p in parts] for c in ("anchor", "content", "wins", "lead")]
                bodies = [raw[p["start"] : p["start"] + p["wins"] + LENGTH - 1] for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([0] * len(parts), pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(bodies, pa.binary())], names=["anchor", "content", "key", "sub", "base", "wins", "lead", "body"])

    return by_text.join(texts, "t").select("text", "parts").mapInArrow(run, "anchor long, content long, key long, sub long, base int, wins int, lead int, body binary")


def _live_pieces(held: list[dict]) -> list[tuple[int, int, bytes]]:
    """(row, first string, bytes) of the strings whose middle another row of the same key has.

    Strings whose offsets to the anchor fall in one stretch all hold the bytes
    between the last start and the first end, so equal strings have equal
    middles; a middle met once has no string that repeats. Hashes that clash
    only keep more.
    """
    middles: Counter[int] = Counter()
    tags = []
    for r in held:
        lead, body, low = r["lead"], r["body"], r["lead"] - r["wins"] + 1
        own = []
        for k in range(low // STRETCH, lead // STRETCH + 1):
            near, far = k * STRETCH, min(k * STRETCH + STRETCH - 1, LENGTH - GRAM)
            own.append((k, hash((r["key"], k, body[lead - near : lead + LENGTH - far]))))
        middles.update(tag for _, tag in own)
        tags.append(own)
    out = []
    for row, (r, own) in enumerate(zip(held, tags, strict=True)):
        run: list[int] = []
        for k, tag in [*reversed(own), (-2, 0)]:
            if k >= 0 and middles[tag] > 1 and (not run or run[-1] == k + 1):
                run.append(k)
                continue
            if run:
                first = max(0, r["lead"] - run[0] * STRETCH - STRETCH + 1)
                last = min(r["wins"] - 1, r["lead"] - run[-1] * STRETCH)
                out.append((row, first, r["body"][first : last + LENGTH]))
            run = [k] if k >= 0 and middles[tag] > 1 else []
    return out


def _expand(rows: DataFrame) -> DataFrame:
    """(anchor, content, ranges) by interval expansion: groups of equal key, whole, in batches."""

    def solve(held: list[dict]) -> pa.RecordBatch:
        pieces = _live_pieces(held)
        ranges: dict[int, list[int]] = {}
        for (row, first, _), flag in zip(pieces, repeated_windows([x[2] for x in pieces], LENGTH), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
            if len(edges):
                ranges.setdefault(row, []).extend((edges + (held[row]["base"] + first)).tolist())
        own = [held[k] for k in ranges]
        return pa.RecordBatch.from_arrays([pa.array([r["anchor"] for r in own], pa.int64()), pa.array([r["content"] for r in own], pa.int64()), pa.array(list(ranges.values()), pa.list_(pa.int32()))], names=["anchor", "content", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for r in batch.to_pylist():
                if size > BATCH_BYTES and r["key"] != held[-1]["key"]:
                    yield solve(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["body"])
        if held:
            yield solve(held)

    return rows.repartition("key").sortWithinPartitions("key", "sub").mapInArrow(run, "anchor long, content long, ranges array<int>")


def _split(rows: DataFrame, width: int) -> DataFrame:
    """rows cut into blocks of `width` offsets to the anchor, keyed by the bytes that a block's strings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("anchor", "content", "key", "sub", "base", "wins", "lead", "body")}
            for r in batch.to_pylist():
                at = 0
                while at < r["wins"]:
                    block = (r["lead"] - at) // width
                    end = min(r["wins"], r["lead"] - block * width + 1)
                    near, far = block * width, min(block * width + width - 1, LENGTH - GRAM)
                    core = r["body"][r["lead"] - near : r["lead"] + LENGTH - far]
                    body = r["body"][at : end + LENGTH - 1]
                    key = hashlib.blake2b(core, digest_size=8, salt=b"%d" % width, person=(r["key"] & (2**64 - 1)).to_bytes(8, "big")).digest()
                    sub = hashlib.blake2b(body, digest_size=8, salt=b"%d" % (r["lead"] - at)).digest()
                    for c, v in (("anchor", r["anchor"]), ("content", r["content"]), ("key", int.from_bytes(key, "big", signed=True)), ("sub", int.from_bytes(sub, "big", signed=True)), ("base", r["base"] + at), ("wins", end - at), ("lead", r["lead"] - at), ("body", body)):
                        out[c].append(v)
                    at = end
            yield pa.RecordBatch.from_pydict({c: pa.array(v, {"base": pa.int32(), "wins": pa.int32(), "lead": pa.int32(), "body": pa.binary()}.get(c, pa.int64())) for c, v in out.items()})

    return rows.mapInArrow(run, "anchor long, content long, key long, sub long, base int, wins int, lead int, body binary")


def _resolve(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(anchor, content, ranges): repeated strings of rows that are distinct by (key, sub)."""
    found = None
    for level, width in enumerate((*WIDTHS, 0)):
        sizes = rows.groupBy("key").agg(F.count("*").alias("classes"))
        sized = rows.join(sizes.filter("classes > 1"), "key")
        small = scratch.write(_expand(sized.filter(F.col("classes") <= GROUP).drop("classes")), f"expanded{level}")
        found = small if found is None else found.unionByName(small)
        big = scratch.write(sized.filter(F.col("classes") > GROUP).drop("classes"), f"big{level}")
        if not width or big.isEmpty():
            break
        parts = scratch.write(_split(big, width), f"parts{level}")
        alike = parts.groupBy("key", "sub").agg(F.count("*").alias("n"))
        many = parts.join(alike.filter("n > 1").select("key", "sub"), ["key", "sub"])
        found = found.unionByName(many.select("anchor", "content", F.array("base", F.col("base") + F.col("wins")).alias("ranges")))
        rows = scratch.write(parts.dropDuplicates(["key", "sub"]), f"rows{level}")
    return found


def repeated_spans(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """(t, spans): per distinct text the byte ranges [from, to, from, to, ...] to remove, merged and ascending."""
    keyed = docs.select(text_key(F.col(text)).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = scratch.write(region_table(keyed.filter(F.octet_length("text") >= LENGTH)), "regions")
    live = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi")).filter("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    live = scratch.write(live, "live-anchors")  # as a table, so that the join can split a frequent anchor
    live_rows = scratch.write(every.join(live, "anchor"), "live")
    classes = live_rows.groupBy("anchor", "content", "mixed", "wins", "lead").agg(F.count("*").alias("n"), F.min(F.struct("t", "start")).alias("rep"))
    classes = scratch.write(classes, "classes")
    reps = classes.filter("mixed").select("anchor", "content", "wins", "lead", "rep.t", "rep.start")
    texts = texts_of(keyed, scratch.write(reps.select("t").distinct(), "rep-keys"))
    found = _resolve(scratch.write(_bodies(reps, texts), "bodies"), scratch)
    whole = classes.filter("n > 1").select("anchor", "content", F.array(F.lit(0), F.col("wins")).alias("ranges"))
    once = found.join(classes.filter("n = 1").select("anchor", "content"), ["anchor", "content"])
    # A class of one region has pieces of at most LENGTH - GRAM + 1 strings, so its list is short.
    marks = once.groupBy("anchor", "content").agg(F.flatten(F.collect_list("ranges")).alias("ranges")).unionByName(whole)
    hits = live_rows.join(scratch.write(marks, "marks"), ["anchor", "content"])
    pairs = hits.select("t", F.explode(F.transform(F.sequence(F.lit(0), (F.size("ranges") / 2).cast("int") - 1), lambda k: F.struct((F.col("start") + F.get("ranges", 2 * k)).alias("a"), (F.col("start") + F.get("ranges", 2 * k + 1) + LENGTH - 1).alias("b")))).alias("r"))
    return scratch.write(pairs.select("t", "r.a", "r.b").distinct(), "ranges")


def _digests(ranges: DataFrame, texts: DataFrame) -> DataFrame:
    """(t, n_removed, n_spans, kept_sha256, kept) of texts with ranges."""
    lists = ranges.groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, hashes = [], [], []
            for text, parts in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                steps = np.zeros(len(raw) + 1, dtype=np.int32)
                np.add.at(steps, [p["a"] for p in parts], 1)
                np.add.at(steps, [p["b"] for p in parts], -1)
                gone = np.cumsum(steps)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(gone & ~np.concatenate(([False], gone[:-1])))))
                hashes.append(hashlib.sha256(raw[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())], names=["t", "n_removed", "n_spans", "kept_sha256"])

    return lists.join(texts, "t").select("t", "text", "spans").mapInArrow(run, "t binary, n_removed long, n_spans long, kept_sha256 string")


def substring_digest(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) per row of docs.

    Texts that are copies vanish whole by count alone; only texts that lose a
    part are read again.
    """
    own = docs.select(F.col(key), text_key(F.col(text)).alias("t"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("whole_sha"))
    own = scratch.write(own, "own")
    copies = scratch.write(own.groupBy("t").agg(F.count("*").alias("n")).filter("n > 1").select("t", F.lit(True).alias("copied")), "copies")
    ranges = repeated_spans(docs, scratch, text).join(copies, "t", "left_anti")
    ranges = scratch.write(ranges, "single-ranges")
    keyed = docs.select(text_key(F.col(text)).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = texts_of(keyed, scratch.write(ranges.select("t").distinct(), "range-keys"))
    digests = scratch.write(_digests(ranges, texts), "digests")
    joined = own.join(copies, "t", "left").join(digests, "t", "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= LENGTH)
    return joined.select(key, "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole_sha")).alias("kept_sha256"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "substrings")
    result = checkpointed(substring_digest(read_table(spark, sf_dir, "documents"), scratch))
    scratch.drop()
    return result


QUERIES = {"op3_substrings": op3_substrings}
ORACLES: dict = {}
