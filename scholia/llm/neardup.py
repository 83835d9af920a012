"""Near duplicates: DartMinHash signatures, banded joining, exact verification.

Texts are sets of five-word shingles (a text of fewer words is one shingle),
and two texts are linked at a Jaccard similarity of 0.8 or more. Exact copies
are one text by their MD5. Every distinct text gets a DartMinHash signature and
one key per band; texts that share a band key are candidates.

First each text of a band is verified against the band's leader only: the text
that meets most others over all its bands, so the one that edited copies stem
from. Bands whose texts are then still in different components are compared
inside one task each, every text sent once, up to GROUP_ROWS rows and
GROUP_BYTES of text. There a text that shares too little with other components
to be similar to anything is set aside first, exactly; the others are verified,
each pair in the first band that it shares. Larger bands are cut into blocks,
and the blocks of the largest component are never compared with each other. A
text of five words or more shares no band with a similar one with probability
under (1 - 0.8^4)^32 < 1e-7; all else is exact.

Defined results: null texts are empty and all empty texts are copies of each
other; a null doc_id is smallest nowhere unless a class has no other; repeated
rows share a class; empty tables give empty results. Only the named columns
are read; others, whatever their names, pass through `keep_one` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.components import components
from scholia.llm.wordhash import U, chunks, mix, ngrams, raw_bytes, word_hashes, word_spans
from scholia.session import Scratch, as_row, checkpointed, read_table

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Bounds of what one task compares at once.
GROUP_ROWS, GROUP_BYTES = 2_048, 16_000_000
#: Texts are hashed in pieces of so many bytes and rows; a row throws about 900 darts.
PIECE_BYTES, PIECE_ROWS = 1_000_000, 2_048
#: A key of 16 bytes and its overhead stay under 100 bytes a row: at most 20 MB.
BROADCAST_KEYS = 200_000
_SEED = U(0x51ED270B76A4D3C5)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, shingle hashes, row of each) with distinct shingles by row."""
    data, offsets = raw_bytes(texts)
    for first, last in chunks(offsets, PIECE_BYTES, PIECE_ROWS):
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        starts, ends, counts = word_spans(part, at)
        words = word_hashes(part, starts, ends)
        grams, rows = ngrams(words, counts, SHINGLE)
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        if len(short):
            cut = np.concatenate(([0], np.cumsum(counts)))
            own = np.array([ngrams(words[cut[r] : cut[r + 1]], counts[r : r + 1], int(counts[r]))[0][0] for r in short], dtype=U)
            grams, rows = np.concatenate((grams, own)), np.concatenate((rows, short))
        order = np.lexsort((grams, rows))
        grams, rows = grams[order], rows[order]
        fresh = np.ones(len(grams), dtype=bool)
        fresh[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        yield first, last, grams[fresh], rows[fresh]


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U(11)).astype(np.float64) * (1.0 / (1 << 53))


def _darts(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray, limit: np.ndarray, hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, coordinate, rank, id) of the darts that fall below an element's weight and its row's rank limit.

    The weight axis is cut into dyadic cells [0, 1), [1, 2), [2, 4), ... In a
    cell darts arrive along the rank axis at the rate of the cell's width, by
    exponential gaps drawn from a hash of element, cell and number, so the same
    element throws the same darts in every text.
    """
    out: list[tuple[np.ndarray, ...]] = []
    heaviest = float(weights.max()) if len(elements) else 0.0
    low, width, cell = 0.0, 1.0, 1
    while low < heaviest:
        own = np.flatnonzero(weights > low)
        seed = mix(elements[own] ^ U(cell) * U(0xD1342543DE82EF95) ^ _SEED)
        most, rank = limit[rows[own]], np.zeros(len(own))
        dart = 0
        while len(own):
            name = mix(seed + U(2 * dart + 1) * U(0xA0761D6478BD642F))
            rank = rank - np.log1p(-_uniform(name)) / width
            live = rank < most
            own, seed, most, rank, name = own[live], seed[live], most[live], rank[live], name[live]
            inside = low + width * _uniform(mix(name + U(1))) < weights[own]
            kept = name[inside]
            out.append((rows[own[inside]], (mix(kept + U(3)) % U(hashes)).astype(np.int64), rank[inside], kept))
            dart += 1
        low, width, cell = low + width, max(width, low + width), cell + 1
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def dart_signatures(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray, n: int, hashes: int = HASHES) -> np.ndarray:
    """DartMinHash: an array (n, hashes) of dart ids; two rows agree at a coordinate
    with probability equal to their weighted Jaccard similarity. Rows without elements are 0.

    Darts up to rank (k ln k + 2k) / weight cover all k coordinates of most
    rows; rows with an empty coordinate try again with twice the rank.
    """
    out = np.zeros((n, hashes), dtype=U)
    total = np.bincount(rows, weights=weights, minlength=n)
    pending = np.flatnonzero(total > 0)
    darts = hashes * np.log(hashes) + 2 * hashes
    with np.errstate(over="ignore"):
        while len(pending):
            limit = np.zeros(n)
            limit[pending] = darts / total[pending]
            own = limit[rows] > 0
            row, coordinate, rank, name = _darts(elements[own], weights[own], rows[own], limit, hashes)
            slot = row * hashes + coordinate
            order = np.argsort(slot + 0.999 * rank / limit[row], kind="stable")  # by coordinate, then rank
            slot, name = slot[order], name[order]
            first = np.ones(len(slot), dtype=bool)
            first[1:] = slot[1:] != slot[:-1]
            out.reshape(-1)[slot[first]] = name[first]
            filled = np.bincount(slot[first] // hashes, minlength=n)
            pending = pending[filled[pending] < hashes]
            darts *= 2
    return out


def band_keys(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """(n, bands) int64 keys of bands of equally many coordinates."""
    n, width = signatures.shape
    with np.errstate(over="ignore"):
        parts = signatures.reshape(n, bands, width // bands)
        key = np.broadcast_to(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15), (n, bands)).copy()
        for k in range(width // bands):
            key = mix(key ^ parts[:, :, k]) * U(0x2545F4914F6CDD1D)
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(t, bands) of docs (t, text): texts with words; a copy within one task is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fresh = []
            for i, key in enumerate(batch.column("t").to_pylist()):
                if key not in seen:
                    fresh.append(i)
                    if len(seen) < 500_000:
                        seen.add(key)
            part = batch.take(pa.array(fresh, pa.int64()))
            for first, last, grams, rows in shingles(part.column("text")):
                keys = band_keys(dart_signatures(grams, np.ones(len(grams)), rows, last - first))
                full = np.flatnonzero(np.bincount(rows, minlength=last - first) > 0)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(full) + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys[full].reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("t").slice(first, last - first).take(pa.array(full)), flat], names=["t", "bands"])

    return docs.mapInArrow(run, "t binary, bands array<long>")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(t, text), once for each of keys (t, distinct). Broadcast only when counted to be at most BROADCAST_KEYS."""
    side = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    return docs.join(side, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))


def similar_pairs(pairs: DataFrame, texts: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Of pairs (a, b), those whose shingle sets have a Jaccard similarity of `least` or more."""

    def sets(column: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for first, last, grams, rows in shingles(column):
            cut = np.searchsorted(rows, np.arange(last - first + 1))
            out += [grams[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_jaccard(x, y) >= least for x, y in zip(sets(batch.column("text_a")), sets(batch.column("text_b")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("t").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("t").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes."""
    if not len(x) or not len(y) or min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return float(len(x) == len(y) == 0)
    shared = len(x) + len(y) - len(np.union1d(x, y))
    return shared / (len(x) + len(y) - shared)


def _apart(sets: list[np.ndarray], component: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which sets are still open, their shingles as numbers, the set of each).

    A shingle that only one component holds joins nothing, so a set has at most
    `cap` shingles in common with another component's, and is similar only to
    sets of at most 2.25 cap - size shingles (at 0.8). Sets that no other
    component's can be similar to are dropped, and counts taken anew, until all
    that are left may have a partner.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, names = np.unique(np.concatenate([np.zeros(0, U), *sets]), return_inverse=True)
    width = int(names.max()) + 1 if len(names) else 0
    open_ = sizes > 0
    share = SIMILAR / (1 + SIMILAR)
    while True:
        low, high = np.full(width, len(sets)), np.full(width, -1)
        np.minimum.at(low, names, component[owner])
        np.maximum.at(high, names, component[owner])
        cap = np.bincount(owner[low[names] != high[names]], minlength=len(sets))
        most = cap / share - sizes + 1e-6  # of a partner's size
        order = np.argsort(sizes, kind="stable")
        keep = open_.copy()
        own = np.flatnonzero(open_)
        if len(own):
            # The widest reach of any set as small or smaller must reach the set, and its own a set at all.
            ranked = order[open_[order]]
            keep[own] = (most[own] >= sizes[ranked[0]]) & (sizes[own] <= most[own].max())
        if (keep == open_).all():
            return open_, names, owner
        open_ = keep
        left = open_[owner]
        names, owner = names[left], owner[left]


def _group_links(rows: pa.Table) -> list[tuple[bytes, bytes]]:
    """Links between components within one group of texts, as many as join them; no two texts are linked twice.

    rows: i, j (blocks; equal where all are compared), own (the text's block),
    place (of the band), t, component, bands, text. A pair is taken up in the
    first band that it shares, and only while its two components are apart.
    """
    keys = rows.column("t").to_pylist()
    bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
    place = rows.column("place")[0].as_py()
    own = rows.column("own").to_numpy()
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    group = np.unique(np.array(rows.column("component").to_pylist(), dtype=object), return_inverse=True)[1]
    sets: list[np.ndarray] = []
    for first, last, grams, row in shingles(rows.column("text").combine_chunks()):
        cut = np.searchsorted(row, np.arange(last - first + 1))
        sets += [grams[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
    open_, names, owner = _apart(sets, group)
    sizes = np.array([len(x) for x in sets])
    by_name = np.argsort(names, kind="stable")
    holders, ends = owner[by_name], np.cumsum(np.bincount(names)) if len(names) else np.zeros(0, np.int64)
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    cut = np.searchsorted(owner, np.arange(len(sets) + 1))
    common = np.bincount(group[open_], minlength=group.max() + 1)
    root = np.arange(len(common))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    mine = open_ & (own == i)
    if i == j and len(common):
        mine &= group != np.argmax(common)  # its texts are met from the others' side
    others = own == j
    for a in sorted(np.flatnonzero(mine), key=lambda a: (common[group[a]], a)):
        spans = [holders[begins[x] : ends[x]] for x in names[cut[a] : cut[a + 1]]]
        shared = np.bincount(np.concatenate(spans), minlength=len(sets))
        near = others & (shared > 0) & (group != group[a]) & (shared / np.maximum(sizes + sizes[a] - shared, 1) >= SIMILAR)
        for b in np.flatnonzero(near):
            x, y = find(group[a]), find(group[b])
            if x != y and not (bands[a, :place] == bands[b, :place]).any():
                root[x] = y
                links.append((keys[a], keys[b]))
    return links


def remaining_links(members: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) within bands whose texts are still in different components.

    members: (band, place, t, component, bands, size), without the band's
    leader, against which all others have been verified; texts: (t, text).
    """
    parts = members.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    sums = parts.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.max(F.struct("n", "component", "bytes")).alias("most"), F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).filter("kinds > 1")

    def blocks(rows: Column, size: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(rows / GROUP_ROWS), F.ceil(size / GROUP_BYTES)).cast("int")

    whole = (F.col("n") <= GROUP_ROWS) & (F.col("bytes") <= GROUP_BYTES)
    plan = sums.select("band", "top.component", F.when(whole, 0).otherwise(blocks(F.col("most.n"), F.col("most.bytes"))).alias("top_blocks"), F.when(whole, 1).otherwise(blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes"))).alias("blocks"))
    plan = scratch.write(plan.withColumnRenamed("component", "top"), "plan")
    # Blocks 0 .. blocks - 1 hold the smaller components; those of the largest, if it has its own, follow.
    deal = F.xxhash64("t")
    in_top = (F.col("component") == F.col("top")) & (F.col("top_blocks") > 0)
    placed = members.join(plan, "band").withColumn("own", F.when(in_top, F.col("blocks") + F.pmod(deal, F.greatest("top_blocks", F.lit(1)))).otherwise(F.pmod(deal, "blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.when(in_top, F.col("blocks") - 1).otherwise(F.col("blocks") + F.col("top_blocks") - 1))
    placed = placed.withColumn("other", F.explode(others)).select("band", "place", "t", "component", "bands", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    spread = placed.join(texts, "t").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None

        def done() -> Iterator[pa.RecordBatch]:
            links = _group_links(pa.Table.from_batches(held)) if held else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("band", "i", "j")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for x, y in zip([0, *change], [*change, batch.num_rows], strict=True):
                at = tuple(int(c[x]) for c in cols)
                if at != name:
                    yield from done()
                    held, name = [], at
                held.append(batch.slice(x, y - x))
        yield from done()

    return spread.mapInArrow(run, "a binary, b binary")


def near_duplicate_classes(docs: DataFrame, scratch: Scratch, text: str = "text") -> DataFrame:
    """(node, component) of distinct texts by their key; texts in no link are left out."""
    keyed = docs.select(text_key(F.col(text)).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sketched = scratch.write(sketches(keyed), "sketches")
    banded = sketched.select("t", F.posexplode("bands").alias("place", "band"))
    shared = banded.groupBy("band").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("band")
    members = scratch.write(banded.join(shared, "band").distinct(), "members")
    groups = members.groupBy("band").agg(F.count("*").alias("n"))
    ranked = members.join(groups, "band")
    meets = scratch.write(ranked.groupBy("t").agg(F.sum("n").alias("meets")), "meets")
    ranked = scratch.write(ranked.join(meets, "t"), "ranked")
    leaders = scratch.write(ranked.groupBy("band").agg(F.max(F.struct("meets", "t")).alias("top")).select("band", F.col("top.t").alias("leader")), "leaders")
    led = ranked.join(leaders, "band").filter("t <> leader")
    pairs = scratch.write(led.select(F.least("t", "leader").alias("a"), F.greatest("t", "leader").alias("b")).distinct(), "pairs")
    texts = scratch.write(texts_of(keyed, meets.select("t")), "texts")
    links = scratch.write(similar_pairs(pairs, texts), "links")
    labels = components(links, scratch, "star")
    rest = led.filter("n > 2").select("band", "place", "t").join(labels.select(F.col("node").alias("t"), "component"), "t", "left").withColumn("component", F.coalesce("component", "t"))
    mixed = scratch.write(rest.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band"), "mixed")
    rest = scratch.write(rest.join(mixed, "band"), "rest")
    facts = sketched.join(rest.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.first("bands").alias("bands")).join(texts.select("t", F.octet_length("text").alias("size")), "t")
    rest = scratch.write(rest.join(scratch.write(facts, "facts"), "t"), "open")
    more = scratch.write(remaining_links(rest, texts, scratch), "more")
    return components(links.unionByName(more), scratch, "all")


def with_class(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_key, t, class, n rows of docs) with the smallest (doc_key, t) of each class as `first`.

    The table of classes is written first, so that the join with it can split a
    class that holds a large share of the rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "classes")
    ids = docs.select(F.col(key).alias("doc_key"), text_key(F.col(text)).alias("t"))
    ids = ids.join(labels.select(F.col("node").alias("t"), "component"), "t", "left").withColumn("class", F.coalesce("component", "t")).drop("component")
    ids = scratch.write(ids, "ids")
    firsts = ids.groupBy("class").agg(F.min(F.struct(F.col("doc_key").isNull().alias("none"), "doc_key", "t")).alias("first"), F.count("*").alias("class_size"))
    return ids.join(scratch.write(firsts, "firsts"), "class")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs with the smallest doc_id of their class; one of them, if rows repeat it."""
    scratch = Scratch(docs.sparkSession, "neardup")
    classed = scratch.write(with_class(docs, near_duplicate_classes(docs, scratch, text), key, text, scratch), "classed")
    is_first = F.col("doc_key").eqNullSafe(F.col("first.doc_key")) & (F.col("t") == F.col("first.t"))
    kept = classed.filter(is_first).groupBy("doc_key", "t").agg(F.count("*").alias("n"))
    repeated = not kept.filter("n > 1").isEmpty()
    dropped = scratch.write(classed.filter(~is_first).select("doc_key", "t").distinct(), "dropped")
    scratch.keep("dropped")
    rows = docs.select(as_row(docs).alias("row"), F.col(key).alias("own_key"), text_key(F.col(text)).alias("own_t"))
    rows = rows.join(dropped, F.col("own_key").eqNullSafe(F.col("doc_key")) & (F.col("own_t") == F.col("t")), "left_anti")
    if repeated:
        rows = rows.groupBy("own_key", "own_t").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.select("row.*")


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "neardup")
    docs = read_table(spark, sf_dir, "documents")
    labels = near_duplicate_classes(docs, scratch)
    result = checkpointed(with_class(docs, labels, scratch=scratch).select(F.col("doc_key").alias("doc_id"), F.col("first.doc_key").alias("class_id"), "class_size"))
    scratch.drop()
    return result


QUERIES = {"op8_neardup": op8_neardup}
ORACLES: dict = {}
