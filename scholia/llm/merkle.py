"""Merkle dataset manifest by superblock reduction.

Every row is a leaf. Within a group (here a language) leaves are numbered by
their order; a block is FANOUT ** LEVELS consecutive leaves, and one
applyInPandas call collapses the LEVELS levels of a block to one root. Block
roots are reduced in the same way until a group has one block. The subroots of
all groups, in order of their groups, go through the same reduction to the
root. Coming back down, each block is opened once more beside the proof of its
own root, and both proofs are concatenated. So no task holds more than a block,
a group with a third of all rows is many blocks, and the driver sees one number
a round.

Numbers are given without a window over a group: rows are sorted by range of
(group, order), counted per partition and group, and the counts are summed
along the partitions.

Defined results: a null in any column is a `-` in the leaf; rows without a
group form a group of their own that comes first; rows are ordered by doc_id
(null first), then by leaf, so rows that repeat a doc_id each have a place and
rows equal in all five columns are interchangeable; empty and very long texts
are hashed like others; a row without a doc_id is never tampered with; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.session import Scratch, read_table

FANOUT = 8
#: Levels that one block collapses: 512 leaves at fanout 8.
LEVELS = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_OPENED = "grp string, place long, tag string, note string, at array<int>, siblings array<string>, subroot string, root string"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf_hash(*columns: Column) -> Column:
    """Hex sha256 of the columns as text: `-` for null, else UTF-8 length, `:`, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(node: Column, at: Column, siblings: Column) -> Column:
    """The root that a leaf and its proof give: each step puts the node at place `at` among its run's other digests."""
    steps = F.arrays_zip(at.alias("at"), siblings.alias("siblings"))

    def step(own: Column, s: Column) -> Column:
        cut = s["at"] * 64
        run = F.concat(F.substring(s["siblings"], F.lit(1), cut), own, F.substring(s["siblings"], cut + 1, F.length(s["siblings"])))
        return F.sha2(run.cast("binary"), 256)

    return F.aggregate(steps, node, step)


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """rows with place (from 0 within grp, by `order`) and size (rows of grp).

    A sort by range, never a window over a group: rows equal in all of `order`
    are told apart by their position in the written table, so that one key
    repeated very often is cut like any other.
    """
    kept = scratch.write(rows.withColumn("nth", F.monotonically_increasing_id()), f"{name}-rows")
    keys = ["grp", *order, "nth"]
    dealt = kept.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("nth")
    dealt = scratch.write(dealt.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), f"{name}-sorted")
    # One row per partition and group in it: at most as many as both together.
    parts = dealt.groupBy("grp", "part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    along = Window.partitionBy("grp").orderBy("part")
    parts = parts.select("grp", "part", (F.sum("n").over(along) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("grp")).alias("size"))
    return dealt.join(parts, ["grp", "part"]).withColumn("place", F.col("seq") + F.col("shift")).drop("part", "seq", "shift")


def _levels(nodes: list[str], whole: bool, fanout: int, most: int) -> list[list[str]]:
    """The nodes, level by level, up to the block's root. A block of a larger group (not whole) is collapsed by all its levels, even alone."""
    levels = [nodes]
    while len(levels) <= most and (not whole or len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([_hash("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


class Forest:
    """Superblock reduction of nodes (grp, place, size, tag, note, node); tag and note are text that travels along."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT, levels: int = LEVELS):
        self.scratch, self.fanout, self.levels = scratch, fanout, levels
        self.block = fanout**levels
        self.step = 0

    def _write(self, df: DataFrame) -> DataFrame:
        self.step += 1
        return self.scratch.write(df, f"step{self.step}")

    def prove(self, nodes: DataFrame, above: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(grp, place, tag, note, at, siblings, subroot, root): nodes with their proofs.

        above takes the subroots (grp, node) and gives (grp, at, siblings,
        root): the proof of each subroot.
        """
        fanout, most, block = self.fanout, self.levels, self.block
        largest = nodes.agg(F.max("size").alias("size")).first()["size"] or 0
        blocks = nodes.withColumn("block", F.expr(f"place div {block}"))

        def collapse(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("place")
            size = int(rows["size"].iloc[0])
            top = _levels(rows["node"].tolist(), size <= block, fanout, most)[-1][0]
            return pd.DataFrame({"grp": [key[0]], "place": [key[1]], "size": [-(-size // block)], "node": [top]})

        roots = self._write(blocks.select("grp", "block", "place", "size", "node").groupBy("grp", "block").applyInPandas(collapse, "grp string, place long, size long, node string"))
        if largest > block:
            parents = roots.select("grp", "place", "size", F.lit("").alias("tag"), F.lit("").alias("note"), "node")
            upper = self.prove(parents, above).select("grp", F.col("place").alias("block"), "at", "siblings", "subroot", "root")
        else:
            upper = above(roots.select("grp", "node")).join(roots.select("grp", F.col("node").alias("subroot")), "grp").select("grp", F.lit(0).cast("long").alias("block"), "at", "siblings", "subroot", "root")

        def open_block(key: tuple, rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("place").reset_index(drop=True)
            levels = _levels(rows["node"].tolist(), bool((rows["size"] <= block).all()), fanout, most)[:-1] if len(rows) else []
            runs = [["".join(level[i : i + fanout]) for i in range(0, len(level), fanout)] for level in levels]
            at_up, siblings_up = list(up["at"].iloc[0]), list(up["siblings"].iloc[0])
            at, siblings = [], []
            for i in range(len(rows)):
                places, others = [], []
                for run in runs:
                    i, own = divmod(i, fanout)
                    places.append(own)
                    others.append(run[i][: own * 64] + run[i][own * 64 + 64 :])
                at.append(places + at_up)
                siblings.append(others + siblings_up)
            return rows[["grp", "place", "tag", "note"]].assign(at=at, siblings=siblings, subroot=up["subroot"].iloc[0], root=up["root"].iloc[0])

        return blocks.groupBy("grp", "block").cogroup(upper.groupBy("grp", "block")).applyInPandas(open_block, _OPENED)


def manifest(docs: DataFrame, scratch: Scratch, group: str = "lang", key: str = "doc_id", columns: tuple[str, ...] = COLUMNS, fanout: int = FANOUT, levels: int = LEVELS, tampered: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, tampered_leaf, at, siblings, subroot, root), one row per row of docs.

    at and siblings are the proof, one step per level from the leaf to the root
    (see fold). key is a whole number. The leaf of what `tampered` makes of the
    columns (names to expressions) is carried along; without it, it is null.
    """
    own = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    other = leaf_hash(*[(tampered or {}).get(c, F.col(c)) for c in columns]) if tampered else F.lit(None).cast("string")
    leaf = leaf_hash(*[F.col(c) for c in columns])
    leaves = docs.select(own.alias("grp"), F.col(key).cast("long").alias("id"), leaf.alias("node"), other.alias("note"))
    forest = Forest(scratch, fanout, levels)
    placed = numbered(leaves, ["id", "node"], scratch, "leaves")
    # A leaf and its id travel as one text: pandas would turn a null id's column into floats.
    nodes = placed.select("grp", "place", "size", F.concat_ws(":", "node", F.col("id").cast("string")).alias("tag"), F.coalesce("note", F.lit("")).alias("note"), "node")

    def top(subroots: DataFrame) -> DataFrame:
        rows = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("tag"), F.lit("").alias("note"), "node")
        placed = numbered(rows, ["tag"], scratch, "subroots").select("grp", "place", "size", "tag", "note", "node")
        end = forest.prove(placed, lambda r: r.select("grp", F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("siblings"), F.col("node").alias("root")))
        return forest._write(end.select(F.col("tag").alias("grp"), "at", "siblings", "root"))

    proved = forest.prove(nodes, top)
    return proved.select(F.get(F.split("tag", ":"), 1).cast("long").alias("doc_id"), F.substring("tag", 1, 64).alias("leaf"), F.when(F.col("note") != "", F.col("note")).alias("tampered_leaf"), "at", "siblings", "subroot", "root")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof; where 3 divides crc32(doc_id) the text is lower-cased in A-Z before its proof is folded."""
    docs = read_table(spark, sf_dir, "documents")
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = manifest(docs, Scratch(spark, "merkle"), tampered={"text": F.when(third, lowered).otherwise(F.col("text"))})
    folded = rows.withColumns({"proof_sha256": F.sha2(F.array_join("siblings", "").cast("binary"), 256), "folded_root": fold(F.col("tampered_leaf"), F.col("at"), F.col("siblings"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL unrolls: 8 ** 7 documents of one language.
_DEEP = 7


def _sql() -> str:
    def tree(name: str, source: str, deep: int) -> list[str]:
        """Levels of every group's tree, the tops, and each level's siblings."""
        out = [f"{name}0 AS MATERIALIZED ({source})"]
        out += [f"{name}{i + 1} AS MATERIALIZED (SELECT grp, place // 8 AS place, (n + 7) // 8 AS n, sha256(string_agg(node, '' ORDER BY place)) AS node FROM {name}{i} WHERE n > 1 GROUP BY grp, place // 8, n)" for i in range(deep)]
        out += [f"{name}_top AS ({' UNION ALL '.join(f'SELECT grp, node FROM {name}{i} WHERE n = 1' for i in range(deep + 1))})"]
        for i in range(deep):
            out.append(f"""{name}_by{i} AS MATERIALIZED (SELECT a.grp, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM {name}{i} a JOIN {name}{i} b ON a.grp = b.grp AND a.place // 8 = b.place // 8 WHERE a.n > 1 GROUP BY a.grp, a.place)""")
        return out

    def climbed(node: str, name: str, deep: int) -> str:
        for i in range(deep):
            node = f"CASE WHEN {name}{i}.before IS NULL THEN {node} ELSE sha256({name}{i}.before || {node} || {name}{i}.after) END"
        return node

    # crc32 of the decimal doc_id, half a byte at a time, by the table of the reversed polynomial.
    steps = []
    for i in range(16):
        c = i
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        steps.append(c)
    halves = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) & 15 AS BIGINT), CAST(ascii(c) >> 4 AS BIGINT)]))"
    crc = f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {halves}), lambda a, h: xor(a >> 4, CAST({steps}[(xor(a, h) & 15) + 1] AS BIGINT))))"

    def leaf(text: str) -> str:
        parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    # The SQL lower-cases A-Z only, letter by letter.
    lowered = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    joins = " ".join(f"LEFT JOIN leaf_by{i} l{i} ON l{i}.grp = d.grp AND l{i}.place = d.place // {8**i}" for i in range(_DEEP))
    joins += " JOIN leaf_top t ON t.grp = d.grp JOIN groups g ON g.grp = d.grp "
    joins += " ".join(f"LEFT JOIN lang_by{i} g{i} ON g{i}.place = g.place // {8**i}" for i in range(2))
    proof = " || ".join([f"coalesce(l{i}.before || l{i}.after, '')" for i in range(_DEEP)] + [f"coalesce(g{i}.before || g{i}.after, '')" for i in range(2)])
    parts = [
        f"hashed AS MATERIALIZED (SELECT doc_id, coalesce('=' || lang, '') AS grp, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(f'({lowered})')} ELSE {leaf('text')} END AS seen FROM documents)",
        "placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY grp) AS n FROM hashed)",
        *tree("leaf", "SELECT grp, place, n, leaf AS node FROM placed", _DEEP),
        "groups AS MATERIALIZED (SELECT grp, node, row_number() OVER (ORDER BY encode(grp)) - 1 AS place, count(*) OVER () AS n FROM leaf_top)",
        *tree("lang", "SELECT '' AS grp, place, n, node FROM groups", 2),
        f"folded AS (SELECT d.doc_id, d.leaf, t.node AS subroot, (SELECT node FROM lang_top) AS root, sha256({proof}) AS proof_sha256, {climbed(climbed('d.seen', 'l', _DEEP), 'g', 2)} AS folded_root FROM placed d {joins})",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT *, folded_root = root AS verified FROM folded"


QUERIES = {"op11_merkle": op11_merkle}
ORACLES = {"op11_merkle": _sql()}
