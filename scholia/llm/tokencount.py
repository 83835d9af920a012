"""Token counts that follow edits: a segment tree of pre-token runs per document.

A text is cut into pre-tokens by the tokenizer's pattern; LEAF pre-tokens make
a leaf, and a sum tree over the leaves holds the token count of every subtree.
An edit re-encodes only the leaves that it touches, from a leaf boundary with
enough unchanged text before the edit that the pattern cannot see it, until a
pre-token boundary meets an old leaf boundary after the edit; then the sums on
the paths of those leaves are updated.

Defined results: null texts are empty and have 0 tokens; a null doc_id is kept;
repeated rows are counted each; edits beyond the end append; empty tables give
empty results. Only the named columns are read. The vocabulary is a rank file
of a public tokenizer; its path is a parameter, and its ranks (under 2 MB)
travel to the executors.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.session import read_table

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 32
#: Characters after a pre-token that the pattern may look at before it ends one.
SIGHT = 3
CACHE_PIECES = 300_000


def default_vocabulary() -> str:
    return "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PieceCounter:
    """Token counts of pre-tokens. The cache is bounded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("scholia", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, int] = {}

    def count(self, piece: str) -> int:
        got = self.cache.get(piece)
        if got is None:
            got = len(self.encoding.encode_ordinary(piece))
            if len(self.cache) < CACHE_PIECES:
                self.cache[piece] = got
        return got


class TokenTree:
    """Leaves of pre-tokens with a sum tree over their token counts."""

    def __init__(self, text: str, counter: PieceCounter):
        self.counter, self.text = counter, text
        self.encoded = 0
        self._build([self._leaf(pieces) for pieces in self._runs(self._pieces(0))])

    def _pieces(self, start: int) -> Iterator[str]:
        for found in self.counter.pattern.finditer(self.text, start):
            self.encoded += 1
            yield found.group()

    @staticmethod
    def _runs(pieces: Iterator[str]) -> Iterator[list[str]]:
        run: list[str] = []
        for piece in pieces:
            run.append(piece)
            if len(run) == LEAF:
                yield run
                run = []
        if run:
            yield run

    def _leaf(self, pieces: list[str]) -> tuple[int, int, int]:
        """(characters, pre-tokens, tokens)."""
        get, count = self.counter.cache.get, self.counter.count
        return sum(map(len, pieces)), len(pieces), sum(get(p) or count(p) for p in pieces)

    def _build(self, leaves: list[tuple[int, int, int]]) -> None:
        self.leaves = leaves
        self.width = 1 << max(0, (max(1, len(leaves)) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 3), dtype=np.int64)
        if leaves:
            self.sums[self.width : self.width + len(leaves)] = leaves
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 2])

    @property
    def pieces(self) -> int:
        return int(self.sums[1, 1])

    def _find(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character `place`, by descent."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if start + self.sums[node, 0] <= place:
                start += int(self.sums[node, 0])
                node += 1
        return min(node - self.width, max(0, len(self.leaves) - 1)), start

    def _update(self, leaf: int, value: tuple[int, int, int]) -> None:
        self.leaves[leaf] = value
        node = leaf + self.width
        self.sums[node] = value
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, replacement: str) -> int:
        """Replace text[start:end]; returns how many pre-tokens were encoded again."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        shift = len(replacement) - (end - start)
        before = self.encoded
        self.text = self.text[:start] + replacement + self.text[end:]
        if not self.leaves:
            self._build([self._leaf(run) for run in self._runs(self._pieces(0))])
            return self.encoded - before
        first, at = self._find(max(0, start - SIGHT))
        if at > 0 and at + SIGHT > start:
            first, at = first - 1, at - self.leaves[first - 1][0]
        if first > 0:  # the leaf boundary itself must lie SIGHT before the edit
            while at > 0 and at > start - SIGHT:
                first, at = first - 1, at - self.leaves[first - 1][0]
        last, old_end = first, at + self.leaves[first][0]
        while last + 1 < len(self.leaves) and old_end < end:
            last += 1
            old_end += self.leaves[last][0]
        pieces: list[str] = []
        place = at
        if place < len(self.text):
            for piece in self._pieces(place):
                pieces.append(piece)
                place += len(piece)
                while last + 1 < len(self.leaves) and old_end + shift < place:
                    last += 1
                    old_end += self.leaves[last][0]
                if place == old_end + shift and old_end >= end:
                    break
        if place != old_end + shift:  # the text ended first
            last = len(self.leaves) - 1
        slots = last - first + 1
        if len(pieces) > 4 * LEAF * slots:
            middle = [self._leaf(run) for run in self._runs(iter(pieces))]
            self._build([*self.leaves[:first], *middle, *self.leaves[last + 1 :]])
        else:
            share = -(-len(pieces) // slots) if pieces else 0
            for k in range(slots):
                self._update(first + k, self._leaf(pieces[k * share : (k + 1) * share]))
        return self.encoded - before


def token_counts(docs: DataFrame, edits: DataFrame | None, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_pretokens, n_tokens, n_edits, n_tokens_edited, n_reencoded) per row of docs.

    edits: (doc_id, edits array<struct<start int, end int, replacement string>>),
    one row per doc_id, applied in order to the text as it then stands.
    """
    none = F.lit(None).cast("array<struct<start:int,end:int,replacement:string>>")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("edits", none) if edits is None else rows.join(edits.select("doc_id", "edits"), "doc_id", "left")
    return count_rows(rows, vocabulary)


def count_rows(rows: DataFrame, vocabulary: str) -> DataFrame:
    """token_counts of rows (doc_id, text, edits), which carry their own edits."""
    ranks = read_ranks(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(ranks)
        for batch in batches:
            out = []
            for body, todo in zip(batch.column("text"), batch.column("edits"), strict=True):
                tree = TokenTree(body.as_py() or "", counter)
                first = (tree.pieces, tree.tokens)
                changes = todo.as_py() or []
                again = sum(tree.edit(e["start"], e["end"], e["replacement"]) for e in changes)
                out.append((*first, len(changes), tree.tokens, again))
            columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_tokens_edited", "n_reencoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, n_edits long, n_tokens_edited long, n_reencoded long")


def op2_tokencount(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Every document, and again after a stated pair of edits in its middle and at its end."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    middle = F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    stated = F.array(
        F.struct(middle.alias("start"), (middle + 12).alias("end"), F.lit(" revised in 2024").alias("replacement")),
        F.struct(F.lit(2**31 - 1).alias("start"), F.lit(2**31 - 1).alias("end"), F.lit(" The end.").alias("replacement")),
    )
    return count_rows(docs.withColumn("edits", stated), vocabulary or default_vocabulary())


QUERIES = {"op2_tokencount": op2_tokencount}
ORACLES: dict = {}
