"""Vectorised hashing of words and word n-grams over Arrow string columns.

A word is a maximal run of other than ASCII white space (0x20, 0x09-0x0D). The
hash of a word is a polynomial in its UTF-8 bytes modulo 2^64, mixed; n-grams
combine word hashes by position. Texts are handled in chunks of bounded bytes,
whole texts at a time, so a batch with very long texts stays small in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
CHUNK_ROWS = 16_384
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
U = np.uint64
_P = U(0x9E3779B97F4A7C15 | 1)
_MIX = (U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB))
_SPREAD = [U(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * _MIX[0]
    x = (x ^ (x >> U(27))) * _MIX[1]
    return x ^ (x >> U(31))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts are empty."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` rows and `most` bytes each, or of one row that is longer."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), first + rows, len(offsets) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row) of the words of texts laid end to end; words don't cross texts."""
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word, by differences of a running polynomial."""
    if not len(starts):
        return np.zeros(0, dtype=U)
    with np.errstate(over="ignore"):
        n = len(data)
        powers = np.full(n, _P, dtype=U)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum((data.astype(U) + U(1)) * powers, out=sums[1:])
        # The inverse power at the start makes the hash independent of the place.
        inverse = U(pow(int(_P), -1, 1 << 64))
        back = np.full(n, inverse, dtype=U)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U))


def ngrams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the n-grams of each row's words, in order; rows with fewer words have none."""
    rows = np.repeat(np.arange(len(counts)), counts)
    if n == 1:
        return words, rows
    if len(words) < n:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        out = words[: len(words) - n + 1] * _SPREAD[0]
        for k in range(1, n):
            out = mix(out) + words[k : len(words) - n + 1 + k] * _SPREAD[k % len(_SPREAD)]
        out = mix(out)
    whole = rows[: len(out)] == rows[n - 1 :]
    return out[whole], rows[: len(out)][whole]


def hashed(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, words per row) for chunks of a column."""
    data, offsets = raw_bytes(texts)
    for first, last in chunks(offsets, most):
        part = data[offsets[first] : offsets[last]]
        at = offsets[first : last + 1] - offsets[first]
        starts, ends, counts = word_spans(part, at)
        yield first, last, word_hashes(part, starts, ends), counts
