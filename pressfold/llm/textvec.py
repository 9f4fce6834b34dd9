"""Vectorised text arithmetic for Arrow batches: tokens, hashes, n-grams.

Texts stay UTF-8 bytes. Hashes are polynomial over random byte values modulo
2**64, taken from running sums, so that a whole batch costs a few numpy passes;
a finaliser mixes the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses modulo 2**64

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Token classes: 0 white space, 1 anything else.
PLAIN = np.ones(256, np.uint8)
PLAIN[list(SPACES)] = 0

#: Token classes: 0 white space, 1 letters, digits and all bytes beyond ASCII, 2 punctuation.
SPLIT = PLAIN.copy()
SPLIT[[b for b in range(128) if not chr(b).isalnum() and b not in SPACES]] = 2

VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


#: Bytes of a run of texts; only the powers that such runs need are kept in a worker.
RUN = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (BASE, pow(BASE, -1, 2**64)):
        p = np.empty(n, np.uint64)
        p[0] = 1
        done = 1
        while done < n:
            more = min(done, n - done)
            p[done : done + more] = p[:more] * U64(pow(b, done, 2**64))
            done += more
        out.append(p)
    return out[0], out[1]


@lru_cache(maxsize=1)
def _run_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(RUN)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of BASE and of its inverse; those of one longer text are not kept."""
    return _run_powers() if n <= RUN else _powers(n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser with good avalanche (the 64-bit variant of a well-known public mixer)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_chunks(col: pa.Array, most: int = RUN - 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of rows with about ``most`` bytes, one row at least. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def token_bounds(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first token of each text and the end): maximal runs of one class other than 0 inside a text."""
    n = len(data)
    c = np.zeros(n + 2, np.uint8)
    c[1:-1] = classes[data]
    cut = c[1:] != c[:-1]
    cut[bounds] = True  # texts end runs
    at = np.flatnonzero(cut)
    kind = c[1:][at[:-1]] if len(at) else c[:0]
    own = np.flatnonzero(kind)
    starts, ends = at[own], at[own + 1]
    return starts, ends, np.searchsorted(starts, bounds)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    p = np.zeros(len(data) + 1, np.uint64)
    power, _ = powers(len(data) + 1)
    np.cumsum(VALUES[data] * power[: len(data)], out=p[1:])
    return p


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unmixed hashes of the byte spans."""
    _, inverse = powers(len(prefix))
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def word_hashes(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray = PLAIN, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each text and the end)."""
    starts, ends, first = token_bounds(data, bounds, classes)
    return mix(span_hash(prefix_hash(LOWER[data] if fold_case else data), starts, ends)), first


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n-gram, first n-gram of each text and the end). whole: a text of 1 to n-1 words counts as one gram."""
    counts = np.diff(first)
    grams = np.maximum(counts - n + 1, 0)
    if whole:
        grams = np.where((counts > 0) & (counts < n), 1, grams)
    out_first = np.zeros(len(first), np.int64)
    np.cumsum(grams, out=out_first[1:])
    total = int(out_first[-1])
    if not total:
        return np.empty(0, np.uint64), out_first
    doc = np.repeat(np.arange(len(counts)), grams)
    at = np.arange(total) - out_first[doc] + first[doc]
    end = first[1:][doc]
    h = np.zeros(total, np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    for k in range(n):
        part = padded[at + k]
        if whole:
            part = np.where(at + k < end, part, U64(0))
        h = (h + part) * U64(BASE + 2 * k)
        h ^= h >> U64(29)
    return mix(h), out_first


def distinct_sorted(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and the bounds."""
    parts, counts = [], np.zeros(len(first), np.int64)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        s = np.sort(h[a:b])
        keep = np.empty(len(s), bool)
        keep[0] = True
        np.not_equal(s[1:], s[:-1], out=keep[1:])
        s = s[keep]
        parts.append(s)
        counts[i + 1] = len(s)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.cumsum(counts)


def list_column(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
