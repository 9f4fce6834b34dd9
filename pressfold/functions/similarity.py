"""The matching ratio of two texts, behind exact upper bounds.

The ratio is 2 * M / (characters of both), M being the characters in matching blocks. Blocks keep their order in both texts, so M is at most
the longest common subsequence, and that is at most the characters that both have of each kind. The second bound is a JVM expression over counts
that each text carries; the first is taken in the Arrow function, word-parallel over the bits of a whole number and given up as
soon as too little of the text is left.

In texts of 200 characters and more the matcher begins blocks only at characters that are rare in the second text; so they bound the number of blocks.
A block of n characters holds n - 7 strings of eight characters that both texts have. So M is at most the places of one text whose eight characters
the other has as well, and seven for each block. That is counted in one pass, by a table of hashes. Only pairs that pass all bounds are matched.
"""

from __future__ import annotations

import difflib
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that are counted one by one; all others count together, which only loosens the bound. Each costs a pass over the text.
COUNTED = " eaiontsrh"

#: Characters of the strings that two texts are bounded by, and bits of a hash that tell them apart at most.
GRAM, BITS = 8, 22


def char_counts(text: Column) -> Column:
    """How often ``text`` has each of COUNTED, and all others."""
    each = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in COUNTED]
    return F.array(*each, F.length(text) - reduce(lambda x, y: x + y, each))


def may_exceed(a: Column, b: Column, least: float) -> Column:
    """Whether texts with the counts ``a`` and ``b`` can have a ratio above ``least``."""
    total = lambda f: reduce(lambda x, y: x + y, [f(i) for i in range(len(COUNTED) + 1)])
    size = total(lambda i: a[i] + b[i])
    return (total(lambda i: F.least(a[i], b[i])) * 2 > size * least) | (size == 0)  # two empty texts are equal


@lru_cache(maxsize=8)
def _places(text: str) -> dict[str, int]:
    chars = _codes(text)
    return {c: int.from_bytes(np.packbits(chars == ord(c), bitorder="little").tobytes(), "little") for c in set(text)}


def has_common(a: str, b: str, needed: int) -> bool:
    """Whether the longest common subsequence of ``a`` and ``b`` has at least ``needed`` characters."""
    places, free, full = _places(a), (1 << len(a)) - 1, (1 << len(a)) - 1
    for i, c in enumerate(b):
        if not i % 64 and len(a) - free.bit_count() + len(b) - i < needed:
            return False
        hit = free & places.get(c, 0)
        free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count() >= needed


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(text: str) -> np.ndarray:
    """A hash of ``BITS`` bits for each GRAM characters of ``text``, in order."""
    chars = _codes(text).astype(np.uint64)
    n = max(0, len(chars) - GRAM + 1)
    found = np.zeros(n, np.uint64)
    for k in range(GRAM):
        found = (found + chars[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    return (found >> np.uint64(64 - BITS)).astype(np.int32)


def gram_table(text: str) -> np.ndarray:
    """Which hashes ``text`` has; about 16 places for each of its characters, ``1 << BITS`` at most."""
    bits = min(BITS, (16 * len(text)).bit_length())
    table = np.zeros(1 << bits, bool)
    table[grams(text) >> (BITS - bits)] = True
    return table


def in_table(found: np.ndarray, table: np.ndarray) -> int:
    """How many of the hashes ``found`` are in ``table``: as many as the text of the table has at least."""
    return int(np.count_nonzero(table[found >> (BITS + 1 - len(table).bit_length())]))


def rare_chars(text: str) -> dict[str, int] | None:
    """The characters at which the matcher begins a block if ``text`` is the second one, with their number; null if it begins at any."""
    if len(text) < 200:
        return None
    counts = Counter(text)
    return {c: n for c, n in counts.items() if n <= len(text) // 100 + 1}


def most_blocks(a: str, rare: dict[str, int]) -> int:
    """At most so many blocks match ``a`` with a text of these rare characters; one that both texts begin with needs none of them."""
    return 1 + sum(min(n, a.count(c)) for c, n in rare.items())


_rare_chars, _gram_table = lru_cache(maxsize=32)(rare_chars), lru_cache(maxsize=32)(gram_table)


def needed_above(size: int, least: float) -> int:
    """How many characters must match in texts of ``size`` characters together for a ratio above ``least``."""
    needed = max(0, int(least * size / 2) - 1)
    while not 2.0 * needed / size > least:
        needed += 1
    return needed


def ratio_above(a: str, b: str, least: float) -> float | None:
    """The ratio of ``a`` and ``b`` if it is above ``least``."""
    if a == b:
        return 1.0 if least < 1 else None
    needed = needed_above(len(a) + len(b), least)
    rare = _rare_chars(b)
    if rare is not None and in_table(grams(a), _gram_table(b)) + (GRAM - 1) * most_blocks(a, rare) < needed:
        return None
    return matched_above(a, b, needed, least)


def matched_above(a: str, b: str, needed: int, least: float) -> float | None:
    """The ratio of ``a`` and ``b`` if it is above ``least``, which needs ``needed`` characters in blocks."""
    if not has_common(a, b, needed):
        return None
    found = difflib.SequenceMatcher(None, a, b).ratio()
    return found if found > least else None


def close_ratio(a: Column, b: Column, least: float) -> Column:
    """The matching ratio of two texts where it is above ``least``; else null."""

    @F.pandas_udf(T.DoubleType())
    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or t is None else ratio_above(s, t, least) for s, t in zip(x, y, strict=True)], dtype="float64")

    return ratios(a, b)


def close_pairs(others: pa.Table, asking: pa.Table, least: float, needed: int) -> pa.Table:
    """(key, other) of those texts (key, text) of ``asking`` and ``others`` whose ratio is above ``least``; keys tell texts apart.

    A text of ``asking`` is done with as soon as it has ``needed`` others of higher keys. The bounds are taken from the cheapest on: lengths, counts of
    characters by the lower bits of their codes, strings of both texts with the rare characters of the other one, then those of both.
    """
    keys, texts = asking.column("key").to_pylist(), asking.column("text").to_pylist()
    counted = lambda codes: np.bincount(codes & 127, minlength=128).astype(np.int32)
    size = np.array([len(t) for t in texts], np.int64)
    counts = np.array([counted(_codes(t)) for t in texts], np.int32).reshape(len(texts), 128)
    tables: dict[int, np.ndarray] = {}
    wanted = np.full(len(texts), needed)
    found: list[tuple] = []
    for other, text in zip(others.column("key").to_pylist(), others.column("text").to_pylist(), strict=True):
        both = size + len(text)
        able = np.flatnonzero((wanted > 0) & (np.minimum(size, len(text)) * 2 > both * least))
        if not len(able):
            continue
        codes = _codes(text)
        able = able[np.minimum(counts[able], counted(codes)).sum(axis=1, dtype=np.int64) * 2 > both[able] * least]
        if not len(able):
            continue
        each, mine, rare = np.bincount(codes), grams(text), None
        seeds = int(each[each <= len(text) // 100 + 1].sum())
        for k in able.tolist():
            if keys[k] == other:
                continue
            least_chars = needed_above(int(both[k]), least)
            if len(text) >= 200:
                if k not in tables:
                    tables[k] = gram_table(texts[k])
                common = in_table(mine, tables[k])
                if common + (GRAM - 1) * (1 + seeds) < least_chars:
                    continue
                rare = rare_chars(text) if rare is None else rare
                if common + (GRAM - 1) * most_blocks(texts[k], rare) < least_chars:
                    continue
            if matched_above(texts[k], text, least_chars, least) is not None:
                found.append((keys[k], other))
                wanted[k] -= other > keys[k]
    kind = asking.schema.field("key").type
    return pa.table({"key": pa.array([x for x, _ in found], kind), "other": pa.array([y for _, y in found], kind)})
