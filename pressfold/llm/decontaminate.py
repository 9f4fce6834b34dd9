"""Benchmark decontamination: n-gram seeds, a bound for each passage, then Smith-Waterman alignment.

Words are runs of letters, digits and characters beyond ASCII, lower-cased (A-Z). The benchmark is taken in
blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes; a block is what is broadcast, so its
size is bounded, and every block meets the whole corpus.

1. Where a three-word seed of an item occurs, however often it does, the passage around it is a candidate. Seeds on
   nearby diagonals share one passage.
2. No alignment gains more than the best stretch of the item does when each word that occurs in the passage counts
   2 and any other -1. Passages whose bound is under the score cannot be leaks and are left.
3. The others are aligned with the item: match 2, other word -1, gap -1. The score is the best local alignment by
   the item's own (2 a word); ``SCORE`` and above is a leak.

Edge cases: items that are null or have under ``SEED_WORDS`` words take no part, and those under ``MIN_WORDS`` words
are leaks only where they occur whole; null and empty texts match
nothing; items and documents with repeated ids are reported each; a document matches an
item once, with its best passage (ties: the first); an empty table on either side gives an empty result;
extra columns are ignored by :func:`leaks` and kept by :func:`keep_clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.llm import textvec as tv
from pressfold.llm.common import bounded_batches, keyed, table

SEED_WORDS = 3
MIN_WORDS = 5
SCORE = 0.5
BLOCK_ITEMS = 8192
BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1

#: Cells of one set of alignments that are computed side by side.
CELLS = 1 << 20

#: Pairs of a hit and an item's place, and words of passages and items, that are looked at together.
ENTRIES = 1 << 20
BOUNDED = 1 << 18

U64 = np.uint64

#: Token classes: 1 for words; everything else separates them.
WORDS_ONLY = np.where(tv.SPLIT == 1, 1, 0).astype(np.uint8)


@dataclass
class Block:
    """Items of the benchmark: ids, words, and seeds as sorted hashes with the places that each stands for."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    places: np.ndarray  # bounds of each seed's entries in item and offset
    item: np.ndarray
    offset: np.ndarray

    def marks(self) -> np.ndarray:
        seen = np.zeros(1 << 20, bool)
        seen[(self.seeds & U64(len(seen) - 1)).astype(np.int64)] = True
        return seen


def make_block(ids: list, texts: list[str]) -> Block:
    _, _, data, bounds = next(tv.text_chunks(pa.array(texts, pa.string()), 1 << 62))
    words, first = tv.word_hashes(data, bounds, WORDS_ONLY)
    grams, cut = tv.gram_hashes(words, first, SEED_WORDS)
    item = np.repeat(np.arange(len(ids)), np.diff(cut))
    offset = np.arange(len(grams)) - cut[:-1][item]
    order = np.argsort(grams, kind="stable")
    seeds, start = np.unique(grams[order], return_index=True)
    return Block(ids, words, first, seeds, np.append(start, len(grams)), item[order], offset[order])


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in bounded blocks; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if ids and (len(ids) == BLOCK_ITEMS or size + len(r["text"]) * 4 > BLOCK_BYTES):
            yield make_block(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"]) * 4
    if ids:
        yield make_block(ids, texts)


def _hits(col: pa.Array, block: Block, marks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words, bounds of the texts' words, row of each hit, its first word, its seed) of runs of rows."""
    for a, _, data, bounds in tv.text_chunks(col):
        words, first = tv.word_hashes(data, bounds, WORDS_ONLY)
        grams, cut = tv.gram_hashes(words, first, SEED_WORDS)
        at = np.flatnonzero(marks[(grams & U64(len(marks) - 1)).astype(np.int64)])
        seed = np.minimum(np.searchsorted(block.seeds, grams[at]), len(block.seeds) - 1)
        own = block.seeds[seed] == grams[at]
        at, seed = at[own], seed[own]
        row = np.searchsorted(cut, at, "right") - 1
        yield a, words, first, row, at - cut[row] + first[row], seed


def align(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of the rows of ``a`` and ``b`` (lengths na, nb), and where they end in b."""
    lanes, width = b.shape
    slope = np.arange(width, dtype=np.int32) * -GAP
    inside = np.arange(width) < nb[:, None]
    above = np.zeros((lanes, width + 1), np.int32)
    best, end = np.zeros(lanes, np.int32), np.zeros(lanes, np.int64)
    for i in range(a.shape[1]):
        step = np.where((a[:, i : i + 1] == b) & inside, MATCH, MISMATCH).astype(np.int32)
        h = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] + GAP), 0)
        h = np.maximum.accumulate(h + slope, axis=1) - slope
        h[i >= na] = 0
        at = h.argmax(axis=1)
        top = h[np.arange(lanes), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        above[:, 1:] = h
    return best, end


def _entries(block: Block, row: np.ndarray, at: np.ndarray, seed: np.ndarray, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, row, where the item would start) of each hit and each place of its seed in the items low to high; the rows and items of a run are in no other."""
    begin, stop = block.places[seed], block.places[seed + 1]
    if (low, high) != (0, len(block.ids)):
        keys = np.repeat(np.arange(len(block.seeds)), np.diff(block.places)) * len(block.ids) + block.item
        begin, stop = np.searchsorted(keys, seed * len(block.ids) + low), np.searchsorted(keys, seed * len(block.ids) + high)
    n = stop - begin
    if n.sum() > ENTRIES and row[0] != row[-1]:
        cut = int(np.searchsorted(row, row[len(row) // 2])) or int(np.searchsorted(row, row[0], "right"))
        yield from _entries(block, row[:cut], at[:cut], seed[:cut], low, high)
        yield from _entries(block, row[cut:], at[cut:], seed[cut:], low, high)
    elif n.sum() > ENTRIES and high - low > 1:
        yield from _entries(block, row, at, seed, low, (low + high) // 2)
        yield from _entries(block, row, at, seed, (low + high) // 2, high)
    elif n.sum():
        hit = np.repeat(np.arange(len(seed)), n)
        entry = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + begin[hit]
        yield block.item[entry], row[hit], at[hit] - block.offset[entry]


def _spans(begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span, place) of all places of the spans."""
    span = np.repeat(np.arange(len(n)), n)
    return span, np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n) + begin[span]


def bounds(block: Block, words: np.ndarray, item: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each item and passage what no alignment of them exceeds. Words are told apart by some of their bits, which can only raise it."""
    size, wide = np.diff(block.first)[item], stop - begin
    out = np.zeros(len(item), np.int64)
    order = np.argsort(size + wide, kind="stable")
    i = 0
    while i < len(order):
        width = (size + wide)[order[i : i + BOUNDED]]
        own = order[i : i + max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), BOUNDED, "right")))]
        bits = 1 << int(wide[own].max() * 16).bit_length()
        seen = np.zeros(len(own) * bits, bool)
        lane, at = _spans(begin[own], wide[own])
        seen[lane * bits + (words[at] & U64(bits - 1)).astype(np.int64)] = True
        lane, at = _spans(block.first[item[own]], size[own])
        step = np.where(seen[lane * bits + (block.words[at] & U64(bits - 1)).astype(np.int64)], MATCH, max(MISMATCH, GAP))
        head = np.cumsum(size[own] + 1) - size[own] - 1  # before each item a fall that no stretch can cross
        total = np.full(len(step) + len(own), -MATCH * (int(size[own].max()) + 1), np.int64)
        total[np.arange(len(step)) + lane + 1] = step
        np.cumsum(total, out=total)
        out[own] = np.maximum.reduceat(total - np.minimum.accumulate(total), head)
        i += len(own)
    return out


def _needed(size: np.ndarray, least: float) -> np.ndarray:
    return np.where(size < MIN_WORDS, 1.0, least)


def matches(col: pa.Array, block: Block, marks: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, item, score, last word) of every text and item that align well enough."""
    runs = ((a, words, first, *e) for a, words, first, row, at, seed in _hits(col, block, marks) if len(seed) for e in _entries(block, row, at, seed, 0, len(block.ids)))
    for a, words, first, item, row, start in runs:
        order = np.lexsort((start, item, row))
        item, row, start = item[order], row[order], start[order]
        size = np.diff(block.first)[item]
        pad = size // 4 + 2
        new = np.ones(len(item), bool)  # hits on nearby diagonals share a passage
        new[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1]) | (start[1:] - start[:-1] > pad[1:])
        lead = np.flatnonzero(new)
        last = np.append(lead[1:], len(item)) - 1
        item, row, size, pad = item[lead], row[lead], size[lead], pad[lead]
        begin = np.maximum(start[lead] - pad, first[row])
        stop = np.minimum(start[last] + size + pad, first[row + 1])
        able = bounds(block, words, item, begin, stop) / (MATCH * size) >= _needed(size, least)
        item, row, size, begin, stop = item[able], row[able], size[able], begin[able], stop[able]
        score, end = np.zeros(len(item)), np.zeros(len(item), np.int64)
        order = np.argsort((stop - begin) * size, kind="stable")
        i = 0
        while i < len(order):  # passages of about one size side by side
            j = i + 1
            wide, long = int((stop - begin)[order[i]]), int(size[order[i]])
            while j < len(order):
                w, s = max(wide, int((stop - begin)[order[j]])), max(long, int(size[order[j]]))
                if w * (j - i + 1) > CELLS // 8 or w * s * (j - i + 1) > CELLS * 64:
                    break
                wide, long, j = w, s, j + 1
            own = order[i:j]
            x = block.words[np.minimum(block.first[item[own]][:, None] + np.arange(long), len(block.words) - 1)]
            y = words[np.minimum(begin[own][:, None] + np.arange(wide), len(words) - 1)]
            best, where = align(x, y, size[own], (stop - begin)[own])
            score[own], end[own] = best / (MATCH * size[own]), begin[own] + where - first[row[own]]
            i = j
        order = np.lexsort((end, -score, item, row))
        item, row, score, end = item[order], row[order], score[order], end[order]
        once = np.ones(len(item), bool)
        once[1:] = (item[1:] != item[:-1]) | (row[1:] != row[:-1])
        once &= score >= _needed(np.diff(block.first)[item], least)
        yield row[once] + a, item[once], score[once], end[once]


def leaks(docs: DataFrame, benchmark: DataFrame, score: float = SCORE, key: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, score, end_word) of every document and benchmark item of which it holds a copy; ``key`` names the id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(key, "text").filter("text IS NOT NULL")
    types = (docs.schema[key].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString())
    schema = f"{key} {types[0]}, item_id {types[1]}, score double, end_word long"
    found = spark.createDataFrame([], schema)
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(block)

        def one(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            if not len(block.seeds):
                return
            marks, ids = block.marks(), pa.array(block.ids)
            for batch in batches:
                for row, item, value, end in matches(batch.column("text"), block, marks, score):
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), ids.take(pa.array(item)), pa.array(value), pa.array(end)], [key, "item_id", "score", "end_word"])

        found = found.union(docs.mapInArrow(one, schema))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, score: float = SCORE) -> DataFrame:
    """The rows of ``docs`` that hold a copy of no benchmark item, with all their columns.

    With a benchmark of one block that is a map over the rows; with more, each block meets all rows and those that any block finds go.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    few = list(islice(blocks(benchmark), 2))  # two blocks at most
    if not few:
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if len(few) == 2:
        rows = keyed(docs.select("doc_id", "text", row), "_key")
        return rows.join(leaks(rows, benchmark, score, "_key").select("_key").distinct(), "_key", "left_anti").select("row.*")
    shared = spark.sparkContext.broadcast(few[0])
    rows = docs.select(row, "text")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        marks = block.marks()
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            if len(block.seeds):
                for at, *_ in matches(batch.column("text"), block, marks, score):
                    clean[at] = False
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(clean))], ["row"])

    return rows.mapInArrow(one, rows.select("row").schema).select("row.*")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
