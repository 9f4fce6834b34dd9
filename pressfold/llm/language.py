"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled rows: the ``ROWS``
documents with the smallest seeded hashes among those of at most ``TEXT_BYTES`` bytes, whole texts (where a language has
fewer, the shortest of the others follow, up to ``LANGUAGE_BYTES`` in all). A text is cut greedily into the longest phrases that occur in a
language's sample; a symbol that does not occur there is a phrase of its own. The language with the fewest phrases a symbol,
times the bits that one phrase's place in its sample takes, wins; ties go to the language that is first by code point.

Texts are parsed whole, as lower-cased UTF-8 bytes with all ASCII non-letters as one
symbol. Pieces of ``LANE`` symbols go through an automaton side by side, each as if a phrase began at its start; where one
does not, the piece is parsed again from the end of the phrase that reaches into it until both parses
begin a phrase at the same place (see :func:`phrases`), so the counts are those of one parse from front to back.

Samples, at most ``LANGUAGE_BYTES`` a language, are broadcast ``AT_ONCE`` languages at a time; the tasks build the automata. With more languages
each block is a pass of its own, and the blocks' best two meet by document.

Edge cases: a text that is null or without any letter is ``und`` with score 0, as is
everything if no language was learned; with one language the score is 1; rows with a null
doc_id are predicted but not learned from and not held out; repeated rows are predicted
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressfold.llm import textvec as tv
from pressfold.llm.common import bounded_batches, fold, keyed, table

ROWS = 32
TEXT_BYTES = 1024
LANGUAGE_BYTES = ROWS * TEXT_BYTES
AT_ONCE = 16
LANE = 256
FEW = 24
SEED = 29
FOLDS, HELD_OUT = 4, 2

#: Byte to symbol: 0 for ASCII other than letters, else the lower-cased byte.
SYMBOL = tv.LOWER.copy()
SYMBOL[[b for b in range(128) if not chr(b).isalpha()]] = 0


def suffix_automaton(symbols: list[int]) -> tuple[list[dict[int, int]], int]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts, last


def build(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """(column of each byte, flat table, sample size). An entry is the next state's row start, -1 if there is none.

    The last column stands for symbols that the sample lacks, the last row for a phrase that cannot go on.
    """
    data = SYMBOL[np.frombuffer(b"\n".join(texts), np.uint8)]
    own = np.unique(data)
    width = len(own) + 1
    column = np.full(256, width - 1, np.uint8)
    column[own] = np.arange(len(own))
    nexts, _ = suffix_automaton(column[data].tolist())
    flat = np.full((len(nexts) + 1, width), -1, np.int32)
    for s, out in enumerate(nexts):
        for c, to in out.items():
            flat[s, c] = to * width
    return column[SYMBOL], flat.reshape(-1), len(data)


def _run(symbols: np.ndarray, flat: np.ndarray, dead: int, pos: np.ndarray, stop: np.ndarray, end: np.ndarray, marks: np.ndarray, again: bool) -> tuple[np.ndarray, np.ndarray]:
    """(phrases, exit) of a greedy parse from each ``pos``, where a phrase begins, to the first phrase that begins at ``stop`` or later (or the text's ``end``).

    The first run marks where phrases begin; one that runs ``again`` also exits where it begins a phrase at a mark.
    """
    count, out = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    live, pos, state = np.arange(len(pos)), pos.copy(), np.full(len(pos), dead, np.int32)
    while len(live) > FEW:
        c = symbols[pos]
        step = flat[state + c]
        new = np.flatnonzero(step < 0)
        going = None
        if len(new):
            at = pos[new]
            over = at >= stop[new]
            if again:
                over |= marks[at]
            first = flat[c[new]]
            step[new] = np.where(first < 0, dead, first)
            count[live[new[~over]]] += 1
            if not again:
                marks[at[~over]] = True
            if over.any():
                out[live[new[over]]] = at[over]
                going = np.ones(len(live), bool)
                going[new[over]] = False
        state = step
        pos += 1
        ended = pos == end
        if ended.any():
            going = np.ones(len(live), bool) if going is None else going
            last = ended & going
            out[live[last]] = end[last]
            going &= ~ended
        if going is not None:
            live, pos, state, stop, end = live[going], pos[going], state[going], stop[going], end[going]
    for i, p, st, halt, last in zip(live.tolist(), pos.tolist(), state.tolist(), stop.tolist(), end.tolist(), strict=True):  # one by one
        for c in symbols[p:last].tolist():
            step = flat.item(st + c)
            if step < 0:
                if p >= halt or (again and marks.item(p)):
                    break
                count[i] += 1
                marks[p] |= not again
                step = flat.item(c)
                step = dead if step < 0 else step
            st = step
            p += 1
        out[i] = p
    return count, out


def phrases(data: np.ndarray, bounds: np.ndarray, column: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Phrases of each text data[bounds[i]:bounds[i + 1]]."""
    size = np.diff(bounds)
    lanes = -(-size // LANE)
    text = np.repeat(np.arange(len(size)), lanes)
    nth = np.arange(len(text)) - (np.cumsum(lanes) - lanes)[text]
    start, end = bounds[:-1][text] + nth * LANE, bounds[1:][text]
    stop = np.minimum(start + LANE, end)
    symbols, dead = column[data], len(flat) - (int(column.max()) + 1)
    marks = np.zeros(len(data) + 1, bool)
    count, out = _run(symbols, flat, dead, start, stop, end, marks, False)
    alone, before = out.copy(), np.concatenate([[0], np.cumsum(marks)])
    todo = np.flatnonzero(nth > 0)
    while len(todo):  # pieces that a phrase of the piece before reaches into
        begin = out[todo - 1]
        inside = np.flatnonzero(begin < stop[todo])
        own = todo[inside]
        n, at = np.zeros(len(todo), np.int64), begin.copy()
        n[inside], at[inside] = _run(symbols, flat, dead, begin[inside], stop[own], end[own], marks, True)
        met = inside[at[inside] < stop[own]]
        n[met] += before[stop[todo[met]]] - before[at[met]]
        at[met] = alone[todo[met]]
        follow = todo[at != out[todo]] + 1
        count[todo], out[todo] = n, at
        follow = follow[follow < len(text)]
        todo = follow[nth[follow] > 0]
    return np.bincount(text, weights=count, minlength=len(size)).astype(np.int64)


def samples(docs: DataFrame, rows: int = ROWS, text_bytes: int = TEXT_BYTES, seed: int = SEED) -> DataFrame:
    """(lang, texts): the texts (bytes) that each language is learned from."""
    known = docs.select("lang", "doc_id", "text").filter(F.col("lang").isNotNull() & (F.length("text") > 0) & (fold("doc_id", FOLDS) != HELD_OUT))
    size, most = F.octet_length("text"), rows * text_bytes
    narrow = known.select("lang", F.greatest(size, F.lit(text_bytes)).alias("_long"), F.xxhash64("doc_id", F.lit(seed)).alias("_h"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_t"), size.alias("_size"))
    order = Window.partitionBy("lang").orderBy("_long", "_h", "_id", "_t")
    chosen = narrow.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rows)
    chosen = chosen.withColumn("_room", F.lit(most) - (F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size"))).filter("_room > 0")
    chosen = chosen.select(F.col("lang").alias("_lang"), "_id", "_t", F.col("_room").cast("int").alias("_room"), "_n")
    found = known.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_t")))  # at most ROWS a language
    found = found.select("lang", "_n", F.substring(F.col("text").cast("binary"), F.lit(1), F.col("_room")).alias("text")).distinct()
    return found.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]).alias("texts"))


def learn(docs: DataFrame, **params) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Blocks of (language, texts) in the order of code points, ``LANGUAGE_BYTES`` a language at most."""
    block = []
    for r in samples(docs, **params).orderBy("lang").toLocalIterator():
        block.append((r["lang"], [bytes(t) for t in r["texts"]]))
        if len(block) == AT_ONCE:
            yield block
            block = []
    if block:
        yield block


@lru_cache(maxsize=1)
def _models(block: tuple[tuple[str, tuple[bytes, ...]], ...]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Built once in a Python worker."""
    return [build(list(texts)) for _, texts in block]


def parse_bits(col: pa.Array, models: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Bits a symbol of each text (row) in each language (column)."""
    out = np.ones((len(col), len(models)))
    for a, b, data, bounds in tv.text_chunks(col):
        for k, (column, flat, n) in enumerate(models):
            out[a:b, k] = phrases(data, bounds, column, flat) * np.log2(n + 2) / np.maximum(np.diff(bounds), 1)
    return out


def _parsed(rows: DataFrame, block: list[tuple[str, list[bytes]]]) -> DataFrame:
    """``rows`` (row of any type, text) as (row, lang, bits, second): the best language of the block, its bits a symbol and those of the next."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple((lang, tuple(texts)) for lang, texts in block))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([lang for lang, _ in shared.value], object)
        models = _models(shared.value)
        for batch in batches:
            bits = np.column_stack([parse_bits(batch.column("text"), models), np.full(batch.num_rows, np.inf)])
            best = bits[:, :-1].argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names[best], pa.string()), pa.array(bits.min(axis=1)), pa.array(np.partition(bits, 1, axis=1)[:, 1])], ["row", "lang", "bits", "second"])

    return rows.mapInArrow(one, rows.select("row", F.lit("").alias("lang"), F.lit(0.0).alias("bits"), F.lit(0.0).alias("second")).schema)


def predict(docs: DataFrame, **params) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    blocks = list(learn(docs, **params))
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not blocks:
        found = docs.select("doc_id", F.lit(False).alias("known"), F.lit("").alias("lang"), F.lit(0.0).alias("bits"), F.lit(0.0).alias("second"))
    elif len(blocks) == 1:
        found = _parsed(docs.select(F.struct("doc_id", known.alias("known")).alias("row"), "text"), blocks[0]).select("row.*", "lang", "bits", "second")
    else:
        rows = keyed(docs.select("doc_id", "text"), "_key").select(F.struct("_key", "doc_id", known.alias("known")).alias("row"), "text")
        parts = _parsed(rows, blocks[0])
        for block in blocks[1:]:
            parts = parts.union(_parsed(rows, block))
        parts = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("bits", "lang", "second"))).alias("m"))
        found = parts.select("row.doc_id", "row.known", F.col("m")[0]["lang"].alias("lang"), F.col("m")[0]["bits"].alias("bits"), F.least(F.col("m")[0]["second"], F.col("m")[1]["bits"]).alias("second"))
    # with one language only, the second is infinite
    sure = F.when(F.col("second") == float("inf"), 1.0).when(F.col("second") + F.col("bits") > 0, F.col("second") / (F.col("second") + F.col("bits"))).otherwise(0.5)
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.when(F.col("known"), F.col("lang")).otherwise("und").alias("lang_pred"), F.when(F.col("known"), sure).otherwise(0.0).alias("score"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))
