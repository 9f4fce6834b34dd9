"""Logistic regression over hashed word n-grams, trained by follow-the-regularised-leader (FTRL-proximal).

Quality (:data:`QUALITY`) uses word n-grams and n-grams of word shapes, counted and
divided by the text's number of tokens. Toxicity (:data:`TOXIC`) uses word n-grams,
skip-grams and stems (the first bytes of longer words), once or repeated, so that a few words count in a long text as in a short one.

Training reads a bounded sample, ``FIT_ROWS`` labelled documents of the training folds
with the smallest seeded hashes and ``FIT_BYTES`` bytes at most (a document that would pass them is left out), whole texts, in one task and in hash order. FTRL keeps a learning
rate for each coordinate; L1 sets most weights to zero, and only the others
(bounded by ``2 ** BITS``) go to the executors. Scoring is a map over whole texts.

Edge cases: a null text is empty and scores the intercept alone; labels of other values
than 0 and 1 (null included) are ignored; repeated label rows count again; without any
label all scores are 0.5; an empty table gives an empty result; rows with a null doc_id
are scored and not held out; extra columns, whatever their names, are ignored by
:func:`score_texts` and kept by :func:`keep_accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.llm import textvec as tv
from pressfold.llm.common import bounded_batches, fold, table

BITS = 24
FIT_ROWS = 8192
FIT_BYTES = 48 << 20
EPOCHS = 3
SEED = 11
ACCEPT = 0.7

U64 = np.uint64
MASK = U64((1 << BITS) - 1)


@dataclass(frozen=True)
class Task:
    """What a classifier looks at and how it is fitted."""

    label: str
    folds: int
    held_out: int
    words: tuple[int, ...]  # distances between the two words of a pair; 0: single words
    stems: tuple[int, ...]  # bytes of a longer word's beginning, its inflections' common part
    shapes: tuple[int, ...]  # lengths of shape n-grams
    damped: bool  # 1, or 1.5 if repeated, whatever the text's length; else counts by tokens
    weight: float  # of label 1
    alpha: float
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0


QUALITY = Task("quality", 4, 2, words=(0, 1), stems=(), shapes=(1, 2, 3), damped=False, weight=1.0, alpha=0.5, l1=0.02, l2=0.0)
TOXIC = Task("toxic", 3, 1, words=(0, 1, 2, 3), stems=(4, 5, 6), shapes=(), damped=True, weight=1.5, alpha=1.0, l1=4.0, l2=0.0)

#: Mean counts are small; this factor brings the gradients of frequent features near 1.
SCALE = 8.0


def _shape_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Case, digits, letters beyond ASCII, kind and length class of each token."""
    def counts(flags: np.ndarray) -> np.ndarray:
        run = np.zeros(len(data) + 1, np.int32)
        np.cumsum(flags, out=run[1:])
        return run[ends] - run[starts]

    length = (ends - starts).astype(np.int64)
    upper, digit, wide = counts((data >= 65) & (data <= 90)), counts((data >= 48) & (data <= 57)), counts(data >= 128)
    first = data[starts]
    case = np.where(upper == 0, 0, np.where(upper == length, 2, np.where((upper == 1) & (first >= 65) & (first <= 90), 1, 3)))
    word = (tv.SPLIT[first] == 1).astype(np.int64)
    return case + 4 * (digit > 0) + 8 * (wide > 0) + 16 * word + 32 * np.minimum(length, 3 + (length > 6) + (length > 12) + (length > 24))


def grams(data: np.ndarray, bounds: np.ndarray, task: Task) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(feature, document) of every n-gram, one kind after the other; the third array is the number of tokens, once."""
    starts, ends, first = tv.token_bounds(data, bounds, tv.SPLIT)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    running = tv.prefix_hash(tv.LOWER[data])
    words = tv.mix(tv.span_hash(running, starts, ends))
    yield words & MASK, doc, n
    for gap in task.words:
        if gap and len(words) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = tv.mix(words[:-gap] * U64(0xD1342543DE82EF95) + words[gap:] + U64(gap))
            yield pair[same] & MASK, doc[gap:][same], None
    for size in task.stems:
        long = np.flatnonzero(ends - starts > size)
        yield tv.mix(tv.span_hash(running, starts[long], starts[long] + size) + U64(size)) & MASK, doc[long], None
    if task.shapes and len(starts):
        shape = _shape_ids(data, starts, ends).astype(np.uint64)
        for size in task.shapes:
            if len(shape) >= size:
                h = np.zeros(len(shape) - size + 1, np.uint64)
                for k in range(size):
                    h = h * U64(512) + shape[k : len(shape) - size + 1 + k]
                same = doc[size - 1 :] == doc[: len(doc) - size + 1]
                yield tv.mix(h + U64(size << 40))[same] & MASK, doc[size - 1 :][same], None


def _examples(batches: Iterator[pa.RecordBatch], task: Task) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    room = FIT_BYTES
    for batch in batches:
        fits = []
        for size in pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist():
            fits.append(size <= room)
            room -= size if fits[-1] else 0
        batch = batch.filter(pa.array(fits, pa.bool_()))
        labels = batch.column("label").to_pylist()
        for a, b, data, bounds in tv.text_chunks(batch.column("text")):
            parts = list(grams(data, bounds, task))
            feats = np.concatenate([p[0] for p in parts]).astype(np.int64)
            docs = np.concatenate([p[1] for p in parts]).astype(np.int64)
            tokens = np.maximum(parts[0][2], 1)
            del parts
            feats |= docs << BITS
            del docs
            keys, counts = np.unique(feats, return_counts=True)
            del feats
            cut = np.searchsorted(keys >> BITS, np.arange(b - a))
            idx = (keys & int(MASK)).astype(np.int32)
            value = (1.0 + (counts > 1) / 2 if task.damped else counts * (SCALE / tokens[keys >> BITS])).astype(np.float32)
            cut = np.append(cut, len(keys))
            del keys, counts
            for i in range(b - a):  # views of the run's arrays, which are freed whole
                yield idx[cut[i] : cut[i + 1]], value[cut[i] : cut[i + 1]], labels[a + i]


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], task: Task, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features with a weight, their weights, intercept). The features in ``examples`` are numbered anew, in place, so that state is kept for those that occur only."""
    seen = np.zeros(1 << BITS, bool)
    for idx, _, _ in examples:
        seen[idx] = True
    features = np.flatnonzero(seen).astype(np.int32)
    del seen
    for idx, _, _ in examples:
        idx[:] = np.searchsorted(features, idx)
    z, n = np.zeros(len(features), np.float32), np.zeros(len(features), np.float32)
    zb = nb = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = (np.sign(zi) * task.l1 - zi) / ((task.beta + np.sqrt(ni)) / task.alpha + task.l2)
        w[np.abs(zi) <= task.l1] = 0
        return w

    def intercept() -> float:
        return -zb / ((task.beta + nb**0.5) / task.alpha)

    for _ in range(epochs):
        for idx, value, y in examples:
            zi, ni, b = z[idx], n[idx], intercept()
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(float(w @ value) + b, -30, 30)))
            d = (p - y) * (task.weight if y else 1.0)
            g = np.float32(d) * value
            n[idx] = ni + g * g
            z[idx] = zi + g - (np.sqrt(n[idx]) - np.sqrt(ni)) / task.alpha * w
            zb += d - ((nb + d**2) ** 0.5 - nb**0.5) / task.alpha * b
            nb += d**2
    used = np.flatnonzero(np.abs(z) > task.l1)
    return features[used], weights(z[used], n[used]).astype(np.float32), intercept()


def fit(docs: DataFrame, labels: DataFrame, task: Task, fit_rows: int = FIT_ROWS, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on ``fit_rows`` labelled documents of the training folds at most."""
    bounded_batches(docs.sparkSession)
    chosen = labels.select("doc_id", F.col(task.label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (fold("doc_id", task.folds) != task.held_out))
    chosen = chosen.withColumn("_h", F.xxhash64("doc_id", F.lit(seed))).orderBy("_h", "doc_id", "label").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(1).sortWithinPartitions("_h", "doc_id", "label").select("text", "label")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, w, b = train(list(_examples(batches, task)), task, epochs)
        yield pa.RecordBatch.from_pydict({"idx": pa.array([idx.tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary()), "b": [b]})

    row = rows.mapInArrow(one, "idx binary, w binary, b double").first()
    if row is None:
        return np.empty(0, np.int32), np.empty(0, np.float32), 0.0
    return np.frombuffer(row["idx"], np.int32), np.frombuffer(row["w"], np.float32), row["b"]


def score_batch(col: pa.Array, task: Task, model: tuple[np.ndarray, np.ndarray, float], seen: np.ndarray) -> np.ndarray:
    """Scores of the texts of ``col``; ``seen`` marks the low bits of the features that have a weight."""
    idx, w, b = model
    out = np.full(len(col), b)
    low = U64(len(seen) - 1)
    for a, e, data, bounds in tv.text_chunks(col):
        tokens, total = None, np.zeros(e - a)
        for feats, docs, n in grams(data, bounds, task):
            tokens = n if n is not None else tokens
            hit = np.flatnonzero(seen[feats & low])
            f, d = feats[hit].astype(np.int64), docs[hit].astype(np.int64)
            at = np.minimum(np.searchsorted(idx, f), max(0, len(idx) - 1))
            own = idx[at] == f if len(idx) else np.zeros(len(f), bool)
            at, d = at[own], d[own]
            value = w[at].astype(np.float64)
            if task.damped and len(d):
                keys, counts = np.unique(d * len(idx) + at, return_counts=True)
                d, value = keys // len(idx), w[keys % len(idx)] * (1.0 + (counts > 1) / 2)
            total += np.bincount(d, weights=value, minlength=e - a)
        out[a:e] += total if task.damped else total * (SCALE / np.maximum(tokens, 1))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _scored(rows: DataFrame, task: Task, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """``rows`` (row of any type, text) as (row, score)."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = rows.select("row", F.lit(0.0).alias("score")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seen = np.zeros(1 << 20, bool)
        seen[model[0] & (len(seen) - 1)] = True
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score_batch(batch.column("text"), task, model, seen))], ["row", "score"])

    return rows.mapInArrow(score, schema)


def score_texts(docs: DataFrame, labels: DataFrame, task: Task, **params) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``."""
    model = fit(docs, labels, task, **params)
    scored = _scored(docs.select(F.struct("doc_id").alias("row"), "text"), task, model)
    held = F.coalesce(fold(F.col("row.doc_id"), task.folds) == task.held_out, F.lit(False))
    return scored.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_accepted(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, task: Task = QUALITY, **params) -> DataFrame:
    """The rows of ``docs`` that a classifier fitted on ``train_docs`` accepts, with all their columns."""
    model = fit(train_docs, labels, task, **params)
    bounded_batches(docs.sparkSession)
    scored = _scored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), task, model)
    return scored.filter(F.col("score") >= ACCEPT).select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), TOXIC)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), QUALITY)
