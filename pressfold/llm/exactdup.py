"""Exact removal of repeated 100-byte strings over a collection (suffix sorting by columns).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id,
or earlier in the document). Strings never cross documents; all are judged on the input.

1. Every window of LENGTH bytes has an anchor: its ``GRAM``-byte string with the smallest hash (the
   first of equals). Equal windows have equal anchors, and the windows of one anchor in a text
   are a run. So a text falls into blocks, one for each run, of at most 2 * LENGTH - GRAM bytes.
2. Tasks send a record for each block, without its bytes, to the bucket of its anchor. Equal blocks (by the
   64-bit hashes of anchor and block) collapse to the first, in the task and in the bucket; the windows of the others repeat it.
3. Only anchors that are left with several different blocks go on. Their blocks' bytes meet in buckets, where windows whose
   hash no other window of the bucket has are cut off, and of the rest
   the Burrows-Wheeler transform and the common prefixes are built column by column (:mod:`pressfold.llm.bwt`), in collections of
   about ``COLLECTION`` bytes with whole anchors. Rows with a common prefix of LENGTH bytes are the
   occurrences of one string; all but the first occurrence are removed.
   An anchor with more than ``HOT`` different blocks (a frequent passage's edge, say) would make a collection of any size. Its blocks
   are cut into single windows, which are dealt by their own hash and collapse like blocks.
4. The removed windows of each document are united.

The numbers of buckets follow the measured bytes (``RECORD_BYTES``, ``BUCKET_BYTES``), so what a task holds does not
grow with the table. Texts that hold nothing repeated are not shuffled, as long as the keys of the others are few enough to be
broadcast (``BROADCAST_KEYS``). The runs of one document meet in one row; they take about as many bytes as its text at most.

Edge cases: a null or empty text has 0 bytes, nothing removed and the hash of the empty string;
rows that share a doc_id, or have none, are ordered by text and are documents of their own (null ids
come last); of repeated rows the first is kept; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.llm import textvec as tv
from pressfold.llm.bwt import collection_bwt, suffix_rows
from pressfold.llm.common import bounded_batches, keyed, materialize, table

LENGTH = 100
GRAM = 32
BLOCK = 2 * LENGTH - GRAM
HOT = 1024
BROADCAST_KEYS = 1 << 20

#: Window starts that are hashed at once, and records that a task gathers before it sends them.
SEGMENT = 1 << 21
FLUSH = 1 << 19

#: Bytes of blocks that a task gathers before it sends them (their index takes eight times as much).
BLOCK_BYTES = 4 << 20

#: Bytes of records, of blocks, and of windows of hot anchors that a bucket holds on average.
RECORD_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
HOT_BYTES = 1 << 20

#: Bytes of blocks that one collection holds (and at most ``HOT`` blocks more).
COLLECTION = 1 << 19

U64 = np.uint64
BLOB = "bucket int, kind byte, n int, blob binary"
RUNS, BLOCKS, HOTS = 0, 1, 2  # kinds of rows: removed windows, records or blocks, blocks of hot anchors


def anchors(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first window, number of windows, anchor hash) of the blocks of all texts."""
    for s in range(0, len(data) - LENGTH + 1, SEGMENT):
        part = data[s : min(len(data), s + SEGMENT + LENGTH - 1)]
        run = tv.prefix_hash(part)
        at = np.arange(len(part) - GRAM + 1)
        h = tv.mix(tv.span_hash(run, at, at + GRAM))
        low = (h & ~U64((1 << 23) - 1)) | at.astype(np.uint64)
        span, width = LENGTH - GRAM + 1, 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])  # one for each window
        place = (low & U64((1 << 23) - 1)).astype(np.int64)
        start = np.arange(len(place)) + s
        text = np.searchsorted(bounds, start, "right") - 1
        good = start + LENGTH <= bounds[text + 1]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new & good)
        stop = np.flatnonzero(np.append(new[1:], True) | ~np.append(good[1:], False))
        last = stop[np.searchsorted(stop, first)]
        yield text[first], start[first], last - first + 1, h[place[first]]


#: A block, or a single window: its anchor, its own hash, its place and its number of windows.
RECORD = np.dtype([("h", "u8"), ("g", "u8"), ("key", "i8"), ("a", "i4"), ("n", "u1")])

#: A run of windows that are removed.
RUN = np.dtype([("key", "i8"), ("a", "i4"), ("n", "i4")])

#: A block on its way to its bucket, the bytes apart.
SENT = np.dtype([("h", "u8"), ("key", "i8"), ("a", "i4"), ("n", "u1")])

BLOB_NAMES = ["bucket", "kind", "n", "blob"]


def _bytes(records: np.ndarray) -> bytes:
    """Column by column, so that the files compress."""
    return b"".join(np.ascontiguousarray(records[c]).tobytes() for c in records.dtype.names)


def _read(raw: pa.Buffer, n: int, dtype: np.dtype) -> tuple[np.ndarray, int]:
    out, at = np.empty(n, dtype), 0
    for c in dtype.names:
        out[c] = np.frombuffer(raw, dtype[c], n, at)
        at += n * dtype[c].itemsize
    return out, at


def _blobs(bucket: np.ndarray, records: np.ndarray, kind: int) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    cut = _groups(bucket)
    end = np.append(cut, len(bucket))[1:]
    blob = [_bytes(records[a:b]) for a, b in zip(cut, end, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(np.full(len(cut), kind, np.int8)), pa.array((end - cut).astype(np.int32)), pa.array(blob, pa.binary())], BLOB_NAMES)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _collapsed(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first of all equal records, in the order of their hashes; the runs of the others)."""
    r = r[np.lexsort((r["a"], r["key"], r["g"], r["h"]))]
    first = np.zeros(len(r), bool)
    first[_groups(r["h"], r["g"])] = True
    return r[first], _joined(r["key"][~first], r["a"][~first], r["n"][~first])


def _joined(key: np.ndarray, a: np.ndarray, n: np.ndarray) -> np.ndarray:
    """RUNs of the windows, adjacent ones as one."""
    order = np.lexsort((a, key))
    key, a, n = key[order], a[order].astype(np.int64), n[order].astype(np.int64)
    if not len(key):
        return np.empty(0, RUN)
    new = np.append(True, (key[1:] != key[:-1]) | (a[1:] > (a + n)[:-1]))
    cut = np.flatnonzero(new)
    out = np.empty(len(cut), RUN)
    out["key"], out["a"] = key[cut], a[cut]
    out["n"] = (a + n)[np.append(cut[1:], len(key)) - 1] - a[cut]
    return out


def _run_table(parts: list[np.ndarray]) -> dict[str, np.ndarray]:
    runs = np.concatenate([*parts, np.empty(0, RUN)])
    return {"key": runs["key"], "a": runs["a"], "n": runs["n"]}


def block_records(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, key, h, a, n): the runs of blocks that repeat an earlier one, and the different blocks of anchors that have several."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            r, runs = _collapsed(np.concatenate(held))
            held.clear()
            yield _blobs(((r["h"] >> U64(20)) % U64(buckets)).astype(np.int64), r, BLOCKS)
            yield _blobs((tv.mix(runs["key"].astype(np.uint64)) % U64(buckets)).astype(np.int64), runs, RUNS)

        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, _, data, bounds in tv.text_chunks(batch.column("text")):
                running = tv.prefix_hash(data)
                for text, start, n, h in anchors(data, bounds):
                    r = np.empty(len(text), RECORD)
                    r["h"], r["key"], r["a"], r["n"] = h, keys[first + text], start - bounds[text], n
                    r["g"] = tv.mix(tv.span_hash(running, start, start + n + LENGTH - 1) + U64(7))
                    held.append(r)
                    if sum(map(len, held)) >= FLUSH:
                        yield from flush()
        if held:
            yield from flush()

    def meet(group: pa.Table) -> pa.Table:
        records, runs = [np.empty(0, RECORD)], []
        for kind, n, blob in zip(group.column("kind").to_pylist(), group.column("n").to_pylist(), group.column("blob"), strict=True):
            if kind == RUNS:
                runs.append(_read(blob.as_buffer(), n, RUN)[0])
            else:
                records.append(_read(blob.as_buffer(), n, RECORD)[0])
        r, gone = _collapsed(np.concatenate(records))
        gone = _run_table([*runs, gone])
        cut = _groups(r["h"])
        each = np.diff(np.append(cut, len(r)))
        each = np.repeat(each, each)
        r, each = r[each > 1], each[each > 1]
        kind = np.concatenate([np.full(len(gone["key"]), RUNS), np.where(each > HOT, HOTS, BLOCKS)]).astype(np.int8)
        both = {c: np.concatenate([gone[c].astype(t), r[c].astype(t)]) for c, t in (("key", np.int64), ("a", np.int32), ("n", np.int32))}
        h = np.concatenate([np.zeros(len(gone["key"]), np.int64), r["h"].view(np.int64) if len(r) else np.empty(0, np.int64)])
        return pa.table({"kind": pa.array(kind), "key": pa.array(both["key"]), "h": pa.array(h), "a": pa.array(both["a"]), "n": pa.array(both["n"])})

    return docs.mapInArrow(send, BLOB).groupBy("bucket").applyInArrow(meet, "kind byte, key long, h long, a int, n int")


def sent_blocks(rows: DataFrame, buckets: int, hot_buckets: int) -> DataFrame:
    """Buckets of blocks with their bytes (0 to buckets - 1) and of the windows of hot anchors (from there on).

    ``rows``: key, text, blocks (array of kind, h, a, n).
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        windows: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            r = np.concatenate([r for r, _ in held])
            size = r["n"].astype(np.int64) + LENGTH - 1
            at = np.cumsum(size) - size
            data = np.concatenate([d for _, d in held])
            held.clear()
            bucket = ((r["h"] >> U64(20)) % U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            r, at, size, bucket = r[order], at[order], size[order], bucket[order]
            cut = _groups(bucket)
            for a, b in zip(cut, np.append(cut, len(r))[1:], strict=True):
                blob = _bytes(r[a:b]) + data[_places(at[a:b], size[a:b])].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([BLOCKS], pa.int8()), pa.array([b - a], pa.int32()), pa.array([blob], pa.binary())], BLOB_NAMES)

        def flush_windows() -> Iterator[pa.RecordBatch]:
            r, runs = _collapsed(np.concatenate(windows))
            windows.clear()
            yield _blobs(buckets + ((r["h"] >> U64(20)) % U64(hot_buckets)).astype(np.int64), r, HOTS)
            yield _blobs(buckets + (tv.mix(runs["key"].astype(np.uint64)) % U64(hot_buckets)).astype(np.int64), runs, RUNS)

        for batch in batches:
            keys, lists = batch.column("key").to_numpy(), batch.column("blocks")
            for a, b, data, bounds in tv.text_chunks(batch.column("text")):
                part = lists.slice(a, b - a)
                flat = part.flatten()
                text = np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy()))
                kind, h, first, n = (flat.field(c).to_numpy() for c in ("kind", "h", "a", "n"))
                h, n = h.view(np.uint64), n.astype(np.int64)
                start = bounds[text] + first
                cold = np.flatnonzero(kind == BLOCKS)
                r = np.empty(len(cold), SENT)
                r["h"], r["key"], r["a"], r["n"] = h[cold], keys[a + text[cold]], first[cold], n[cold]
                held.append((r, data[_places(start[cold], n[cold] + LENGTH - 1)]))
                if sum(len(d) for _, d in held) >= BLOCK_BYTES:
                    yield from flush()
                hot = np.flatnonzero(kind == HOTS)
                if not len(hot):
                    continue
                running = tv.prefix_hash(data)
                for i in range(0, len(hot), FLUSH // BLOCK):
                    own = hot[i : i + FLUSH // BLOCK]
                    at, block = _places(start[own], n[own]), np.repeat(own, n[own])
                    r = np.empty(len(at), RECORD)
                    r["g"], r["key"], r["a"], r["n"] = h[block], keys[a + text[block]], at - bounds[text[block]], 1
                    r["h"] = tv.mix(tv.span_hash(running, at, at + LENGTH) ^ h[block])
                    windows.append(r)
                    if sum(map(len, windows)) >= FLUSH:
                        yield from flush_windows()
        if held:
            yield from flush()
        if windows:
            yield from flush_windows()

    return rows.mapInArrow(send, BLOB)


def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of n[0] places, then those of the next."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def later_windows(r: np.ndarray, data: np.ndarray) -> np.ndarray:
    """RUNs of the windows that are not the first of their string; ``data`` holds the blocks of ``r`` one after the other."""
    if not len(r):
        return np.empty(0, RUN)
    first = np.concatenate([[0], np.cumsum(r["n"].astype(np.int64) + LENGTH - 1)])
    bwt, lcp, row = collection_bwt(data, first, LENGTH)
    rows = suffix_rows(bwt, row, np.diff(first), int(r["n"].max()))
    step, block = np.nonzero((np.arange(len(rows))[:, None] < r["n"]))
    string = np.cumsum(lcp < LENGTH)[rows[step, block]]
    key, at = r["key"][block], r["a"][block] + step
    order = np.lexsort((at, key, string))
    later = np.zeros(len(order), bool)
    later[order[1:]] = string[order[1:]] == string[order[:-1]]
    return _joined(key[later], at[later], np.ones(int(later.sum()), np.int64))


def _trimmed(r: np.ndarray, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks, and their bytes, cut down to the windows whose hash another window has; a window that is alone repeats nothing."""
    n = r["n"].astype(np.int64)
    first = np.cumsum(n) - n
    block = np.repeat(np.arange(len(r)), n)
    step = np.arange(len(block)) - first[block]
    start = at[block] + step
    h = tv.span_hash(tv.prefix_hash(data), start, start + LENGTH)
    order = np.argsort(h)
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    block, step = block[twice], step[twice]
    cut = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.empty(0, np.int64)
    low, high = step[cut], step[np.append(cut[1:], len(block)) - 1] if len(block) else cut
    own = block[cut]
    out, at = r[own].copy(), at[own] + low
    out["a"] += low.astype(np.int32)
    out["n"] = high - low + 1
    return out, data[_places(at, high - low + LENGTH)]


def _removals(group: pa.Table) -> pa.Table:
    """The runs of repeated windows of one bucket, collection by collection."""
    records, pieces, windows, runs = [], [], [], []
    for kind, n, blob in zip(group.column("kind").to_pylist(), group.column("n").to_pylist(), group.column("blob"), strict=True):
        raw = blob.as_buffer()
        if kind == BLOCKS:
            r, at = _read(raw, n, SENT)
            records.append(r)
            pieces.append(np.frombuffer(raw, np.uint8, len(raw) - at, at))
        elif kind == HOTS:
            windows.append(_read(raw, n, RECORD)[0])
        else:
            runs.append(_read(raw, n, RUN)[0])
    if windows:
        runs.append(_collapsed(np.concatenate(windows))[1])
    if records:
        r, data = np.concatenate(records), np.concatenate(pieces)
        del records, pieces
        size = r["n"].astype(np.int64) + LENGTH - 1
        at = np.cumsum(size) - size
        order = np.lexsort((r["a"], r["key"], r["h"]))
        r, at, size = r[order], at[order], size[order]
        total, anchor = np.cumsum(size), np.append(_groups(r["h"]), len(r))
        a = 0
        while a < len(r):  # whole anchors
            least = min(len(r), int(np.searchsorted(total, (total[a - 1] if a else 0) + COLLECTION)) + 1)
            b = int(anchor[np.searchsorted(anchor, least)])
            part, places = _trimmed(r[a:b], *_gathered(data, at[a:b], size[a:b]))
            runs.append(later_windows(part, places))
            a = b
    return pa.table({c: pa.array(v) for c, v in _run_table(runs).items()})


def _gathered(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, bytes) of the blocks, one after the other."""
    return np.cumsum(size) - size, data[_places(at, size)]


RESULT = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each text (and of what is left of it, as bytes in ``kept``) without its removed windows."""
    for batch in batches:
        for a, b, data, bounds in tv.text_chunks(batch.column("text")):
            edge = np.zeros(len(data) + 1, np.int32)
            if "runs" in batch.schema.names:
                part = batch.column("runs").slice(a, b - a)
                flat, text = part.flatten(), np.repeat(np.arange(b - a), np.diff(part.offsets.to_numpy()))
                start = bounds[text] + flat.field("a").to_numpy()
                np.add.at(edge, start, 1)
                np.add.at(edge, start + flat.field("n").to_numpy() + LENGTH - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            begins = gone & ~np.append(False, gone[:-1])
            begins[bounds[:-1][bounds[:-1] < len(data)]] |= gone[bounds[:-1][bounds[:-1] < len(data)]]
            removed, spans, digest = [], [], []
            for i in range(b - a):
                x, g = data[bounds[i] : bounds[i + 1]], gone[bounds[i] : bounds[i + 1]]
                n = int(g.sum())
                removed.append(n)
                spans.append(int(begins[bounds[i] : bounds[i + 1]].sum()))
                digest.append(hashlib.sha256((x[~g] if n else x).tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_runs(docs: DataFrame) -> DataFrame:
    """(key, runs): for each document (key, text) that repeats something, its runs (a, n) of repeated windows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.filter(F.octet_length("text") >= LENGTH)
    windows = texts.agg(F.sum(F.octet_length("text") - LENGTH + 1)).first()[0] or 0
    records = windows * 2 * RECORD.itemsize // (LENGTH - GRAM + 1)  # a block has half a span of windows on average
    blocks = materialize(block_records(texts, max(least, records // RECORD_BYTES)), "blocks")
    n = {r["kind"]: (r["blocks"], r["windows"]) for r in blocks.groupBy("kind").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("windows")).collect()}  # three rows at most
    cold, hot = n.get(BLOCKS, (0, 0)), n.get(HOTS, (0, 0))
    buckets = max(least, (cold[0] * (LENGTH - 1 + SENT.itemsize) + cold[1]) // BUCKET_BYTES)
    own = blocks.filter(F.col("kind") != RUNS).groupBy("key").agg(F.collect_list(F.struct("kind", "h", "a", "n")).alias("blocks"))
    rows = _few(texts, own.select("key"))[0].join(own, "key").select("key", "text", "blocks")
    sent = sent_blocks(rows, buckets, max(1, hot[1] * RECORD.itemsize // HOT_BYTES))
    # an explicit number of partitions: the blocks are few bytes and much work, so they must not be coalesced by size
    later = sent.repartition(min(buckets, 4 * least), "bucket").groupBy("bucket").applyInArrow(lambda t: _removals(t), "key long, a int, n int")
    runs = later.union(blocks.filter(F.col("kind") == RUNS).select("key", "a", "n"))
    return materialize(runs.groupBy("key").agg(F.collect_list(F.struct("a", "n")).alias("runs")), "runs")


def _few(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``docs`` of the ``keys`` and the others, found by broadcast; all and none where the keys are too many for that."""
    if keys.count() > BROADCAST_KEYS:
        return docs, None
    return docs.join(F.broadcast(keys), "key", "left_semi"), docs.join(F.broadcast(keys), "key", "left_anti")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``."""
    docs = keyed(docs.select("doc_id", "text"))
    texts = docs.select("key", "text")
    runs = removed_runs(texts)
    some, others = _few(texts, runs.select("key"))
    if others is None:
        with_runs = texts.join(runs, "key", "left").withColumn("runs", F.coalesce("runs", F.expr("array()").cast("array<struct<a:int,n:int>>")))
        found = with_runs.select("key", "text", "runs").mapInArrow(_kept, RESULT)
    else:
        found = some.join(runs, "key").select("key", "text", "runs").mapInArrow(_kept, RESULT).union(others.select("key", "text").mapInArrow(_kept, RESULT))
    ids = docs.schema["doc_id"].dataType
    if "key" in docs.columns and _is_own_key(docs):
        return found.withColumn("doc_id", F.col("key").cast(ids)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return found.join(docs.select("key", "doc_id"), "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _is_own_key(docs: DataFrame) -> bool:
    return not docs.filter(~F.col("doc_id").eqNullSafe(F.col("key"))).take(1)


def op5_exactdup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
