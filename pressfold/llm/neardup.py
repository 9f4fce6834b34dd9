"""Near-duplicate documents by MinHash: fast similarity sketching, banding, exact verification.

1. A text's set holds the 64-bit hashes of its distinct five-word shingles. Its sketch has
   ``BINS`` coordinates. In round i < BINS every shingle is thrown into a random bin
   with the value (i, hash); in round BINS + i all go to bin i. The smallest value
   of a bin stays and a text leaves the rounds once its bins are full, at the latest in the last one.
2. Equal sets collapse to the document with the smallest id; only these go on.
3. ``BANDS`` bands of ``BINS / BANDS`` coordinates are the bucket keys: a pair at
   similarity 0.75 shares none with probability 5e-6.
4. Buckets never expand into all pairs. Each has a seeded hub (another one in each band), and its members
   are held against the hub, those with most shared bands first. Members in one component
   need no further link. While many pairs of one bucket are in different components and hubs still find links, further hubs
   follow, by turns the member with the largest buckets and a random one (``ROUNDS`` of them at most). At last, and however
   the rounds end, an exact prefix
   filter (see :func:`prefix_pairs`) finds, among all documents of buckets that still hold several
   components, every pair that can be similar enough, so no candidate is lost.
5. Every link is confirmed on the full sets.

Edge cases: a text that is null or without words has the empty set, is linked with nothing and kept;
rows that share a doc_id, and rows with a null one, are separate documents
(``component_id`` is the smallest doc_id, null only if the component has no other);
exact copies and repeated rows are one class; an empty table gives an empty
result; extra columns are ignored by :func:`near_duplicates` and kept by :func:`keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from pressfold.llm import textvec as tv
from pressfold.llm.common import bounded_batches, keyed, materialize, table
from pressfold.llm.graph import components

WORDS = 5
BINS = 128
BANDS = 32
PERCENT = 75

#: Links of a document with the hubs of its buckets that are confirmed first.
FIRST_LINKS = 2

#: More rounds of hubs follow while the buckets hold more pairs across components than so many a row ...
LEFT_PAIRS = 2

#: ... and the last round confirmed more than one of so many pairs, but so many rounds at most.
FEW_LINKS = 50
ROUNDS = 12

#: Keys (8 bytes each) that may be broadcast to select rows.
BROADCAST_KEYS = 1 << 20

#: Counters that order shingles by rarity.
SLOTS = 1 << 18

U64 = np.uint64
FULL = U64(2**64 - 1)
BIN_BITS = BINS.bit_length() - 1

SIGNATURE = "key long, n_shingles long, f1 long, f2 long, bands array<long>"


def shingle_sets(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes, bounds) of runs of rows."""
    for a, b, data, bounds in tv.text_chunks(col):
        words, first = tv.word_hashes(data, bounds)
        grams, cut = tv.gram_hashes(words, first, WORDS, whole=True)
        yield a, b, *tv.distinct_sorted(grams, cut)


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of BINS values for each set; rows of empty sets stay at the maximum."""
    n = len(first) - 1
    out = np.full((n, BINS), FULL, np.uint64)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(n), np.diff(first))
    todo = np.flatnonzero(np.diff(first))
    for i in range(2 * BINS):
        if not len(todo):
            break
        if i:
            keep = np.isin(doc, todo, assume_unique=False) if len(todo) < n else slice(None)
            h, doc = h[keep], doc[keep]
        v = tv.mix(h + U64((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
        at = v & U64(BINS - 1) if i < BINS else np.full(len(v), i - BINS, np.uint64)
        np.minimum.at(flat, doc * BINS + at.astype(np.int64), (v >> U64(8)) | U64(i << 56))
        todo = todo[(out[todo] == FULL).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    parts = sketch.reshape(len(sketch), BANDS, BINS // BANDS)
    key = np.zeros(parts.shape[:2], np.uint64)
    for k in range(parts.shape[2]):
        key = tv.mix(key * U64(tv.BASE) + parts[:, :, k])
    return tv.mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * U64(0xD1B54A32D192ED03))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key")
        for a, b, h, first in shingle_sets(batch.column("text")):
            n = np.diff(first)
            total = lambda v: (lambda run: (run[first[1:]] - run[first[:-1]]).view(np.int64))(np.concatenate([[U64(0)], np.cumsum(v, dtype=np.uint64)]))  # noqa: B023, E731
            bands = band_keys(sketches(h, first)).view(np.int64)
            has = np.where(n > 0, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [keys.slice(a, b - a), pa.array(n), pa.array(total(tv.mix(h + U64(1)))), pa.array(total(tv.mix(h + U64(2)))), tv.list_column(bands[n > 0].reshape(-1), np.concatenate([[0], np.cumsum(has)]), pa.int64())],
                ["key", "n_shingles", "f1", "f2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("key")
        for a, b, h, first in shingle_sets(batch.column("text")):
            yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), tv.list_column(h.view(np.int64), first, pa.int64())], ["key", "shingles"])


def _size_fits(x: Column, y: Column) -> Column:
    """Sets whose sizes differ by more cannot reach the similarity."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * PERCENT


def restricted(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The ``rows`` whose key is among ``keys``; keys are broadcast up to BROADCAST_KEYS, else both sides are shuffled."""
    keys = keys.distinct()
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose full sets are similar enough. ``sets``: key, shingles."""
    own = restricted(sets, pairs.select(F.col("a").alias("key")).union(pairs.select("b")))
    both = pairs.join(own.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(own.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.withColumn("i", F.size(F.array_intersect("x", "y")))
    return materialize(both.filter(F.col("i") * 100 >= (F.size("x") + F.size("y") - F.col("i")) * PERCENT).select("a", "b"), "confirmed")


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        h = batch.column("shingles").flatten().to_numpy().view(np.uint64)
        total += np.bincount((h % U64(SLOTS)).astype(np.int64), minlength=SLOTS)
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(total[slot])], ["slot", "c"])


def prefix_pairs(open_keys: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs (a, b) of ``open_keys`` (key, n, comp) in different components that can be similar enough.

    With the shingles of every set in one order, rare ones first, two similar sets share
    one in their prefixes, and behind it enough shingles remain in both. Rarity comes from SLOTS
    counters (any order is right; a good one leaves few pairs): edits that no other text
    has come first. Of two sets the smaller one needs to show only the shorter prefix that a partner of at least its own size
    asks for, so members of a large family (a filled-in form, say) that differ too much never meet.
    """
    spark = sets.sparkSession
    rows = restricted(sets, open_keys.select("key"))
    counts = np.zeros(SLOTS, np.int64)
    for r in rows.mapInArrow(_slot_counts, "slot int, c long").groupBy("slot").agg(F.sum("c").alias("c")).toLocalIterator():
        counts[r["slot"]] = r["c"]
    shared = spark.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            col = batch.column("shingles")
            h, first = col.flatten().to_numpy().view(np.uint64), col.offsets.to_numpy().astype(np.int64) - col.offsets[0].as_py()
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((h, counts[(h % U64(SLOTS)).astype(np.int64)], doc))
            keep = n - (n * PERCENT + 99) // 100 + 1
            at = np.arange(len(h)) - first[:-1][doc] < keep[doc]
            yield pa.RecordBatch.from_arrays([batch.column("key"), tv.list_column(h[order][at].view(np.int64), np.concatenate([[0], np.cumsum(keep)]), pa.int64())], ["key", "prefix"])

    e = rows.mapInArrow(prefixes, "key long, prefix array<long>").join(open_keys, "key").select("key", "n", "comp", F.posexplode("prefix").alias("pos", "shingle"))
    crossing = e.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("shingle")
    e = materialize(e.join(crossing, "shingle"), "prefixes")
    side = lambda s, e: e.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("key", "n", "comp", "pos")])
    short = (F.col("n") - F.col("pos")) * (100 + PERCENT) >= F.col("n") * 2 * PERCENT
    room = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("key_a") < F.col("key_b")))
    near = smaller & (F.col("comp_a") != F.col("comp_b")) & (room * (100 + PERCENT) >= (F.col("n_a") + F.col("n_b")) * PERCENT)
    found = side("a", e.filter(short)).join(side("b", e), "shingle").filter(near & _size_fits(F.col("n_a"), F.col("n_b")))
    return _ordered(found.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` is (key, text). Returns the signature rows and (key of a class representative, comp)."""
    bounded_batches(docs.sparkSession)
    sig = materialize(docs.mapInArrow(_signatures, SIGNATURE), "signatures")
    firsts = sig.filter("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("key").alias("rep"))
    members = materialize(sig.filter("n_shingles > 0").join(firsts, ["f1", "f2", "n_shingles"]).select("key", "rep", "n_shingles", F.expr("IF(key = rep, bands, NULL)").alias("bands")), "members")
    buckets = members.filter("key = rep").select("key", F.col("n_shingles").alias("n"), F.explode("bands").alias("band"))

    mask = F.xxhash64("band")
    hubs = buckets.groupBy("band").agg(F.min(F.col("key").bitwiseXOR(mask)).alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    hubs = materialize(hubs.select("band", "c", F.col("m").bitwiseXOR(mask).alias("hub")), "first-hubs")
    shared = materialize(buckets.join(hubs, "band"), "buckets")  # buckets of at least two sets only
    sets = materialize(restricted(docs, shared.select("key")).mapInArrow(_sets, "key long, shingles array<long>"), "sets")
    sizes = members.filter("key = rep").select(F.col("key").alias("hub"), F.col("n_shingles").alias("n_hub"))
    star = shared.filter("key <> hub").groupBy("key", "n", "hub").agg(F.count(F.lit(1)).alias("c")).join(sizes, "hub").filter(_size_fits(F.col("n"), F.col("n_hub")))
    order = Window.partitionBy("key").orderBy(F.desc("c"), "hub")
    star = materialize(star.select(F.col("key").alias("a"), F.col("hub").alias("b"), F.row_number().over(order).alias("nth")), "star")

    first = star.filter(F.col("nth") <= FIRST_LINKS).select("a", "b")
    comps = components(confirmed(first, sets))
    label = lambda side: comps.select(F.col("key").alias(side), F.col("comp").alias(f"comp_{side}"))
    rest = star.filter(F.col("nth") > FIRST_LINKS).join(label("a"), "a", "left").join(label("b"), "b", "left")
    rest = materialize(rest.filter(F.coalesce("comp_a", "a") != F.coalesce("comp_b", "b")).select("a", "b"), "star-rest")
    comps = components(confirmed(rest, sets), comps)

    tried = _ordered(first.union(rest))
    used = hubs.select("band", F.col("hub").alias("key"))
    most = shared.count() * LEFT_PAIRS
    central = shared.groupBy("key").agg(F.sum("c").alias("score"))
    done, turn = False, 0
    while True:
        now = shared.join(comps, "key", "left").select("band", "key", "n", F.coalesce("comp", "key").alias("comp"))
        parts = now.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"))
        mixed = parts.filter("k > 1").select("band", ((F.col("s") * F.col("s") - F.col("ss")) / 2).alias("pairs"))
        now = materialize(now.join(mixed, "band"), "mixed-buckets")
        left = now.groupBy("band").agg(F.first("pairs").alias("pairs")).agg(F.sum("pairs")).first()[0] or 0
        if left <= most or done or turn == ROUNDS:
            break
        open_keys = now.join(used, ["band", "key"], "left_anti")
        if turn % 2:
            mask = F.xxhash64("band", F.lit(turn))
            next_hub = open_keys.groupBy("band").agg(F.min(F.col("key").bitwiseXOR(mask)).alias("m")).select("band", F.col("m").bitwiseXOR(mask).alias("key"))
        else:
            next_hub = open_keys.join(central, "key").groupBy("band").agg(F.max(F.struct("score", "key")).alias("m")).select("band", "m.key")
        next_hub = materialize(next_hub, "hubs")
        used = used.union(next_hub)
        at_hub = now.join(next_hub, ["band", "key"]).select("band", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
        pairs = now.join(at_hub, "band").filter((F.col("comp") != F.col("comp_b")) & _size_fits(F.col("n"), F.col("n_b")))
        pairs = materialize(_ordered(pairs.select(F.col("key").alias("a"), "b")).distinct().join(tried, ["a", "b"], "left_anti"), "star-pairs")
        links = confirmed(pairs, sets)
        tried = tried.union(pairs)
        done = links.count() * FEW_LINKS <= pairs.count()  # so a round without pairs is the last one
        comps = components(links, comps)
        turn += 1

    pairs = prefix_pairs(now.select("key", "n", "comp").distinct(), sets).join(tried, ["a", "b"], "left_anti")
    comps = components(confirmed(materialize(pairs, "pairs"), sets), comps)
    return sig.select("key", "n_shingles").join(members.select("key", "rep"), "key", "left"), comps


def _keyed_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with the column _key, (_key, n_shingles, comp))."""
    docs = keyed(docs, "_key")
    rows, comps = _classes(docs.select(F.col("_key").alias("key"), "text"))
    found = rows.join(comps.withColumnRenamed("key", "rep"), "rep", "left").select(F.col("key").alias("_key"), "n_shingles", F.coalesce("comp", "rep", "key").alias("comp"))
    return docs, found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    docs, found = _keyed_classes(docs.select("doc_id", "text"))
    found = found.join(docs.select("_key", "doc_id"), "_key").join(docs.select(F.col("_key").alias("comp"), F.col("doc_id").alias("component_id")), "comp")
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has an earlier one."""
    rows, found = _keyed_classes(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")))
    drop = found.filter("_key <> comp").select("_key")
    return rows.join(drop, "_key", "left_anti").select("row.*")


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB: all pairs of different sets that share a shingle, by full sets; components by reachability. For small tables.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
g AS (SELECT k, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
s AS (SELECT DISTINCT k, shingle FROM g),
z AS (SELECT k, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS whole FROM s GROUP BY k),
c AS (SELECT *, min(k) OVER (PARTITION BY whole) AS rep FROM z),
r AS (SELECT s.k, s.shingle, c.n FROM s JOIN c ON s.k = c.rep AND c.k = c.rep),
p AS (SELECT a.k AS x, b.k AS y FROM r a JOIN r b ON a.shingle = b.shingle AND a.k < b.k AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 75
      GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
reach AS (SELECT DISTINCT x AS k, x AS to_k FROM e UNION SELECT reach.k, e.y FROM reach JOIN e ON reach.to_k = e.x),
m AS (SELECT k, min(to_k) AS comp FROM reach GROUP BY k)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, f.doc_id AS component_id, d.doc_id IS NOT DISTINCT FROM f.doc_id AS kept
FROM d LEFT JOIN c ON d.k = c.k LEFT JOIN m ON c.rep = m.k JOIN d f ON f.k = coalesce(m.comp, c.rep, d.k)
"""
