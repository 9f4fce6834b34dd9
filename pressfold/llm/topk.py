"""Exact top-k inner products by aggregation of sorted lists without random access.

Vectors become integers, floor(64 * x). Candidates are dealt into blocks of about
``BLOCK`` rows and queries into blocks of about ``QUERY_BLOCK``; each pair of blocks is a
row of its own, so neither side is ever broadcast or gathered whole.

In a pair of blocks every dimension has one list of the candidates by value, read downward for positive query
components and upward for negative ones. Every query reads its lists in steps (``STEPS`` of a list; equal values are read together), those first whose unread part can
still change most, until a share of all that was open is left (``OPEN``). A candidate's lower bound counts what was read of it and the worst value of the other lists, its upper bound
the last values read there; the sums of all queries of the block are taken at once. A candidate whose upper bound is under the k-th best lower bound cannot qualify. Once
``RESOLVE`` * k candidates are left at most, or the lists have ended, a query stops reading and the scores of these are
resolved; the others read on. Each pair of blocks gives its k best for each query, and a window of k rows a block merges them.

Edge cases: vectors that are null, empty or hold null or non-finite components, and rows
with a null vec_id, take no part; shorter vectors count as filled up with zeros; rows
that share the query's vec_id are its own; each of several query rows with one
vec_id gives its list; ties go to the smaller vec_id; without candidates a query gives no row; components and scores
beyond 64 bits count as the nearest long (such blocks are multiplied out in whole numbers); extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressfold.llm.common import materialize, table

K = 20
BLOCK = 8192
QUERY_BLOCK = 1024

#: Scores are resolved when at most so many candidates for each wanted one are left.
RESOLVE = 4

#: Shares of a list up to which it is read, and shares of the widest bounds at which they are compared.
STEPS = (0.25, 0.5)
OPEN = (0.2, 0.1, 0.05, 0.0)

BLOCK_SCHEMA = "block int, ids binary, dims int, kind string, data binary"


def _packed(group: pa.Table) -> pa.Table:
    """One row for a block: ids in ascending order and the matrix in the narrowest integer type."""
    ids = group.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    lists = group.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    dims = int(size.max(initial=0))
    x = np.zeros((len(ids), dims), np.int64)
    x[np.repeat(np.arange(len(ids)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
    kind = next(k for k in ("int16", "int32", "int64") if not x.size or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max))
    block = group.column("block")[:1]
    return pa.table({"block": block, "ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()), "dims": pa.array([dims], pa.int32()), "kind": [kind], "data": pa.array([x[order].astype(kind).tobytes()], pa.binary())})


def _blocks(vectors: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    n = max(1, -(-vectors.count() // size))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int"))  # repeated rows are spread too
    return materialize(dealt.groupBy("block").applyInArrow(_packed, BLOCK_SCHEMA), name), n


def integers(embedding: Column | str, scale: int = 64) -> Column:
    """floor(scale * x) of each component, null where the vector takes no part."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    e = e.cast("array<double>")
    good = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(e, lambda x: F.floor(x * scale).cast("long")))


def _unpack(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{side}_ids"], np.int64)
    return ids, np.frombuffer(row[f"{side}_data"], row[f"{side}_kind"]).reshape(len(ids), row[f"{side}_dims"])


class Lists:
    """The sorted lists of a block of candidates ``x``, as far as each step reads them."""

    def __init__(self, x: np.ndarray):
        s = np.sort(x, axis=0)
        self.x, self.low, self.high = x, s[0], s[-1]
        n = len(x)
        ends = [max(1, int(n * share)) for share in STEPS]
        self.down, self.up = [s[n - e] for e in ends], [s[e - 1] for e in ends]  # the last values read
        self.read = np.array([0, *ends, n])
        upper, lower = [x], [x]
        for high, low in zip(self.down, self.up, strict=True):
            upper += [np.maximum(x, high), np.minimum(x, low)]
            lower += [np.where(x >= high, x, self.low), np.where(x <= low, x, self.high)]
        self.upper, self.lower = (np.hstack(m).T for m in (upper, lower))

    def gaps(self, q: np.ndarray) -> np.ndarray:
        """(step, query, list): what the list's unread part can still change after each step."""
        pos, neg = np.maximum(q, 0), np.maximum(-q, 0)
        steps = [pos * (self.high - self.low) + neg * (self.high - self.low)]
        steps += [pos * (high - self.low) + neg * (self.high - low) for high, low in zip(self.down, self.up, strict=True)]
        return np.stack([*steps, np.zeros_like(q)])

    def bounds(self, q: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bound of each query and candidate after the queries' ``step`` of each list."""
        pos, neg = np.maximum(q, 0), np.minimum(q, 0)
        parts = [q * (step == len(STEPS) + 1)]
        for k in range(1, len(STEPS) + 1):
            parts += [pos * (step == k), neg * (step == k)]
        weights, shut = np.hstack(parts), step == 0
        least, most = (pos * shut) @ self.low + (neg * shut) @ self.high, (pos * shut) @ self.high + (neg * shut) @ self.low
        return weights @ self.lower + least[:, None], weights @ self.upper + most[:, None]


def survivors(q: np.ndarray, x: np.ndarray, barred: list[slice], k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each query the candidates that may be among its k best, ascending; entries that it read)."""
    lists = Lists(x)
    gaps = lists.gaps(q)
    step = np.zeros(q.shape, np.int64)
    rows, queries = np.arange(len(q)), np.arange(q.shape[1])
    gap = lambda i: gaps[step[i], i[:, None], queries]
    all_open, found = gap(rows).sum(axis=1), [np.empty(0, np.int64)] * len(q)
    for share in OPEN:
        while len(wide := rows[gap(rows).sum(axis=1) > share * all_open[rows]]):  # read on
            g = gap(wide)
            step[wide] += (g * 2 >= g.max(axis=1, keepdims=True)) & (g > 0)
        low, high = lists.bounds(q[rows], step[rows])
        for j, i in enumerate(rows):
            low[j, barred[i]] = high[j, barred[i]] = -np.inf
        left = high >= np.partition(low, len(x) - k, axis=1)[:, len(x) - k, None]
        left &= high > -np.inf
        few = (left.sum(axis=1) <= RESOLVE * k) | (gap(rows).sum(axis=1) == 0)
        for j in np.flatnonzero(few):
            found[rows[j]] = np.flatnonzero(left[j])
        rows = rows[~few]
        if not len(rows):
            break
    return found, lists.read[step].sum(axis=1)


def best_of_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's place, score) of each query's k best of the block; ``ids`` ascend."""
    dims = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) for m in (q, x))
    k = min(k, len(ids))
    # doubles hold all bounds exactly up to 2 ** 53
    small = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(dims, 1) * 4 < 2**53
    q, x = (m.astype(np.float64 if small else object) for m in (q, x))
    barred = [slice(a, b) for a, b in zip(np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right"), strict=True)]
    some = survivors(q, x, barred, k)[0] if small else [np.concatenate([np.arange(b.start), np.arange(b.stop, len(ids))]) for b in barred]
    who, what, scores = [], [], []
    for i, own in enumerate(some):
        score = np.array([*(x[own] @ q[i])], None if small else object)
        take = np.array(sorted(range(len(own)), key=lambda j: -score[j])[:k], np.int64)  # stable: the smaller id first among equals
        who.append(np.full(len(take), i))
        what.append(own[take])
        scores.append(np.clip(score[take], -(2**63), 2**63 - 1).astype(np.int64))
    empty = [np.empty(0, np.int64)]
    return tuple(np.concatenate(part + empty) for part in (who, what, scores))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = 64, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best of all rows but its own."""
    rows = vectors.select("vec_id", integers("embedding", scale).alias("v"), is_query.alias("is_query")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    cands, n_c = _blocks(rows.drop("is_query"), block, "topk-candidates")
    queries, n_q = _blocks(rows.filter("is_query").drop("is_query"), query_block, "topk-queries")
    side = lambda df, s, other, n: df.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "dims", "kind", "data")], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(other))
    parts = min(n_c * n_q, 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = side(queries, "q", "c", n_c).repartition(parts, "q", "c").join(side(cands, "c", "q", n_q).repartition(parts, "q", "c"), ["q", "c"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, q = _unpack(row, "q")
                ids, x = _unpack(row, "c")
                who, what, score = best_of_block(q_ids, q, ids, x, k)
                yield pa.RecordBatch.from_arrays([pa.array((row["q"] << 32) + who), pa.array(q_ids[who]), pa.array(ids[what]), pa.array(score)], ["_query", "query_id", "vec_id", "score"])

    found = pairs.mapInArrow(one, "_query long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = f"""
WITH v AS (SELECT vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
