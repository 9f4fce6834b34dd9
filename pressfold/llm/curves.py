"""Approximate nearest neighbours along several shifted Hilbert curves.

Equal vectors become one head with its k + 1 smallest ids, so a crowd of copies is one entry and ties among
copies are exact. Each curve projects the heads on ``AXES`` random orthogonal directions, puts them on a grid that is shifted
by a random offset and orders them by their place on a Hilbert curve; Spark range-partitions that order. Position
windows of +-W around the queries are cut into blocks: a chunk of neighbouring queries meets each block of its window in a row of its own, is
ranked exactly in double precision there and gives its k + 1 nearest. The curves' lists merge, and the heads' ids are put in.

How wide a window has to be depends on the data: vectors in clusters need narrow ones, vectors without structure in many
dimensions need nearly all rows, whatever the index. So W is measured: for at most ``SAMPLE`` queries (smallest hashes) the exact neighbours are found by
one pass over all rows, their positions on every curve by a second, and ``plan`` takes the number of curves and the W that reach
``TARGET`` of these neighbours at the least work. Nothing caps W; with W as large as the table the search is exact. Only that sample, its
neighbours and one number for each partition reach the driver. Curves are worked on one after the other, and each frees its blocks.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; shorter
vectors count as filled up with zeros; rows repeated with id and vector count once; another vector with the query's id is a row of its own;
each of several query rows with one id gives its list; ties go to the smaller vec_id; fewer candidates give fewer rows, none give none; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressfold.llm.common import materialize, remove, table, written

K = 10
CURVES = 4
AXES = 10
BITS = 5  # of the grid; the shift adds one
SEED = 11
SAMPLE = 64
TARGET = 0.96

#: Heads of one block, and queries of one chunk.
BLOCK = 4096
CHUNK = 1024
SLICE = 256
#: Queries whose lists a task holds before it gives them.
HELD = 1 << 16

PACKED = "kind string, part int, low long, high long, uids binary, dims int, data binary, ids array<array<long>>"
FOUND = "query long, uid long, score double, ids array<long>"


def heads_of(rows: DataFrame, k: int) -> DataFrame:
    """(uid, v, ids, asked): each different vector of ``rows`` (vec_id, v, is_query) with its k + 1 smallest ids, and whether a query has it."""
    if rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").take(1):
        rows = rows.groupBy("vec_id", "v").agg(F.max("is_query").alias("is_query"))
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.select("vec_id", "v").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)  # limited before the shuffle, too
    heads = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter("is_query").select("v").distinct().withColumn("asked", F.lit(True))
    return heads.join(asked, "v", "left").select(F.monotonically_increasing_id().alias("uid"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column, filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == dims).all():
        return flat.reshape(-1, dims)
    x = np.zeros((len(size), dims), flat.dtype)
    x[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat
    return x


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of grid points (rows, axes) of ``bits`` bits each; axes * bits < 64."""
    x, axes = [c.astype(np.int64) for c in x.T], x.shape[1]
    for bit in range(bits - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i in range(axes):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[i] = x[i] ^ swap
            x[0] = x[0] ^ np.where(turned, p, swap if i else 0)
    for i in range(1, axes):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        t ^= np.where(x[-1] & (1 << bit), (1 << bit) - 1, 0)
    place = np.zeros_like(t)
    for bit in range(bits - 1, -1, -1):
        for c in x:
            place = (place << 1) | (((c ^ t) >> bit) & 1)
    return place


@dataclass
class Curve:
    """A projection, a grid and its shift."""

    axes: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    shift: np.ndarray

    def keys(self, x: np.ndarray) -> np.ndarray:
        p = np.clip((x.astype(np.float64) @ self.axes - self.mean) / self.spread, -4, 4)
        cells = np.minimum(((p + 4) * (1 << BITS) / 8).astype(np.int64), (1 << BITS) - 1)
        return hilbert(cells + self.shift, BITS + 1)


def directions(dims: int, curves: int, seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray]]:
    """(orthogonal directions, shift) of each curve."""
    rnd = np.random.default_rng(seed)
    return [(np.linalg.qr(rnd.standard_normal((dims, min(AXES, dims))))[0], rnd.integers(0, 1 << BITS, min(AXES, dims))) for _ in range(curves)]


def curves_of(heads: DataFrame, dims: int, curves: int, seed: int = SEED) -> list[Curve]:
    """Curves whose grids span four deviations around the mean of all heads."""
    made = directions(dims, curves, seed)
    every = np.hstack([a for a, _ in made])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * every.shape[1])
        for batch in batches:
            p = matrix(batch.column("v"), dims).astype(np.float64) @ every
            total += np.concatenate([[len(p)], p.sum(axis=0), (p * p).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["sums"])

    sums = heads.select("v").mapInArrow(moments, "sums array<double>").select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s"))
    n, *rest = [r["s"] for r in sums.orderBy("i").collect()]
    first, second = np.array(rest).reshape(2, -1) / max(n, 1)
    spread = np.sqrt(np.maximum(second - first * first, 0))
    spread[~(spread > 0) | ~np.isfinite(spread)] = 1
    first = np.nan_to_num(first)
    at = np.cumsum([0] + [a.shape[1] for a, _ in made])
    return [Curve(a, first[at[i] : at[i + 1]], spread[at[i] : at[i + 1]], s) for i, (a, s) in enumerate(made)]


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of one vector to the rows of ``x``, in doubles; very large components are scaled first."""
    gap = np.abs(x.astype(np.float64) - q.astype(np.float64))
    top = gap.max(initial=0)
    if top > 1e150:
        return np.sqrt(((gap / top) ** 2).sum(axis=1)) * top
    return np.sqrt((gap * gap).sum(axis=1))


def nearest(q: np.ndarray, x: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query its k nearest rows of ``x`` and their distances; ties go to the smaller ``first``."""
    wide = x.astype(np.float64)
    own = (wide * wide).sum(axis=1)
    for at in range(0, len(q), SLICE):
        part = q[at : at + SLICE].astype(np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            about = (part * part).sum(axis=1)[:, None] + own - 2 * (part @ wide.T)
            some = np.partition(about, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(part), np.inf)
            slack = 1e-9 * ((part * part).sum(axis=1) + own.max(initial=0))  # far above what rounding changes
        for i in range(len(part)):
            limit = some[i] + slack[i]
            rows = np.flatnonzero(about[i] <= limit) if np.isfinite(limit) else np.arange(len(x))
            d = distances(q[at + i], x[rows])
            best = np.lexsort((first[rows], d))[:k]
            yield rows[best], d[best]


def sampled(heads: DataFrame, dims: int, k: int) -> list[tuple[int, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """(uid, vector, its nearest heads) of at most SAMPLE query heads, by one pass over all heads."""
    some = heads.filter("asked").orderBy(F.xxhash64("v"), "uid").limit(SAMPLE).select("uid", "v").collect()
    q = np.array([np.pad(np.array(r["v"], np.float64), (0, dims - len(r["v"]))) for r in some])
    uids = np.array([r["uid"] for r in some], np.int64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[tuple[float, int, np.ndarray]]] = [[] for _ in q]
        for batch in batches:
            x, ids = matrix(batch.column("v"), dims), batch.column("uid").to_numpy()
            for i, (rows, d) in enumerate(nearest(q, x, ids, k + 1)):
                merged = kept[i] + [(float(e), int(ids[r]), x[r].astype(np.float64)) for r, e in zip(rows, d, strict=True)]
                kept[i] = sorted(merged, key=lambda t: t[:2])[: k + 1]
        flat = [(i, d, u, v) for i, row in enumerate(kept) for d, u, v in row]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], pa.float64()), pa.array([r[2] for r in flat], pa.int64()), pa.array([r[3] for r in flat], pa.list_(pa.float64()))], ["i", "d", "uid", "v"])

    order = Window.partitionBy("i").orderBy("d", "uid")
    found = heads.select("uid", "v").mapInArrow(best, "i int, d double, uid long, v array<double>").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).collect()  # SAMPLE * (k + 1) rows
    near: list[list[tuple[int, np.ndarray]]] = [[] for _ in some]
    for r in found:
        if r["uid"] != uids[r["i"]]:
            near[r["i"]].append((r["uid"], np.array(r["v"])))
    return [(int(u), v, n) for u, v, n in zip(uids, q, near, strict=True)]


def _codes(keys: np.ndarray, uids: np.ndarray) -> np.ndarray:
    """Sixteen bytes that ascend with (key, uid)."""
    pair = np.empty((len(keys), 2), ">u8")
    pair[:, 0], pair[:, 1] = keys, uids
    return pair.view("S16").ravel()


def plan(heads: DataFrame, dims: int, curves: list[Curve], k: int, target: float = TARGET) -> tuple[int, int]:
    """(curves to use, W): the least work that reaches ``target`` of the sampled queries' neighbours."""
    sample = sampled(heads, dims, k)
    points = {u: v for q, vector, near in sample for u, v in [(q, vector), *near]}
    if not any(near for *_, near in sample):
        return min(2, len(curves)), 0
    uids, x = np.array(list(points), np.int64), np.array(list(points.values()))
    codes = [_codes(c.keys(x), uids) for c in curves]
    bounds = [np.sort(c) for c in codes]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(curves), len(uids) + 1), np.int64)
        for batch in batches:
            v, ids = matrix(batch.column("v"), dims), batch.column("uid").to_numpy()
            for i, c in enumerate(curves):
                counts[i] += np.bincount(np.searchsorted(bounds[i], _codes(c.keys(v), ids), side="right"), minlength=len(uids) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([counts.ravel()])], ["counts"])

    sums = heads.select("uid", "v").mapInArrow(tally, "counts array<long>").select(F.posexplode("counts").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    counts = np.zeros(len(curves) * (len(uids) + 1), np.int64)
    for r in sums:
        counts[r["i"]] = r["s"]
    ahead = np.cumsum(counts.reshape(len(curves), -1), axis=1)  # rows before each of the sorted points
    place = [dict(zip(uids.tolist(), ahead[i][np.searchsorted(bounds[i], codes[i])].tolist(), strict=True)) for i in range(len(curves))]
    gaps = np.array([[abs(p[q] - p[u]) for p in place] for q, _, near in sample for u, _ in near])
    choices = []
    for n in range(min(2, len(curves)), len(curves) + 1):
        wide = int(np.quantile(gaps[:, :n].min(axis=1), target, method="higher"))
        choices.append((n * max(wide, 1), n, wide))
    return min(choices)[1:]


def _packing(curve: Curve, dims: int, wide: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of consecutive heads, and chunks of the queries among them that span max(BLOCK, W) heads at most."""
    span = max(BLOCK, wide)

    def row(kind: str, part: int, low: int, high: int, uids: list, vectors: list, ids: list | None) -> pa.RecordBatch:
        lists = pa.array([None if ids is None else ids], pa.list_(pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(
            [pa.array([kind]), pa.array([part], pa.int32()), pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([np.array(uids, np.int64).tobytes()], pa.binary()), pa.array([dims], pa.int32()), pa.array([np.array(vectors).tobytes()], pa.binary()), lists],
            ["kind", "part", "low", "high", "uids", "dims", "data", "ids"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, None
        block: tuple[list, list, list] = ([], [], [])
        chunk: tuple[list, list, list] = ([], [], [])  # places, uids, vectors
        for batch in batches:
            x, uids, asked, ids = matrix(batch.column("v"), dims), batch.column("uid").to_pylist(), batch.column("asked").to_pylist(), batch.column("ids").to_pylist()
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for i in range(batch.num_rows):
                for held, value in zip(block, (uids[i], x[i], ids[i]), strict=True):
                    held.append(value)
                if asked[i]:
                    if chunk[0] and (len(chunk[0]) >= CHUNK or at - chunk[0][0] >= span):
                        yield row("query", part, chunk[0][0], chunk[0][-1], *chunk[1:], None)
                        chunk = ([], [], [])
                    for held, value in zip(chunk, (at, uids[i], x[i]), strict=True):
                        held.append(value)
                at += 1
                if len(block[0]) == BLOCK:
                    yield row("data", part, at - BLOCK, at - 1, *block)
                    block = ([], [], [])
        if block[0]:
            yield row("data", part, at - len(block[0]), at - 1, *block)
        if chunk[0]:
            yield row("query", part, chunk[0][0], chunk[0][-1], *chunk[1:], None)

    return pack


def _best(who: np.ndarray, score: np.ndarray, first: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each ``who``."""
    order = np.lexsort((uid, first, score, who))
    sizes = np.bincount(who)
    return order[np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k]


def _ranking(k: int, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ranks each chunk of queries in each of its blocks; the blocks that meet in one task give one list for each query."""

    def merged(held: dict[bytes, list]) -> Iterator[pa.RecordBatch]:
        for key, (who, uid, score, _, ids) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(key, np.int64)[who]), pa.array(uid), pa.array(score), ids], ["query", "uid", "score", "ids"])
        held.clear()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        for batch in batches:
            for j in range(batch.num_rows):
                raw = lambda c, j=j, batch=batch: batch.column(c)[j].as_buffer()
                dims, key = batch.column("dims")[j].as_py(), raw("q_uids").to_pybytes()
                uids = np.frombuffer(raw("uids"), np.int64)
                q, x = np.frombuffer(raw("q_data"), kind).reshape(-1, dims), np.frombuffer(raw("data"), kind).reshape(-1, dims)
                ids = batch.column("ids")[j].values
                first = ids.values.to_numpy().take(ids.offsets.to_numpy()[:-1])
                lists = list(nearest(q, x, first, k + 1))
                rows = np.concatenate([r for r, _ in lists])
                found = [np.repeat(np.arange(len(lists)), [len(r) for r, _ in lists]), uids[rows], np.concatenate([d for _, d in lists]), first[rows], ids.take(pa.array(rows))]
                if key in held:
                    both = [np.concatenate(c) for c in zip(held[key][:4], found[:4], strict=True)]
                    keep = _best(both[0], both[2], both[3], both[1], k + 1)
                    found = [*(c[keep] for c in both), pa.concat_arrays([held[key][4], found[4]]).take(pa.array(keep))]
                held[key] = found
                if len(held) * CHUNK > HELD:
                    yield from merged(held)
        yield from merged(held)

    return rank


def along(heads: DataFrame, curve: Curve, dims: int, wide: int, k: int) -> DataFrame:
    """(query, uid, score, ids): each query head's k + 1 nearest heads in its window of one curve."""
    spark = heads.sparkSession
    kind = "float32" if dict(heads.dtypes)["v"] == "array<float>" else "float64"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(curve.keys(matrix(batch.column("v"), dims))), *batch.columns], ["key", *batch.schema.names])

    placed = heads.mapInArrow(keys, f"key long, {', '.join(f'{c} {t}' for c, t in heads.dtypes)}")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "key", "uid").sortWithinPartitions("key", "uid").withColumn("part", F.spark_partition_id())
    packed, path = written(ordered.select("part", "uid", "v", "ids", "asked").mapInArrow(_packing(curve, dims, wide), PACKED), "curve")
    counts = sorted((r["part"], r["n"]) for r in packed.filter("kind = 'data'").groupBy("part").agg(F.max("high").alias("n")).collect())
    starts, total = [], 0
    for part, high in counts:
        starts.append((part, total))
        total += high + 1
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, start long"))  # one row for each partition
    packed = packed.join(offsets, "part").withColumns({"low": F.col("low") + F.col("start"), "high": F.col("high") + F.col("start")})
    data = packed.filter("kind = 'data'").select((F.col("low") / BLOCK).cast("long").alias("cell"), "low", "high", "uids", "dims", "data", "ids")
    # a block starts in one cell and may end in the next
    cells = F.sequence(F.floor((F.col("low") - wide) / BLOCK) - 1, F.floor((F.col("high") + wide) / BLOCK))
    asked = packed.filter("kind = 'query'").select(F.explode(cells).alias("cell"), F.col("low").alias("q_low"), F.col("high").alias("q_high"), F.col("uids").alias("q_uids"), F.col("data").alias("q_data")).filter("cell >= 0")
    near = asked.join(data, "cell").filter((F.col("low") <= F.col("q_high") + wide) & (F.col("high") >= F.col("q_low") - wide))
    found = near.select("q_uids", "q_data", "uids", "dims", "data", "ids").mapInArrow(_ranking(k, kind), FOUND)
    order = Window.partitionBy("query").orderBy("score", F.col("ids")[0], "uid")
    best = materialize(found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).drop("n"), "nearest")
    remove(spark, path)
    return best


def neighbours(vectors: DataFrame, is_query: Column, k: int = K, curves: int = CURVES, target: float = TARGET, told: list[dict] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest found of all rows (vec_id, embedding) but its own.

    ``told`` gets the number of curves, W and the number of heads.
    """
    spark = vectors.sparkSession
    e = F.col("embedding") if dict(vectors.dtypes)["embedding"] in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    good = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, e).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    heads = materialize(heads_of(rows, k), "heads")
    dims, n = heads.agg(F.max(F.size("v")), F.count(F.lit(1))).first()
    if not n or not heads.filter("asked").take(1):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    made = curves_of(heads, dims, curves)
    used, wide = plan(heads, dims, made, k, target)
    if told is not None:
        told.append({"curves": used, "window": wide, "heads": n})
    lists = None
    for curve in made[:used]:
        found = along(heads, curve, dims, wide, k)
        lists = found if lists is None else lists.unionByName(found)
    order = Window.partitionBy("query").orderBy("score", F.col("ids")[0], "uid")
    lists = lists.withColumn("n", F.dense_rank().over(order)).filter(F.col("n") <= k + 1).dropDuplicates(["query", "uid"])  # one head may come along several curves
    asked = rows.filter("is_query").select(F.col("vec_id").alias("query_id"), "v").distinct()
    asked = asked.join(heads.filter("asked").select("v", F.col("uid").alias("query")), "v").select("query_id", "query")
    each = asked.join(lists, "query").select("query_id", "query", "score", (F.col("query") == F.col("uid")).alias("own"), F.explode("ids").alias("vec_id"))
    each = each.filter(~F.col("own") | (F.col("vec_id") != F.col("query_id")))
    best = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query").orderBy("score", "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
