"""Ball k-means on whole-number vectors, exactly Lloyd's result.

A cluster is a ball: its centroid and a radius. Each round is one pass over blocks of vectors that carry their cluster.
The driver holds k centroids and k radii only. From the distances between centroids it lists each ball's neighbours: those
whose centroid is no farther than twice the radius. A member nearer to its centroid than half the way to the nearest
neighbour lies in the stable core and stays without a comparison. The others lie in annuli between the half distances
to one neighbour and the next, and are compared with the neighbours up to their annulus only. By the triangle
inequality no other centroid can be as near, so every assignment is the exact one, ties included (smaller number).

The pass that assigns also sums members, counts and radii, a few rows for each block, which are all that the update
reads. A radius bounds the next round's ball when the way that its centroid has moved is added, so no further pass
measures it. Each round's blocks are written to the shared folder and the round before is freed: a lost executor repeats
one round's blocks at most. Nothing is shuffled but the sums. Rounds end early when no centroid moves.

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part; a null vec_id
takes part but starts no cluster, unless there are too few others; repeated rows count each; of equal hashes the smaller vector starts
first; with fewer than k vectors there are as many clusters; an empty table gives none; components beyond 64 bits
count as the nearest long, and distances and sums beyond 64 bits are compared exactly but returned as the largest long;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.llm.common import remove, table, written

K = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024
SALT = 3

#: Vectors of one block; about 2 MB of doubles while it is worked on.
BLOCK = 4096

#: Up to this size all sums of squares are whole numbers that a double holds exactly (64 * (2 * 2**22)**2 < 2**53).
SMALL = 1 << 22
LONGEST = (1 << 63) - 1

#: Of each cluster in a block; sums holds the rows, the summed distances, the distances computed and the summed components.
STATS = "array<struct<cluster: int, radius: decimal(38,0), sums: array<decimal(38,0)>>>"
BLOCKS = f"ids array<long>, kind string, data binary, own binary, distance binary, stats {STATS}"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"

Centroids = list[list[int]]
#: Of each ball the squared distances to its neighbours, ascending, and their numbers.
Balls = list[tuple[np.ndarray, list[int]]]


def whole_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors with exactly ``dims`` finite components."""
    e = F.col("embedding").cast("array<double>")
    good = (F.size(e) == dims) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(good, F.transform(e, lambda x: F.floor(x * scale).cast("long"))).alias("v")).filter("v IS NOT NULL")


def _block(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    kind = next(k for k in ("int16", "int32", "int64") if x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max)
    n = len(x)
    none = pa.array([[]], pa.list_(pa.struct([("cluster", pa.int32()), ("radius", pa.decimal128(38)), ("sums", pa.list_(pa.decimal128(38)))])))
    lists = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([lists, pa.array([kind]), pa.array([x.astype(kind).tobytes()], pa.binary()), pa.array([np.zeros(n, np.int32).tobytes()], pa.binary()), pa.array([np.zeros(n, np.int64).tobytes()], pa.binary()), none], ["ids", "kind", "data", "own", "distance", "stats"])


def _packing(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids.append(part.column("vec_id"))
                vectors.append(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                held += part.num_rows
                if held >= BLOCK:
                    yield _block(pa.concat_arrays(ids), np.concatenate(vectors))
                    ids, vectors, held = [], [], 0
        if held:
            yield _block(pa.concat_arrays(ids), np.concatenate(vectors))

    return pack


def neighbours(centroids: Centroids, radii: list[int | None]) -> Balls:
    """Each ball's neighbours within twice its radius (all where it is not known), nearest first."""
    balls = []
    for i, (c, radius) in enumerate(zip(centroids, radii, strict=True)):
        far = sorted((sum((a - b) ** 2 for a, b in zip(c, o, strict=True)), j) for j, o in enumerate(centroids) if j != i)
        near = [(d, j) for d, j in far if radius is None or d <= 4 * radius * radius]
        balls.append((np.array([d for d, _ in near], object), [j for _, j in near]))
    return balls


def reassigned(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances computed) of the members ``x`` of the balls ``own``."""
    measured = lambda rows, j: ((x[rows] - centroids[j]) ** 2).sum(axis=1)
    new, best, compared = own.copy(), np.zeros(len(x), x.dtype), len(x)
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        best[members] = d = measured(members, i)
        gaps, order = balls[i]
        ring = np.searchsorted(gaps.astype(x.dtype), d * 4, side="right")  # 0: stable core; a: compared with a neighbours
        for place, j in enumerate(order):
            out = members[ring > place]
            if not len(out):
                break
            other = measured(out, j)
            compared += len(out)
            better = (other < best[out]) | ((other == best[out]) & (j < new[out]))
            new[out[better]], best[out[better]] = j, other[better]
    return new, best, compared


def _assigning(centroids: Centroids, balls: Balls) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    dims = len(centroids[0])
    widest = max(abs(v) for c in centroids for v in c)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                x = np.frombuffer(row.column("data")[0].as_buffer(), row.column("kind")[0].as_py()).reshape(-1, dims)
                small = max(widest, -int(x.min()), int(x.max())) < SMALL
                x = x.astype(np.float64 if small else object)
                if not small:
                    x = np.frompyfunc(int, 1, 1)(x)
                own, d, compared = reassigned(x, np.frombuffer(row.column("own")[0].as_buffer(), np.int32), np.array(centroids, x.dtype), balls)
                stats = []
                for i in np.unique(own):
                    rows = own == i
                    radius, whole = min(int(d[rows].max()), LONGEST), sum(min(int(v), LONGEST) for v in d[rows])
                    stats.append({"cluster": int(i), "radius": Decimal(radius), "sums": [Decimal(int(v)) for v in (rows.sum(), whole, compared, *x[rows].sum(axis=0))]})
                    compared = 0  # counted once for a block
                capped = np.array([min(int(v), LONGEST) for v in d], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [row.column("ids"), row.column("kind"), row.column("data"), pa.array([own.tobytes()], pa.binary()), pa.array([capped.tobytes()], pa.binary()), pa.array([stats], batch.schema.field("stats").type)],
                    ["ids", "kind", "data", "own", "distance", "stats"],
                )

    return assign


def _summed(blocks: DataFrame) -> dict[int, dict]:
    """Of each cluster n, inertia, compared, radius and the sums of the components: k rows for each of them."""
    each = blocks.select(F.explode("stats").alias("s")).select("s.cluster", "s.radius", F.posexplode("s.sums").alias("dim", "v"))
    found: dict[int, dict] = {}
    for r in each.groupBy("cluster", "dim").agg(F.sum("v").alias("v"), F.max("radius").alias("radius")).collect():
        found.setdefault(r["cluster"], {})[r["dim"]] = (int(r["v"]), int(r["radius"]))
    out = {}
    for i, sums in found.items():
        n, inertia, compared, *rest = [sums[d][0] for d in sorted(sums)]
        out[i] = {"n": n, "inertia": inertia, "compared": compared, "radius": sums[0][1], "sums": rest}
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            own, d = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("own", np.int32), ("distance", np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, pa.array(own), pa.array(d)], ["vec_id", "cluster", "distance"])


def ball_kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: int = SALT, told: list[dict] | None = None) -> DataFrame:
    """One row for each kept vector of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``told`` gets of each round the rows and the distances that it computed, k * rows being what comparing all would take.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors, dims, scale)
    first = kept.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = [[int(v) for v in r["v"]] for r in first]
    blocks, path = written(kept.mapInArrow(_packing(dims), BLOCKS), "kmeans")
    radii: list[int | None] = [None] * len(centroids)
    for step in range(rounds + 1):
        assigned, at = written(blocks.mapInArrow(_assigning(centroids, neighbours(centroids, radii)), BLOCKS), "kmeans")
        remove(spark, path)
        blocks, path, found = assigned, at, _summed(assigned)
        if told is not None:
            told.append({"rows": sum(s["n"] for s in found.values()), "compared": sum(s["compared"] for s in found.values())})
        moved = [[s // found[i]["n"] for s in found[i]["sums"]] if i in found else c for i, c in enumerate(centroids)]
        if step == rounds or moved == centroids:
            break
        ways = [math.isqrt(sum((a - b) ** 2 for a, b in zip(c, m, strict=True))) + 1 for c, m in zip(centroids, moved, strict=True)]
        reach = [int(found[i]["radius"]) if i in found else 0 for i in range(len(centroids))]
        radii = [None if r >= LONGEST else math.isqrt(r) + 1 + way for r, way in zip(reach, ways, strict=True)]
        centroids = moved
    total = min(sum(int(s["inertia"]) for s in found.values()), LONGEST)
    ends = [(i, min(int(s["inertia"]), LONGEST), total, hashlib.sha256(",".join(map(str, centroids[i])).encode()).hexdigest()) for i, s in found.items()]
    ends = spark.createDataFrame(ends, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    rows = blocks.select("ids", "own", "distance").mapInArrow(_rows, "vec_id long, cluster int, distance long")
    return rows.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(table(spark, sf_dir, "embeddings"))


def oracle_sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: int = SALT) -> str:
    """DuckDB SQL: every vector with every centroid, round by round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
d{r} AS MATERIALIZED (SELECT row, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM kept, c{r}),
a{r} AS MATERIALIZED (SELECT row, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{r} GROUP BY row)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, {dims + 1})) AS i FROM kept JOIN a{r} USING (row)) GROUP BY ALL),
n{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM m{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (SELECT cluster, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (cluster))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{salt}:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS cluster, v AS c FROM kept QUALIFY cluster < {k}),{",".join(steps)}
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(list_aggregate(c, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (row) JOIN c{rounds} USING (cluster)
"""


ORACLE_SQL = oracle_sql()
