"""Exact nearest vectors by cosine, without comparing what cannot be near.

Vectors gather in cells around pivots (of the candidates with the smallest hashes those that lie farthest apart). A cell's radius is the largest angle to its pivot. By the
triangle inequality of angles two cells can hold vectors within the wanted angle only if their pivots are no farther apart than both radii
and that angle. Within a cell vectors are packed into blocks in the order of ids, each with the range of its angles and ids, which rule out further pairs of
blocks; where only earlier candidates count, half of the pairs go at once. If cells rule out less than half of their pairs, as for vectors
without clusters, there is one cell only and ids alone decide.

Only those candidates (``CELLS`` * ``PER_PIVOT``), radii and the pairs of cells (at most ``CELLS`` ** 2) reach the driver. Each pair of blocks is multiplied in a row of its own,
a strip of it at a time, so a task holds two blocks and ``CELLS_OF_PRODUCT`` cosines whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressfold.session import durable

#: About so many blocks of a table, and the fewest and most vectors of one. What is sent is a multiple of the table by the number of its blocks.
SPLIT = 16
LEAST_BLOCK = 1024
MOST_BLOCK = 65536
#: Candidates that meet ready-made blocks of queries, at most.
FEW = 4096
#: Cosines that a task holds at once.
CELLS_OF_PRODUCT = 1 << 22
CELLS = 256
#: Candidates of a cell, about, and vectors that each pivot is chosen from.
CELL = 512
PER_PIVOT = 8
#: Cosines are rounded to so many digits before they are compared, so that the shape of a product cannot decide a tie.
DIGITS = 12
SLACK = 1e-6  # radians, far above what rounding changes

BLOCKS = "part int, seq int, cell int, low long, high long, near double, far double, ids binary, wide boolean, m binary"


def _raw(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of its own kind of numbers; shorter ones are filled up with zeros, and nulls are no numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    kind = np.float32 if pa.types.is_float32(flat.type) else np.float64
    x = np.zeros((len(size), int(size.max(initial=0))), kind)
    x[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat.to_numpy(zero_copy_only=False).astype(kind)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; what is no number counts 0."""
    x = np.nan_to_num(x.astype(np.float64))
    scale = np.abs(x).max(axis=1, initial=0.0, keepdims=True)
    x /= np.where(scale > 0, scale, 1)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(_raw(column))


def _padded(x: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, dims - x.shape[1]))))


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    dims = max(x.shape[1], y.shape[1])
    return np.arccos(np.clip(_padded(x, dims) @ _padded(y, dims).T, -1, 1))


def _in_cells(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Vectors (id, v) with their nearest pivot and the angle to it; those without length are left out."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            angles = _angles(x, pivots)
            cell = angles.argmin(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(x)), cell])], ["id", "v", "cell", "angle"])
            yield out.filter(pa.array(np.abs(x).max(axis=1, initial=0.0) > 0))

    kind = dict(vectors.dtypes)["v"]
    return durable(vectors.select("id", "v").filter("id IS NOT NULL AND v IS NOT NULL").mapInArrow(assign, f"id long, v {kind}, cell int, angle double"))


def _packed(placed: DataFrame, block: int, parts: int) -> DataFrame:
    """Blocks of up to ``block`` vectors of one cell, consecutive in ids, out of ``parts`` ranges. They hold vectors as they came."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seq = 0

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            ids, angle, m = t.column("id").to_numpy(), t.column("angle").to_numpy(), _raw(t.column("v"))
            row = [t.column("part")[0].as_py(), seq, t.column("cell")[0].as_py(), int(ids.min()), int(ids.max()), float(angle.min()), float(angle.max()), ids.astype(np.int64).tobytes(), m.dtype == np.float64, m.tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "seq", "cell", "low", "high", "near", "far", "ids", "wide", "m"])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if held and (held[0].column("cell")[0].as_py() != cells[a] or sum(h.num_rows for h in held) >= block):
                        yield flush()
                        held, seq = [], seq + 1
                    n = min(b - a, block - sum(h.num_rows for h in held))
                    held.append(batch.slice(a, n))
                    a += n
        if held:
            yield flush()

    ordered = placed.repartitionByRange(parts, "cell", "id").sortWithinPartitions("cell", "id").withColumn("part", F.spark_partition_id())
    return durable(ordered.mapInArrow(pack, BLOCKS))


def _spread(some: np.ndarray, n: int) -> np.ndarray:
    """Up to n of the vectors, each the farthest from those before it."""
    taken, gap = [0], _angles(some, some[:1])[:, 0]
    while len(taken) < min(n, len(some)):
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, _angles(some, some[taken[-1:]])[:, 0])
    return some[taken]


def _near_cells(pivots: np.ndarray, left: np.ndarray, right: np.ndarray, angle: float) -> list[tuple[int, int, float]]:
    """(cell, other cell, angle of their pivots) of the cells with the radii ``left`` and ``right`` (-1: empty) that can hold vectors within ``angle``."""
    apart = _angles(pivots, pivots)
    near = (apart <= left[:, None] + right[None, :] + angle + SLACK) & (left[:, None] >= 0) & (right[None, :] >= 0)
    return [(int(i), int(j), float(apart[i, j])) for i, j in zip(*np.nonzero(near), strict=True)]


def _radii(placed: DataFrame, n: int) -> np.ndarray:
    out = np.full(n, -1.0)
    for r in placed.groupBy("cell").agg(F.max("angle").alias("far")).collect():
        out[r["cell"]] = r["far"]
    return out


def _sizes(count: int, block: int | None) -> tuple[int, int]:
    """(vectors of a block at most, ranges) for ``count`` vectors; ranges are not quite even."""
    block = block or min(MOST_BLOCK, max(LEAST_BLOCK, -(-count // SPLIT)))
    return block + block // 4, max(1, -(-count // block))


def plain_blocks(vectors: DataFrame, block: int | None = None) -> DataFrame:
    """Vectors (id, embedding) in blocks of one cell, for ``nearest`` with few candidates or many rounds over the same queries."""
    long = F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    rows = vectors.filter(F.col("id").isNotNull() & long).select("id", F.col("embedding").alias("v"), F.lit(0).alias("cell"), F.lit(0.0).cast("double").alias("angle"))
    return _packed(rows, *_sizes(rows.count(), block))


def _ordered_pairs(a: DataFrame, b: DataFrame, earlier: bool) -> DataFrame:
    """All pairs of blocks, but those in which no candidate is earlier."""
    y = b.select(F.col("part").alias("part_y"), F.col("seq").alias("seq_y"), "cell", F.col("low").alias("low_y"))
    pairs = a.select("part", "seq", "cell", "high").join(y, "cell")
    return (pairs.filter("low_y < high") if earlier else pairs).select("part", "seq", "part_y", "seq_y")


def block_pairs(queries: DataFrame, candidates: DataFrame, least: float, earlier: bool = False, block: int | None = None, cells: int = CELLS, per_cell: int = CELL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs of blocks that can hold cosines of at least ``least``, blocks of queries, blocks of candidates)."""
    spark, same = queries.sparkSession, candidates is queries
    queries = queries.select("id", F.col("embedding").alias("v"))
    candidates = queries if same else candidates.select("id", F.col("embedding").alias("v"))
    angle = float(np.arccos(min(1.0, max(-1.0, least)))) + SLACK
    count = candidates.filter("v IS NOT NULL").count()
    wanted = min(cells, max(1, count // per_cell))
    some = candidates.filter("v IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(wanted * PER_PIVOT).select("v").collect()
    vectors = _matrix(pa.array([[float(x or 0) for x in r["v"]] for r in some], pa.list_(pa.float64())))
    vectors = vectors[np.abs(vectors).max(axis=1, initial=0.0) > 0]  # one without length is at a right angle to itself
    pivots = _spread(vectors if len(vectors) else np.ones((1, 1)), wanted)
    right = _in_cells(candidates, pivots)
    left = right if same else _in_cells(queries, pivots)
    near = _near_cells(pivots, _radii(left, len(pivots)), _radii(right, len(pivots)), angle)
    if len(near) * 2 > len(pivots) ** 2:  # cells do not pay
        left, right = (df.withColumns({"cell": F.lit(0), "angle": F.lit(0.0)}) for df in (left, right))
        near = [(0, 0, 0.0)]
        bounded = False
    else:
        bounded = True
    a, b = _packed(left, *_sizes(count if same else left.count(), block)), None
    b = a if same else _packed(right, *_sizes(count, block))
    links = F.broadcast(spark.createDataFrame(near, "cell int, other int, apart double"))
    x = a.select("part", "seq", "cell", "low", "high", "near", "far").join(links, "cell")
    y = b.select(F.col("part").alias("part_y"), F.col("seq").alias("seq_y"), F.col("cell").alias("other"), F.col("low").alias("low_y"), F.col("high").alias("high_y"), F.col("near").alias("near_y"), F.col("far").alias("far_y"))
    pairs = x.join(y, "other")
    if bounded:
        wide = angle + SLACK
        # each block as the other's pivot sees it
        pairs = pairs.filter((F.col("apart") - F.col("far") <= F.col("far_y") + wide) & (F.col("apart") + F.col("far") >= F.col("near_y") - wide) & (F.col("apart") - F.col("far_y") <= F.col("far") + wide) & (F.col("apart") + F.col("far_y") >= F.col("near") - wide))
    if earlier:
        pairs = pairs.filter("low_y < high")
    return pairs.select("part", "seq", "part_y", "seq_y"), a, b


def nearest(queries: DataFrame, candidates: DataFrame, least: float, earlier: bool = False, block: int | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """(id, other, cosine): each query's most similar candidates (all of equals) with a cosine of at least ``least`` and above 0.

    Cosines are rounded to 12 digits. With ``earlier`` only candidates of a smaller id count. Vectors (id, embedding) that are null or without length
    are near to nothing; shorter ones count as filled up with zeros. Up to ``FEW`` candidates meet ``blocks``, the queries' ``plain_blocks``, if these are given.
    """
    if blocks is not None and len(candidates.select("id").head(FEW + 1)) <= FEW:
        a, b = blocks, plain_blocks(candidates, block or FEW)
        pairs = _ordered_pairs(a, b, earlier)
    else:
        pairs, a, b = block_pairs(queries, candidates, least, earlier, block)
    other = b.select(F.col("part").alias("part_y"), F.col("seq").alias("seq_y"), F.col("ids").alias("ids_y"), F.col("wide").alias("wide_y"), F.col("m").alias("m_y"))
    both = pairs.join(a.select("part", "seq", "ids", "wide", "m"), ["part", "seq"]).join(other, ["part_y", "seq_y"])
    both = both.repartition("part", "seq", "part_y", "seq_y")  # else all pairs of one block meet in a task

    def vectors(batch: pa.RecordBatch, k: int, ids: str, wide: str, m: str) -> tuple[np.ndarray, np.ndarray]:
        i = np.frombuffer(batch.column(ids)[k].as_buffer(), np.int64)
        return i, _unit(np.frombuffer(batch.column(m)[k].as_buffer(), np.float64 if batch.column(wide)[k].as_py() else np.float32).reshape(len(i), -1))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                i_a, p = vectors(batch, k, "ids", "wide", "m")
                i_b, q = vectors(batch, k, "ids_y", "wide_y", "m_y")
                dims = max(p.shape[1], q.shape[1])
                p, q = _padded(p, dims), _padded(q, dims).T
                step = max(1, CELLS_OF_PRODUCT // max(1, len(i_b)))
                for at in range(0, len(i_a), step):
                    i_s, s = i_a[at : at + step], p[at : at + step] @ q
                    if earlier and i_b.max() >= i_s.min():
                        s[i_b[None, :] >= i_s[:, None]] = -1.0
                    # rounding keeps the order, so only what is as near as the top can be equal to it
                    top = s.max(axis=1, initial=-1.0)
                    i, j = np.nonzero(s >= np.maximum(top, least)[:, None] - 10.0 ** (1 - DIGITS))
                    found = np.round(s[i, j], DIGITS)
                    kept = (found == np.round(top, DIGITS)[i]) & (found >= least) & (found > 0)
                    yield pa.RecordBatch.from_arrays([pa.array(i_s[i[kept]]), pa.array(i_b[j[kept]]), pa.array(found[kept])], ["id", "other", "cosine"])

    found = durable(both.select("ids", "wide", "m", "ids_y", "wide_y", "m_y").mapInArrow(one, "id long, other long, cosine double"))
    top = found.groupBy("id").agg(F.max("cosine").alias("top"))
    return found.join(top, "id").filter("cosine = top").drop("top")
