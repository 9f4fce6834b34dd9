"""Curve search against brute force: recall, exact scores, ties and awkward rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pressfold.llm import curves

SCHEMA = "vec_id long, embedding array<float>, uid string"


def brute(rows, k, is_query):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dims = max(len(v) for _, v in good)
    good = list({(i, tuple(v)): (i, np.pad(v, (0, dims - len(v)))) for i, v in good}.values())
    x = np.array([v for _, v in good])
    out = {}
    for j, (q, v) in enumerate(good):
        if is_query(q):
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            out.setdefault(q, []).append(sorted((d[i], good[i][0]) for i in range(len(good)) if i != j)[:k])
    return out


def found(frame, k=10, every=10, **rest):
    got = {}
    for r in curves.neighbours(frame, F.col("vec_id") % every == 0, k=k, **rest).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: [(s, i) for _, s, i in sorted(v)] for q, v in got.items()}


@pytest.mark.parametrize(("axes", "bits"), [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_hilbert_visits_neighbouring_cells(axes, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    place = curves.hilbert(grid, bits)
    assert sorted(place) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_clusters_need_narrow_windows(spark, monkeypatch):
    monkeypatch.setattr(curves, "BLOCK", 64)
    monkeypatch.setattr(curves, "CHUNK", 8)
    rnd = np.random.default_rng(5)
    centres = rnd.standard_normal((150, 16))
    x = (centres[rnd.integers(0, 150, 4000)] + 0.05 * rnd.standard_normal((4000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    told = []
    got = found(spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(4), told=told)
    want = {q: v[0] for q, v in brute(rows, 10, lambda i: i % 10 == 0).items()}
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    recall = np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 10 for q in want])
    assert recall >= 0.9 and told[0]["curves"] >= 2 and told[0]["window"] * 2 * told[0]["curves"] < 0.5 * told[0]["heads"]
    for q, best in got.items():  # every score is the exact distance
        for s, i in best:
            assert s == pytest.approx(np.sqrt(((x[q].astype(float) - x[i]) ** 2).sum()), rel=1e-12)
        assert best == sorted(best)


def test_exact_within_one_window(spark):
    rnd = random.Random(8)
    made = [(i, [float(rnd.randrange(-2, 3)) for _ in range(3)]) for i in range(200)]
    made += [(1000 + i, [0.5, 0.25, 1.0]) for i in range(300)] + [made[10]] * 5 + [(10, [9.0, 9.0, 9.0]), (20, [1.0, 2.0])]
    made += [(None, [1.0, 1.0, 1.0]), (30, None), (40, []), (50, [0.0, 0.0, 0.0]), (60, [1.0, None, 2.0]), (70, [math.nan, 1.0, 1.0]), (80, [math.inf, 1.0, 1.0])]
    made += [(90, [1e30, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in made], SCHEMA).repartition(4)
    f32 = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in made]
    got = curves.neighbours(frame, F.col("vec_id") % 10 == 0, k=10, target=1.0).collect()
    want = brute(f32, 10, lambda i: i % 10 == 0)
    lists = {}
    for r in got:
        lists.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    flat = {q: sorted((n + 1, s, i) for best in v for n, (s, i) in enumerate(best)) for q, v in want.items()}
    assert {q: [(n, i) for n, _, i in sorted(v)] for q, v in lists.items()} == {q: [(n, i) for n, _, i in v] for q, v in flat.items()}
    for q in lists:
        assert [s for _, s, _ in sorted(lists[q])] == pytest.approx([s for _, s, _ in flat[q]], rel=1e-12)


def test_few_rows(spark):
    assert curves.neighbours(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0], "")], SCHEMA)
    assert curves.neighbours(one, F.lit(True)).count() == 0
    three = spark.createDataFrame([(0, [1.0, 2.0], ""), (1, [1.0, 2.0], ""), (2, [1.0, 4.0], "")], "vec_id long, embedding array<double>, uid string")
    got = sorted(map(tuple, curves.neighbours(three, F.col("vec_id") != 1).collect()))
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 2.0), (2, 1, 0, 2.0), (2, 2, 1, 2.0)]
