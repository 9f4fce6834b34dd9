"""Ball k-means against plain Lloyd rounds in whole numbers."""

import hashlib
import math
import random
from collections import Counter

import pytest

from pressfold.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def lloyd(rows, k, rounds, dims, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: ((0, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), r[1]))
    c = [v for _, v in order[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((d2(v, o), j) for j, o in enumerate(c))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own, strict=True) if o == j] for j in range(len(c))]
        c = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else o for g, o in zip(groups, c, strict=True)]
    end = [(i, *nearest(v)) for i, v in kept]
    cap = lambda x: min(x, 2**63 - 1)
    per = Counter()
    for _, d, j in end:
        per[j] += cap(d)
    return Counter((i, j, cap(d), cap(per[j]), cap(sum(per.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in end)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    made = [(i, [rnd.gauss(x, 0.05) for x in rnd.choice(centres)]) for i in range(600)]
    made += [(700 + i, [float(rnd.randrange(-2, 3)) for _ in range(6)]) for i in range(200)]  # ties
    made += [made[5]] * 40 + [(None, made[6][1]), (5, made[9][1])]
    made += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 7), (2004, [1.0] * 5 + [None]), (2005, [1.0] * 5 + [math.nan]), (2006, [math.inf] * 6)]
    f32 = lambda v: v and [x if x is None else __import__("numpy").float32(x).item() for x in v]
    return [(i, f32(v)) for i, v in made]


@pytest.mark.parametrize(("rounds", "scale"), [(0, 1024), (1, 1024), (10, 1024), (4, 2), (3, 1 << 26), (2, 1 << 50)])
def test_equals_lloyd(spark, rows, rounds, scale):
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA).repartition(3)
    told = []
    got = clusters.ball_kmeans(frame, rounds=rounds, dims=6, scale=scale, told=told).collect()
    assert Counter(tuple(r) for r in got) == lloyd(rows, 8, rounds, 6, scale)
    if rounds == 10:  # most members lie in the stable core or an inner annulus
        assert told[-1]["compared"] < 0.5 * 8 * told[-1]["rows"]


def test_few_rows(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)]
    got = clusters.ball_kmeans(spark.createDataFrame([(i, v, "") for i, v in few], SCHEMA), dims=2).collect()
    assert Counter(tuple(r) for r in got) == lloyd(few, 8, 10, 2, 1024)
    assert clusters.ball_kmeans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_small_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(clusters, "BLOCK", 7)
    frame = spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA)
    got = clusters.ball_kmeans(frame.coalesce(1), rounds=2, dims=6).collect()
    assert Counter(tuple(r) for r in got) == lloyd(rows, 8, 2, 6, 1024)
