"""Pruned nearest vectors and growing merges against plain loops."""

import random

import numpy as np
import pytest

from pressfold.operators import similar, stories

SCHEMA = "id long, embedding array<float>"


def cosines(rows):
    dims = max((len(v) for _, v in rows if v), default=1)
    x = np.array([np.pad(np.array(v or [], np.float32).astype(float), (0, dims - len(v or []))) for _, v in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(n > 0, n, 1)
    return np.round(x @ x.T, 12)


@pytest.mark.parametrize(("spread", "least", "earlier"), [(0.05, 0.9, True), (0.05, 0.9, False), (3.0, 0.3, True)])
def test_nearest_equals_all_pairs(spark, spread, least, earlier):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 12))
    x = centres[rng.integers(0, 40, 1200)] + spread * rng.standard_normal((1200, 12))
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(1200), x, strict=True)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 12), (5003, [1.0, 2.0]), (5004, [1.0, 2.0]), (5005, rows[3][1]), (5006, rows[3][1])]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    s = cosines(rows)
    want = {}
    for i, (a, _) in enumerate(rows):
        ok = [(s[i, j], b) for j, (b, _) in enumerate(rows) if (b < a if earlier else True)]
        top = max((c for c, _ in ok), default=-1)
        want |= {(a, b): c for c, b in ok if c == top and c >= least and c > 0}
    got = {(r["id"], r["other"]): r["cosine"] for r in similar.nearest(frame, frame, least, earlier, block=64).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-11) for k in got)
    pairs, a, b = similar.block_pairs(frame, frame, least, earlier, block=32, cells=64, per_cell=20)
    share = pairs.count() / (a.count() * b.count())
    assert share < (0.1 if spread < 1 else 0.6)  # clusters: most pairs of blocks are skipped; else ids skip half


@pytest.mark.parametrize("seed", range(3))
def test_growing_merges_equal_the_scan(spark, seed):
    rnd = random.Random(seed)
    angle = lambda: [float(np.cos(t := rnd.randrange(60) / 10)), float(np.sin(t))]
    rows, story = [], 0
    for _ in range(70):
        story += rnd.randrange(1, 3)
        for _ in range(1 if rnd.random() < 0.85 else rnd.randrange(2, 4)):
            rows.append((story, 1000 + len(rows), None if rnd.random() < 0.05 else angle()))
    s = cosines([(i, v) for _, i, v in rows])
    sizes = {}
    for st, *_ in rows:
        sizes[st] = sizes.get(st, 0) + 1
    for judged in (False, True):
        accept, ask = 0.9999, 0.995
        yes = lambda i, j: (i + j) % 3 != 0
        member = {k: st for k, (st, _, v) in enumerate(rows) if sizes[st] > 1 and v}
        want = {}
        for k, (st, i, v) in enumerate(rows):
            if sizes[st] > 1 or not v:
                continue
            best = min(((-s[k, m], into, rows[m][1]) for m, into in member.items() if s[k, m] > 0), default=None)
            if best and (-best[0] >= accept or judged and -best[0] >= ask and yes(i, best[2])):
                want[st] = best[1]
                member[k] = best[1]
        judge = (lambda p: p.filter("(id + other) % 3 <> 0")) if judged else None
        got = stories.merge_growing(spark.createDataFrame(rows, "story_id long, id long, embedding array<float>"), accept, ask, judge)
        assert {r["story_id"]: r["into"] for r in got.collect()} == want and want


@pytest.mark.parametrize("hot", [0, 2, 12, 1000])
def test_keyword_candidates_equal_all_pairs(spark, hot):
    rnd = random.Random(hot)
    words = [f"word{k}" for k in range(60)]
    title = lambda n: " ".join(rnd.choice(words[: rnd.choice([3, 12, 60])]) for _ in range(rnd.randrange(n)))
    articles = [(i, title(9)) for i in range(80)] + [(90, None), (91, "a an the"), (92, "unknownword")]
    items = [(i, title(7).upper()) for i in range(70)] + [(80, None)]
    split = lambda t: {w for w in (t or "").lower().split() if len(w) > 3}
    want = set()
    for i, t in articles:
        best = sorted((-n, k) for k, s in items if (n := len(split(t) & split(s))))[:5]
        want |= {(i, k, -n, p + 1) for p, (n, k) in enumerate(best)}
    got = stories.keyword_candidates(spark.createDataFrame(articles, "id long, title string"), spark.createDataFrame(items, "story_id long, title string"), hot=hot)
    assert set(map(tuple, got.collect())) == want
