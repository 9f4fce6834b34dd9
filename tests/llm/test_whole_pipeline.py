"""The classifier and every stage of the pipeline against plain versions on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pressfold.llm import decontaminate, ftrl, mixing, sharding
from tests.llm.test_operators import brute_components, plain_alignment

TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+")


def shape(token):
    upper = sum(65 <= b <= 90 for b in token)
    case = 0 if not upper else 2 if upper == len(token) else 1 if upper == 1 and 65 <= token[0] <= 90 else 3
    n = len(token)
    word = bool(re.match(rb"[A-Za-z0-9\x80-\xff]", token))
    return case, any(48 <= b <= 57 for b in token), any(b >= 128 for b in token), word, min(n, 3 + (n > 6) + (n > 12) + (n > 24))


def plain_features(text, task):
    tokens = TOKEN.findall((text or "").encode())
    low, shapes = [t.lower() for t in tokens], [shape(t) for t in tokens]
    found = Counter(low)
    for gap in filter(None, task.words):
        found.update((gap, *p) for p in zip(low, low[gap:], strict=False))
    for size in task.stems:
        found.update(("stem", size, t[:size]) for t in low if len(t) > size)
    for size in task.shapes:
        found.update(("shape", *shapes[k : k + size]) for k in range(len(shapes) - size + 1))
    return {f: 1 + (c > 1) / 2 if task.damped else c * ftrl.SCALE / max(1, len(tokens)) for f, c in found.items()}


def plain_scores(examples, texts, task):
    """Scores of ``texts`` by FTRL-proximal as its authors state it, one coordinate at a time."""
    z, n, b, total = defaultdict(float), defaultdict(float), 0.0, 0.0
    rate = lambda s: (task.beta + math.sqrt(s)) / task.alpha
    weight = lambda f: 0.0 if abs(z[f]) <= task.l1 else (math.copysign(task.l1, z[f]) - z[f]) / (rate(n[f]) + task.l2)

    def predict(x):
        return 1 / (1 + math.exp(-max(-30, min(30, sum(weight(f) * v for f, v in x.items()) - b / rate(total)))))

    for _ in range(ftrl.EPOCHS):
        for text, y in examples:
            x = plain_features(text, task)
            d = (predict(x) - y) * (task.weight if y else 1)
            intercept = -b / rate(total)
            for f, v in x.items():
                g, w = d * v, weight(f)
                step = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / task.alpha
                n[f], z[f] = n[f] + g * g, z[f] + g - step * w
            b += d - (math.sqrt(total + d * d) - math.sqrt(total)) / task.alpha * intercept
            total += d * d
    return [predict(plain_features(t, task)) for t in texts]


def training_examples(spark, rows, labels, task):
    """(text, label) of the training folds in the order of the seeded hashes."""
    ids = spark.createDataFrame([(i,) for i in {i for i, _ in labels}], "doc_id long")
    order = {r["doc_id"]: r["h"] for r in ids.select("doc_id", F.xxhash64("doc_id", F.lit(ftrl.SEED)).alias("h")).collect()}
    chosen = sorted((order[i], i, y) for i, y in labels if zlib.crc32(str(i).encode()) % task.folds != task.held_out)
    return [(t, y) for _, i, y in chosen for k, t in rows if k == i]


@pytest.mark.parametrize("task", [ftrl.QUALITY, ftrl.TOXIC])
def test_classifier_is_plain_ftrl(spark, task):
    rnd = random.Random(31)
    rows, labels = [(1000, None), (1001, "")], []
    for i in range(160):
        y = rnd.randrange(2)
        w = [rnd.choice(["Plain", "words", "ofSome", "TEXT", "über", "n0", "and", "more"]) for _ in range(rnd.randrange(3, 25))]
        for _ in range(rnd.randrange(3)):
            w.insert(rnd.randrange(len(w)), "vilely" if y else "nicely, ok")
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    want = plain_scores(training_examples(spark, rows, labels, task), [t for _, t in rows], task)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {task.label} int")
    got = {r["doc_id"]: r["score"] for r in ftrl.score_texts(docs, lab, task).collect()}
    assert max(abs(got[i] - s) for (i, _), s in zip(rows, want, strict=True)) < 0.01 and max(want) - min(want) > 0.3


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(32)
    words = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    items = [(k, " ".join(words(25))) for k in range(4)] + [(9, None)]
    texts, labels = [], []
    for i in range(150):
        w = words(rnd.randrange(40, 80))
        if i % 10 == 3:
            w = texts[i - 3].split()
            w[rnd.randrange(len(w))] = "edited"
        if i % 20 == 7:
            part = items[i % 4][1].split()
            part[rnd.randrange(9, 16)] = "other"
            w[10:10] = part
        texts.append(" ".join(f"{x}$$$" for x in w) if i % 5 == 1 else " ".join(w))
        labels.append((i, int(i % 5 != 1)))
    source = lambda i: ["hot", "hot", "a", None][i % 4]
    rows = [(i, t, "en", source(i), i, "clash") for i, t in enumerate(texts)]
    rows += [(12, texts[12], "en", "hot", 200, None), (None, texts[14], None, "a", 201, None), (300, None, None, None, 202, None), (301, "", "en", "a", 203, None)]
    at = tmp_path_factory.mktemp("tables")
    schema = {"documents": (rows, "doc_id long, text string, lang string, source string, row int, _key string"), "labels": (labels, "doc_id long, quality int"), "benchmark": (items, "item_id long, text string")}
    for name, (data, columns) in schema.items():
        spark.createDataFrame(data, columns).write.parquet(f"{at}/{name}.parquet")
        spark.createDataFrame([], columns).write.parquet(f"{at}/empty/{name}.parquet")
    return str(at), rows, labels, items


def by_sql(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs)
    return con.sql(sql).df()


def test_stages_are_their_plain_versions(spark, tables):
    at, rows, labels, items = tables
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns

    def after(name):
        nonlocal docs
        docs = corpus_pipeline.materialize(stages[name](spark, docs, at), name)
        return [(r["doc_id"], r["text"]) for r in docs.collect()]

    pairs = [r[:2] for r in rows]
    scores = plain_scores(training_examples(spark, pairs, labels, ftrl.QUALITY), [t for _, t in pairs], ftrl.QUALITY)
    assert all(abs(s - ftrl.ACCEPT) > 0.01 for s in scores)
    kept = after("quality")
    assert Counter(kept) == Counter(p for p, s in zip(pairs, scores, strict=True) if s >= ftrl.ACCEPT)
    assert 60 < len(kept) < len(rows)

    kept.sort(key=lambda p: (p[0] is None, p[0] or 0, p[1] or ""))
    comp = brute_components(list(enumerate(t for _, t in kept)))
    want = Counter(p for k, p in enumerate(kept) if comp[k] == k)
    kept = after("near-duplicates")
    assert Counter(kept) == want and docs.columns == columns

    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    leak = lambda t: any(plain_alignment(split(i), split(t)) >= 2 * len(split(i)) * decontaminate.SCORE for _, i in items if i)
    want = Counter(p for p in kept if not leak(p[1]))
    before, kept = len(kept), after("decontamination")
    assert Counter(kept) == want and len(kept) < before and docs.columns == columns

    taken = by_sql(docs.toPandas(), mixing.ORACLE_SQL)
    times = {i: math.floor(t / s + 0.5) for i, s, t in zip(taken["doc_id"], taken["size"], taken["taken"], strict=True) if s}
    kept = after("mixing")
    assert Counter(i for i, _ in kept) == Counter({i: n for i, n in times.items() if n}) and docs.columns == columns

    plain = lambda frame: Counter(tuple(None if x != x else int(x) for x in r) for r in frame[["doc_id", "size", "text_crc32", "shard", "slot"]].astype(float).values.tolist())
    want = plain(by_sql(docs.toPandas(), sharding.ORACLE_SQL))
    assert plain(corpus_pipeline.run(spark, at).toPandas()) == want and sum(want.values()) == len(kept)


def test_pipeline_of_empty_tables(spark, tables):
    assert corpus_pipeline.run(spark, f"{tables[0]}/empty").count() == 0
