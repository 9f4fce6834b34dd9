"""One-edit pairs and forms against plain loops."""

import random
import re
import zlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from pressfold.llm import spelling
from tests.test_oracles import rows as as_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    found, out = {}, {}
    for w, n in words.items():
        others = [o for o in words if near(w, o)]
        top = min(others, key=lambda o: (-words[o], o), default=None)
        found[w] = (top if top and words[top] >= 10 * n else None, len(others))
    for w, n in words.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        form = found[w][0]
        out[w] = (w, form, root, n, found[w][1], words[form] if form else None)
    return Counter(out.values())


def test_pairs_of_dense_words(spark):
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 8))) for _ in range(500)} | {"a" * k for k in range(1, 9)} | {"zzz", "zz"}
    frame = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long").repartition(3)
    got = Counter((r["word"], r["other"]) for r in spelling.one_edit_pairs(frame).collect())
    assert got == Counter((a, b) for a in words for b in words if a != b and near(a, b))
    light = Counter(r["word"] for r in spelling.light_edges(frame).collect())
    assert max(light.values()) <= len(words).bit_length()  # small to large


def test_equals_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    common = ["Überlegung", "separate", "necessary", "ÉCOLEAUX", "committee", "aaaaaaaaa", "naïveté×÷", "x" * 3000]
    odd = ["seperate", "neccessary", "comittee", "committees", "separates", "aaaaaaaa", "İstanbulular", "shorter", "überlegung"]
    docs = []
    for i in range(120):
        w = [rnd.choice(common) for _ in range(150)] + [rnd.choice(odd) for _ in range(rnd.randrange(3))]
        docs.append((i if i % 7 else None, rnd.choice([" ", "-", "1", "\n"]).join(w)))
    docs += [(5, None), (6, ""), (7, "12 34 !"), docs[3], docs[3]]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, word string").repartition(5)
    got = spelling.variants(spelling.word_counts(frame))
    want = brute(docs)
    assert Counter(map(tuple, got.collect())) == want
    assert sum(form is not None for _, form, *_ in want) >= 5
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert as_rows(spelling.op13_spelling(spark, str(tmp_path)).toPandas()) == as_rows(con.sql(spelling.ORACLE_SQL).df())


def test_chains_and_ties(spark):
    words = [("abcdefg", 10**6), ("abcdefgh", 10**4), ("abcdefghi", 10**2), ("abcdefghij", 2), ("bbbbbbb", 50), ("bbbbbba", 500), ("bbbbbbc", 500), ("éééééééé", 9), ("ééééééé", 90)]
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["abcdefghij"] == ("abcdefghi", "abcdefg", 2, 1, 100)
    assert got["bbbbbbb"] == ("bbbbbba", "bbbbbba", 50, 2, 500) and got["bbbbbbc"] == (None, "bbbbbbc", 500, 2, None)
    assert got["éééééééé"] == ("ééééééé", "ééééééé", 9, 1, 90) and got["abcdefg"][:2] == (None, "abcdefg")


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(none)).count() == 0
    assert spelling.one_edit_pairs(spark.range(1).select(F.lit("alonely").alias("word"), F.lit(2).cast("long").alias("n"))).count() == 0
