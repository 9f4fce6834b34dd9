import os

import duckdb
import pytest

from pressfold.operators import quality
from pressfold.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    cols = sorted(frame.columns)
    plain = lambda v: list(v) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(map(str, frame[cols].astype(object).where(frame[cols].notna(), None).map(plain).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
        assert rows(got) == rows(con.sql(registry.ORACLES[name]).df())


def test_whole_tables(spark, tmp_path):
    titles = ["A story - The Outlet", "A - b - one two three four five", "A | B News", "A — B", "A - one two three four five | C", "a - - b", " - x", "w " * 40 + "- Out", None, ""]
    docs = [(i, t and t + "\nbody", "en", "s", 1) for i, t in enumerate(titles)]
    turns = [(1, i, "user", t) for i, t in enumerate(["Sports", "gaming, sports\nUS politics\nSPORTS", "3", " 4 ", None, "", "Other\nBusiness/Finance"])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("all_clean_titles", "all_model_responses"):
        assert rows(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(con.sql(registry.ORACLES[name]).df())
    got = {r["doc_id"]: r["title"] for r in registry.QUERIES["all_clean_titles"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(5)] == ["A story", "A - b - one two three four five", "A", "A", "A - one two three four five"] and got[8] is None
    got = {r["turn"]: r["topics"] for r in registry.QUERIES["all_model_responses"](spark, str(tmp_path)).collect()}
    assert got[1] == ["Gaming", "Sports", "US Politics"] and got[2] == ["Other"]


def test_audit_clears_what_follows_in_a_domain(spark, tmp_path):
    text = lambda i: " ".join(f"word{i}x{k}" for k in range(400)) + "."
    docs = [(1, text(1), "en", "a", 1), (2, quality.STRONG_SIGNS[0], "en", "a", 1), (3, text(3), "en", "a", 1), (4, text(4), "en", "b", 1), (5, text(5), "en", None, 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, registry.QUERIES["retroactive_audit"](spark, str(tmp_path)).collect())) == [("a", 2), ("a", 3)]
