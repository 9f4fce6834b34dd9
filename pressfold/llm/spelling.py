"""Spelling variants: one-edit pairs of words by merging the light subtrees of their trie, and the form each variant stands for.

The trie of the words is a table: a node is a prefix, and its children are the symbols that follow it (``END`` where a
word ends). Aggregation gives the words below every child; the heavy child of a branching node is the one with most of them
(ties: a letter before ``END``, then the largest letter), all others are light. Two words part at exactly one node, and at least one of them goes
on into a light child there. So only words of light subtrees are merged, small to large: each is moved into the heavy
sibling's coordinates with its light letter replaced by the heavy one, into the node itself with the
light letter skipped, and below the heavy child with the heavy letter put before it (the skip seen from the shorter word).
A word lies in at most log2(words) light subtrees, so that is the number of such moves for each word, three terminals each. Terminals coincide
where a moved string is a word (an equality join) or where two light subtrees of a node give the same string (a group of at most as
many words as the alphabet has letters). Each pair comes up once, at the node where its words part.

Everything is DataFrame code: node sizes are aggregated in the map tasks first, and the few nodes near the root, which all
words share, are broadcast to the words.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty one; repeated rows count each; a run
of any length is one word; words with no near word stand for themselves; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.llm.common import materialize, table

LETTERS = "A-Za-zÀ-ÿ"
LEAST = 7
TIMES = 2
STEP = 31
FACTOR = 10
END = "$"
#: Depth up to which nodes are broadcast: 90 letters give 8,191 nodes at most.
SHALLOW = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(word: Column) -> Column:
    """Only A-Z in lower case; words of ASCII letters take the short way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def misspelt(doc_id: Column, word: Column, step: int = STEP) -> Column:
    """``word`` without the code point h % length where ``step`` divides h, the crc32 of ``<doc_id>:<word>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % step == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


def word_counts(docs: DataFrame, least: int = LEAST, times: int = TIMES, step: int = STEP) -> DataFrame:
    """(word, n) of the words of whole texts with at least ``least`` letters and ``times`` occurrences, misspellings put in."""
    runs = docs.filter("text IS NOT NULL").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    words = runs.select("doc_id", _lowered(F.col("run")).alias("run")).select(misspelt(F.col("doc_id"), F.col("run"), step).alias("word"))
    return words.filter(F.char_length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= times)


def light_edges(words: DataFrame) -> DataFrame:
    """(word, n, node, letter, heavy): of each word (word, n) the edges of its path that lead into light subtrees."""
    edges = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("d"))
    edges = edges.select("word", "n", F.left("word", F.col("d")).alias("node"), F.substring(F.concat("word", F.lit(END)), F.col("d") + 1, F.lit(1)).alias("letter"))
    children = edges.groupBy("node", "letter").agg(F.count(F.lit(1)).alias("size"))
    heavy = children.groupBy("node").agg(F.max_by("letter", F.struct("size", F.col("letter") != END, "letter")).alias("heavy"), F.count(F.lit(1)).alias("kids")).filter("kids > 1").drop("kids")
    heavy = materialize(heavy, "heavy")
    near_root = lambda rows: F.char_length(rows["node"]) <= SHALLOW
    # all words share the nodes near the root; there are at most as many of these as short strings of letters, so they are sent to the words
    top = edges.filter(near_root(edges)).join(F.broadcast(heavy.filter(near_root(heavy))), "node")
    return top.unionByName(edges.filter(~near_root(edges)).join(heavy.filter(~near_root(heavy)), "node")).filter("letter <> heavy")


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of distinct words (word, n) that differ by one inserted, deleted or replaced letter, both ways."""
    d, rest = F.char_length("node"), F.substring("word", F.char_length("node") + 2, F.char_length("word"))
    real = F.col("letter") != END
    moved = F.filter(
        F.array(
            F.when(real, F.struct(F.concat("node", "heavy", rest).alias("at"), d.alias("place"))),
            F.when(real & (F.left(rest, F.lit(1)) != F.col("letter")), F.struct(F.concat("node", rest).alias("at"), F.lit(-1).alias("place"))),
            F.struct(F.concat("node", "heavy", F.substring("word", d + 1, F.char_length("word"))).alias("at"), F.lit(-1).alias("place")),
        ),
        lambda t: t.isNotNull(),
    )
    terminals = materialize(light_edges(words).select("word", "n", F.explode(moved).alias("t")).select("word", "n", "t.at", "t.place"), "terminals")
    met = terminals.join(words.select(F.col("word").alias("at"), F.col("n").alias("other_n")), "at").select("word", "n", F.col("at").alias("other"), "other_n")
    # two light letters in one place: at most as many words as letters
    both = terminals.filter("place >= 0").groupBy("at", "place").agg(F.collect_list(F.struct("word", "n")).alias("same")).filter(F.size("same") > 1)
    both = both.select("same", F.explode("same").alias("a")).select("a", F.explode("same").alias("b")).filter("a.word <> b.word")
    both = both.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))
    return met.unionByName(met.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))).unionByName(both)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word of each chain of ``forms`` (word, form). Chains have no cycles; every round doubles the way that is known."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if not step.filter("moved").take(1):
            return now


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word (word, n): its commonest near word is its form, if that has ``factor`` times its n."""
    pairs = one_edit_pairs(words)
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top"))
    found = words.join(near, "word", "left").withColumn("good", -F.col("top.less") >= factor * F.col("n"))
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("good"), F.col("top.other")).alias("form"), F.when(F.col("good"), -F.col("top.less")).alias("form_n")), "variants")
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(materialize(word_counts(table(spark, sf_dir, "documents")), "words"))


#: crc32 is the exclusive or of one table entry for each byte and its distance from the end (``part``) and of a constant for each length (``base``).
ORACLE_SQL = f"""
WITH RECURSIVE run AS MATERIALIZED (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(r, '{UPPER}', '{LOWER}') AS r, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{LETTERS}]{{{LEAST},}}')) AS r FROM documents) GROUP BY ALL),
msg AS MATERIALIZED (SELECT row_number() OVER () AS k, *, hex(encode(id || ':' || r)) AS h, octet_length(encode(id || ':' || r)) AS len FROM run),
byte AS MATERIALIZED (SELECT i AS b, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS t FROM range(256) AS g(i)),
part AS (SELECT 0 AS d, b, t FROM byte UNION ALL SELECT d + 1, p.b, xor(p.t >> 8, s.t) FROM part p JOIN byte s ON s.b = p.t & 255 WHERE d < (SELECT max(len) FROM msg)),
base AS (SELECT 0 AS len, 4294967295 AS t UNION ALL SELECT len + 1, xor(p.t >> 8, s.t) FROM base p JOIN byte s ON s.b = p.t & 255 WHERE len < (SELECT max(len) FROM msg)),
crc AS (SELECT k, bit_xor(part.t) AS t FROM (SELECT k, len - i AS d, ('0x' || h[2 * i - 1:2 * i])::BIGINT AS b FROM (SELECT k, len, h, unnest(range(1, len + 1)) AS i FROM msg)) JOIN part USING (d, b) GROUP BY k),
made AS (SELECT r, times, length(r) AS m, xor(xor(crc.t, base.t), 4294967295) AS h FROM msg JOIN crc USING (k) JOIN base USING (len)),
spelt AS (SELECT CASE WHEN h % {STEP} = 0 THEN r[:h % m] || r[h % m + 2:] ELSE r END AS word, times FROM made),
w AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM spelt WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(times) >= {TIMES}),
del AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS v FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
less AS (SELECT DISTINCT del.word AS a, del.n AS an, w.word AS b, w.n AS bn FROM del JOIN w ON w.word = del.v),
pair AS (SELECT * FROM less UNION ALL SELECT b, bn, a, an FROM less
  UNION ALL SELECT x.word, x.n, y.word, y.n FROM del x JOIN del y ON x.i = y.i AND x.v = y.v AND x.word <> y.word AND length(x.word) = length(y.word)),
near AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-bn, encode(b))) AS other, max(bn) AS other_n FROM pair GROUP BY a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {FACTOR} * n THEN other END AS form, CASE WHEN other_n >= {FACTOR} * n THEN other_n END AS form_n FROM w LEFT JOIN near USING (word)),
chain AS (SELECT word, word AS cur, 0 AS step FROM f UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.cur AND f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(cur, step) AS root FROM chain GROUP BY word) USING (word)
"""
