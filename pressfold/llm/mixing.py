"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sources, ordered by code point with null last, weigh 5, 2, 1, 5, 2, 1, ...
   and share all words of the table. A target above ``max_epochs`` times its
   source's words stops there; the excess is shared again by weight.
2. The mix is cut into blocks of ``block_tokens`` words. Sainte-Lague's highest
   quotients target / (2k + 1) give each source an integer number of blocks, and
   by the same rule each of its shards (documents by hash, about ``shard_rows``
   rows each) an integer quota. Quotas of one source add up to its blocks.
3. Within a shard the documents stand in a seeded order. The quota takes whole
   passes over the shard and, for the rest, a run of blocks that starts at a
   seeded block and wraps around. So every shard takes its quota to the word.

Only DataFrame operations run; a hot source is many shards, so neither a window
nor a join needs its rows in one task. The candidate quotients of step 2 are cut
to those around the exact answer (see ``shard_seats``): about two rows for each
competitor, whatever the number of blocks, which one distributed sort ranks.

Edge cases: a null or empty text has size 0 and takes 0; a null source is a source
of its own; repeated rows, and rows that share or lack an id, count as separate documents; equal quotients go to the
source (shard) that comes first; an empty table gives an empty result; extra
columns are ignored by :func:`mix` and kept by :func:`apply_mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressfold.llm.common import WORD, keyed, materialize, numbered, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_TOKENS = 16
SHARD_ROWS = 1024
SEED = 17


def _hash32(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources`` (n words, weight) with the column target.

    Each round of the loop caps the sources whose share passes the limit and
    shares the rest anew; the driver sees four sums a round.
    """
    level = 0.0
    cap = F.lit(max_epochs) * F.col("n")
    total = sources.agg(F.sum("n")).first()[0] or 0
    while total:
        capped = F.col("weight") * F.lit(level) > cap
        held, free = sources.agg(F.sum(F.when(capped, cap).otherwise(0)), F.sum(F.when(~capped, F.col("weight")).otherwise(0))).first()
        grown = (total - held) / free if free else level
        if grown <= level:
            break
        level = grown
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def source_seats(sources: DataFrame, seats: int) -> DataFrame:
    """``sources`` with the column blocks: ``seats`` blocks by the highest quotients of target."""
    totals = sources.agg(F.sum("target").alias("w"), F.count(F.lit(1)).alias("k")).first()
    if not totals["w"]:
        return sources.withColumn("blocks", F.lit(0).cast("long"))
    w, half = float(totals["w"]), totals["k"] / 2.0
    few = F.floor(F.col("target") * max(0.0, seats - half) / w + 0.5) - 1
    many = F.floor(F.col("target") * (seats + half) / w + 0.5) + 1
    d = sources.withColumn("base", F.greatest(F.lit(0), few).cast("long")).withColumn("_many", F.least(many, F.lit(seats)).cast("long"))
    certain = d.agg(F.sum("base")).first()[0]
    q = d.filter("_many > base").select("src", F.explode(F.sequence("base", F.col("_many") - 1)).alias("_k"), "target")
    q = q.select("src", (-F.col("target") / (F.col("_k") * 2 + 1)).alias("_q"))
    won = numbered(q, ["_q", "src"], "_rank").filter(F.col("_rank") < seats - certain).groupBy("src").agg(F.count(F.lit(1)).alias("_won"))
    return d.join(won, "src", "left").withColumn("blocks", F.col("base") + F.coalesce("_won", F.lit(0))).drop("base", "_many", "_won")


def shard_seats(shards: DataFrame) -> DataFrame:
    """(src, shard, n, quota): each source's seats over its shards (src, shard, n, seats) by words.

    For k shards, the divisors W / (M - k/2) and W / (M + k/2) give at most and at least M seats in all, so each shard's
    seats lie between what these two give it (one more on either side for rounding). Only quotients between are
    sorted, all sources' in one distributed order.
    """
    sums = shards.groupBy("src").agg(F.sum("n").cast("double").alias("_w"), (F.count(F.lit(1)) / 2.0).alias("_k"))
    d = shards.join(sums, "src")
    few = F.when((F.col("seats") > F.col("_k")) & (F.col("_w") > 0), F.floor(F.col("n") * (F.col("seats") - F.col("_k")) / F.col("_w") + 0.5) - 1).otherwise(0)
    many = F.when(F.col("_w") > 0, F.floor(F.col("n") * (F.col("seats") + F.col("_k")) / F.col("_w") + 0.5) + 1).otherwise(0)
    d = d.withColumn("base", F.greatest(F.lit(0), few).cast("long")).withColumn("_many", F.least(many, F.col("seats")).cast("long"))
    d = materialize(d.select("src", "shard", "n", "seats", "base", "_many"), "mix-shards")
    q = d.filter("_many > base").select("src", "shard", "n", F.explode(F.sequence("base", F.col("_many") - 1)).alias("_i"))
    ranked = numbered(q.select("src", (-F.col("n") / (F.col("_i") * 2 + 1)).alias("_q"), "shard"), ["src", "_q", "shard"], "_rank")
    still = d.groupBy("src").agg((F.first("seats") - F.sum("base")).alias("_open")).join(ranked.groupBy("src").agg(F.min("_rank").alias("_from")), "src")
    won = ranked.join(still, "src").filter(F.col("_rank") - F.col("_from") < F.col("_open")).groupBy("src", "shard").agg(F.count(F.lit(1)).alias("_won"))
    return d.join(won, ["src", "shard"], "left").select("src", "shard", "n", (F.col("base") + F.coalesce("_won", F.lit(0))).alias("quota"))


def _taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs`` (_key, unique, doc_id, source, text): _key, doc_id, source, size, source_size, target, taken."""
    sizes = docs.select(
        "_key", "doc_id", "source",
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_key").cast("string")).cast("binary")).alias("_h"),
    )
    sizes = materialize(sizes, "mix-sizes")
    sources = sizes.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("_rows"))
    sources = numbered(sources.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "src")
    picked = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", picked).withColumn("_shards", F.ceil(F.col("_rows") / shard_rows))
    sources = targets(sources, max_epochs)
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    sources = materialize(source_seats(sources, round(total / block_tokens)), "mix-sources")

    by_source = sources.select(F.col("source").alias("_s"), "src", F.col("n").alias("source_size"), "target", "blocks", "_shards")
    rows = sizes.join(by_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("shard", F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % F.col("_shards"))
    shards = rows.groupBy("src", "shard").agg(F.sum("size").alias("n"), F.first("blocks").alias("seats"))
    quotas = shard_seats(shards)

    take = F.least(F.col("quota") * block_tokens, F.col("n") * max_epochs)
    start = _hash32(F.concat_ws("|", F.lit(str(seed)), F.col("src"), F.col("shard"))) % F.greatest(F.ceil(F.col("n") / block_tokens), F.lit(1)) * block_tokens
    runs = quotas.withColumn("_passes", F.when(F.col("n") > 0, F.floor(take / F.col("n"))).otherwise(0))
    runs = runs.withColumn("_from", start).withColumn("_to", start + take - F.col("_passes") * F.col("n"))
    runs = materialize(runs, "mix-runs")
    rows = rows.join(runs, ["src", "shard"])
    seen = Window.partitionBy("src", "shard").orderBy("_h", "_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum("size").over(seen)).withColumn("_begin", F.col("_end") - F.col("size"))
    inside = F.greatest(F.lit(0), F.least("_end", F.least("_to", "n")) - F.greatest("_begin", "_from"))
    wrapped = F.greatest(F.lit(0), F.least(F.col("_end"), F.col("_to") - F.col("n")) - F.col("_begin"))
    return rows.select("_key", "doc_id", "source", "size", "source_size", "target", (F.col("_passes") * F.col("size") + inside + wrapped).cast("long").alias("taken"))


def mix(docs: DataFrame, **params) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, taken."""
    return _taken(keyed(docs.select("doc_id", "source", "text"), "_key"), **params).drop("_key")


def apply_mix(docs: DataFrame, **params) -> DataFrame:
    """The mix as documents: a row comes as often as it is taken whole, and once more if at least half of it is taken besides."""
    rows = keyed(docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "_key")
    taken = _taken(rows, **params).filter("size > 0")
    times = taken.select("_key", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")).filter("times > 0")
    rows = rows.select("_key", "row").join(times, "_key")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


#: DuckDB: the same rules without the windows around the quotients and with the level of the targets read off sorted prefixes.
ORACLE_SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
src0 AS (SELECT source, sum(size)::BIGINT AS n, count(*) AS rws FROM sizes GROUP BY source),
src1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM src0),
src2 AS (SELECT *, CASE src % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM src1),
src3 AS (SELECT *, sum(n) OVER () AS total,
           coalesce(sum({MAX_EPOCHS} * n) OVER below, 0) AS held, sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS free
         FROM src2 WINDOW below AS (ORDER BY n::DOUBLE / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT arg_min((total - held)::DOUBLE / free, (n::DOUBLE / weight, src)) AS level FROM src3 WHERE (total - held)::DOUBLE / free * weight <= {MAX_EPOCHS} * n),
src4 AS (SELECT src3.*, least(weight * level, ({MAX_EPOCHS} * n)::DOUBLE) AS target, greatest(1, ceil(rws / {SHARD_ROWS}.0))::BIGINT AS shards FROM src3, lvl),
tot AS (SELECT round_even(sum(target) / {BLOCK_TOKENS}, 0)::BIGINT AS seats, sum(target) AS t FROM src4),
q AS (SELECT src, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, src) AS r
      FROM src4, tot, range(0, (ceil(src4.target / {BLOCK_TOKENS}) + 40)::BIGINT) AS g(k)),
won AS (SELECT src, count(*) AS blocks FROM q, tot WHERE r <= seats GROUP BY src),
src5 AS (SELECT src4.*, coalesce(blocks, 0) AS blocks FROM src4 LEFT JOIN won USING (src)),
docs AS (SELECT s.doc_id, s.size, s.h, b.src, b.n AS source_size, b.target, b.blocks,
           ('0x' || substr(s.h, 1, 8))::BIGINT % b.shards AS shard
         FROM sizes s JOIN src5 b ON s.source IS NOT DISTINCT FROM b.source),
sh AS (SELECT src, shard, sum(size)::BIGINT AS n, first(blocks) AS seats FROM docs GROUP BY src, shard),
sq AS (SELECT src, shard, seats, row_number() OVER (PARTITION BY src ORDER BY n / (2.0::DOUBLE * k + 1) DESC, shard) AS r
       FROM sh, range(0, sh.seats) AS g(k) WHERE n > 0),
swon AS (SELECT src, shard, count(*) AS quota FROM sq WHERE r <= seats GROUP BY src, shard),
runs AS (SELECT sh.src, sh.shard, sh.n, least(coalesce(quota, 0) * {BLOCK_TOKENS}, {MAX_EPOCHS} * n) AS take,
           ('0x' || substr(md5('{SEED}|' || sh.src || '|' || sh.shard), 1, 8))::BIGINT % greatest(ceil(n / {BLOCK_TOKENS}.0)::BIGINT, 1) * {BLOCK_TOKENS} AS f
         FROM sh LEFT JOIN swon USING (src, shard)),
rns AS (SELECT *, CASE WHEN n > 0 THEN take // n ELSE 0 END AS passes FROM runs),
pos AS (SELECT d.*, r.n, r.f, r.passes, r.f + r.take - r.passes * r.n AS t,
          sum(d.size) OVER (PARTITION BY d.src, d.shard ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS e
        FROM docs d JOIN rns r USING (src, shard))
SELECT doc_id, size, source_size, target,
  (passes * size + greatest(0, least(e, t, n) - greatest(e - size, f)) + greatest(0, least(e, t - n) - (e - size)))::BIGINT AS taken
FROM pos
"""
