"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Law ``rows``: a row's number in the order (doc_id, text_crc32, size) is permuted
within 0..N-1; the permuted number p gives shard ``p % shards`` and slot
``p // shards``. Shard sizes differ by one row at most, slots are gapless, and
place and row can be computed from each other without a lookup table.

The permutation is a mixed-radix Feistel network over Z_a x Z_b with
a = ceil(sqrt(N)) and b = ceil(N / a). a * b exceeds N by less than a, so few
rows leave the domain; cycle walking encrypts those again until they are inside.
All of it is column arithmetic: no Python runs on the executors.

Edge cases: a null text has size 1 and a null text_crc32; null ids sort first;
repeated rows are numbered one by one (equal rows are interchangeable); an empty
table gives an empty result; extra columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressfold.llm.common import numbered, table

SHARDS = 8
ROUNDS = 6
SEED = 20_240_229
PRIME = 2_147_483_647  # 2^31 - 1: squares of residues fit a long

#: No walk leaves the domain more often than this; see walk_limit().
WALKS = 64


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    keys, x = [], seed % PRIME
    for _ in range(rounds):
        x = (x * 48_271 + 11) % PRIME
        keys.append(x)
    return keys


def radices(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def walk_limit(n: int) -> int:
    """Steps that bring every row inside: at most a * b - n numbers lie outside.

    For large n the share outside is below 1 / sqrt(n), so that WALKS steps
    leave a row outside with a probability under n ** -31.
    """
    a, b = radices(n)
    return max(1, min(WALKS, a * b - n + 1))


def _mix(x: str, key: str) -> str:
    y = f"(({x} % {PRIME} + {key}) % {PRIME})"
    return f"(({y} * {y} % {PRIME}) * 31 + {y} * 17 + ({x} div 65537))"


def feistel_sql(value: str, n: int, seed: int = SEED) -> str:
    """SQL for one pass of the network over 0..a*b-1."""
    a, b = radices(n)
    keys = ", ".join(f"{k}L" for k in round_keys(seed))
    step = (
        "(s, k) -> named_struct("
        f"'l', CASE WHEN s.i % 2 = 0 THEN (s.l + {_mix('s.r', 'k')}) % {a} ELSE s.l END, "
        f"'r', CASE WHEN s.i % 2 = 1 THEN (s.r + {_mix('s.l', 'k')}) % {b} ELSE s.r END, "
        "'i', s.i + 1)"
    )
    return f"aggregate(array({keys}), named_struct('l', {value} % {a}L, 'r', {value} div {a}L, 'i', 0), {step}, s -> s.l + s.r * {a}L)"


def permute(value: str, n: int, seed: int = SEED) -> Column:
    """The place of the row number in column ``value`` in a permutation of 0..n-1."""
    walk = f"aggregate(sequence(1, {walk_limit(n)}), {feistel_sql(value, n, seed)}, (w, j) -> CASE WHEN w < {n}L THEN w ELSE {feistel_sql('w', n, seed)} END)"
    return F.expr(f"transform(array({walk}), w -> CASE WHEN w < {n}L THEN w ELSE raise_error('a walk left the rows') END)[0]")


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, row_number, position, law, shard, slot, grown_shard."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    rows = numbered(narrow, ["doc_id", "text_crc32", "size"], "row_number")
    n = rows.count()
    return rows.withColumn("position", permute("row_number", max(n, 1), seed)).select(
        "doc_id", "size", "text_crc32", "row_number", "position",
        F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.expr(f"position div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents")).drop("row_number", "position")


def oracle_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """DuckDB SQL for :func:`op7_sharding`; crc32 is spelt out, byte by byte."""
    rounds, l, r = [], "l0", "r0"
    for i, key in enumerate(round_keys(seed)):
        x, radix, old = (r, "a", l) if i % 2 == 0 else (l, "b", r)
        new = f"{'l' if i % 2 == 0 else 'r'}{i + 1}"
        y = f"(({x} % {PRIME} + {key}) % {PRIME})"
        rounds.append(f"LATERAL (SELECT ({old} + ({y} * {y} % {PRIME}) * 31 + {y} * 17 + {x} // 65537) % {radix} AS {new}) AS t{i}")
        l, r = (new, r) if i % 2 == 0 else (l, new)
    return f"""
WITH RECURSIVE tbl AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS g(i)),
d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size,
       CASE WHEN text IS NOT NULL THEN xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(text), '..'), lambda p: ('0x' || p)::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) END AS text_crc32
     FROM documents, tbl),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS num, count(*) OVER () AS n FROM d),
s AS (SELECT *, ceil(sqrt(n))::BIGINT AS a FROM n),
m AS (SELECT *, (n + a - 1) // a AS b FROM s),
walk(num, n, a, b, v, step) AS (
  SELECT num, n, a, b, num, 0 FROM m
  UNION ALL
  SELECT num, n, a, b, {l} + {r} * a, step + 1 FROM walk, LATERAL (SELECT v % a AS l0, v // a AS r0) AS t, {", ".join(rounds)} WHERE step = 0 OR v >= n)
SELECT doc_id, size, text_crc32, 'rows' AS law, (v % {shards})::INT AS shard, v // {shards} AS slot, NULL::INT AS grown_shard
FROM m JOIN walk USING (num) WHERE step > 0 AND v < walk.n
"""


ORACLE_SQL = oracle_sql()
