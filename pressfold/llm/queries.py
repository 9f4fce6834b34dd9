"""The queries of this subpackage and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressfold.llm import clusters, curves, decontaminate, exactdup, ftrl, html, language, mixing, neardup, sharding, spelling, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": neardup.op1_neardup,
    "op2_html": html.op2_html,
    "op3_mixing": mixing.op3_mixing,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_exactdup": exactdup.op5_exactdup,
    "op6_toxicity": ftrl.op6_toxicity,
    "op7_sharding": sharding.op7_sharding,
    "op8_topk": topk.op8_topk,
    "op9_quality": ftrl.op9_quality,
    "op10_language": language.op10_language,
    "op11_neighbours": curves.op11_neighbours,
    "op12_clusters": clusters.op12_clusters,
    "op13_spelling": spelling.op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_neardup": neardup.ORACLE_SQL,
    "op3_mixing": mixing.ORACLE_SQL,
    "op7_sharding": sharding.ORACLE_SQL,
    "op8_topk": topk.ORACLE_SQL,
    "op12_clusters": clusters.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
