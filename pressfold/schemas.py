"""Schemas of the stored tables; columns that were added later are nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names and types of the entities.
SCHEMAS = {
    "outlets": "id long, name string, url string, description string, bias_score double",
    "topics": "id long, name string",
    "stories": "id long, title string, headline string, summary string, deep_report string, headline_score double, created_at timestamp_ntz",
    "articles": "id long, title string, content string, source string, url string, outlet_id long, story_id long, date timestamp_ntz, "
    "fetched_at timestamp_ntz, bias_score double, image_url string, embedding array<float>, summary string",
    "story_topics": "story_id long, topic string",
    "article_topics": "article_id long, topic string",
    "app_settings": "key string, value string",
    "raw_article_payloads": "id long, source string, topic_name string, payload string, fetched_at timestamp_ntz",
    "editorial_history": "id long, story_id long, run_at timestamp_ntz, editorial_rank int, editorial_score double, base_score double, final_score double",
    "scrape_blocklist": "id long, domain string, reason string, added_at timestamp_ntz, is_permanent boolean",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A table without rows: what a source gives that has no key, and what a store begins with."""
    return spark.createDataFrame([], SCHEMAS[table])
