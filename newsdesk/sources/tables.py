"""Schemas of the stored tables, and readers of them and of raw feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsdesk.functions.text import clean_text, json_list, summary_chars
from newsdesk.functions.times import parse_datetime
from newsdesk.functions.urls import canonicalize_url

SCHEMAS = {
    "sources": "source_id bigint, source_name string, source_category string, source_url string, enabled boolean, priority string, list_page_limit int, item_limit_per_run int, error_count bigint",
    "content_items": "content_id bigint, source_id bigint, title string, url string, canonical_url string, source_name string, source_category string, publish_time timestamp_ntz, publish_time_status string, crawl_time timestamp_ntz, summary string, ai_related boolean, extraction_status string, llm_status string, relevance_score int, relevance_confidence double, relevance_reasons array<string>, review_status string, language string, word_count int, content_fingerprint string, favorite boolean",
    "content_cache": "content_id bigint, clean_text string, expire_at timestamp_ntz",
    "content_tags": "content_id bigint, tag_key string, tag_value string, confidence double, source string",
    "content_entities": "content_id bigint, entity_type string, name string, confidence double, source string",
    "tag_definitions": "tag_id bigint, tag_key string, tag_value string, enabled boolean",
    "entities": "entity_id bigint, entity_type string, canonical_name string, display_name string",
    "financing_events": "event_id bigint, event_type string, event_title string, company_name string, company_name_normalized string, announced_date date, financing_round string, amount_original string, amount_normalized double, currency string, investors array<string>, lead_investors array<string>, event_summary string, confidence double, review_status string, locked_by_user boolean, updated_at timestamp_ntz",
    "event_contents": "event_content_id bigint, event_id bigint, content_id bigint, is_primary_source boolean, match_score double, match_reasons array<string>, association_source string",
    "event_change_logs": "event_id bigint, operation string, before string, after string",
    "crawl_runs": "crawl_run_id bigint, source_id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string, total_items bigint, new_items bigint, failed_items bigint, message string",
    "crawl_errors": "source_id bigint, crawl_run_id bigint, error_type string, message string, url string, occurred_at timestamp_ntz",
    "daily_summaries": "summary_date date, total_items bigint, successful_items bigint, partial_items bigint, failed_items bigint, source_counts map<string,bigint>",
    "watch_items": "watch_id bigint, target_type string, target_id bigint, active_target_key string, priority string, status string, next_review_date date, completed_at timestamp_ntz, updated_at timestamp_ntz",
    "intelligence_reviews": "content_id bigint, seq bigint, decision string, previous_status string, previous_score int",
    "reports": "report_id bigint, report_type string, period_start date, period_end date, status string, latest_version int",
    "report_inputs": "report_id bigint, position int, target_type string, target_id bigint, included boolean",
    "report_versions": "report_id bigint, version_number bigint, version_source string, generation_status string, markdown_text string",
    "report_exports": "report_id bigint, version_number bigint, path string",
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A table with its fixed schema: other columns are dropped, missing ones are null."""
    schema = StructType.fromDDL(SCHEMAS[name])
    df = spark.read.parquet(path)
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages (url, html) that stand in for fetched ones."""
    return spark.read.parquet(path).select("url", "html")


#: A longer text than the parser's own bound, 20,000,000 characters, would make a story without any value.
LONGEST = {"maxStringLen": str((1 << 31) - 1)}
STORY = "id bigint, type string, title string, url string, text string, time bigint, score bigint, by string"


def read_stories(df: DataFrame, text: str = "value", top: int = 20) -> DataFrame:
    """Items from story JSON (rank, JSON text): stories among the first `top` ranks, with the defaults for missing
    titles and addresses; epoch seconds become Beijing time."""
    s = df.where(F.col("rank") <= top).select("rank", F.from_json(text, STORY, LONGEST).alias("s")).where("s.type = 'story'").select("rank", "s.*")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Hacker News story "), F.col("id").cast("string")))
    url = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("id").cast("string")))
    body = clean_text(F.coalesce(F.nullif(F.col("text"), F.lit("")), title))
    at = F.when(F.coalesce(F.col("time"), F.lit(0)) != 0, F.timestamp_seconds("time"))
    beijing = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz"))
    return s.select("rank", title.alias("title"), url.alias("url"), summary_chars(body).alias("summary"), body.alias("clean_text"), beijing.alias("publish_time"), F.when(at.isNull(), "missing").otherwise("exact").alias("publish_time_status"), F.lit("en").alias("language"), "score", F.col("by"))


def read_atom(spark: SparkSession, path: str, limit: int = 30) -> DataFrame:
    """Products of an Atom feed: alternate links to product pages, the first paragraph as summary; of entries with one
    canonical address the last one's values at the first one's place. An empty feed is an error."""
    schema = "title string, link array<struct<_href:string,_rel:string>>, content string, published string"
    raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path).withColumn("_at", F.monotonically_increasing_id())
    link = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    rows = raw.select("_at", clean_text(F.col("title")).alias("title"), F.try_element_at(link, F.lit(1))["_href"].alias("href"), "content", "published")
    rows = rows.where(F.contains("href", F.lit("/products/")) & F.length("title").between(3, 120) & (F.lower("title") != "artificial intelligence"))
    first = F.regexp_extract("content", r"(?is)<p[^>]*>(.*?)</p>", 1)
    text = clean_text(F.regexp_replace(F.when(first != "", first).otherwise(F.coalesce("content", F.lit(""))), r"(?s)<[^>]+>", " "))
    rows = rows.select("_at", "title", canonicalize_url(F.col("href"), F.lit("https://www.producthunt.com")).alias("url"), F.when(text != "", text).otherwise(F.col("title")).alias("clean_text"), parse_datetime(F.col("published")).alias("publish_time"))
    one = Window.partitionBy("url")
    rows = rows.withColumn("position", F.min("_at").over(one)).withColumn("_n", F.row_number().over(one.orderBy(F.desc("_at")))).where("_n = 1").drop("_n", "_at")
    out = rows.withColumn("summary", summary_chars(F.col("clean_text"))).withColumn("publish_time_status", F.when(F.col("publish_time").isNull(), "missing").otherwise("exact")).withColumn("language", F.lit("en")).orderBy("position").limit(limit)
    if out.isEmpty():
        raise ValueError("the feed holds no product entries")
    return out


def read_signal_cards(cards: DataFrame, run_at: Column, kind: str, limit: int) -> DataFrame:
    """Items from parsed cards (position, title, href, description, detail): canonical addresses, the first card of
    each, at most `limit` (10 at least for repositories), published at the run's time by estimate."""
    most = max(limit, 10) if kind == "github" else limit
    rows = cards.withColumn("url", canonicalize_url(F.col("href")))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("position"))).where("_n = 1").orderBy("position").limit(most)
    text = F.concat_ws(" · ", F.nullif(clean_text(F.col("description")), F.lit("")), F.nullif(clean_text(F.col("detail")), F.lit("")))
    body = F.when(text != "", text).otherwise(clean_text(F.col("title")))
    return rows.select("position", clean_text(F.col("title")).alias("title"), "url", summary_chars(body).alias("summary"), body.alias("clean_text"), run_at.alias("publish_time"), F.lit("estimated").alias("publish_time_status"))


__all__ = ["SCHEMAS", "json_list", "read_atom", "read_pages", "read_signal_cards", "read_stories", "read_table"]
