"""Ingest of extracted items: new ones, inside the window, worth keeping; and the accounting of what was not."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.functions.text import fingerprint, summary_chars
from newsdesk.functions.times import daily_window, in_window
from newsdesk.functions.urls import canonicalize_url
from newsdesk.operators.filters import keep_items

CACHE_HOURS = 48
CONTENT_TYPES = {"github": "repo", "product_hunt": "product_launch", "hacker_news": "discussion", "ai_research_signal": "research", "ai_product_signal": "product_launch", "startup_directory": "company_news"}


def label_items(items: DataFrame, contents: DataFrame, sources: DataFrame, run_at: dt.datetime, outputs: DataFrame | None = None) -> DataFrame:
    """items with canonical_url, ai_related and outcome: duplicate, outside_window, not_ai or new, by the first rule
    that holds. Of items with one canonical URL the first by position can be new."""
    start, end = daily_window(run_at.date())
    rows = items.withColumn("canonical_url", canonicalize_url(F.col("url")))
    known = contents.select("canonical_url", F.lit(True).alias("_known")).dropDuplicates(["canonical_url"])
    first = rows.groupBy("canonical_url").agg(F.min(F.struct("source_id", "position")).alias("_first"))
    rows = rows.join(known, "canonical_url", "left").join(first, "canonical_url")
    rows = keep_items(rows, sources, outputs)
    again = F.col("_known").isNotNull() | (F.struct("source_id", "position") > F.col("_first"))
    inside = in_window(F.col("publish_time"), F.col("publish_time_status"), start, end)
    outcome = F.when(again, "duplicate").when(~inside, "outside_window").when(~F.coalesce("keep", F.lit(False)), "not_ai").otherwise("new")
    return rows.withColumn("outcome", outcome).drop("_known", "_first", "keep", "reason")


def ingest_stats(labelled: DataFrame) -> DataFrame:
    """Per source: candidates and how many had each outcome."""
    count = lambda x: F.count_if(F.col("outcome") == x)
    return labelled.groupBy("source_id").agg(F.count(F.lit(1)).alias("candidates"), count("new").alias("new_items"), count("duplicate").alias("duplicates"), count("outside_window").alias("outside_window"), count("not_ai").alias("not_ai"))


def stored_rows(labelled: DataFrame, run_at: dt.datetime) -> DataFrame:
    """The rows that the new items become, with fingerprint, word count, summary and cache expiry."""
    body = F.coalesce(F.nullif(F.col("clean_text"), F.lit("")), F.nullif(F.col("summary"), F.lit("")), F.col("title"))
    now = F.lit(str(run_at)).cast("timestamp_ntz")
    return (
        labelled.where("outcome = 'new'")
        # before the summary is filled in: the body is what was collected
        .withColumn("content_fingerprint", fingerprint(body))
        .withColumn("word_count", F.length(body))
        .withColumn("summary", F.coalesce(F.when(F.col("summary") != "", F.col("summary")), summary_chars(body)))
        .withColumn("crawl_time", now)
        .withColumn("expire_at", now + F.expr(f"interval {CACHE_HOURS} hours"))
        .withColumn("extraction_status", F.lit("processed"))
        .withColumn("llm_status", F.lit("pending"))
        .drop("outcome")
    )


def rule_tags(rows: DataFrame, key: str = "content_id") -> DataFrame:
    """(key, tag_key, tag_value): category and priority of the source, and the content type that the category implies."""
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv)), F.col("source_category"))
    tags = F.array(
        F.struct(F.lit("source_category").alias("tag_key"), F.col("source_category").alias("tag_value")),
        F.struct(F.lit("priority").alias("tag_key"), (F.col("priority") if "priority" in rows.columns else F.lit(None).cast("string")).alias("tag_value")),
        F.struct(F.lit("content_type").alias("tag_key"), kind.alias("tag_value")),
    )
    return rows.select(key, F.explode(tags).alias("t")).select(key, "t.*").where(F.coalesce(F.trim("tag_value"), F.lit("")) != "")


def ingest(items: DataFrame, contents: DataFrame, sources: DataFrame, run_at: dt.datetime, outputs: DataFrame | None = None, cache_hours: int = CACHE_HOURS) -> dict[str, DataFrame]:
    """The whole run over extracted items (source_id, position, url, title, summary, clean_text, publish_time,
    publish_time_status): new ones inside the window that are worth keeping become contents.

    Returns contents (the new rows, keyed by canonical_url), cache (their texts, which expire after cache_hours), tags
    and stats by source. The rows' own content_cache_until always counts CACHE_HOURS."""
    from newsdesk.sources.shared import stored

    labelled = stored(label_items(items, contents, sources, run_at, outputs), "labelled")
    rows = stored_rows(labelled, run_at)
    expire = F.lit(str(run_at)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(cache_hours))
    cache = rows.where(F.coalesce("clean_text", F.lit("")) != "").select("canonical_url", "clean_text", expire.alias("expire_at"))
    return {"contents": rows.withColumnRenamed("expire_at", "content_cache_until"), "cache": cache, "tags": rule_tags(rows, "canonical_url"), "stats": ingest_stats(labelled)}


def error_rows(rows: DataFrame, failed: Column, message: Column, run_id: int, at: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(good, errors): rows that fail become error records, the others go on."""
    bad = rows.where(failed).select("source_id", F.lit(run_id).alias("crawl_run_id"), F.lit("extract").alias("error_type"), message.alias("message"), "url", F.lit(str(at)).cast("timestamp_ntz").alias("occurred_at"))
    return rows.where(~F.coalesce(failed, F.lit(False))), bad


def update_error_counts(sources: DataFrame, outcomes: DataFrame) -> DataFrame:
    """sources with error_count one higher after a failed run and 0 after a good one. outcomes: (source_id, failed)."""
    last = outcomes.groupBy("source_id").agg(F.bool_or("failed").alias("_failed"))
    rows = sources.join(last, "source_id", "left")
    count = F.when(F.col("_failed"), F.col("error_count") + 1).when(~F.col("_failed"), 0).otherwise(F.col("error_count"))
    return rows.withColumn("error_count", count).drop("_failed")
