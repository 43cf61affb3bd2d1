"""Deduplication, anti joins and nested views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def new_items(items: DataFrame, contents: DataFrame, order: Column) -> DataFrame:
    """Items whose canonical_url is not stored yet; of several with one URL the first in order."""
    return first_of(items, ["canonical_url"], [order]).join(contents.select("canonical_url"), "canonical_url", "left_anti")


def content_view(contents: DataFrame, tags: DataFrame, entities: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """contents with sorted arrays of tags and entities and the cached body; bridges are aggregated before they are joined."""
    t = tags.groupBy("content_id").agg(F.sort_array(F.collect_list(F.struct("tag_key", "tag_value"))).alias("tags"))
    out = contents.join(t, "content_id", "left").withColumn("tags", F.coalesce("tags", F.expr("cast(array() as array<struct<tag_key:string,tag_value:string>>)")))
    if entities is not None:
        e = entities.groupBy("content_id").agg(F.sort_array(F.collect_list(F.struct("entity_type", "name"))).alias("entities"))
        out = out.join(e, "content_id", "left").withColumn("entities", F.coalesce("entities", F.expr("cast(array() as array<struct<entity_type:string,name:string>>)")))
    if cache is not None:
        out = out.join(cache.select("content_id", F.col("clean_text").alias("body")), "content_id", "left")
    return out


def event_view(events: DataFrame, links: DataFrame, contents: DataFrame) -> DataFrame:
    """events with their sources, the primary one first, then by link id."""
    named = links.join(contents.select("content_id", "title", "url", "source_name"), "content_id")
    listed = named.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct((~F.col("is_primary_source")).alias("secondary"), "event_content_id", "content_id", "title", "url", "source_name"))).alias("sources"))
    return events.join(listed, "event_id", "left")


def watch_targets(watch: DataFrame, events: DataFrame, contents: DataFrame) -> DataFrame:
    """watch with title and summary of the target, and whether it still exists."""
    targets = events.select(F.lit("financing_event").alias("target_type"), F.col("event_id").alias("target_id"), F.col("event_title").alias("title"), F.col("event_summary").alias("summary"))
    targets = targets.unionByName(contents.select(F.lit("content").alias("target_type"), F.col("content_id").alias("target_id"), "title", "summary"))
    return watch.join(targets.withColumn("target_available", F.lit(True)), ["target_type", "target_id"], "left").withColumn("target_available", F.coalesce("target_available", F.lit(False)))


def watch_view(watch: DataFrame, events: DataFrame, contents: DataFrame, today: dt.date) -> DataFrame:
    """watch_targets() with is_due: an unfinished item whose date has come."""
    due = (F.col("status") != "completed") & (F.col("next_review_date") <= F.lit(today))
    return watch_targets(watch, events, contents).withColumn("is_due", due)


def exclude_contents(tags: DataFrame, contents: DataFrame, ids: DataFrame) -> DataFrame:
    """tags with the mark that keeps the named contents out of financing reports, once each."""
    wanted = ids.where("content_id > 0").select("content_id").distinct().join(contents.select("content_id"), "content_id", "left_semi")
    marked = tags.where("tag_key = 'manual_financing_status' and tag_value = 'excluded'").select("content_id")
    fresh = wanted.join(marked, "content_id", "left_anti").select("content_id", F.lit("manual_financing_status").alias("tag_key"), F.lit("excluded").alias("tag_value"))
    return tags.unionByName(fresh, allowMissingColumns=True)


def attach_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """tags with the new ones (content_id, tag_key, tag_value): blank values are ignored, one of each stays, stored ones first."""
    keys = ["content_id", "tag_key", "tag_value"]
    fresh = new.where(F.trim("tag_value") != "").dropDuplicates(keys).join(tags, keys, "left_anti")
    return tags.unionByName(fresh, allowMissingColumns=True)


def attach_definitions(definitions: DataFrame, tags: DataFrame) -> DataFrame:
    """definitions (tag_id, tag_key, tag_value, enabled) with enabled ones for the pairs of tags that have none. New ids
    follow the largest; there are as many as distinct new pairs."""
    fresh = tags.where(F.trim("tag_value") != "").select("tag_key", "tag_value").distinct().join(definitions, ["tag_key", "tag_value"], "left_anti")
    top = definitions.agg(F.coalesce(F.max("tag_id"), F.lit(0))).first()[0]
    made = fresh.withColumn("tag_id", (F.row_number().over(Window.orderBy("tag_key", "tag_value")) + top).cast("long")).withColumn("enabled", F.lit(True))
    return definitions.unionByName(made.select(*(c for c in made.columns if c in definitions.columns)), allowMissingColumns=True)


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], columns: list[str], insert_only: list[str] = [], renames: dict[str, dict[str, str]] | None = None) -> DataFrame:  # noqa: B006
    """Rows of updates replace `columns` of the rows with their keys and are inserted where there is none; the
    columns in insert_only are set on insertion alone, so values that users edited stay. renames: for a key, the names
    that rows of target may still have, and what they are called now."""
    for key, names in (renames or {}).items():
        now = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
        target = target.withColumn(key, F.coalesce(F.try_element_at(now, F.col(key)), F.col(key)))
    u = updates.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns + insert_only), F.lit(True).alias("_hit"))
    joined = target.withColumn("_old", F.lit(True)).join(u, keys, "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in columns:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c in insert_only:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)
