"""Tags, entities and edits of contents, as table-to-table jobs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions.text import collapse, summary_chars
from newsdesk.operators.joins import attach_definitions, attach_tags

#: Kinds of entities.
ENTITY_TYPES = ("company", "investor", "person", "organization", "product", "model")


def attach_entities(entities: DataFrame, links: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, links). new: (content_id, entity_type, name): known types and names that are not blank; entities are
    made for unknown names, with ids after the largest, and a content is linked to an entity once."""
    n = new.where(F.col("entity_type").isin(*ENTITY_TYPES)).withColumn("name", collapse(F.col("name"))).where("name <> ''").select("content_id", "entity_type", "name").distinct()
    names = n.select("entity_type", F.col("name").alias("canonical_name")).distinct().join(entities.select("entity_type", "canonical_name"), ["entity_type", "canonical_name"], "left_anti")
    top = entities.agg(F.coalesce(F.max("entity_id"), F.lit(0))).first()[0]
    made = names.withColumn("entity_id", (F.row_number().over(Window.orderBy("entity_type", "canonical_name")) + top).cast("long"))
    every = entities.unionByName(made, allowMissingColumns=True)
    fresh = n.join(every.select("entity_id", "entity_type", F.col("canonical_name").alias("name")), ["entity_type", "name"]).select("content_id", "entity_id").distinct().join(links, ["content_id", "entity_id"], "left_anti")
    return every, links.unionByName(fresh, allowMissingColumns=True)


def apply_metadata(contents: DataFrame, tags: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contents, tags) after model outputs (content_id, summary, ai_related, content_type, relevance, sectors, regions).

    A relevance of high or none replaces the stored one; other values leave it; sector and region are arrays."""
    o = outputs.select("content_id", summary_chars(F.col("summary")).alias("_summary"), F.col("ai_related").alias("_ai"), F.lower(F.trim("relevance")).alias("_rel"), collapse(F.col("content_type")).alias("_type"), "sectors", "regions")
    rows = contents.join(o.select("content_id", "_summary", "_ai", F.lit(True).alias("_hit")), "content_id", "left")
    rows = rows.withColumn("summary", F.when(F.coalesce("_summary", F.lit("")) != "", F.col("_summary")).otherwise(F.col("summary"))).withColumn("ai_related", F.when(F.col("_hit"), F.col("_ai")).otherwise(F.col("ai_related")))
    replaced = o.where(F.col("_rel").isin("high", "none")).select("content_id", F.lit("ai_financing_relevance").alias("tag_key"))
    kept = tags.join(replaced, ["content_id", "tag_key"], "left_anti")
    pair = lambda k, v: F.struct(F.lit(k).alias("tag_key"), v.alias("tag_value"))
    single = F.array(pair("content_type", F.col("_type")), pair("ai_financing_relevance", F.when(F.col("_rel").isin("high", "none"), F.col("_rel"))))
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("sectors", "regions")]
    sectors, regions = (F.transform(c, _pair(k)) for c, k in zip(lists, ("sector", "region"), strict=True))
    new = o.select("content_id", F.explode(F.concat(single, sectors, regions)).alias("t")).select("content_id", "t.tag_key", collapse(F.col("t.tag_value")).alias("tag_value"))
    return rows.select(*contents.columns), attach_tags(kept, new)


def _pair(key: str):
    return lambda v: F.struct(F.lit(key).alias("tag_key"), v.alias("tag_value"))


def apply_content_edits(contents: DataFrame, commands: DataFrame, at: dt.datetime) -> DataFrame:
    """contents after (content_id, seq, title, summary, extraction_status, toggle_favorite): the last value that is set
    wins; an odd number of toggles turns the favourite over."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}")
    folded = commands.groupBy("content_id").agg(last("title"), last("summary"), last("extraction_status"), F.count_if("toggle_favorite").alias("_toggles"))
    rows = contents.join(folded, "content_id", "left")
    for c in ("title", "summary", "extraction_status"):
        rows = rows.withColumn(c, F.coalesce(f"_{c}", c))
    odd = F.coalesce(F.col("_toggles") % 2 == 1, F.lit(False))
    rows = rows.withColumn("favorite", F.coalesce("favorite", F.lit(False)) != odd)
    if "favorite_at" in contents.columns:
        rows = rows.withColumn("favorite_at", F.when(odd & F.col("favorite"), F.lit(str(at)).cast("timestamp_ntz")).when(odd, None).otherwise(F.col("favorite_at")))
    return rows.select(*contents.columns)


def manual_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """tags with those that a person set (content_id, tag_key, tag_value): certain, and marked as manual."""
    return attach_tags(tags, new.withColumn("confidence", F.lit(1.0)).withColumn("source", F.lit("manual")))


def edit_definitions(definitions: DataFrame, new: DataFrame, toggles: DataFrame) -> DataFrame:
    """definitions (tag_id, tag_key, tag_value, enabled) after new ones (key and value are required) and toggles (tag_key,
    tag_value, enabled), one of a definition."""
    wanted = new.where((F.trim("tag_key") != "") & (F.trim("tag_value") != ""))
    every = attach_definitions(definitions, wanted)
    switched = toggles.select("tag_key", "tag_value", F.col("enabled").alias("_enabled")).dropDuplicates(["tag_key", "tag_value"])
    rows = every.join(switched, ["tag_key", "tag_value"], "left").withColumn("enabled", F.coalesce("_enabled", "enabled"))
    return rows.select(*definitions.columns)


def apply_aliases(aliases: DataFrame, commands: DataFrame) -> DataFrame:
    """aliases (entity_id, alias) with the new ones that are not blank, once each."""
    fresh = commands.select("entity_id", collapse(F.col("alias")).alias("alias")).where("alias <> ''").distinct()
    return aliases.unionByName(fresh.join(aliases, ["entity_id", "alias"], "left_anti"), allowMissingColumns=True)


def apply_taxonomy_edits(entities: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, rejected): renames and changes of type (entity_id, canonical_name, entity_type, both optional). A
    change that would give two entities one type and name is rejected."""
    c = commands.select("entity_id", F.col("canonical_name").alias("_name"), F.col("entity_type").alias("_type"), F.lit(True).alias("_hit"))
    rows = entities.join(c, "entity_id", "left").withColumn("_n", F.coalesce("_name", "canonical_name")).withColumn("_t", F.coalesce("_type", "entity_type"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("_t", "_n")) > 1
    rows = rows.withColumn("_bad", F.coalesce("_hit", F.lit(False)) & twice)
    new = rows.withColumn("canonical_name", F.when(F.col("_bad"), F.col("canonical_name")).otherwise(F.col("_n"))).withColumn("entity_type", F.when(F.col("_bad"), F.col("entity_type")).otherwise(F.col("_t")))
    return new.select(*entities.columns), rows.where("_bad").select("entity_id", F.lit("duplicate entity").alias("reason"))


def delete_or_disable(sources: DataFrame, contents: DataFrame, ids: DataFrame) -> DataFrame:
    """sources without the named ones that have no contents; those that have are disabled."""
    named = ids.select("source_id", F.lit(True).alias("_named")).distinct()
    used = contents.select("source_id", F.lit(True).alias("_used")).distinct()
    rows = sources.join(named, "source_id", "left").join(used, "source_id", "left").where("_named is null or _used")
    return rows.withColumn("enabled", F.when(F.col("_named"), False).otherwise(F.col("enabled"))).select(*sources.columns)


def list_tags(tags: DataFrame) -> DataFrame:
    return tags.orderBy("tag_key", "tag_value")


def list_entities(entities: DataFrame, limit: int = 500) -> DataFrame:
    return entities.orderBy("entity_type", "canonical_name").limit(max(1, min(2000, limit)))
