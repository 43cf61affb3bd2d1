"""Filters and predicates on content, events and links."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions.terms import Terms
from newsdesk.functions.text import collapse, contains_any, first_chars
from newsdesk.functions.times import in_window

#: Source categories by what their items are.
ARTICLE_CATEGORIES = ("venture_media", "ai_media", "tech_business_media", "official_news", "official_research")
INTRINSIC_CATEGORIES = ("ai_media", "official_news", "official_research")
INTRINSIC_HOSTS = ("openai.com", "anthropic.com", "qbitai.com", "a16z.com")
#: Words that show that a text is about AI, and about financing.
AI_WORDS = (
    "人工智能", "生成式", "大模型", "基础模型", "多模态", "智能体", "算力", "推理", "训练", "语料", "机器人", "具身智能", "自动驾驶",
    "ai infra", "ai agent", "aigc", "llm", "rag", "mcp", "gpu", "openai", "anthropic", "deepseek", "claude", "gemini", "chatgpt", "copilot",
)
FINANCING_WORDS = ("融资", "投资", "领投", "跟投", "参投", "募资", "并购", "收购", "funding", "financing", "investment", "raised", "raises", "round", "seed", "series")

AI_TERMS, FINANCING_TERMS = Terms(AI_WORDS), Terms(FINANCING_WORDS)


def like(c: Column, query: str) -> Column:
    """Case-insensitive substring test in which % and _ of the query are wildcards."""
    return c.ilike(f"%{query.strip()}%")


def search_contents(contents: DataFrame, tags: DataFrame | None = None, entities: DataFrame | None = None, query: str = "", source_id: int | None = None, status: str = "", limit: int | None = 300) -> DataFrame:
    """Rows whose title, summary or source name, or a tag or entity of theirs, holds the query; newest first."""
    out = contents
    if source_id is not None:
        out = out.where(F.col("source_id") == source_id)
    if status:
        out = out.where(F.col("extraction_status") == status)
    if query.strip():
        found = F.coalesce(like(F.col("title"), query) | like(F.col("summary"), query) | like(F.col("source_name"), query), F.lit(False))
        hits = [tags.where(like(F.col("tag_key"), query) | like(F.col("tag_value"), query)).select("content_id")] if tags is not None else []
        if entities is not None:
            hits.append(entities.where(like(F.col("name"), query)).select("content_id"))
        if hits:
            named = hits[0].unionByName(hits[-1]) if len(hits) > 1 else hits[0]
            out = out.join(named.select("content_id", F.lit(True).alias("_named")).distinct(), "content_id", "left").where(found | F.col("_named").isNotNull()).drop("_named")
        else:
            out = out.where(found)
    out = out.orderBy(F.desc("crawl_time"), F.desc("content_id"))
    return out if limit is None else out.limit(limit)


def financing_contents(contents: DataFrame, tags: DataFrame) -> DataFrame:
    """AI-related items tagged as financing of high relevance and not excluded by hand."""

    def tagged(key: str, value: str) -> Column:
        return F.bool_or((F.col("tag_key") == key) & (F.col("tag_value") == value))

    kinds = tags.where(F.col("tag_key").isin("content_type", "ai_financing_relevance", "manual_financing_status")).groupBy("content_id")
    marks = kinds.agg(tagged("content_type", "financing").alias("financing"), tagged("ai_financing_relevance", "high").alias("high"), tagged("manual_financing_status", "excluded").alias("excluded"))
    return contents.where(F.col("ai_related").eqNullSafe(True)).join(marks.where("financing and high and not excluded").select("content_id"), "content_id", "left_semi")


def keyword_ai_related(title: Column, summary: Column, body: Column) -> Column:
    text = F.lower(collapse(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")), first_chars(body, 1200))))
    return text.rlike("(?<![a-z])ai(?![a-z])") | AI_TERMS.any_of(AI_TERMS.found(text), AI_WORDS)


def keep_items(items: DataFrame, sources: DataFrame, outputs: DataFrame | None = None) -> DataFrame:
    """items with keep, ai_related and reason. outputs: (url, ai_related) of a model, if there is one."""
    s = sources.select("source_id", "source_category", F.lower(F.regexp_extract("source_url", r"^[a-z]+://([^/?#]+)", 1)).alias("_host")) if "source_url" in sources.columns else sources.select("source_id", "source_category", F.lit("").alias("_host"))
    rows = items.drop("source_category").join(s, "source_id", "left")
    rows = rows.join(outputs.select("url", F.col("ai_related").alias("_model")), "url", "left") if outputs is not None else rows.withColumn("_model", F.lit(None).cast("boolean"))
    article = F.coalesce(F.col("source_category").isin(*ARTICLE_CATEGORIES), F.lit(False))
    own = F.coalesce(F.col("source_category").isin(*INTRINSIC_CATEGORIES), F.lit(False)) | contains_any(F.col("_host"), INTRINSIC_HOSTS)
    words = keyword_ai_related(F.col("title"), F.col("summary"), F.col("clean_text"))
    reason = F.when(~article, "signal_source").when(own, "intrinsic_source").when(F.col("_model").isNotNull(), "model").when(words, "keywords").otherwise("not_ai")
    keep = F.when(F.col("_model").isNotNull() & article & ~own, F.col("_model")).otherwise(reason != "not_ai")
    flag = F.when(F.col("reason").isin("intrinsic_source", "keywords"), True)
    return rows.withColumn("reason", reason).withColumn("keep", keep).withColumn("ai_related", flag).drop("_host", "_model")


def is_financing_candidate(title: Column, summary: Column, tags: Column, model_type: Column | None = None) -> Column:
    """tags: array of (tag_key, tag_value)."""
    signal = F.exists(tags, lambda t: ((t["tag_key"] == "content_type") & (t["tag_value"] == "financing")) | ((t["tag_key"] == "ai_financing_relevance") & (t["tag_value"] == "high")))
    found = F.coalesce(signal, F.lit(False)) | FINANCING_TERMS.any_of(FINANCING_TERMS.found(F.lower(F.concat_ws(" ", title, F.coalesce(summary, F.lit(""))))), FINANCING_WORDS)
    return found if model_type is None else found | F.coalesce(model_type == "financing", F.lit(False))


def source_window_flags(items: DataFrame, start: Column, end: Column) -> DataFrame:
    """items with in_window and before_window; a date-only row of the first day is not before."""
    ts, whole = F.col("publish_time"), F.coalesce(F.col("publish_time_status") == "date_only", F.lit(False))
    before = F.coalesce((ts < start) & ~(whole & (F.to_date(ts) == F.to_date(start))), F.lit(False))
    return items.withColumn("in_window", in_window(ts, F.col("publish_time_status"), start, end)).withColumn("before_window", before)


#: Positions of a source that are one block of the streak's scan.
STREAK_BLOCK = 4_096


def cut_after_older_streak(links: DataFrame, streak: int = 10, block: int = STREAK_BLOCK) -> DataFrame:
    """links (source_id, position, in_window, before_window) up to the item at which `streak` older ones have come
    since the last one inside the window; items that are neither do not start the count anew.

    A source is dealt into blocks of positions, so that it spreads over tasks. A block is summed up by whether it has an
    item inside the window, by its older items before the first and behind the last of these, and blocks behind
    one another are summed up alike: that gives the older items that stand before each block, and so each stop."""
    at = F.floor(F.col("position") / block).alias("_block")
    flags = F.col("in_window").cast("int"), F.col("before_window").cast("int")
    order = Window.partitionBy("source_id", "_block").orderBy("position")
    rows = links.select("*", at).withColumn("_island", F.sum(flags[0]).over(order))
    rows = rows.withColumn("_older", F.sum(flags[1]).over(Window.partitionBy("source_id", "_block", "_island").orderBy("position")))
    # the older items of a block's first stretch, of its last one, and whether these are two
    first, last = F.coalesce(F.max(F.when(F.col("_island") == 0, F.col("_older"))), F.lit(0)), F.max_by("_older", F.struct("_island", "position"))
    blocks = rows.groupBy("source_id", "_block").agg((F.max("_island") > 0).alias("broken"), first.alias("first"), last.alias("last"))
    listed = blocks.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("_block", "broken", "first", "last"))).alias("b"))
    start = F.struct(F.lit(0).cast("long").alias("open"), F.expr("cast(array() as array<struct<_block:bigint,_open:bigint>>)").alias("out"))

    def pass_on(state: Column, b: Column) -> Column:
        after = F.when(b["broken"], b["last"]).otherwise(state["open"] + b["first"])
        return F.struct(after.alias("open"), F.concat(state["out"], F.array(F.struct(b["_block"], state["open"].alias("_open")))).alias("out"))

    opened = listed.select("source_id", F.explode(F.aggregate("b", start, pass_on)["out"]).alias("o")).select("source_id", "o.*")
    counted = rows.join(opened, ["source_id", "_block"]).withColumn("_older", F.col("_older") + F.when(F.col("_island") == 0, F.col("_open")).otherwise(0))
    stops = counted.where(F.col("_older") >= streak).groupBy("source_id").agg(F.min("position").alias("_stop"))
    return links.join(stops, "source_id", "left").where("_stop is null or position <= _stop").drop("_stop")


def purge_expired(rows: DataFrame, ts: str, days: int, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(kept, purged): rows older than `days` before as_of are purged; rows without a time stay."""
    old = F.coalesce(F.col(ts) < F.lit(str(as_of - dt.timedelta(days=days))).cast("timestamp_ntz"), F.lit(False))
    return rows.where(~old), rows.where(old)


def llm_backlog(contents: DataFrame, limit: int) -> DataFrame:
    """The newest items that wait for the model; the limit is held between 1 and 100."""
    return contents.where(F.col("llm_status").isin("not_configured", "pending")).orderBy(F.desc("crawl_time"), F.desc("content_id")).limit(max(1, min(100, limit)))


def reset_backlog(contents: DataFrame) -> DataFrame:
    return contents.withColumn("llm_status", F.when(F.col("llm_status") == "not_configured", "pending").otherwise(F.col("llm_status")))


def query_events(events: DataFrame, status: str = "", company: str = "", start: dt.date | None = None, end: dt.date | None = None, least_confidence: float | None = None) -> DataFrame:
    """Events under the filters, latest announcement first; page with offset() and limit()."""
    out = events
    if status:
        out = out.where(F.col("review_status") == status)
    if company:
        out = out.where(like(F.col("company_name"), company))
    if start is not None:
        out = out.where(F.col("announced_date") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("announced_date") <= F.lit(end))
    if least_confidence is not None:
        out = out.where(F.col("confidence") >= least_confidence)
    return out.orderBy(F.desc("announced_date"), F.desc("event_id"))


def event_page(events: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of query_events() with the total of rows that qualify."""
    total = events.agg(F.count(F.lit(1)).alias("total"))
    page = events.orderBy(F.desc("announced_date"), F.desc("event_id")).offset(max(offset, 0)).limit(max(1, min(200, limit)))
    return page.crossJoin(F.broadcast(total))  # one row


def report_candidates(contents: DataFrame, start: Column, end: Column) -> DataFrame:
    """Published from the first day's midnight on, or crawled inside the window."""
    midnight = F.to_date(start).cast("timestamp_ntz")
    published = (F.col("publish_time") >= midnight) & (F.col("publish_time") < end)
    crawled = (F.col("crawl_time") >= start) & (F.col("crawl_time") < end)
    return contents.where(published | crawled)
