"""Aggregations, latest-of-group rows, rankings and date spines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsdesk.functions.text import redact
from newsdesk.functions.times import day_of

#: Sections of the daily summary, and the order of sources on the dashboard.
SECTIONS = {
    "venture_media": "中文投融资 / 创投信息",
    "ai_media": "中文 AI 垂直媒体",
    "tech_business_media": "中文科技商业媒体",
    "official_news": "海外官方新闻 / 研究更新",
    "official_research": "海外官方新闻 / 研究更新",
    "github": "GitHub Trending Daily",
    "product_hunt": "Product Hunt 今日榜单",
    "hacker_news": "Hacker News Top 20",
}
OTHER_SECTION = "其他内容"
CATEGORY_ORDER = ("venture_media", "ai_media", "tech_business_media", "official_news", "official_research", "ai_research_signal", "ai_product_signal", "startup_directory", "github", "product_hunt", "hacker_news")


def _lookup(c: Column, values: dict, rest) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(rest))


def section_of(category: Column) -> Column:
    return _lookup(F.coalesce(category, F.lit("")), SECTIONS, OTHER_SECTION)


def category_rank(category: Column) -> Column:
    return _lookup(F.coalesce(category, F.lit("")), {c: k for k, c in enumerate(CATEGORY_ORDER)}, 99)


def daily_summary(contents: DataFrame) -> DataFrame:
    """Per crawl day: total, failed, partial and other items."""
    bad = lambda s: F.count_if(F.col("extraction_status") == s)
    out = contents.where("crawl_time is not null").groupBy(F.to_date("crawl_time").alias("day")).agg(F.count(F.lit(1)).alias("total_items"), bad("failed").alias("failed_items"), bad("partial").alias("partial_items"))
    return out.withColumn("successful_items", F.col("total_items") - F.col("failed_items") - F.col("partial_items"))


def daily_source_counts(contents: DataFrame) -> DataFrame:
    """Per crawl day: items of each source and each section."""
    return contents.where("crawl_time is not null").groupBy(F.to_date("crawl_time").alias("day"), section_of(F.col("source_category")).alias("section"), "source_name").agg(F.count(F.lit(1)).alias("items"))


def daily_sections(contents: DataFrame) -> DataFrame:
    """(day, section, items): the items of each section of the daily summary, by source category and newest first."""
    late = (-F.unix_micros(F.to_utc_timestamp("crawl_time", F.current_timezone()))).alias("late")
    item = F.struct("source_category", late, "content_id", "title", "source_name", "summary")
    rows = contents.where("crawl_time is not null").groupBy(F.to_date("crawl_time").alias("day"), section_of(F.col("source_category")).alias("section"))
    return rows.agg(F.array_sort(F.collect_list(item)).alias("items"))


def last_summary(contents: DataFrame) -> DataFrame:
    """The daily summary of the latest crawl day."""
    return daily_summary(contents).orderBy(F.desc("day")).limit(1)


def dashboard_counts(contents: DataFrame, sources: DataFrame, day: dt.date) -> DataFrame:
    """One row: contents, contents of the day, enabled sources, sources with errors."""
    c = contents.agg(F.count(F.lit(1)).alias("contents"), F.count_if(F.to_date("crawl_time") == F.lit(day)).alias("contents_today"))
    s = sources.agg(F.count_if("enabled").alias("enabled_sources"), F.count_if(F.col("error_count") > 0).alias("sources_with_errors"))
    return c.crossJoin(s)  # two frames of one row


def financing_counts(financing: DataFrame, day: dt.date, today: dt.date) -> DataFrame:
    d = F.to_date("crawl_time")
    return financing.agg(F.count_if(d == F.lit(day)).alias("selected"), F.count_if(d == F.lit(today)).alias("today"), F.count(F.lit(1)).alias("total"))


def financing_dates(financing: DataFrame, limit: int = 60) -> DataFrame:
    """The latest crawl dates with financing items; the limit is held between 1 and 365."""
    return financing.groupBy(F.to_date("crawl_time").alias("day")).agg(F.count(F.lit(1)).alias("items")).orderBy(F.desc("day")).limit(max(1, min(365, limit)))


def llm_status_counts(contents: DataFrame) -> DataFrame:
    return contents.groupBy(F.coalesce("llm_status", F.lit("unknown")).alias("llm_status")).agg(F.count(F.lit(1)).alias("items"))


def normalize_run_status(status: Column, failed: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("success")))
    named = F.when(s.isin("partial", "partial_success", "warning", "degraded"), "partial").when(s.isin("failed", "error"), "failed").otherwise("success")
    return F.when((F.coalesce(failed, F.lit(0)) > 0) & (named == "success"), "partial").otherwise(named)


def rollup_runs(runs: DataFrame, *keys: Column) -> DataFrame:
    """Runs of sources rolled up: totals, succeeded and failed sources, and the status that follows from them."""
    failed = F.count_if(F.col("failed_items") > 0)
    out = runs.groupBy(*keys).agg(F.sum("new_items").alias("new_items"), F.sum("failed_items").alias("failed_items"), F.count(F.lit(1)).alias("attempted"), failed.alias("failed_sources"))
    return out.withColumn("succeeded", F.col("attempted") - F.col("failed_sources")).withColumn("status", F.when(F.col("failed_items") == 0, "success").otherwise("partial_success"))


def failed_names(runs: DataFrame, *keys: Column) -> DataFrame:
    """(keys, names): distinct names of the sources that failed, in the order of the runs (started_at, crawl_run_id)."""
    rows = runs.where("failed_items > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("started_at", "crawl_run_id", "source_name"))).alias("m"))
    return rows.withColumn("names", F.array_distinct(F.col("m.source_name"))).drop("m")


def run_summaries(runs: DataFrame) -> DataFrame:
    """runs with their normalised status, counts without nulls, and warnings: the message of a run that is no success,
    and the names of the sources that failed (an array failed_names, if runs has one), both without secrets."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in runs.columns else F.lit(0).cast("long")
    status = normalize_run_status(F.col("status"), zero("failed_items"))
    told = F.when((status != "success") & (F.coalesce("message", F.lit("")) != ""), redact(F.col("message"))) if "message" in runs.columns else F.lit(None).cast("string")
    names = F.when(F.size("failed_names") > 0, F.concat(F.lit("failed sources: "), F.array_join(F.transform("failed_names", lambda x: redact(x)), ", "))) if "failed_names" in runs.columns else F.lit(None).cast("string")
    warnings = F.filter(F.array(told, names), lambda x: x.isNotNull())
    counts = F.struct(*(zero(c).alias(c) for c in ("total_items", "new_items", "failed_items")))
    return runs.select("crawl_run_id", status.alias("status"), counts.alias("counts"), warnings.alias("warnings"))


def rollup_jobs(jobs: DataFrame) -> DataFrame:
    """jobs (completed, failed, total) with succeeded and percent; an idle job is at 100."""
    done = F.greatest(F.lit(0), F.col("completed") - F.col("failed"))
    percent = F.when(F.col("total") > 0, F.floor(100 * F.col("completed") / F.col("total"))).otherwise(100)
    return jobs.withColumn("succeeded", done).withColumn("percent", percent.cast("int"))


def latest_run_per_day(runs: DataFrame) -> DataFrame:
    """The newest parent run (without a source) of each day."""
    newest = Window.partitionBy("day").orderBy(F.desc("started_at"), F.desc("crawl_run_id"))
    return runs.where("source_id is null").withColumn("day", F.to_date("started_at")).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def date_spine(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    return spark.sql("select explode(sequence({a}, {b})) as day".replace("{a}", f"date'{start}'").replace("{b}", f"date'{end}'"))


def week_status(spark: SparkSession, runs: DataFrame, contents: DataFrame, target: dt.date, summaries: DataFrame | None = None) -> DataFrame:
    """Each day from Monday to the target: status of its latest run, whether any run of it completed, its contents, and
    whether it has a summary. summaries: (summary_date)."""
    monday = target - dt.timedelta(days=target.weekday())
    days = date_spine(spark, monday, target)
    start, end = (F.lit(str(dt.datetime.combine(d, dt.time()))).cast("timestamp_ntz") for d in (monday, target + dt.timedelta(days=1)))
    runs = runs.where((F.col("started_at") >= start) & (F.col("started_at") < end))
    contents = contents.where((F.col("crawl_time") >= start) & (F.col("crawl_time") < end))
    parents = runs.where("source_id is null").withColumn("day", F.to_date("started_at"))
    done = parents.groupBy("day").agg(F.bool_or(F.col("status").isin("success", "partial_success")).alias("completed"))
    latest = latest_run_per_day(runs).select("day", F.col("status").alias("latest_status"))
    counts = contents.groupBy(F.to_date("crawl_time").alias("day")).agg(F.count(F.lit(1)).alias("content_count"))
    out = days.join(done, "day", "left").join(latest, "day", "left").join(counts, "day", "left")
    if summaries is not None:
        held = summaries.select(F.col("summary_date").cast("date").alias("day"), F.lit(True).alias("_held")).where(F.col("day").between(F.lit(monday), F.lit(target))).distinct()
        out = out.join(held, "day", "left")
    has_summary = F.coalesce("_held", F.lit(False)) if summaries is not None else F.lit(False)
    return out.select("day", "latest_status", F.coalesce("completed", F.lit(False)).alias("completed"), has_summary.alias("has_summary"), F.coalesce("content_count", F.lit(0)).alias("content_count"))


def missing_dates(week: DataFrame) -> DataFrame:
    return week.select("day").join(week.where("completed").select("day"), "day", "left_anti")


def page_per_source(contents: DataFrame, sources: DataFrame, page: int = 1, size: int = 10) -> DataFrame:
    """A page of the newest items of each enabled source, with the source's totals and rank; a page beyond the last is the
    last. A source without contents has one empty page: a row without a place and a content."""
    shown = F.coalesce("publish_time", "crawl_time")
    s = sources.where("enabled").select("source_id", F.col("source_name").alias("name"), category_rank(F.col("source_category")).alias("source_rank"))
    totals = contents.groupBy("source_id").agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int"))
    # a constant bound on the place lets each task keep only its best rows of a source before they are shuffled
    best = F.row_number().over(Window.partitionBy("source_id").orderBy(shown.desc_nulls_last(), F.desc("content_id")))
    rows = contents.select("source_id", "content_id", "publish_time", "crawl_time").withColumn("place", best).where(F.col("place") <= page * size)
    every = s.join(totals, "source_id", "left").withColumn("total", F.coalesce("total", F.lit(0))).withColumn("pages", F.coalesce("pages", F.lit(1)))
    rows = every.join(rows, "source_id", "left")
    at = F.least(F.lit(page), F.col("pages"))
    return rows.where(F.col("place").isNull() | ((F.col("place") > (at - 1) * size) & (F.col("place") <= at * size))).select("source_id", "name", "source_rank", "total", "pages", "place", "content_id")


def latest_versions(versions: DataFrame) -> DataFrame:
    """The highest version of each report and the number that a new one would get."""
    newest = Window.partitionBy("report_id").orderBy(F.desc("version_number"))
    out = versions.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return out.withColumn("next_version", F.col("version_number") + 1)


def exportable_versions(versions: DataFrame) -> DataFrame:
    """The latest successful version of each report that is not blank."""
    return latest_versions(versions.where("generation_status = 'success' and trim(markdown_text) <> ''")).drop("next_version")


def export_versions(versions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exports, rejected). requests: (report_id, version_number): the named version of a report, or its latest one if
    none is named, is exported if it was generated and is not blank; else the request is rejected with a reason."""
    latest = versions.groupBy("report_id").agg(F.max("version_number").alias("_latest"))
    asked = requests.withColumnRenamed("version_number", "_asked").join(latest, "report_id", "left")
    asked = asked.withColumn("version_number", F.coalesce("_asked", "_latest")).drop("_latest")
    rows = asked.join(versions.select("report_id", "version_number", "generation_status", "markdown_text"), ["report_id", "version_number"], "left")
    good = F.coalesce(F.col("generation_status") == "success", F.lit(False))
    reason = F.when(~good, "no version to export").when(F.trim("markdown_text") == "", "the text is blank")
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").select("report_id", "version_number", "markdown_text", F.lit("exported").alias("status")), judged.where("reason is not null").select("report_id", F.col("_asked").alias("version_number"), "reason")


def priority_rank(c: Column) -> Column:
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def rank_watch_items(items: DataFrame, sort: str = "next_review", *ties: Column) -> DataFrame:
    """Follow-ups first, dated before undated, then date, priority and latest update; or by priority; or by update. ties
    order what is equal so far."""
    rank, latest, date = priority_rank(F.col("priority")), F.desc("updated_at"), F.col("next_review_date")
    if sort == "priority":
        return items.orderBy(rank, date, latest, *ties)
    if sort == "updated_at":
        return items.orderBy(latest, *ties)
    return items.orderBy(F.when(F.col("status") == "follow_up", 0).otherwise(1), F.when(date.isNull(), 1).otherwise(0), date, rank, latest, *ties)


def watch_due(items: DataFrame, today: dt.date) -> DataFrame:
    """Follow-ups whose date has come; order by date and then priority as text, as callers show the first few."""
    return items.where((F.col("status") == "follow_up") & (F.col("next_review_date") <= F.lit(today))).orderBy("next_review_date", "priority")


def assign_daily_windows(contents: DataFrame) -> DataFrame:
    """A row per item and report day: one day for exact times, two for dates without a time."""
    ts = F.coalesce("publish_time", "crawl_time")
    whole = F.col("publish_time").isNotNull() & (F.lower("publish_time_status") == "date_only")
    days = F.when(whole, F.array(F.to_date(ts), F.date_add(F.to_date(ts), 1))).otherwise(F.array(day_of(ts)))
    return contents.where(ts.isNotNull()).withColumn("report_date", F.explode(days))


def latest_success(manifests: DataFrame) -> DataFrame:
    """The newest successful run of each target date; partial runs do not count."""
    newest = Window.partitionBy("target_date").orderBy(F.desc("started_at"), F.desc("run_id"))
    return manifests.where("status = 'success'").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def pointed_success(manifests: DataFrame, pointers: DataFrame) -> DataFrame:
    """latest_success(), but the run that a date's pointer (target_date, run_id) names goes first if it succeeded."""
    good = manifests.where("status = 'success'")
    named = good.join(pointers.select("target_date", "run_id"), ["target_date", "run_id"], "left_semi")
    others = latest_success(manifests).join(named.select("target_date"), "target_date", "left_anti")
    return named.dropDuplicates(["target_date"]).unionByName(others)


def manifest_notes(manifests: DataFrame) -> DataFrame:
    """manifests with counts (a map of text) as whole numbers, others left out, and warnings trimmed, not blank, once each."""
    numbers = F.map_filter(F.transform_values("counts", lambda k, v: v.try_cast("bigint")), lambda k, v: v.isNotNull())
    told = F.array_distinct(F.filter(F.transform("warnings", lambda x: F.trim(x)), lambda x: x != ""))
    return manifests.withColumn("counts", F.coalesce(numbers, F.create_map().cast("map<string,bigint>"))).withColumn("warnings", F.coalesce(told, F.array().cast("array<string>")))


def automation_status(dates: DataFrame, manifests: DataFrame, running: DataFrame) -> DataFrame:
    """(target_date, status, run_id): running before the newest manifest's status before missing; a manifest
    without a known status is corrupt. running: target dates of active runs."""
    newest = Window.partitionBy("target_date").orderBy(F.desc("started_at"), F.desc("run_id"))
    last = manifests.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("target_date", "run_id", "status")
    active = running.select("target_date", F.lit(True).alias("_running")).distinct()
    known = F.lower("status").isin("success", "partial", "failed", "running")
    status = F.when(F.col("_running"), "running").when(F.col("run_id").isNull(), "missing").when(F.coalesce(known, F.lit(False)), F.lower("status")).otherwise("corrupt")
    return dates.select("target_date").join(last, "target_date", "left").join(active, "target_date", "left").select("target_date", status.alias("status"), "run_id")


def rank_inbox(contents: DataFrame, least: int | None = None, limit: int = 50, offset: int = 0, candidate_cap: int | None = 1000, status: str = "", query: str = "", day: dt.date | None = None) -> DataFrame:
    """A page of scored contents (score, crawl_time): best first, then latest, with the total of rows that qualify.

    status (of the review), query (in title, summary or source name) and day (of the crawl) hold before candidate_cap,
    which bounds the newest rows that are looked at, as the inbox does; None looks at all of them."""
    from newsdesk.operators.filters import like

    rows = contents
    if status:
        rows = rows.where(F.col("review_status") == status)
    if query.strip():
        rows = rows.where(like(F.col("title"), query) | like(F.col("summary"), query) | like(F.col("source_name"), query))
    if day is not None:
        start, end = (F.lit(str(dt.datetime.combine(d, dt.time()))).cast("timestamp_ntz") for d in (day, day + dt.timedelta(days=1)))
        rows = rows.where((F.col("crawl_time") >= start) & (F.col("crawl_time") < end))
    if candidate_cap is not None:
        rows = rows.orderBy(F.desc("crawl_time"), F.desc("content_id")).limit(min(candidate_cap, max(limit + offset, 200)))
    if least is not None:
        rows = rows.where(F.col("score") >= least)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.orderBy(F.desc("score"), F.desc("crawl_time"), F.desc("content_id")).offset(max(offset, 0)).limit(min(max(limit, 1), 200))
    return page.crossJoin(F.broadcast(total))  # one row


def of_week(contents: DataFrame, monday: dt.date, limit: int | None = None) -> DataFrame:
    """contents crawled in the week from monday; the newest ones if a limit (held between 1 and 1000) is given."""
    start, end = (F.lit(str(dt.datetime.combine(d, dt.time()))).cast("timestamp_ntz") for d in (monday, monday + dt.timedelta(days=7)))
    rows = contents.where((F.col("crawl_time") >= start) & (F.col("crawl_time") < end))
    return rows if limit is None else rows.orderBy(F.desc("crawl_time"), F.desc("content_id")).limit(max(1, min(1000, limit)))


def entity_names(entities: DataFrame, kinds: tuple[str, ...], key: str, order: list[Column]) -> DataFrame:
    """(key, names): distinct names of the given kinds in the order of their first mention."""
    rows = entities.where(F.col("entity_type").isin(*kinds)).select(key, F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order)), F.col("name")).alias("m"))
    return rows.groupBy(key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_set("m")), lambda m: m["name"])).alias("names"))


def weekly_funnel(contents: DataFrame, candidate: Column, relevance: Column, failed: Column | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """How the week's items fall: total, those with model metadata, not articles or no candidates (skipped), candidates,
    classified, high, none, failed: candidates whose classification failed; and event_count, the clusters of its financing
    items. clusters: (content_id, cluster_id)."""
    from newsdesk.operators.filters import ARTICLE_CATEGORIES

    article = F.col("source_category").isin(*ARTICLE_CATEGORIES)
    done = F.coalesce(F.col("llm_status") == "success", F.lit(False)) if "llm_status" in contents.columns else F.lit(False)
    rows = contents.select(article.alias("a"), (article & candidate).alias("c"), relevance.alias("r"), done.alias("m"), (F.lit(False) if failed is None else failed).alias("f"))
    events = contents.limit(0).agg(F.count(F.lit(1)).alias("event_count")) if clusters is None else clusters.agg(F.countDistinct("cluster_id").alias("event_count"))
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("m").alias("metadata_processed"),
        F.count_if(F.col("c") & F.col("f")).alias("failed"),
        F.count_if(~F.col("c")).alias("skipped"),
        F.count_if("c").alias("candidates"),
        F.count_if(F.col("c") & F.col("r").isNotNull()).alias("classified"),
        F.count_if(F.col("c") & (F.col("r") == "high")).alias("high"),
        F.count_if(F.col("c") & (F.col("r") == "none")).alias("none"),
    )
    return counts.crossJoin(F.broadcast(events))  # one row each


def recent(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows in order: recent tests, backups, jobs, summaries or reports."""
    return rows.orderBy(*order).limit(limit)
