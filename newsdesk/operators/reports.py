"""Daily report: items of the 10:00-to-10:00 window by section and theme."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions.finance import ROUNDS
from newsdesk.functions.text import collapse
from newsdesk.functions.times import daily_window, in_window, time_choice
from newsdesk.operators.filters import report_candidates
from newsdesk.operators.scoring import classify_content, item_terms, theme_for
from newsdesk.sources.shared import stored

#: Sections in order, with their titles.
SECTIONS = {"technology": "技术进展", "industry": "产业新闻", "funding": "融资新闻"}


def daily_report_items(contents: DataFrame, day: dt.date, events: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Regular items of the report, flat, with their place in the theme. contents may carry arrays content_types and
    sectors; contents linked to a reported event are left to the event."""
    start, end = daily_window(day)
    rows = report_candidates(contents, start, end).withColumn("_t", time_choice(F.col("publish_time"), F.col("publish_time_status"), F.col("crawl_time")))
    rows = rows.where(in_window(F.col("_t.ts"), F.col("publish_time_status"), start, end))
    if events is not None and links is not None:
        reported = report_events(events, links, rows, day)
        rows = without_reported(rows, links, reported)
    rows = rows.where(F.trim(F.coalesce("url", F.lit(""))) != "")
    rows = rows.withColumn("_found", item_terms(collapse(F.col("title")), collapse(F.col("summary"))))
    none = F.array().cast("array<string>")
    types = F.col("content_types") if "content_types" in contents.columns else none
    sectors = F.col("sectors") if "sectors" in contents.columns else none
    rows = rows.withColumn("category", classify_content(types, F.col("source_category"), F.col("_found"))).withColumn("theme", theme_for(F.col("category"), F.col("_found"), sectors))
    rows = rows.withColumn("published_at", F.col("_t.ts")).withColumn("time_quality", F.col("_t.quality")).drop("_t", "_found")
    order = Window.partitionBy("category", "theme").orderBy("published_at", "title", "content_id")
    return rows.withColumn("place", F.row_number().over(order))


def report_events(events: DataFrame, links: DataFrame, window_contents: DataFrame, day: dt.date) -> DataFrame:
    """Events announced on the window's dates, not excluded, with a linked content inside the window."""
    near = events.where((F.col("announced_date") >= F.lit(day - dt.timedelta(days=1))) & (F.col("announced_date") <= F.lit(day)) & (F.col("review_status") != "excluded"))
    held = links.join(window_contents.select("content_id"), "content_id", "left_semi").select("event_id")
    return near.join(held, "event_id", "left_semi")


def without_reported(contents: DataFrame, links: DataFrame, reported: DataFrame) -> DataFrame:
    """contents that belong to none of the reported events."""
    return contents.join(links.join(reported.select("event_id"), "event_id", "left_semi").select("content_id"), "content_id", "left_anti")


def report_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("source_id").alias("sources"))


def executive_summary(items: DataFrame, day: dt.date) -> DataFrame:
    """One row with the report's summary line."""
    end = dt.datetime.combine(day, dt.time(10))
    start = end - dt.timedelta(days=1)
    counts = items.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("category") == k).alias(k) for k in SECTIONS))
    line = F.format_string(f"北京时间 {start:%Y-%m-%d %H:%M} 至 {end:%Y-%m-%d %H:%M} 共收录 %d 条情报：技术进展 %d 条、产业新闻 %d 条、融资新闻 %d 条。", "n", *SECTIONS)
    return counts.select(F.lit(str(day)).alias("report_date"), line.alias("executive_summary"))


def daily_markdown(contents: DataFrame, summary: DataFrame) -> DataFrame:
    """(day, markdown): the daily summary as text. summary: rollups.daily_summary(contents). Sources are sorted, sections
    come in their order, items as crawled, the newest first. contents may carry tag_text and entity_text."""
    from newsdesk.operators.rollups import OTHER_SECTION, SECTIONS as NAMES, section_of

    order = {name: k for k, name in enumerate(dict.fromkeys([*NAMES.values(), OTHER_SECTION]))}
    day = F.to_date("crawl_time").alias("day")
    counts = contents.groupBy(day, "source_name").agg(F.count(F.lit(1)).alias("n"))
    sources = counts.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_name", "n"))), lambda x: F.concat(F.lit("- "), x["source_name"], F.lit(": "), x["n"].cast("string"))), "\n").alias("sources"))
    line = [F.concat(F.lit("### ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")")), F.concat(F.lit("- 来源："), F.col("source_name")), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit("- 摘要："), F.col("summary")))]
    for c, label in (("tag_text", "- 标签："), ("entity_text", "- 实体：")):
        if c in contents.columns:
            line.append(F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), F.col(c))))
    item = F.concat(F.concat_ws("\n", *line), F.lit("\n"))
    section = section_of(F.col("source_category"))
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), section)
    rows = contents.where("crawl_time is not null").select(day, section.alias("section"), rank.alias("rank"), "source_category", (-F.unix_micros(F.to_utc_timestamp("crawl_time", F.current_timezone()))).alias("late"), "content_id", item.alias("item"))
    parts = rows.groupBy("day", "section", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_category", "late", "content_id", "item"))), lambda x: x["item"]), "\n").alias("body"))
    body = parts.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section", "body"))), lambda x: F.concat(F.lit("## "), x["section"], F.lit("\n\n"), x["body"])), "\n").alias("body"))
    head = F.format_string("# AI 信息收集汇总｜%s\n\n## 一、今日抓取概览\n\n- 总条数：%d\n- 成功处理：%d\n- 部分处理：%d\n- 失败：%d\n", F.col("day").cast("string"), "total_items", "successful_items", "partial_items", "failed_items")
    return summary.join(sources, "day").join(body, "day").select("day", F.concat_ws("\n", head, F.concat(F.lit("### 来源分布\n"), "sources", F.lit("\n")), "body").alias("markdown"))


#: What stands where an item says nothing itself, and the theme of events.
NO_TITLE, NO_SUMMARY, NO_SOURCE, WHY, EVENT_THEME = "未命名内容", "暂无摘要，需打开原文核验。", "未知来源", "基于已入库内容的确定性整理，不代表投资建议。", "融资事件"


def daily_report(contents: DataFrame, day: dt.date, events: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """One row with the whole report: report_date, executive_summary, stats, sections of groups of items, warnings.

    A day's report is small: its window bounds it. Events are items of the funding section with the distinct
    addresses of their sources; events and contents without an address are left out with a warning."""
    start, end = daily_window(day)
    window = report_candidates(contents, start, end).withColumn("_t", time_choice(F.col("publish_time"), F.col("publish_time_status"), F.col("crawl_time")))
    window = window.where(in_window(F.col("_t.ts"), F.col("publish_time_status"), start, end))
    said = lambda c, rest: F.coalesce(F.nullif(collapse(F.col(c)), F.lit("")), F.lit(rest))
    none = F.lit(None).cast("bigint")
    items = daily_report_items(contents, day, events, links)
    flat = items.select("category", "theme", "published_at", said("title", NO_TITLE).alias("title"), F.col("title").alias("written"), F.col("content_id").cast("bigint").alias("content_id"), none.alias("event_id"), said("summary", NO_SUMMARY).alias("summary"), said("source_name", NO_SOURCE).alias("source"), F.array("url").alias("urls"), F.col("source_id").cast("bigint").alias("source_id"))
    regular = window
    bare = [F.lit(None).cast("string")]
    if events is not None and links is not None:
        reported = report_events(events, links, window, day)
        regular = without_reported(window, links, reported)
        linked = links.join(reported.select("event_id"), "event_id", "left_semi").join(contents.select("content_id", "url", "source_id"), "content_id")
        urls = linked.groupBy("event_id").agg(F.array_sort(F.collect_set(F.nullif(F.trim("url"), F.lit("")))).alias("urls"), F.min("source_id").cast("bigint").alias("source_id"))
        told = reported.join(urls, "event_id", "left").withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))
        shown = told.where(F.size("urls") > 0).select(F.lit("funding").alias("category"), F.lit(EVENT_THEME).alias("theme"), F.col("announced_date").cast("timestamp_ntz").alias("published_at"), F.col("event_title").alias("title"), F.col("event_title").alias("written"), none.alias("content_id"), "event_id", F.coalesce("event_summary", F.lit(NO_SUMMARY)).alias("summary"), F.lit(NO_SOURCE).alias("source"), "urls", "source_id")
        flat = flat.unionByName(shown)
        skipped = told.where(F.size("urls") == 0).select(F.concat(F.lit("融资事件 #"), F.col("event_id").cast("string"), F.lit(" 没有可用的数据库来源链接，已跳过")).alias("w"))
    else:
        skipped = contents.limit(0).select(bare[0].alias("w"))
    skipped = skipped.unionByName(regular.where(F.trim(F.coalesce("url", F.lit(""))) == "").select(F.concat(F.lit("内容 #"), F.col("content_id").cast("string"), F.lit(" 没有可用的数据库来源链接，已跳过")).alias("w")))
    item = F.struct("published_at", "title", F.coalesce("content_id", "event_id").alias("id"), "content_id", "event_id", "summary", F.lit(WHY).alias("why_it_matters"), "source", "urls")
    # in order of the titles as they were written, not as they are shown; without one, last
    placed = F.struct("published_at", F.col("written").isNull().alias("untitled"), "written", F.coalesce("content_id", "event_id").alias("id"), item.alias("item"))
    groups = flat.groupBy("category", "theme").agg(F.transform(F.array_sort(F.collect_list(placed)), lambda x: x["item"]).alias("items"), F.count(F.lit(1)).alias("n"))
    listed = groups.agg(F.collect_list(F.struct("category", "theme", "items", "n")).alias("g"))
    counts = flat.agg(F.count(F.lit(1)).alias("included_items"), F.countDistinct("source_id").alias("sources_attempted"))
    raw = window.agg(F.count(F.lit(1)).alias("raw_items"))
    notes = skipped.agg(F.array_sort(F.collect_set("w")).alias("warnings"))
    one = listed.crossJoin(counts).crossJoin(raw).crossJoin(notes)  # single rows

    def of(kind: str, name: str) -> Column:
        own = F.array_sort(F.filter("g", lambda x: x["category"] == kind), lambda x, y: F.when(x["theme"] < y["theme"], -1).when(x["theme"] > y["theme"], 1).otherwise(0))
        return F.struct(F.lit(kind).alias("key"), F.lit(name).alias("title"), F.transform(own, lambda x: F.struct(x["theme"].alias("title"), x["items"].alias("items"))).alias("groups"))

    total = lambda kind: F.aggregate(F.filter("g", lambda x: x["category"] == kind), F.lit(0).cast("long"), lambda n, x: n + x["n"])
    last = dt.datetime.combine(day, dt.time(10))
    line = F.format_string(f"北京时间 {last - dt.timedelta(days=1):%Y-%m-%d %H:%M} 至 {last:%Y-%m-%d %H:%M} 共收录 %d 条情报：技术进展 %d 条、产业新闻 %d 条、融资新闻 %d 条。", "included_items", *(total(k) for k in SECTIONS))
    stats = F.struct("sources_attempted", F.col("sources_attempted").alias("sources_succeeded"), "raw_items", "included_items", F.lit(0).alias("failed_sources"))
    return one.select(F.lit(str(day)).alias("report_date"), line.alias("executive_summary"), stats.alias("stats"), F.array(*(of(k, name) for k, name in SECTIONS.items())).alias("sections"), "warnings")


def weekly_sections(details: DataFrame, start: dt.date, end: dt.date, raw_count: int, label: str = "上周") -> DataFrame:
    """(place, part): the weekly report in parts, its head at place 0 and the events behind it, the largest cluster_id
    first, as many tasks as they need. A week without events says so. details: cluster_detail() with a column links, the
    reports' links as text."""
    from newsdesk.operators.curate import numbered
    from newsdesk.sources.shared import stored

    line = lambda name, c: F.concat(F.lit(f"- {name}："), F.coalesce(c, F.lit("")))
    fields = [line(n, F.col(c)) for n, c in (("公司", "company"), ("融资轮次", "round"), ("融资金额", "amount"), ("项目简介", "project_intro"), ("投资方简介", "investor_intro"), ("新闻来源", "source_names"))]
    told = F.concat_ws("\n", *fields, F.when(F.coalesce("links", F.lit("")) != "", F.concat(F.lit("- 相关报道："), "links")))
    events = stored(details.select((-F.col("cluster_id")).alias("late"), "company", told.alias("told")), "weekly_events")
    count = events.count()
    part = F.concat(F.lit("### "), F.col("place").cast("string"), F.lit(". "), F.col("company"), F.lit("\n\n"), F.col("told"), F.lit("\n"))
    parts = numbered(events, "late", "place", 0).select("place", part.alias("part"))
    basis = "基于 content_type=financing、ai_related=true、ai_financing_relevance=high 的新闻，并按公司、轮次、金额和标题相似度去重。"
    head = f"# 融资新闻周报（{start} 至 {end}）\n\n## 统计汇总\n\n- 融资事件数（去重）：{count}\n- 原始融资新闻数：{raw_count}\n- 统计口径：{basis}\n\n## 事件明细\n\n"
    first = details.sparkSession.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(head if count else f"{head}{label}暂无已识别的融资事件。\n").alias("part"))
    return first.unionByName(parts)


def weekly_markdown(details: DataFrame, start: dt.date, end: dt.date, raw_count: int, label: str = "上周") -> DataFrame:
    """One row with the weekly report as text: weekly_sections() in order. The text is one value, so use the sections for a week
    that is too large for one."""
    parts = weekly_sections(details, start, end, raw_count, label)
    m = parts.agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("m"))
    body = F.array_join(F.transform(F.filter("m", lambda x: x["place"] > 0), lambda x: x["part"]), "\n")
    return m.select(F.concat(F.col("m")[0]["part"], body).alias("markdown"))


def financing_items(financing: DataFrame, today: dt.date, day: dt.date | None = None, limit: int = 100) -> tuple[DataFrame, DataFrame, str]:
    """(items, clusters, label) of a day's list: financing contents crawled on the day, newest first; if no day was asked
    for and today has none, the latest ones. At most max(4 * limit, 200) are clustered; callers show `limit` clusters."""
    from newsdesk.operators.cluster import cluster_financing

    most, wanted = max(4 * limit, 200), day or today
    newest = lambda rows: rows.orderBy(F.desc("crawl_time"), F.desc("content_id")).limit(most)
    rows, label = newest(financing.where(F.to_date("crawl_time") == F.lit(wanted))), "今日融资信息" if wanted == today else f"{wanted} 融资信息"
    if day is None and rows.isEmpty():
        rows, label = newest(financing), "最新融资信息"
    return rows, cluster_financing(rows.select("content_id", "title", "summary", F.col("crawl_time").alias("shown"))), label


def ordered_inputs(inputs: DataFrame) -> DataFrame:
    """(report_id, position, target_type, target_id): the included inputs of each report, numbered from 0 in their order."""
    place = F.row_number().over(Window.partitionBy("report_id").orderBy("position"))
    return inputs.where("included").withColumn("position", place - 1).select("report_id", "position", "target_type", "target_id")


def change_status(reports: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, rejected). commands: (report_id, status[, period_start, period_end]): a period must not end before it
    starts, and the report must exist; one command of a report."""
    c = commands.select("report_id", F.col("status").alias("_status"), *(F.col(x).alias(f"_{x}") for x in ("period_start", "period_end")))
    known = c.join(reports.select("report_id", F.lit(True).alias("_known")), "report_id", "left")
    reason = F.when(F.col("_known").isNull(), "unknown report").when(F.col("_period_start") > F.col("_period_end"), "the period ends before it starts")
    judged = known.withColumn("reason", reason)
    rows = reports.join(judged.where("reason is null").drop("reason", "_known"), "report_id", "left")
    for x in ("status", "period_start", "period_end"):
        rows = rows.withColumn(x, F.coalesce(f"_{x}", x))
    return rows.select(*reports.columns), judged.where("reason is not null").select("report_id", F.col("_status").alias("status"), "reason")


def report_candidates_for(report_type: str, start: dt.date, end: dt.date, events: DataFrame, watch: DataFrame) -> DataFrame:
    """(target_type, target_id, date): confirmed events of the period, or open watch items that are undated or due in it."""
    if report_type in ("weekly_financing", "current_week_financing"):
        rows = events.where((F.col("review_status") == "confirmed") & F.col("announced_date").between(F.lit(start), F.lit(end)))
        return rows.select(F.lit("financing_event").alias("target_type"), F.col("event_id").alias("target_id"), F.col("announced_date").alias("date"))
    due = F.col("next_review_date").isNull() | F.col("next_review_date").between(F.lit(start), F.lit(end))
    rows = watch.where((F.col("status") != "completed") & due) if report_type == "watchlist_digest" else watch.limit(0)
    return rows.select(F.lit("watch_item").alias("target_type"), F.col("watch_id").alias("target_id"), F.col("next_review_date").alias("date"))


def report_inputs(wanted: DataFrame, events: DataFrame, watch: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(inputs, rejected): wanted (target_type, target_id) with title and summary as they are now; unknown ids are rejected."""
    known = events.select(F.lit("financing_event").alias("target_type"), F.col("event_id").alias("target_id"), F.col("event_title").alias("title"), F.col("event_summary").alias("summary"))
    known = known.unionByName(contents.select(F.lit("content").alias("target_type"), F.col("content_id").alias("target_id"), "title", "summary"))
    known = known.unionByName(watch.select(F.lit("watch_item").alias("target_type"), F.col("watch_id").alias("target_id"), F.col("title"), F.col("summary")) if "title" in watch.columns else watch.select(F.lit("watch_item").alias("target_type"), F.col("watch_id").alias("target_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("summary")))
    keys = ["target_type", "target_id"]
    return wanted.join(known, keys), wanted.join(known, keys, "left_anti").withColumn("error", F.lit("unknown target"))


def add_versions(reports: DataFrame, versions: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, versions). new: (report_id, seq, version_source, generation_status, markdown_text) get the next numbers
    in order of seq; only successful ones move the report's latest version."""
    top = versions.groupBy("report_id").agg(F.max("version_number").alias("_top"))
    n = F.row_number().over(Window.partitionBy("report_id").orderBy("seq"))
    base = new.join(top, "report_id", "left").join(reports.select("report_id", "latest_version"), "report_id", "left")
    made = base.withColumn("version_number", (n + F.greatest(F.coalesce("_top", F.lit(0)), F.coalesce("latest_version", F.lit(0)))).cast("long")).drop("seq", "_top", "latest_version")
    best = made.where("generation_status = 'success'").groupBy("report_id").agg(F.max("version_number").alias("_new"))
    moved = reports.join(best, "report_id", "left").withColumn("latest_version", F.coalesce(F.col("_new").cast("int"), F.col("latest_version"))).drop("_new")
    return moved, versions.unionByName(made.select(*versions.columns))


def backfill_plan(missing: DataFrame, sources: DataFrame) -> DataFrame:
    """Each missing date with each enabled source, to run at noon. The dates are those of a week, so they go to the sources."""
    run = F.col("day").cast("timestamp_ntz") + F.expr("interval 12 hours")
    days = sorted(r["day"] for r in missing.select("day").distinct().limit(8).collect())  # a week has seven
    if len(days) > 7:
        raise ValueError("a backfill covers one week")
    every = F.explode(F.array(*map(F.lit, days)) if days else F.array().cast("array<date>"))
    return sources.where("enabled").select(every.alias("day"), "source_id").withColumn("run_at", run)


#: Reports of a cluster that are read as one text; of larger clusters each distinct text is read once. Rows of a table that is sent
#: to all tasks at most.
WHOLE_REPORTS, SENT_ROWS = 32, 10_000
EVIDENCE_MARKS = ("领投", "跟投", "参投", "投资方", "投资机构")
DETAIL_CHARS = 220


def cluster_detail(members: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """Per cluster: company, rounds, amounts, introduction, investors and sources. members: (cluster_id, content_id,
    shown, title, summary, source_name[, body]).

    A cluster's reports count as one text, newest first. Names and amounts are searched for once in each distinct text and put
    together in order of the reports. A cluster with a text in which a mention could go on in the next one, or whose first reports
    don't settle the introductions, is read as a whole text, in one task."""
    from newsdesk.functions.finance import amount_lists, company_display_lists, investor_lists, open_at_end, round_texts
    from newsdesk.functions.text import first_chars
    from newsdesk.operators.cluster import distinct_texts

    rows, texts = members, ["title", "summary"]
    if "body" in members.columns:
        rows, texts = rows.withColumn("_body", first_chars(F.col("body"), 1600)), [*texts, "_body"]
    names = []
    if entities is not None:
        named = lambda kind: entities.where(F.col("entity_type") == kind).groupBy("content_id").agg(F.array_sort(F.collect_set("name")).alias(f"_{kind}"))
        names = ["_company", "_investor"]
        rows = rows.join(named("company"), "content_id", "left").join(named("investor"), "content_id", "left")
    rows = stored(distinct_texts(rows.select("cluster_id", "content_id", "shown", "source_name", *texts, *names), texts)[0], "detail_rows")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = rows.select("k1", "k2", *texts).distinct().repartition(parts)
    text = F.concat_ws("\n", F.col("title"), F.coalesce("summary", F.lit("")), F.col("_body") if "_body" in texts else F.lit(""))
    marked = F.exists(F.array(*map(F.lit, EVIDENCE_MARKS)), lambda x: F.contains("_text", x))
    told = told.withColumn("_text", text)
    found = {"companies": company_display_lists(F.col("_text")), "amounts": amount_lists(F.col("_text")), "investors": investor_lists(F.col("_text")), "rounds": round_texts(F.col("_text")), "marked": marked, "open": open_at_end(F.col("_text"))}
    told = stored(told.select("k1", "k2", "title", "summary", "_text", *(c.alias(k) for k, c in found.items())), "detail_texts")
    if told.count() <= SENT_ROWS:
        told = F.broadcast(told)
    light = rows.drop(*texts)

    def listed(rows: DataFrame) -> DataFrame:
        """Per cluster: its rows (n stands for how many reports), newest first."""
        one = F.struct("shown", "content_id", "title", "summary", "source_name", "_text", *names, *found, "n")
        return rows.join(told, ["k1", "k2"]).groupBy("cluster_id").agg(F.sort_array(F.collect_list(one), False).alias("m"))

    head = F.array_join(F.col("m._text"), "\n").alias("t")
    large = stored(rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE_REPORTS).select("cluster_id"), "large_clusters")
    small = listed(light.join(large, "cluster_id", "left_anti").repartition("cluster_id").withColumn("n", F.lit(1).cast("long")))
    out = small.select("cluster_id", "m", head, F.lit(True).alias("all"))
    if not large.isEmpty():
        of_large = rows.join(large, "cluster_id")
        newest = Window.partitionBy("cluster_id").orderBy(F.desc("shown"), F.desc("content_id"), *map(F.desc, texts[:2]), F.desc("source_name"))
        heads = listed(of_large.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= WHOLE_REPORTS).drop("_n", *texts).withColumn("n", F.lit(1).cast("long"))).select("cluster_id", head)
        first = of_large.groupBy("cluster_id", "k1", "k2", "source_name", *names).agg(F.max(F.struct("shown", "content_id")).alias("at"), F.count(F.lit(1)).alias("n"))
        first = listed(first.select("cluster_id", "k1", "k2", "source_name", *names, "at.*", "n"))
        out = out.unionByName(first.join(heads, "cluster_id").select("cluster_id", "m", "t", F.lit(False).alias("all")))
    each = lambda c, k: F.flatten(F.transform("m", lambda x: x[c][k]))
    every = lambda c, n: F.array_distinct(F.concat(*(each(c, k) for k in range(n))))
    given = lambda c: F.array_distinct(F.flatten(F.transform("m", lambda x: F.coalesce(x[c], F.array().cast("array<string>"))))) if names else F.array().cast("array<string>")
    rounds = F.array_distinct(F.flatten("m.rounds"))
    out = out.select(
        "cluster_id", "t", "all", F.col("m")[0]["title"].alias("title"), F.col("m")[0]["summary"].alias("summary"),
        given("_company").alias("gc"), given("_investor").alias("gi"), every("companies", 2).alias("fc"), every("investors", 3).alias("fi"), every("amounts", 3).alias("amounts"),
        F.filter(F.array(*map(F.lit, ROUNDS)), lambda r: F.array_contains(rounds, r)).alias("rounds"),
        F.array_distinct("m.source_name").alias("sources"), F.aggregate("m", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n"),
        F.exists("m", lambda x: x["marked"]).alias("marked"), F.exists("m", lambda x: x["open"]).alias("open"),
    )
    out = out.select("*", F.when(F.size("gc") > 0, F.col("gc")).otherwise(F.col("fc")).alias("c"), F.when(F.size("gi") > 0, F.col("gi")).otherwise(F.col("fi")).alias("i"))
    out = out.withColumn("evidence", _evidence(F.col("t"), F.col("i")))
    # a text that is cut off behind the first reports settles what it is read for
    nothing = (F.size("i") == 0) & ~F.col("marked")
    settled = (nothing | (F.size("evidence") >= 3) | (F.coalesce(F.length(F.try_element_at("evidence", F.lit(1))), F.lit(0)) > DETAIL_CHARS)) & ((F.coalesce("summary", F.lit("")) != "") | (F.length(collapse(F.col("t"))) > DETAIL_CHARS))
    out = out.withColumn("whole", (F.col("open") & (F.col("n") > 1)) | (~F.col("all") & ~settled))
    if large.isEmpty() and told.where("open").isEmpty():
        return _details(out)
    out = stored(out, "details")
    whole = stored(out.where("whole").select("cluster_id", F.col("gc").alias("c"), F.col("gi").alias("i")), "whole_clusters")
    if whole.isEmpty():
        return _details(out)
    one = listed(light.join(whole.select(F.col("cluster_id").alias("_c")), F.col("cluster_id").eqNullSafe(F.col("_c")), "left_semi").withColumn("n", F.lit(1).cast("long"))).select("cluster_id", "m", head)
    return _details(out.where("not whole")).unionByName(_details(_whole(one.join(whole.withColumnRenamed("cluster_id", "_c"), F.col("cluster_id").eqNullSafe(F.col("_c"))).drop("_c"))))


def _whole(listed: DataFrame) -> DataFrame:
    """What _details() is made from, out of whole texts (cluster_id, m, t) and the names that are known (c, i)."""
    from newsdesk.functions.finance import amount_texts, company_display_candidates, investor_texts, round_texts

    t = F.col("t")
    listed = listed.withColumn("c", F.when(F.size("c") > 0, F.col("c")).otherwise(company_display_candidates(t))).withColumn("i", F.when(F.size("i") > 0, F.col("i")).otherwise(investor_texts(t)))
    first = F.col("m")[0]
    return listed.select("cluster_id", "t", "c", "i", first["title"].alias("title"), first["summary"].alias("summary"), round_texts(t).alias("rounds"), amount_texts(t).alias("amounts"), F.array_distinct("m.source_name").alias("sources"), F.size("m").alias("n"), _evidence(t, F.col("i")).alias("evidence"))


def _evidence(t: Column, i: Column) -> Column:
    """The sentences of a text that speak of investors."""
    sentences = F.filter(F.transform(F.split(t, "[。！？!?；;]\\s*"), lambda x: collapse(x)), lambda x: x != "")
    return F.filter(sentences, lambda s: F.exists(F.concat(F.array(*map(F.lit, EVIDENCE_MARKS)), i), lambda x: F.contains(s, x)))


def _details(out: DataFrame) -> DataFrame:
    from newsdesk.functions.text import summary_chars

    told = lambda a: F.when(F.size(a) > 0, F.array_join(a, "、")).otherwise("未披露")
    intro = F.when(F.size("evidence") > 0, summary_chars(F.array_join(F.array_distinct(F.slice("evidence", 1, 2)), "；"), DETAIL_CHARS)).when(F.size("i") > 0, F.concat(F.lit("公开报道提到投资方："), F.array_join("i", "、"), F.lit("；暂无更详细机构简介。"))).otherwise("未披露或原文未提供明确投资方信息。")
    return out.select(
        "cluster_id",
        F.when(F.size("c") > 0, F.array_join(F.slice("c", 1, 3), "、")).otherwise(F.col("title")).alias("company"),
        told(F.col("rounds")).alias("round"),
        told(F.col("amounts")).alias("amount"),
        summary_chars(F.coalesce(F.nullif("summary", F.lit("")), F.col("t")), DETAIL_CHARS).alias("project_intro"),
        intro.alias("investor_intro"),
        F.array_join("sources", "、").alias("source_names"),
        F.col("n").cast("int").alias("reports"),
    )


def weekly_payload(members: DataFrame, start: dt.date, end: dt.date, limit: int | None = 200) -> DataFrame:
    """One row for the period: counts, whether the events were cut to the newest `limit`, and the events with all their
    reports. members: (cluster_id, content_id, shown, title, url, source_name, summary[, region_tags, body])."""
    from newsdesk.functions.text import first_chars

    body = first_chars(F.col("body"), 1000) if "body" in members.columns else F.lit(None).cast("string")
    regions = F.col("region_tags") if "region_tags" in members.columns else F.array().cast("array<string>")
    row = F.struct("shown", "content_id", "title", "url", "source_name", F.coalesce("summary", F.lit("")).alias("summary"), regions.alias("region_tags"), F.coalesce(F.nullif(body, F.lit("")), "summary", "title").alias("text"))
    events = members.groupBy("cluster_id").agg(F.sort_array(F.collect_list(row), False).alias("m"))
    reports = F.transform("m", lambda x: F.struct(x["content_id"].alias("content_id"), x["title"].alias("title"), x["url"].alias("url"), x["source_name"].alias("source_name"), x["shown"].alias("shown")))
    events = events.select(F.col("m")[0].alias("primary"), (F.size("m") - 1).alias("related_count"), reports.alias("related_reports"))
    counts = events.agg(F.count(F.lit(1)).alias("event_count"), F.coalesce(F.sum(F.col("related_count") + 1), F.lit(0)).alias("raw_news_count"))
    top = events.orderBy(F.desc("primary.shown"), F.desc("primary.content_id"))
    top = top if limit is None else top.limit(limit)
    items = top.agg(F.sort_array(F.collect_list(F.struct("primary.shown", "primary", "related_count", "related_reports")), False).alias("news_items"))
    out = counts.crossJoin(F.broadcast(items))  # two single rows
    return out.select(F.lit(str(start)).alias("start_date"), F.lit(str(end)).alias("end_date"), "raw_news_count", "event_count", (F.col("event_count") > F.size("news_items")).alias("input_truncated"), "news_items")
