"""Registered queries of the engine over frames derived from the driver's tables, and the SQL that checks them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsdesk.functions import finance, text, times, urls
from newsdesk.operators import cluster, filters, rollups, scoring
from newsdesk.plans.registry import ORACLES, QUERIES, query
from newsdesk.sources.shared import stored

FLAGSHIP, LATEST = "rp01_daily_report", "rp01_latest_report"
#: The days that the date-bound queries report on.
DAY, WEEK_DAY = dt.date(2024, 1, 10), dt.date(2024, 1, 11)


# --- functions -------------------------------------------------------------------------------------------

CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{00A0}}]+', ' ', 'g'))"
DROPPED = r"""regexp_replace(lower(coalesce({0}, '')), '[\s_·•・\-—–|｜:：,，.。;；!！?？''"“”‘’「」《》【】（）()\[\]{{}}]+', '', 'g')"""


@query("fn02_first_chars", "d1", f"select content_id, case when length(c) > 40 then rtrim(c[:40]) || '...' else c end as short from (select content_id, {CLEAN.format('summary')} as c from d1)")
def _(spark, d1):
    return d1.select("content_id", text.first_chars(F.col("summary"), 40).alias("short"))


@query("fn03_fingerprint", "d1", f"select content_id, sha256(lower({CLEAN.format('summary')})) as fingerprint from d1")
def _(spark, d1):
    return d1.select("content_id", text.fingerprint(F.col("summary")).alias("fingerprint"))


@query(
    "fn06_summary_chars",
    "d1",
    f"""select content_id, case when length(c) <= 180 then c
      when regexp_extract(w, '(?s)^(.{{80,}}[。！？!?；;])', 1) <> '' then trim(regexp_extract(w, '(?s)^(.{{80,}}[。！？!?；;])', 1))
      when regexp_extract(w, '(?s)^(.{{80,}})[，,、]', 1) <> '' then trim(regexp_extract(w, '(?s)^(.{{80,}})[，,、]', 1)) || '...'
      else rtrim(w) || '...' end as summary_180
    from (select content_id, c, c[:180] as w from (select content_id, {CLEAN.format("summary")} as c from d1))""",
)
def _(spark, d1):
    return d1.select("content_id", text.summary_chars(F.col("summary")).alias("summary_180"))


@query("fn07_normalize_text", "d1", f"select content_id, {DROPPED.format('title')} as norm from d1")
def _(spark, d1):
    return d1.select("content_id", text.normalize_dedupe_text(F.col("title")).alias("norm"))


_COMPANY = DROPPED.format(f"trim(regexp_replace(regexp_replace(trim(coalesce(title, '')), '^(?:{text.COMPANY_PREFIX})', ''), '(?:{text.COMPANY_SUFFIX})$', ''))")


@query("fn08_company_name", "d2", f"select content_id, {_COMPANY} as company from d2")
def _(spark, d2):
    return d2.select("content_id", text.normalize_company_name(F.col("title")).alias("company"))


_TOKENS = "list_sort(list_distinct(list_concat(regexp_extract_all(n, '[a-z0-9]{3,}'), [n[i:i + 1] for i in range(1, length(n))])))"


@query("fn09_title_tokens", "d2", f"select content_id, array_to_string({_TOKENS}, '|') as tokens from (select content_id, {DROPPED.format('title')} as n from d2)")
def _(spark, d2):
    return d2.select("content_id", F.array_join(text.title_tokens(F.col("title")), "|").alias("tokens"))


@query("fn10_estimate_tokens", "d1", "select content_id, cast(greatest(1, (length(coalesce(title, '')) + length(coalesce(summary, '')) + 3) // 4) as int) as tokens from d1")
def _(spark, d1):
    return d1.select("content_id", text.estimate_tokens(F.col("title"), F.col("summary")).alias("tokens"))


@query("fn16_language", "d2", "select content_id, case when regexp_matches(title || summary, '[一-鿿]') then 'zh' else 'en' end as language from d2")
def _(spark, d2):
    return d2.select("content_id", text.detect_language(F.col("title"), F.col("summary")).alias("language"))


@query("fn04_canonical_url", "d6", r"select page_id, case when regexp_matches(host, '^m\.') and not contains(host, 'github.com') then 'https://' || host[3:] else 'https://' || host end || case when p = '' then '/' else p end || case when q = '' then '' else '?' || q end as canonical from (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) as host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') as p, array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: contains(x, '=') and not regexp_matches(x, '=$') and not regexp_matches(x, '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|spm|from|share|share_token|fbclid|gclid)=')), '&') as q from d6)")
def _(spark, d6):
    return d6.select("page_id", urls.canonicalize_url(F.col("url")).alias("canonical"))


@query("fn17_week_start", "d1", "select content_id, cast(date_trunc('week', crawl_time) as timestamp) as week, cast(date_trunc('week', crawl_time) - interval 7 day as timestamp) as previous from d1")
def _(spark, d1):
    return d1.select("content_id", times.week_start(F.col("crawl_time")).alias("week"), times.week_start(F.col("crawl_time"), True).alias("previous"))


_CHOICE = """case when publish_time is not null and publish_time_status = 'date_only' then 'published_date_only'
  when publish_time is not null and publish_time_status = 'exact' then 'published_exact'
  when crawl_time is not null and publish_time is null then 'crawl_time' when crawl_time is not null then 'crawl_time_fallback' else 'missing' end"""
_SHOWN = "case when publish_time is not null and publish_time_status in ('date_only', 'exact') then publish_time else crawl_time end"


@query("fn20_time_choice", "d1", f"select content_id, {_SHOWN} as ts, {_CHOICE} as quality, strftime(coalesce(publish_time, crawl_time), '%Y-%m-%d %H:%M') as shown from d1")
def _(spark, d1):
    c = times.time_choice(F.col("publish_time"), F.col("publish_time_status"), F.col("crawl_time"))
    return d1.select("content_id", c["ts"].alias("ts"), c["quality"].alias("quality"), times.display_time(F.col("publish_time"), F.col("crawl_time")).alias("shown"))


_IN_WINDOW = """case when publish_time is null then false when publish_time_status = 'date_only' then cast(publish_time as date) between date '2024-01-09' and date '2024-01-10'
  else publish_time >= timestamp '2024-01-09 10:00:00' and publish_time < timestamp '2024-01-10 10:00:00' end"""


@query("fn19_in_window", "d1", f"select content_id, {_IN_WINDOW} as inside, cast(crawl_time + interval 14 hour as date) as report_day from d1")
def _(spark, d1):
    start, end = times.daily_window(DAY)
    return d1.select("content_id", times.in_window(F.col("publish_time"), F.col("publish_time_status"), start, end).alias("inside"), times.day_of(F.col("crawl_time")).alias("report_day"))


# --- extraction ------------------------------------------------------------------------------------------


@query(
    "ext03_amounts",
    "d2",
    r"select content_id, array_to_string(list_distinct(regexp_extract_all(t, '\d+万元')), '|') as amounts, cast(regexp_extract(t, '(\d+)万元', 1) as double) * 10000 as amount, 'CNY' as currency from (select content_id, title || ' ' || summary as t from d2)",
)
def _(spark, d2):
    # each step is a projection of its own, so the patterns run once for a row
    found = d2.select("content_id", finance.amount_texts(F.concat_ws(" ", "title", "summary")).alias("found"))
    first = found.select("content_id", F.array_join("found", "|").alias("amounts"), F.try_element_at("found", F.lit(1)).alias("first"))
    return first.select("content_id", "amounts", finance.parse_amount(F.col("first")).alias("p")).select("content_id", "amounts", "p.amount", "p.currency")


@query("ext04_rounds", "d2", "select content_id, array_to_string(list_filter(['Pre-A轮','Pre-A','种子轮','天使轮','A轮','B轮','C轮','D轮','E轮','F轮','战略融资','股权融资'], lambda x: contains(title, x)), '|') as rounds from d2")
def _(spark, d2):
    return d2.select("content_id", F.array_join(finance.round_texts(F.col("title")), "|").alias("rounds"))


@query("ext05_investors", "d2", "select content_id, regexp_extract(summary, '由([^。；;，,]{2,80}?)领投', 1) as investors from d2")
def _(spark, d2):
    return d2.select("content_id", F.array_join(finance.investor_texts(F.col("summary")), "|").alias("investors"))


@query("ext02_company_names", "d2", "select content_id, regexp_extract(title, '^([一-鿿A-Za-z0-9._ -]{2,40})(?:获|完成)', 1) as names from d2")
def _(spark, d2):
    return d2.select("content_id", F.array_join(finance.company_display_candidates(F.col("title")), "|").alias("names"))


# --- filters ---------------------------------------------------------------------------------------------

_FINANCING = """select d2.* from d2 where ai_related
  and exists (select 1 from d5 where d5.content_id = d2.content_id and tag_key = 'content_type' and tag_value = 'financing')
  and exists (select 1 from d5 where d5.content_id = d2.content_id and tag_key = 'ai_financing_relevance' and tag_value = 'high')
  and not exists (select 1 from d5 where d5.content_id = d2.content_id and tag_key = 'manual_financing_status')"""


@query("flt01_search", "d1", "select content_id, crawl_time from d1 where extraction_status = 'processed' and (title ilike '%tion%' or summary ilike '%tion%' or source_name ilike '%tion%') order by crawl_time desc, content_id desc limit 300")
def _(spark, d1):
    return filters.search_contents(d1, query="tion", status="processed").select("content_id", "crawl_time")


@query("flt02_financing", "d2 d5", f"select content_id, title, crawl_time from ({_FINANCING})")
def _(spark, d2, d5):
    return filters.financing_contents(d2, d5).select("content_id", "title", "crawl_time")


@query("flt03_keyword_ai", "d1", r"select content_id, regexp_matches(t, '(^|[^a-z])ai([^a-z]|$)') or regexp_matches(t, 'ai infra|ai agent|aigc|llm|rag|mcp|gpu|openai|anthropic|deepseek|claude|gemini|chatgpt|copilot') as ai from (select content_id, lower(title || ' ' || coalesce(summary, '')) as t from d1)")
def _(spark, d1):
    return d1.select("content_id", filters.keyword_ai_related(F.col("title"), F.col("summary"), F.lit(None).cast("string")).alias("ai"))


@query("flt06_source_window", "d1", f"select content_id, {_IN_WINDOW} as in_window, coalesce(publish_time < timestamp '2024-01-09 10:00:00' and not (publish_time_status = 'date_only' and cast(publish_time as date) = date '2024-01-09'), false) as before_window from d1")
def _(spark, d1):
    return filters.source_window_flags(d1, *times.daily_window(DAY)).select("content_id", "in_window", "before_window")


@query(
    "flt07_older_streak",
    "d1",
    f"""select source_id, position from (
      select *, min(case when older >= 10 then position end) over (partition by source_id) as stop from (
        select *, sum(cast(b as int)) over (partition by source_id, island order by position) as older from (
          select *, sum(cast(i as int)) over (partition by source_id order by position) as island from (
            select source_id, content_id as position, {_IN_WINDOW} as i, coalesce(publish_time < timestamp '2024-01-09 10:00:00' and not (publish_time_status = 'date_only' and cast(publish_time as date) = date '2024-01-09'), false) as b from d1))))
    where stop is null or position <= stop""",
)
def _(spark, d1):
    flagged = filters.source_window_flags(d1, *times.daily_window(DAY)).withColumn("position", F.col("content_id"))
    return filters.cut_after_older_streak(flagged).select("source_id", "position")


@query("flt08_purge", "d3", "select crawl_run_id, started_at from d3 where started_at >= timestamp '2024-01-20 00:00:00' - interval 10 day")
def _(spark, d3):
    return filters.purge_expired(d3, "started_at", 10, dt.datetime(2024, 1, 20))[0].select("crawl_run_id", "started_at")


@query("flt09_backlog", "d1", "select content_id, llm_status from d1 where llm_status in ('not_configured', 'pending') order by crawl_time desc, content_id desc limit 100")
def _(spark, d1):
    return filters.llm_backlog(d1, 500).select("content_id", "llm_status")


@query("flt11_report_candidates", "d1", "select content_id from d1 where (publish_time >= timestamp '2024-01-09' and publish_time < timestamp '2024-01-10 10:00:00') or (crawl_time >= timestamp '2024-01-09 10:00:00' and crawl_time < timestamp '2024-01-10 10:00:00')")
def _(spark, d1):
    return filters.report_candidates(d1, *times.daily_window(DAY)).select("content_id")


# --- joins, roll-ups, rankings ---------------------------------------------------------------------------


@query("jn01_new_items", "d6 d1", r"select min(page_id) as page_id, url from d6 group by url having url not in (select url from d1)")
def _(spark, d6, d1):
    from newsdesk.operators.joins import new_items

    return new_items(d6.withColumn("canonical_url", F.col("url")), d1.withColumn("canonical_url", F.col("url")), F.col("page_id")).select("page_id", "url")


@query("jn02_content_view", "d2 d5", "select content_id, title, string_agg(tag_key || '=' || tag_value, '|' order by tag_key, tag_value) as tags, count(*) as n_tags from d2 join d5 using (content_id) group by content_id, title")
def _(spark, d2, d5):
    from newsdesk.operators.joins import content_view

    v = content_view(d2, d5)
    return v.select("content_id", "title", F.array_join(F.transform("tags", lambda t: F.concat_ws("=", t["tag_key"], t["tag_value"])), "|").alias("tags"), F.size("tags").cast("long").alias("n_tags"))


@query(
    "jn08_daily_windows",
    "d1",
    """select content_id, unnest(case when publish_time is not null and publish_time_status = 'date_only' then [cast(publish_time as date), cast(publish_time as date) + 1]
      else [cast(coalesce(publish_time, crawl_time) + interval 14 hour as date)] end) as report_date from d1""",
)
def _(spark, d1):
    return rollups.assign_daily_windows(d1).select("content_id", "report_date")


@query("ag01_daily_summary", "d1", "select cast(crawl_time as date) as day, count(*) as total_items, count(*) filter (extraction_status = 'failed') as failed_items, count(*) filter (extraction_status = 'partial') as partial_items, count(*) filter (extraction_status = 'processed') as successful_items from d1 group by 1")
def _(spark, d1):
    return rollups.daily_summary(d1)


@query(
    "ag01_source_counts",
    "d1",
    """select cast(crawl_time as date) as day, case source_category when 'venture_media' then '中文投融资 / 创投信息' when 'ai_media' then '中文 AI 垂直媒体' when 'tech_business_media' then '中文科技商业媒体'
      when 'official_news' then '海外官方新闻 / 研究更新' when 'official_research' then '海外官方新闻 / 研究更新' when 'github' then 'GitHub Trending Daily' when 'product_hunt' then 'Product Hunt 今日榜单' else 'Hacker News Top 20' end as section,
      source_name, count(*) as items from d1 group by all""",
)
def _(spark, d1):
    return rollups.daily_source_counts(d1)


@query("ag02_dashboard", "d1 d4", "select (select count(*) from d1) as contents, (select count(*) from d1 where cast(crawl_time as date) = date '2024-01-10') as contents_today, count(*) filter (enabled) as enabled_sources, count(*) filter (error_count > 0) as sources_with_errors from d4")
def _(spark, d1, d4):
    return rollups.dashboard_counts(d1, d4, DAY)


@query("ag03_financing_counts", "d2 d5", f"select count(*) filter (cast(crawl_time as date) = date '2024-01-10') as selected, count(*) filter (cast(crawl_time as date) = date '2024-01-11') as today, count(*) as total from ({_FINANCING})")
def _(spark, d2, d5):
    return rollups.financing_counts(filters.financing_contents(d2, d5), DAY, WEEK_DAY)


@query("ag04_financing_dates", "d2 d5", f"select cast(crawl_time as date) as day, count(*) as items from ({_FINANCING}) group by 1 order by 1 desc limit 10")
def _(spark, d2, d5):
    return rollups.financing_dates(filters.financing_contents(d2, d5), 10)


@query("ag05_llm_status", "d1", "select coalesce(llm_status, 'unknown') as llm_status, count(*) as items from d1 group by 1")
def _(spark, d1):
    return rollups.llm_status_counts(d1)


@query("ag06_run_rollup", "d3", "select cast(started_at as date) as day, sum(new_items)::bigint as new_items, sum(failed_items)::bigint as failed_items, count(*) as attempted, count(*) filter (failed_items > 0) as failed_sources, count(*) filter (failed_items = 0) as succeeded, case when sum(failed_items) = 0 then 'success' else 'partial_success' end as status from d3 where source_id is not null group by 1")
def _(spark, d3):
    return rollups.rollup_runs(d3.where("source_id is not null"), F.to_date("started_at").alias("day"))


@query("ag08_run_status", "d3", "select crawl_run_id, case status when 'failed' then 'failed' when 'partial_success' then 'partial' else 'success' end as status from d3")
def _(spark, d3):
    return d3.select("crawl_run_id", rollups.normalize_run_status(F.col("status"), F.col("failed_items")).alias("status"))


@query("wn01_latest_run", "d3", "select day, crawl_run_id, status from (select *, cast(started_at as date) as day, row_number() over (partition by cast(started_at as date) order by started_at desc, crawl_run_id desc) as n from d3 where source_id is null) where n = 1")
def _(spark, d3):
    return rollups.latest_run_per_day(d3).select("day", "crawl_run_id", "status")


_WEEK = """with r as (select cast(started_at as date) as day, * from d3 where source_id is null),
  l as (select day, status from (select *, row_number() over (partition by day order by started_at desc, crawl_run_id desc) as n from r) where n = 1)
  select s.day, l.status as latest_status, coalesce(c.completed, false) as completed, coalesce(m.held, false) as has_summary, coalesce(n.n, 0) as content_count
  from (select cast(unnest(generate_series(timestamp '2024-01-08', timestamp '2024-01-11', interval 1 day)) as date) as day) s
  left join l using (day) left join (select day, bool_or(status <> 'failed') as completed from r group by day) c using (day)
  left join (select distinct cast(crawl_time as date) as day, true as held from d1 where content_id % 3 = 0 and day(crawl_time) % 2 = 0) m using (day)
  left join (select cast(crawl_time as date) as day, count(*) as n from d1 group by 1) n using (day)"""


def _summaries(d1: DataFrame) -> DataFrame:
    return d1.where("content_id % 3 = 0 and day(crawl_time) % 2 = 0").select(F.to_date("crawl_time").alias("summary_date"))



@query("wn02_week_status", "d3 d1", f"select * from ({_WEEK})")
def _(spark, d3, d1):
    return rollups.week_status(spark, d3, d1, WEEK_DAY, _summaries(d1))


@query("set03_missing_dates", "d3 d1", f"select day from ({_WEEK}) where not completed")
def _(spark, d3, d1):
    return rollups.missing_dates(rollups.week_status(spark, d3, d1, WEEK_DAY))


@query(
    "wn03_page_per_source",
    "d1 d4",
    """select source_id, name, source_rank, total, pages, cast(place as int) as place, content_id from (
      select d1.source_id, d4.source_name as name, case d4.source_category when 'venture_media' then 0 when 'ai_media' then 1 when 'tech_business_media' then 2 when 'official_news' then 3 when 'github' then 8 else 99 end as source_rank,
        count(*) over (partition by d1.source_id) as total, cast(greatest(1, ceil(count(*) over (partition by d1.source_id) / 10.0)) as int) as pages,
        row_number() over (partition by d1.source_id order by coalesce(publish_time, crawl_time) desc nulls last, content_id desc) as place, content_id
      from d1 join d4 on d1.source_id = d4.source_id where enabled)
    where place > (least(2, pages) - 1) * 10 and place <= least(2, pages) * 10""",
)
def _(spark, d1, d4):
    return rollups.page_per_source(d1, d4, page=2)


@query(
    "wn03_page_of_day",
    "d1 d4",
    """select source_id, name, source_rank, coalesce(total, 0) as total, coalesce(pages, 1) as pages, place, content_id from (
      select source_id, source_name as name, case source_category when 'venture_media' then 0 when 'ai_media' then 1 when 'tech_business_media' then 2 when 'official_news' then 3 when 'github' then 8 else 99 end as source_rank from d4 where enabled)
    left join (select source_id, count(*) over (partition by source_id) as total, cast(ceil(count(*) over (partition by source_id) / 10.0) as int) as pages,
        cast(row_number() over (partition by source_id order by coalesce(publish_time, crawl_time) desc nulls last, content_id desc) as int) as place, content_id
      from d1 where cast(crawl_time as date) = date '2024-01-10') using (source_id)
    where place is null or place <= 10""",
)
def _(spark, d1, d4):
    return rollups.page_per_source(d1.where(F.to_date("crawl_time") == F.lit(DAY)), d4)


@query("wn04_latest_version", "d8", "select report_id, version_number, next_version from (select *, version_number + 1 as next_version, row_number() over (partition by report_id order by version_number desc) as n from d8) where n = 1")
def _(spark, d8):
    return rollups.latest_versions(d8).select("report_id", "version_number", "next_version")


@query("snk05_exportable_versions", "d8", "select report_id, version_number, markdown_text from (select *, row_number() over (partition by report_id order by version_number desc) as n from d8 where generation_status = 'success' and trim(markdown_text) <> '') where n = 1")
def _(spark, d8):
    return rollups.exportable_versions(d8).select("report_id", "version_number", "markdown_text")


@query("wn10_watch_ranking", "d7", "select watch_id, cast(place as int) as place from (select watch_id, row_number() over (order by case when status = 'follow_up' then 0 else 1 end, case when next_review_date is null then 1 else 0 end, next_review_date nulls first, case priority when 'high' then 0 when 'medium' then 1 else 2 end, updated_at desc, watch_id) as place from d7) where place <= 100")
def _(spark, d7):
    from pyspark.sql import Window

    w = d7.withColumn("_r", rollups.priority_rank(F.col("priority")))
    key = [F.when(F.col("status") == "follow_up", 0).otherwise(1), F.when(F.col("next_review_date").isNull(), 1).otherwise(0), "next_review_date", "_r", F.desc("updated_at"), "watch_id"]
    top = rollups.rank_watch_items(w).orderBy(*key).limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*key))).select("watch_id", "place")


@query("wn11_watch_due", "d7", "select watch_id, next_review_date, priority from d7 where status = 'follow_up' and next_review_date <= date '2024-01-10'")
def _(spark, d7):
    return rollups.watch_due(d7, DAY).select("watch_id", "next_review_date", "priority")


# --- scores and reports ----------------------------------------------------------------------------------

_TEXT = "lower(trim(title || ' ' || coalesce(summary, '')))"
_SIGNAL = "regexp_matches(t, 'funding|financing|raised|series')"
_FUNDING_RE = "pre-seed|pre seed|series a|series b|series c|series d|series e|raised|raises|funding|investment|invests"
_TECH_RE = "llm|agent|ai infra|gpu|benchmark|open source|robotics|semiconductor"


@query(
    "sc01_score",
    "d1",
    f"""select content_id, greatest(0, least(100, 35 + case when ai_related then 25 when not ai_related then -25 else 0 end + case when {_SIGNAL} then 10 else 0 end + case when k then 5 else 0 end)) as score,
      cast(round(least(0.98, greatest(0.35, 0.45 + 0.08 * greatest(1, cast(ai_related is not null as int) + cast({_SIGNAL} as int) + cast(k as int)))), 2) as double) as confidence,
      greatest(1, cast(ai_related is not null as int) + cast({_SIGNAL} as int) + cast(k as int)) as n_reasons
    from (select *, {_TEXT} as t, source_category in ('official_news', 'official_research', 'venture_media', 'ai_media') as k from d1)""",
)
def _(spark, d1):
    none = F.array().cast("array<string>")
    s = scoring.score_content(F.col("title"), F.col("summary"), F.col("source_category"), F.col("ai_related"), none, none, F.lit(False))
    return d1.withColumn("s", s).select("content_id", F.col("s.score").alias("score"), F.col("s.confidence").alias("confidence"), F.size("s.reasons").alias("n_reasons"))


_CATEGORY = f"case when regexp_matches(t, '{_FUNDING_RE}') then 'funding' when regexp_matches(source_category, 'ai|tech|research|github|hacker|model') or regexp_matches(t, '{_TECH_RE}') then 'technology' else 'industry' end"
_THEME = """case when category = 'technology' then case when regexp_matches(t, 'llm|model') then '基础模型' when regexp_matches(t, 'agent') then '智能体' when regexp_matches(t, 'ai infra|inference') then 'AI基础设施'
  when regexp_matches(t, 'gpu|semiconductor') then '芯片与算力' when regexp_matches(t, 'robotics') then '具身智能' when regexp_matches(t, 'multimodal') then '多模态' else '其他技术' end
  else case when regexp_matches(t, 'regulation') then '政策与监管' when regexp_matches(t, 'saas|b2b|enterprise') then '企业服务' else '其他产业' end end"""


@query("sc05_category", "d1", f"select content_id, category, {_THEME} as theme from (select *, {_CATEGORY} as category from (select *, {_TEXT} as t from d1))")
def _(spark, d1):
    rows = d1.select("content_id", "source_category", scoring.item_terms(F.col("title"), F.col("summary")).alias("found"))
    rows = rows.withColumn("category", scoring.classify_content(F.array().cast("array<string>"), F.col("source_category"), F.col("found")))
    return rows.select("content_id", "category", scoring.theme_for(F.col("category"), F.col("found")).alias("theme"))


@query(
    "sc06_sector_themes",
    "d1 d9",
    f"""select content_id, case when content_id % 3 <> 0 then words else case content_id % 4 when 0 then '基础模型' when 2 then '具身智能' else '智能体' end end as theme
    from (select content_id, {_THEME} as words from (select *, 'technology' as category, {_TEXT} as t from d1))""",
)
def _(spark, d1, d9):
    from newsdesk.operators.joins import content_view

    v = content_view(d1, d9)
    sectors = F.transform(F.filter("tags", lambda t: t["tag_key"] == "sector"), lambda t: t["tag_value"])
    return v.select("content_id", scoring.theme_for(F.lit("technology"), scoring.item_terms(F.col("title"), F.col("summary")), sectors).alias("theme"))


_REPORT_WINDOW = f"""(select *, {_SHOWN} as ts, {_CHOICE} as time_quality from d1) where
  ((publish_time >= timestamp '2024-01-09' and publish_time < timestamp '2024-01-10 10:00:00') or (crawl_time >= timestamp '2024-01-09 10:00:00' and crawl_time < timestamp '2024-01-10 10:00:00'))
  and case when ts is null then false when publish_time_status = 'date_only' then cast(ts as date) between date '2024-01-09' and date '2024-01-10' else ts >= timestamp '2024-01-09 10:00:00' and ts < timestamp '2024-01-10 10:00:00' end"""


@query(FLAGSHIP, "d1", f"select content_id, category, {_THEME} as theme, ts as published_at, time_quality, cast(row_number() over (partition by category, theme order by ts, title, content_id) as int) as place from (select *, {_CATEGORY} as category from (select *, {_TEXT} as t from {_REPORT_WINDOW}))")
def _(spark, d1):
    from newsdesk.operators.reports import daily_report_items

    return daily_report_items(d1, DAY).select("content_id", "category", "theme", "published_at", "time_quality", "place")


_LAST = "(select max(cast(crawl_time as date)) from d1)"
_OF_LAST = (
    _REPORT_WINDOW.replace("timestamp '2024-01-09 10:00:00'", f"(cast({_LAST} as timestamp) - interval 14 hour)")
    .replace("timestamp '2024-01-10 10:00:00'", f"(cast({_LAST} as timestamp) + interval 10 hour)")
    .replace("timestamp '2024-01-09'", f"(cast({_LAST} as timestamp) - interval 1 day)")
    .replace("between date '2024-01-09' and date '2024-01-10'", f"between {_LAST} - 1 and {_LAST}")
)


@query(LATEST, "d1", f"select content_id, category, {_THEME} as theme, ts as published_at, time_quality, cast(row_number() over (partition by category, theme order by ts, title, content_id) as int) as place from (select *, {_CATEGORY} as category from (select *, {_TEXT} as t from {_OF_LAST}))")
def _(spark, d1):
    from newsdesk.operators.reports import daily_report_items

    last = d1.agg(F.max(F.to_date("crawl_time"))).first()[0]
    return daily_report_items(d1, last or DAY).select("content_id", "category", "theme", "published_at", "time_quality", "place")


@query(
    "rp01_full_report",
    "d1 d11 d12",
    f"""select * from (with w as (select * from {_REPORT_WINDOW}),
      e as (select * from d11 where announced_date between date '2024-01-09' and date '2024-01-10' and review_status <> 'excluded' and event_id in (select event_id from d12 join w using (content_id))),
      r as (select *, {_CATEGORY} as category from (select *, {_TEXT} as t from w where content_id not in (select content_id from d12 join e using (event_id)))),
      i as (select category, {_THEME} as theme, content_id as id, ts, title from r union all select 'funding', '融资事件', event_id, cast(announced_date as timestamp), event_title from e)
      select category, theme, string_agg(cast(id as varchar), ',' order by ts, title, id) as ids, (select count(*) from i) as included_items, (select count(*) from w) as raw_items from i group by category, theme)""",
)
def _(spark, d1, d11, d12):
    from newsdesk.operators.reports import daily_report

    r = daily_report(d1, DAY, d11, d12).select("stats", F.explode("sections").alias("s")).select("stats", "s.key", F.explode("s.groups").alias("g"))
    ids = F.array_join(F.transform("g.items.id", lambda x: x.cast("string")), ",").alias("ids")
    return r.select(F.col("key").alias("category"), F.col("g.title").alias("theme"), ids, "stats.included_items", "stats.raw_items")


@query("ag14_report_counts", "d1", f"select category, count(*) as items, count(distinct source_id) as sources from (select *, {_CATEGORY} as category from (select *, {_TEXT} as t from {_REPORT_WINDOW})) group by category")
def _(spark, d1):
    from newsdesk.operators.reports import daily_report_items, report_counts

    return report_counts(daily_report_items(d1, DAY))


@query("cl01_fingerprint_dedupe", "d1", f"select min(content_id) as content_id, f as fingerprint from (select content_id, sha256(lower({CLEAN.format('summary')})) as f from d1) group by f")
def _(spark, d1):
    from newsdesk.operators.joins import first_of

    rows = d1.withColumn("fingerprint", text.fingerprint(F.col("summary")))
    return first_of(rows, ["fingerprint"], [F.col("content_id")]).select("content_id", "fingerprint")


def _financing_items(d2: DataFrame, d5: DataFrame) -> DataFrame:
    return filters.financing_contents(d2, d5).select("content_id", "title", "summary", F.col("crawl_time").alias("shown"))


def _week_clusters(items: DataFrame) -> DataFrame:
    """The clusters of every weekly report: each week's items by themselves."""
    return cluster.cluster_financing(items, period=times.week_start(F.col("shown")))


@query("cl02_clusters", "d2 d5")
def _(spark, d2, d5):
    return _week_clusters(stored(_financing_items(d2, d5), "financing_items"))


@query("cl04_build_events", "d2 d5")
def _(spark, d2, d5):
    return cluster.build_events(_financing_items(d2, d5))[0]


_SETS = f"select n_id as id, {_TOKENS} as t from (select content_id as n_id, {DROPPED.format('title')} as n from d1)"


@query(
    "cl05_near_duplicates",
    "d1",
    f"""select a as left_id, b as right_id, cast(c as int) as common, cast(na + nb - c as int) as total from (
      with s as (select min(id) as id, t from ({_SETS}) where len(t) > 0 group by t), k as (select id, len(t) as n, unnest(t) as w from s)
      select x.id as a, y.id as b, count(*) as c, any_value(x.n) as na, any_value(y.n) as nb from k x join k y on x.w = y.w and x.id < y.id group by 1, 2)
    where 100 * c >= 80 * (na + nb - c)""",
)
def _(spark, d1):
    return cluster.near_duplicates(d1, "content_id", F.col("title"))


# --- pages, ingest, streams ------------------------------------------------------------------------------

_LINKS = """(select page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) as root, unnest(regexp_extract_all(html, '<a href="/[^"<>]*">[^<]*</a>')) as a from d6)"""


@query("ext08_articles", "d6")
def _(spark, d6):
    from newsdesk.operators.pages import extract_articles

    return extract_articles(d6, F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))


@query("ext09_links", "d6")
def _(spark, d6):
    from newsdesk.operators.pages import harvest_links

    return harvest_links(d6, 20).select("url", "href", "text")


@query("ext13_challenge", "d6", "select page_id, html like '%/probe.js%' or html like '%Just a moment%' or html like '%HuaweiCloudWAF%' or html like '%Please Enable JavaScript and Cookie%' as challenge from d6")
def _(spark, d6):
    from newsdesk.operators.pages import is_challenge_page

    return d6.select("page_id", is_challenge_page(F.col("html")).alias("challenge"))


@query(
    "ag07_ingest_stats",
    "d1 d4",
    rf"""select * from (with i as (select content_id, source_id, url, publish_time, publish_time_status, lower(trim(title || ' ' || coalesce(summary, '') || ' ')) as t from d1),
      k as (select i.*, s.source_category, {_IN_WINDOW} as inside from i left join d4 s using (source_id)),
      l as (select source_id, case when content_id % 10 = 0 then 'duplicate' when not inside then 'outside_window'
        when coalesce(source_category in ('venture_media', 'tech_business_media'), false) and not (regexp_matches(t, '(^|[^a-z])ai([^a-z]|$)') or regexp_matches(t, 'ai infra|ai agent|aigc|llm|rag|mcp|gpu|openai|anthropic|deepseek|claude|gemini|chatgpt|copilot')) then 'not_ai' else 'new' end as o from k)
      select source_id, count(*) as candidates, count(*) filter (o = 'new') as new_items, count(*) filter (o = 'duplicate') as duplicates, count(*) filter (o = 'outside_window') as outside_window, count(*) filter (o = 'not_ai') as not_ai from l group by source_id)""",
)
def _(spark, d1, d4):
    from newsdesk.operators.ingest import ingest_stats, label_items

    items = d1.select("source_id", F.col("content_id").alias("position"), "url", "title", "summary", F.lit(None).cast("string").alias("clean_text"), "publish_time", "publish_time_status")
    held = d1.where("content_id % 10 = 0").select(F.col("url").alias("canonical_url"))
    return ingest_stats(label_items(items, held, d4, dt.datetime(2024, 1, 10, 10)))


@query("st02_daily_windows", "d3", "select cast(started_at + interval 14 hour as date) as report_day, source_id, count(*) as items from d3 group by 1, 2")
def _(spark, d3):
    from newsdesk.streaming.jobs import daily_window_counts

    return daily_window_counts(d3, "started_at")


@query("ev_merge_links", "d2", "select content_id // 3 // 2 * 2 as event_id, count(*) as sources from d2 group by 1")
def _(spark, d2):
    from newsdesk.operators.curate import merge_events

    ids = d2.select((F.col("content_id") / 3).cast("long").alias("event_id")).distinct()
    events = ids.select("event_id", F.lit("t").alias("event_title"), F.lit("c").alias("company_name"), F.lit(None).cast("date").alias("announced_date"), F.lit("A轮").alias("financing_round"), F.lit("1").alias("amount_original"), F.lit("pending").alias("review_status"), F.lit(False).alias("locked_by_user"), F.lit("s").alias("event_summary"))
    links = d2.select(F.col("content_id").alias("event_content_id"), (F.col("content_id") / 3).cast("long").alias("event_id"), "content_id", F.lit(True).alias("is_primary_source"), F.lit(80.0).alias("match_score"), F.lit("automatic").alias("association_source"))
    commands = events.where("event_id % 2 = 1").join(events.select((F.col("event_id") + 1).alias("event_id")), "event_id", "left_semi").select(F.col("event_id").alias("seq"), (F.col("event_id") - 1).alias("target_id"), F.array(F.col("event_id") - 1, "event_id").alias("event_ids"))
    return merge_events(events, links, commands)[1].groupBy("event_id").agg(F.count(F.lit(1)).alias("sources"))


# --- more reports, curation and taxonomy -----------------------------------------------------------------


@query("flt05_candidates", "d2 d5", "select content_id, title like '%融资%' or summary like '%融资%' or content_id % 5 <> 0 or content_id % 4 <> 0 as candidate from d2")
def _(spark, d2, d5):
    from newsdesk.operators.joins import content_view

    return content_view(d2, d5).select("content_id", filters.is_financing_candidate(F.col("title"), F.col("summary"), F.col("tags")).alias("candidate"))


@query("jn12_exclude", "d2 d5", "select tag_key, tag_value, count(*) as n from (select * from d5 union select content_id, 'manual_financing_status', 'excluded' from d2 where content_id % 25 = 1) group by all")
def _(spark, d2, d5):
    from newsdesk.operators.joins import exclude_contents

    tags = exclude_contents(d5, d2, d2.where("content_id % 25 = 1").select("content_id"))
    return tags.groupBy("tag_key", "tag_value").agg(F.count(F.lit(1)).alias("n"))


@query("wn07_latest_success", "d3", "select target_date, run_id from (select cast(started_at as date) as target_date, crawl_run_id as run_id, row_number() over (partition by cast(started_at as date) order by started_at desc, crawl_run_id desc) as n from d3 where status = 'success') where n = 1")
def _(spark, d3):
    m = d3.select(F.to_date("started_at").alias("target_date"), F.col("crawl_run_id").alias("run_id"), "started_at", "status")
    return rollups.latest_success(m).select("target_date", "run_id")


_SCORE = f"""select *, greatest(0, least(100, 35 + case when ai_related then 25 when not ai_related then -25 else 0 end + case when {_SIGNAL} then 10 else 0 end + case when k then 5 else 0 end)) as score
  from (select *, {_TEXT} as t, source_category in ('official_news', 'official_research', 'venture_media', 'ai_media') as k from d1)"""


def _scored(d1: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    s = scoring.score_content(F.col("title"), F.col("summary"), F.col("source_category"), F.col("ai_related"), none, none, F.lit(False))
    return d1.withColumn("_s", s).withColumn("score", F.col("_s.score")).withColumn("confidence", F.col("_s.confidence")).withColumn("reasons", F.col("_s.reasons")).drop("_s")


@query("wn09_inbox", "d1", f"select content_id, score, (select count(*) from ({_SCORE}) where score >= 40) as total from ({_SCORE}) where score >= 40 order by score desc, crawl_time desc, content_id desc limit 50")
def _(spark, d1):
    return rollups.rank_inbox(_scored(d1), least=40, candidate_cap=None).select("content_id", "score", "total")


@query("wn09_inbox_filters", "d1", f"select content_id, score, (select count(*) from ({_SCORE}) where review_status = 'unread' and (title ilike '%er%' or summary ilike '%er%' or source_name ilike '%er%') and cast(crawl_time as date) = date '2024-01-10') as total from ({_SCORE}) where review_status = 'unread' and (title ilike '%er%' or summary ilike '%er%' or source_name ilike '%er%') and cast(crawl_time as date) = date '2024-01-10' order by score desc, crawl_time desc, content_id desc limit 50")
def _(spark, d1):
    return rollups.rank_inbox(_scored(d1), candidate_cap=None, status="unread", query="er", day=DAY).select("content_id", "score", "total")


@query(
    "sc03_reviews",
    "d1",
    f"select content_id, case when content_id % 4 = 0 then greatest(score, 80) when content_id % 4 = 1 then least(score, 20) else score end as score, case when content_id % 4 = 0 then 'reviewed' when content_id % 4 = 1 then 'unread' else review_status end as review_status from ({_SCORE})",
)
def _(spark, d1):
    every = d1.select("content_id", F.lit(1).cast("bigint").alias("seq"), F.when(F.col("content_id") % 4 == 0, "relevant").when(F.col("content_id") % 4 == 1, "not_relevant").alias("decision")).where("decision is not null")
    again = every.where("decision = 'not_relevant'").withColumn("seq", F.lit(2).cast("bigint")).withColumn("decision", F.lit("reset"))
    return scoring.apply_reviews(_scored(d1), every.unionByName(again))[0].select("content_id", "score", "review_status")


@query("tg04_metadata", "d2 d5", "select tag_value, count(*) as n from (select content_id, case when content_id % 6 = 0 then 'high' when content_id % 4 = 0 then 'none' else 'high' end as tag_value from d2) group by 1")
def _(spark, d2, d5):
    from newsdesk.operators.taxonomy import apply_metadata

    none = F.lit(None).cast("array<string>")
    out = d2.where("content_id % 6 = 0").select("content_id", F.lit("").alias("summary"), F.lit(True).alias("ai_related"), F.lit("").alias("content_type"), F.lit("High").alias("relevance"), none.alias("sectors"), none.alias("regions"))
    return apply_metadata(d2, d5, out)[1].where("tag_key = 'ai_financing_relevance'").groupBy("tag_value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "wt01_save_watch",
    "d7",
    "select status, count(*) as n, count(distinct watch_id) as ids, max(watch_id) as last_id from (select status, watch_id from d7 union all select 'watching', (select max(watch_id) from d7) + row_number() over (order by watch_id desc) from d7 where status = 'completed') group by status",
)
def _(spark, d7):
    from newsdesk.operators.curate import active_key, save_watch_items

    now = F.lit(None).cast("timestamp_ntz")
    items = d7.withColumn("active_target_key", active_key(F.col("target_type"), F.col("target_id"), F.col("status"))).withColumn("completed_at", now)
    # only the targets whose items are completed are free
    commands = d7.select(F.col("watch_id").alias("seq"), "target_type", "target_id", "priority", F.lit("watching").alias("status"), "next_review_date")
    commands = commands.unionByName(commands.withColumn("seq", -F.col("seq") - 1))  # each asked for twice
    saved = save_watch_items(items, commands, dt.datetime(2024, 2, 1))[0]
    return saved.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("watch_id").alias("ids"), F.max("watch_id").alias("last_id"))


_RANK = "case source_category when 'venture_media' then 0 when 'ai_media' then 1 when 'tech_business_media' then 2 when 'official_news' then 3 when 'official_research' then 3 when 'github' then 4 when 'product_hunt' then 5 else 6 end"
_NAMES = "['中文投融资 / 创投信息', '中文 AI 垂直媒体', '中文科技商业媒体', '海外官方新闻 / 研究更新', 'GitHub Trending Daily', 'Product Hunt 今日榜单', 'Hacker News Top 20']"


@query(
    "rp02_markdown",
    "d1",
    f"""select * from (with r as (select *, cast(crawl_time as date) as day, {_RANK} as rank from d1),
      i as (select day, rank, source_category, crawl_time, content_id, '### [' || title || '](' || url || ')' || chr(10) || '- 来源：' || source_name || case when coalesce(summary, '') <> '' then chr(10) || '- 摘要：' || summary else '' end || chr(10) as item from r),
      b as (select day, rank, '## ' || {_NAMES}[rank + 1] || chr(10) || chr(10) || string_agg(item, chr(10) order by source_category, crawl_time desc, content_id) as body from i group by day, rank),
      d as (select day, string_agg(body, chr(10) order by rank) as body from b group by day),
      s as (select day, string_agg('- ' || source_name || ': ' || n, chr(10) order by source_name) as sources from (select day, source_name, count(*) as n from r group by all) group by day),
      h as (select day, count(*) as n, count(*) filter (extraction_status = 'processed') as good, count(*) filter (extraction_status = 'partial') as part, count(*) filter (extraction_status = 'failed') as bad from r group by day)
      select day, '# AI 信息收集汇总｜' || day || chr(10) || chr(10) || '## 一、今日抓取概览' || chr(10) || chr(10) || '- 总条数：' || n || chr(10) || '- 成功处理：' || good || chr(10) || '- 部分处理：' || part || chr(10) || '- 失败：' || bad || chr(10)
        || chr(10) || '### 来源分布' || chr(10) || sources || chr(10) || chr(10) || body as markdown from h join s using (day) join d using (day))""",
)
def _(spark, d1):
    from newsdesk.operators.reports import daily_markdown

    return daily_markdown(d1, rollups.daily_summary(d1))


@query("rp03_cluster_detail", "d2 d5")
def _(spark, d2, d5):
    from newsdesk.operators.reports import cluster_detail

    items = stored(_financing_items(d2, d5), "financing_items")
    return cluster_detail(items.join(_week_clusters(items), "content_id").withColumn("source_name", F.lit("源")))


@query("rp05_watch_digest", "d7", "select watch_id as target_id, next_review_date as date from d7 where status <> 'completed' and (next_review_date is null or next_review_date between date '2024-01-08' and date '2024-01-14')")
def _(spark, d7):
    from newsdesk.operators.reports import report_candidates_for

    return report_candidates_for("watchlist_digest", dt.date(2024, 1, 8), dt.date(2024, 1, 14), d7, d7).select("target_id", "date")


@query("rp06_add_versions", "d8", "select report_id, max(version_number) as latest, count(*) as versions from (select report_id, version_number from d8 union all select report_id, max(version_number) + 1 from d8 group by report_id) group by report_id")
def _(spark, d8):
    from newsdesk.operators.reports import add_versions

    reports = d8.select("report_id").distinct().withColumn("latest_version", F.lit(0))
    versions = d8.select("report_id", "version_number", "generation_status", "markdown_text")
    new = reports.select("report_id", F.lit(1).alias("seq"), F.lit("success").alias("generation_status"), F.lit("x").alias("markdown_text"))
    moved, every = add_versions(reports, versions, new)
    counts = every.groupBy("report_id").agg(F.count(F.lit(1)).alias("versions"))
    return moved.select("report_id", F.col("latest_version").cast("long").alias("latest")).join(counts, "report_id")


@query("rp09_backfill", "d3 d1 d4", f"select day, source_id, cast(day as timestamp) + interval 12 hour as run_at from ({_WEEK}) w, d4 where enabled and not completed")
def _(spark, d3, d1, d4):
    from newsdesk.operators.reports import backfill_plan

    return backfill_plan(rollups.missing_dates(rollups.week_status(spark, d3, d1, WEEK_DAY)), d4)


_LATE_DAY = dt.date(2024, 2, 2)
_LATE_WEEK = _WEEK.replace("timestamp '2024-01-08', timestamp '2024-01-11'", "timestamp '2024-01-29', timestamp '2024-02-02'")


@query("wn02_late_week", "d3 d1", f"select * from ({_LATE_WEEK})")
def _(spark, d3, d1):
    return rollups.week_status(spark, d3, d1, _LATE_DAY, _summaries(d1))


@query("set03_days_without_runs", "d3 d1", f"select day from ({_LATE_WEEK}) where not completed")
def _(spark, d3, d1):
    return rollups.missing_dates(rollups.week_status(spark, d3, d1, _LATE_DAY))


@query("rp09_late_backfill", "d3 d1 d4", f"select day, source_id, cast(day as timestamp) + interval 12 hour as run_at from ({_LATE_WEEK}) w, d4 where enabled and not completed")
def _(spark, d3, d1, d4):
    from newsdesk.operators.reports import backfill_plan

    return backfill_plan(rollups.missing_dates(rollups.week_status(spark, d3, d1, _LATE_DAY)), d4)


@query(
    "dq01_report_check",
    "d1",
    "select violation, count(*) as n from (select 'summary must be a non-empty string' as violation from d1 where summary is null or trim(summary) = '' union all select 'title must be a non-empty string' from d1 where title is null or trim(title) = '' union all select 'id must be positive' from d1 where content_id <= 0) group by 1",
)
def _(spark, d1):
    from newsdesk.operators.enrich import validate_report

    items = d1.select(F.lit(DAY).alias("report_date"), F.lit("technology").alias("section"), "content_id", F.lit(None).cast("long").alias("event_id"), "title", "summary", F.col("source_name").alias("source"), "url")
    return validate_report(items).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


from newsdesk.plans import jobs  # noqa: E402, F401  registers its queries after those above

__all__ = ["DAY", "FLAGSHIP", "LATEST", "ORACLES", "QUERIES", "WEEK_DAY"]
