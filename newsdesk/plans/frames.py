"""News frames derived from the driver's tables, written once and rendered for Spark and for DuckDB.

$text is the string type and $T{x} the time that number x of minutes after 2024-01-01 00:00 stands for.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "documents events orders customer pages".split()

FRAMES = {
    "d1": """
select doc_id as content_id, source as source_name, doc_id % 34 + 1 as source_id,
  case when doc_id % 11 in (0,1,2) then 'venture_media' when doc_id % 11 in (3,4) then 'ai_media'
       when doc_id % 11 = 5 then 'official_news' when doc_id % 11 = 6 then 'official_research'
       when doc_id % 11 = 7 then 'tech_business_media' when doc_id % 11 = 8 then 'github'
       when doc_id % 11 = 9 then 'product_hunt' else 'hacker_news' end as source_category,
  substr(text,1,80) as title, concat('https://news.example.com/', cast(doc_id as $text)) as url,
  case when doc_id % 13 = 0 then null else text end as summary, lang as language,
  case when doc_id % 7 = 0 then null
       when doc_id % 7 = 1 then cast(date_trunc('day', $T{doc_id*37}) as $ntz) else $T{doc_id*37} end as publish_time,
  case when doc_id % 7 = 0 then 'missing' when doc_id % 7 = 1 then 'date_only'
       when doc_id % 7 = 2 then 'estimated' else 'exact' end as publish_time_status,
  $T{doc_id*37 + 45} as crawl_time,
  case when doc_id % 17 = 0 then 'failed' when doc_id % 17 in (1,2) then 'partial' else 'processed' end as extraction_status,
  case when doc_id % 19 = 0 then null when doc_id % 19 = 1 then 'not_configured' when doc_id % 19 < 5 then 'pending' else 'success' end as llm_status,
  case when doc_id % 5 = 0 then 'reviewed' else 'unread' end as review_status,
  case when doc_id % 3 = 0 then true when doc_id % 3 = 1 then false else null end as ai_related
from documents""",
    "d2": """
select o_orderkey as content_id, 1 + o_orderkey % 34 as source_id,
  concat('星辰', lpad(cast(c_custkey % 400 as $text),4,'0'),
         case when o_orderkey % 2 = 0 then '完成' else '获' end,
         cast(100 * (1 + c_custkey % 7) as $text), '万元',
         case cast(c_custkey % 4 as int) when 0 then '天使轮' when 1 then 'A轮' when 2 then 'B轮' else 'C轮' end,
         '融资') as title,
  concat('由资本', cast(c_custkey % 50 as $text), '领投') as summary,
  case when o_orderkey % 3 = 2 then cast(null as boolean) else true end as ai_related,
  $T{o_orderkey*17} as crawl_time
from orders join customer on o_custkey = c_custkey""",
    "d3": """
select event_id as crawl_run_id, case when event_id % 5 = 0 then null else 1 + user_id % 34 end as source_id,
  ts as started_at,
  case event_type when 'error' then 'failed' when 'click' then 'partial_success' else 'success' end as status,
  cast(floor(value) as bigint) as new_items,
  case when event_type in ('error','click') then 1 else 0 end as failed_items
from events""",
    "d4": """
select cast(id as bigint) as source_id, concat('src', cast(id as $text)) as source_name,
  case when id % 6 = 0 then 'venture_media' when id % 6 = 1 then 'ai_media' when id % 6 = 2 then 'official_news'
       when id % 6 = 3 then 'github' when id % 6 = 4 then 'tech_business_media' else 'other_kind' end as source_category,
  id % 9 <> 0 as enabled, cast(id % 4 as bigint) as error_count
from (select distinct o_orderkey % 34 + 1 as id from orders)""",
    "d5": """
select content_id, 'content_type' as tag_key, case when content_id % 5 = 0 then 'other' else 'financing' end as tag_value from d2
union all select content_id, 'ai_financing_relevance', case when content_id % 4 = 0 then 'none' else 'high' end from d2
union all select content_id, 'manual_financing_status', 'excluded' from d2 where content_id % 50 = 1""",
    "d6": "select page_id, url, html from pages",
    "d7": """
select content_id as watch_id, case when content_id % 2 = 0 then 'content' else 'financing_event' end as target_type,
  content_id as target_id,
  case when content_id % 3 = 0 then 'high' when content_id % 3 = 1 then 'medium' else 'low' end as priority,
  case when content_id % 4 = 0 then 'watching' when content_id % 4 = 1 then 'follow_up'
       when content_id % 4 = 2 then 'paused' else 'completed' end as status,
  case when content_id % 5 = 0 then cast(null as date) else cast(crawl_time as date) end as next_review_date,
  crawl_time as updated_at
from d2""",
    "d8": """
select content_id as report_version_id, content_id % 6007 as report_id, 1 + content_id $div 6007 as version_number,
  case when content_id % 7 = 0 then 'failed' else 'success' end as generation_status,
  case when content_id % 11 = 0 then '' else title end as markdown_text
from d2""",
    "d9": """
select content_id, 'content_type' as tag_key, case when content_id % 5 = 0 then 'financing' else 'other' end as tag_value from d1
union all select content_id, 'ai_financing_relevance', case when content_id % 7 = 0 then 'high' else 'none' end from d1
union all select content_id, 'sector', case content_id % 4 when 0 then 'LLM' when 2 then 'Robotics' else 'AI Agents' end from d1 where content_id % 3 = 0""",
    "d10": """
select content_id, case content_id % 3 when 0 then 'company' when 1 then 'investor' else 'person' end as entity_type, concat('Name', cast(content_id % 50 as $text)) as name from d1
union all select content_id, 'investor', concat('Fund', cast(content_id % 20 as $text)) from d1 where content_id % 4 = 0""",
    "d11": """
select c_custkey as event_id, concat('星辰', lpad(cast(c_custkey % 400 as $text),4,'0'), '完成融资') as event_title,
  concat('星辰', lpad(cast(c_custkey % 400 as $text),4,'0')) as company_name, concat('星辰', lpad(cast(c_custkey % 400 as $text),4,'0')) as company_name_normalized,
  cast($T{c_custkey*31} as date) as announced_date,
  case cast(c_custkey % 4 as int) when 0 then '天使轮' when 1 then 'A轮' when 2 then 'B轮' else 'C轮' end as financing_round,
  concat(cast(100 * (1 + c_custkey % 7) as $text), '万元') as amount_original,
  case cast(c_custkey % 5 as int) when 0 then 'confirmed' when 1 then 'excluded' else 'pending' end as review_status,
  c_custkey % 11 = 0 as locked_by_user, cast(c_custkey % 50 as double) / 50 as confidence, $T{c_custkey*13} as updated_at, c_mktsegment as event_summary
from customer""",
    "d12": """
select o_orderkey as event_content_id, o_custkey as event_id, o_orderkey as content_id, o_orderkey % 3 = 0 as is_primary_source,
  cast(70 + o_orderkey % 30 as double) as match_score, 'automatic' as association_source
from orders""",
}


def needs(name: str) -> list[str]:
    """The frames that a frame is made from, itself last."""
    out: list[str] = []
    for other in sorted(set(re.findall(r"\bd\d+\b", FRAMES[name]))):
        out += [n for n in needs(other) if n not in out]
    return [*out, name]


def render(sql: str, spark: bool) -> str:
    minutes = "(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0,0,cast((\\1) % 43200 as int),0))" if spark else "(timestamp '2024-01-01 00:00:00' + to_minutes(cast((\\1) % 43200 as int)))"
    sql = re.sub(r"\$T\{([^}]*)\}", minutes, sql)
    return sql.replace("$text", "string" if spark else "varchar").replace("$ntz", "timestamp_ntz" if spark else "timestamp").replace("$div", "div" if spark else "//")


def oracle(frames: str, sql: str) -> str:
    """DuckDB SQL with the frames (and those that they need) in front."""
    names: list[str] = []
    for name in frames.split():
        names += [n for n in needs(name) if n not in names]
    return "with " + ",\n".join(f"{n} as ({render(FRAMES[n], False)})" for n in names) + "\n" + render(sql, False)


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores, if its files give fewer: work on the rows of one small file, or of one
    row group, would else be one task. Larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived frame over the driver's tables."""
    args = {t: spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in TABLES if re.search(rf"\b{t}\b", FRAMES[name])}
    args |= {n: frame(spark, sf_dir, n) for n in needs(name)[:-1] if re.search(rf"\b{n}\b", FRAMES[name])}
    sql = FRAMES[name]
    for t in args:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(re.sub(r"\$T\{([^}]*)\}", lambda m: render(m.group(0), True), sql).replace("$text", "string").replace("$ntz", "timestamp_ntz").replace("$div", "div"), **args)
