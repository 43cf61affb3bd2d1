"""Raw pages to articles and links."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions.text import clean_card_title, clean_title, contains_any, detect_language, first_chars, summary_chars
from newsdesk.functions.times import date_from_text, date_from_url, parse_datetime
from newsdesk.functions.urls import canonicalize_url

#: Marks of pages that stand in for the real one.
CHALLENGE = ("/probe.js", "Please Enable JavaScript and Cookie", "Just a moment", "HuaweiCloudWAF")
#: Link texts that lead nowhere of interest, and parts of addresses that do not.
LOW_VALUE = ("首页", "快讯", "全部", "热点", "登录", "注册", "关于我们", "加入我们", "广告联系", "research", "company", "product", "safety", "engineering", "security", "global affairs", "skip to main content")
SKIPPED_PATHS = ("login", "signup", "about", "contact", "privacy")
#: Where pages state when they were published, in order.
META_TIMES = (("property", "article:published_time"), ("name", "pubdate"), ("name", "publishdate"), ("name", "publish_time"), ("name", "date"), ("itemprop", "datePublished"))
JSON_TIMES = ("datePublished", "dateCreated", "dateModified", "uploadDate")


def is_challenge_page(html: Column) -> Column:
    found = F.lit(False)
    for mark in CHALLENGE:
        found = found | F.contains(F.coalesce(html, F.lit("")), F.lit(mark))
    return found


class _Page(HTMLParser):
    """Collects titles, meta values, times, paragraphs, anchors and text of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[tuple[str, str], str] = {}
        self.times: list[str] = []
        self.scripts: list[str] = []
        self.anchors: list[list[str]] = []
        self.heading = self.title = ""
        self.paragraphs: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.text: list[str] = []
        self._open: list[str] = []
        self._inside = {"article": 0, "main": 0}
        self._paragraph: list[str] | None = None
        self._json = False

    def _end_paragraph(self) -> None:
        if self._paragraph is not None:
            text = " ".join(" ".join(self._paragraph).split())
            if len(text) > 20:
                for place in ("article", "main"):
                    if self._inside[place]:
                        self.paragraphs[place].append(text)
                self.paragraphs["body"].append(text)
            self._paragraph = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "meta":
            for key in ("property", "name", "itemprop"):
                if key in a and a.get("content"):
                    self.meta.setdefault((key, a[key]), " ".join(a["content"].split()))
            return
        if tag == "time" or a.get("itemprop") == "datePublished":
            self.times.append(next((a[k] for k in ("datetime", "content", "data-time", "data-date") if a.get(k)), ""))
        if tag == "p":
            self._end_paragraph()
            self._paragraph = []
        elif tag == "a":
            self.anchors.append([a.get("href", ""), ""])
        elif tag == "script":
            self._json = a.get("type") == "application/ld+json"
        if tag in self._inside:
            self._inside[tag] += 1
        if tag in ("title", "h1", "script", "style", "a"):
            self._open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p":
            self._end_paragraph()
        if tag in self._inside and self._inside[tag]:
            self._end_paragraph()
            self._inside[tag] -= 1
        if tag in self._open:
            while self._open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        where = self._open[-1] if self._open else ""
        if where == "script":
            if self._json:
                self.scripts.append(data)
            return
        if where == "style":
            return
        if where == "title":
            self.title += data
        elif where == "h1" and not self.heading.endswith("\0"):
            self.heading += data
        if where == "a" and self.anchors:
            self.anchors[-1][1] += data
        if self._paragraph is not None:
            self._paragraph.append(data)
        self.text.append(data)

    def close(self) -> None:
        super().close()
        self._end_paragraph()


def _json_time(scripts: list[str]) -> str | None:
    for raw in scripts:
        try:
            stack = [json.loads(raw)]
        except ValueError:
            continue
        while stack:
            node = stack.pop()
            if isinstance(node, dict):
                for key in JSON_TIMES:
                    if isinstance(node.get(key), str) and node[key]:
                        return node[key]
                stack.extend(node.values())
            elif isinstance(node, list):
                stack.extend(node)
    return None


PARSED = "url string, title string, description string, stated string, json_time string, page_text string, body string, links array<struct<href:string,text:string>>"


#: Pages that are parsed before their rows are handed on.
PAGES_TOGETHER = 64


def parse_pages(pages: DataFrame) -> DataFrame:
    """What the markup of pages (url, html) says, before any rule on it. One pass of the standard parser; a task holds its
    batch as it came and what PAGES_TOGETHER pages gave."""
    link = pa.struct([("href", pa.string()), ("text", pa.string())])
    schema = pa.schema([(c.split()[0], pa.string()) for c in PARSED.split(", ")[:-1]] + [("links", pa.list_(link))])
    tidy = lambda s: " ".join(s.split())

    def parsed(url: str | None, html: str | None) -> tuple:
        page = _Page()
        page.feed(html or "")
        page.close()
        title = tidy(page.heading) or tidy(page.title) or page.meta.get(("property", "og:title")) or page.meta.get(("name", "twitter:title")) or ""
        stated = next((page.meta[k] for k in META_TIMES if k in page.meta), None) or next((x for x in page.times if x), None)
        about = page.meta.get(("name", "description")) or page.meta.get(("property", "og:description")) or ""
        body = next((page.paragraphs[k] for k in ("article", "main", "body") if page.paragraphs[k]), [])
        return (url, title, about, stated, _json_time(page.scripts), tidy(" ".join(page.text))[:2500], " ".join(body), [{"href": h, "text": tidy(t)} for h, t in page.anchors])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_TOGETHER):
                part = batch.slice(at, PAGES_TOGETHER)
                rows = [parsed(*x) for x in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return pages.select("url", "html").mapInArrow(run, PARSED)


def extract_articles(pages: DataFrame, as_of: Column) -> DataFrame:
    """Articles of pages (url, html): title, summary, body, publish time with its status, language. Pages without a
    title and pages that stand in for the real one are left out."""
    p = parse_pages(pages.where(~is_challenge_page(F.col("html")))).where("title <> ''")
    stated = F.coalesce(parse_datetime(F.col("stated")), parse_datetime(F.col("json_time")))
    written = date_from_text(F.col("page_text"), as_of)
    by_url = date_from_url(F.col("url")).cast("timestamp_ntz")
    status = F.when(stated.isNotNull(), "exact").when(written["ts"].isNotNull(), written["status"]).when(by_url.isNotNull(), "estimated").otherwise("missing")
    title = clean_title(F.col("title"))
    text = F.when(F.col("description") != "", F.col("description")).when(F.col("body") != "", F.col("body")).otherwise(title)
    return p.select("url", first_chars(title, 180).alias("title"), summary_chars(text).alias("summary"), F.col("body").alias("clean_text"), F.coalesce(stated, written["ts"], by_url).alias("publish_time"), status.alias("publish_time_status"), detect_language(F.col("body"), title).alias("language"))


def low_value(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return t.isin(*LOW_VALUE) | t.startswith("share") | t.startswith("skip to")


def humanize_slug(slug: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(F.coalesce(slug, F.lit("")), "[-_]+", " ")))


def harvest_links(pages: DataFrame, limit: int, variant: str = "predicate", keep: Column | None = None) -> DataFrame:
    """(url, href, text, position) of the links of pages, at most `limit` a page.

    predicate: links with text; of several texts for one address the longest. path: as before, but links without
    text are named by the last part of their path. same_host: 8 to 120 characters of text, on the page's own
    host, and not about log-in, contact and the like. keep: a further condition on href and text."""
    links = parse_pages(pages).select("url", F.posexplode("links").alias("position", "link")).where("link.href <> ''")
    rows = links.select("url", "position", canonicalize_url(F.col("link.href"), F.col("url")).alias("href"), F.col("link.text").alias("text")).where(F.col("href").startswith("http"))
    if variant == "path":
        bare = low_value(F.col("text")) | F.lower("text").isin("learn more", "featured", "next", "")
        rows = rows.withColumn("text", F.when(bare, humanize_slug(F.regexp_extract("href", r"/([^/?#]+)/*(?:\?.*)?$", 1))).otherwise(F.col("text")))
    rows = rows.where((F.col("text") != "") & ~low_value(F.col("text")))
    if keep is not None:
        rows = rows.where(keep)
    if variant == "same_host":
        host = F.replace(F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.lit("www."), F.lit(""))
        rows = rows.where(F.length("text").between(8, 120) & F.contains(F.replace(F.regexp_extract("href", r"^[a-z]+://([^/?#]+)", 1), F.lit("www."), F.lit("")), host) & ~contains_any(F.col("href"), SKIPPED_PATHS))
    else:
        rows = rows.groupBy("url", "href").agg(F.max_by("text", F.struct(F.length("text"), -F.col("position"))).alias("text"), F.min("position").alias("position"))
    order = Window.partitionBy("url").orderBy("position")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n").select("url", "href", "text", "position")


def match_link_rules(links: DataFrame, rules: DataFrame) -> DataFrame:
    """links (source_id, href, text, ...) that a rule of their source accepts, with the rule of lowest precedence.

    rules: (source_id, rule_id, precedence, pattern, min_text, marker, excluded): href must match pattern and not
    excluded, the text must have min_text characters and hold the marker; null conditions hold."""
    r = rules.select("source_id", "rule_id", "precedence", "pattern", "min_text", "marker", "excluded")
    hit = links.join(F.broadcast(r), "source_id") if rules.count() <= 10_000 else links.join(r, "source_id")
    test = F.coalesce(F.expr("href rlike pattern"), F.lit(True)) & F.coalesce(F.length("text") >= F.col("min_text"), F.lit(True))
    test = test & F.coalesce(F.contains(F.lower("text"), F.lower("marker")), F.lit(True)) & ~F.coalesce(F.expr("href rlike excluded"), F.lit(False))
    first = Window.partitionBy("source_id", "href").orderBy("precedence", "rule_id")
    return hit.where(test).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*links.columns, "rule_id")


#: Hosts whose lists date their items better than the pages do; lengths of titles.
LIST_DATED_HOSTS = ("openai.com", "anthropic.com", "jazzyear.com", "cyzone.cn")
LONG_TITLE, FALLBACK_TITLE = 120, 180


def apply_list_hints(items: DataFrame, links: DataFrame, as_of: Column, list_dated_hosts: tuple[str, ...] = LIST_DATED_HOSTS) -> DataFrame:
    """items (url, title, summary, publish_time, publish_time_status, ...), which are what pages say, corrected by what the list
    says of them: links (href, text, position). Of links to one address the first counts; items without one stay.

    The link's text, as a card, replaces a title that is too long or that is this text itself. A date in the text replaces
    the page's on the named hosts, and fills a missing one, with its own status; else a date in the address does, as
    estimated. A link whose page is not among items becomes an item of its own, made of the text and these dates."""
    first = Window.partitionBy("href").orderBy("position", "text")
    hints = links.select("href", "text", "position").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    hints = hints.select(F.col("href").alias("url"), F.col("text").alias("_text"), date_from_text(F.col("text"), as_of).alias("_listed"), date_from_url(F.col("href")).cast("timestamp_ntz").alias("_from_url"), clean_card_title(F.col("text")).alias("_card"))
    rows = items.withColumn("_page", F.lit(True)).join(hints, "url", "full")
    read, blank = F.coalesce(F.col("_page"), F.lit(False)), F.coalesce(F.col("_card"), F.lit("")) == ""
    card = F.when(blank, F.col("_text")).otherwise(F.col("_card"))
    retitled = ~blank & ((F.length("title") > LONG_TITLE) | (F.col("title") == F.col("_text")))
    title = F.when(~read, first_chars(card, FALLBACK_TITLE)).when(retitled, F.col("_card")).otherwise(F.col("title"))
    named = F.lit(False)
    for host in list_dated_hosts:
        named = named | F.contains(F.col("url"), F.lit(host))
    own = F.when(read, F.col("publish_time"))
    listed, estimated = F.col("_listed.ts").isNotNull() & (own.isNull() | named), own.isNull() & F.col("_from_url").isNotNull()
    time = F.when(listed, F.col("_listed.ts")).when(estimated, F.col("_from_url")).otherwise(own)
    status = F.when(listed, F.col("_listed.status")).when(estimated, "estimated").when(read, F.col("publish_time_status")).otherwise("missing")
    out = {"title": title, "summary": F.when(read, F.col("summary")).otherwise(summary_chars(F.col("_text"))), "publish_time": time, "publish_time_status": status}
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in items.columns))


#: Sources that are limited by name: (list pages, links).
NAMED_LIMITS = {("36氪创投", "36氪AI", "TechCrunch AI", "The Verge AI", "VentureBeat AI", "The Decoder", "Crunchbase News AI"): (10, 30), ("a16z AI",): (10, 20)}
CATEGORY_LIMITS = {"venture_media": (10, 120), "tech_business_media": (10, 120), "ai_media": (10, 80), "ai_research_signal": (10, 80), "ai_product_signal": (10, 80), "startup_directory": (20, 100), "official_news": (5, 50), "official_research": (5, 50), "github": (10, 30), "hacker_news": (20, 50)}


def source_limits(name: Column, category: Column) -> Column:
    """struct(items, links) that a run takes of a source: by name, else by category."""
    pair = lambda p: F.struct(F.lit(p[0]).alias("items"), F.lit(p[1]).alias("links"))
    out = pair((3, 20))
    for c, p in CATEGORY_LIMITS.items():
        out = F.when(category == c, pair(p)).otherwise(out)
    for names, p in NAMED_LIMITS.items():
        out = F.when(name.isin(*names), pair(p)).otherwise(out)
    return out
