"""Model output: row-wise generation, validation and merging; and the checks that a report must pass."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsdesk.functions.text import estimate_tokens
from newsdesk.operators.reports import SECTIONS

GENERATED = "row_id string, status string, output string, error string, tokens_in int, tokens_out int, seconds double"
FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")
TEXT_KEYS = ("report", "markdown", "content", "text")


def unfence(text: str) -> str:
    """Model text without the code fence around it."""
    return FENCE.sub("", text or "").strip()


def report_text(text: str) -> str:
    """Report text that may come as a JSON object with one of the usual keys."""
    bare = unfence(text)
    try:
        data = json.loads(bare)
    except ValueError:
        return bare
    return next((data[k] for k in TEXT_KEYS if isinstance(data.get(k), str)), bare) if isinstance(data, dict) else bare


def generate_rows(payloads: DataFrame, generator: Callable[[str], str] | None, parallel: int | None = None) -> DataFrame:
    """A row per payload (row_id, payload) with what the generator returned: status success, failed or, without a
    generator, not_configured. A failing row carries its error and never fails the job; parallel bounds the
    number of tasks that call the generator."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row, payload in zip(frame["row_id"], frame["payload"], strict=True):
                began = time.time()
                out, error, status = None, None, "not_configured"
                if generator is not None:
                    try:
                        out, status = unfence(generator(payload)), "success"
                    except Exception as e:  # the row records it
                        error, status = f"{type(e).__name__}: {e}"[:1000], "failed"
                rows.append((str(row), status, out, error, max(1, (len(payload or "") + 3) // 4), (len(out or "") + 3) // 4, time.time() - began))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in GENERATED.split(", ")])

    asked = payloads.select(F.col("row_id").cast("string").alias("row_id"), "payload")
    return (asked.repartition(parallel) if parallel else asked).mapInPandas(run, GENERATED)


def guard_payloads(payloads: DataFrame, context_tokens: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): payloads whose estimated tokens exceed the context window are rejected with a message."""
    sized = payloads.withColumn("tokens", estimate_tokens(F.col("payload")))
    message = F.format_string("estimated %d tokens exceed the context window of %d", F.col("tokens"), F.lit(context_tokens))
    return sized.where(F.col("tokens") <= context_tokens), sized.where(F.col("tokens") > context_tokens).withColumn("error", message)


def validate_updates(updates: DataFrame, items: DataFrame) -> DataFrame:
    """updates (report_date, content_id, event_id, summary, why_it_matters, category, theme) with violations, an array.
    Any violation in a report means that none of its updates may be used: `accepted` says so."""
    known = items.select("report_date", F.coalesce("content_id", F.lit(0)).alias("_c"), F.coalesce("event_id", F.lit(0)).alias("_e"), F.lit(True).alias("_known")).dropDuplicates(["report_date", "_c", "_e"])
    u = updates.withColumn("_c", F.coalesce("content_id", F.lit(0))).withColumn("_e", F.coalesce("event_id", F.lit(0)))
    times = u.groupBy("report_date", "_c", "_e").agg(F.count(F.lit(1)).alias("_times"))
    u = u.join(known, ["report_date", "_c", "_e"], "left").join(times, ["report_date", "_c", "_e"], "left")
    one = F.col("content_id").isNotNull() != F.col("event_id").isNotNull()
    tests = [
        (~one, "one of content_id and event_id"),
        (one & (F.coalesce("content_id", "event_id") <= 0), "id is not positive"),
        (one & F.col("_known").isNull(), "unknown item"),
        (F.col("_times") > 1, "item updated twice"),
        (F.col("theme").isNotNull() & (F.trim("theme") == ""), "blank theme"),
        (F.col("category").isNotNull() & ~F.col("category").isin(*SECTIONS), "unknown category"),
    ]
    u = u.withColumn("violations", F.filter(F.array(*(F.when(t, F.lit(name)) for t, name in tests)), lambda x: x.isNotNull())).drop("_c", "_e", "_known", "_times")
    bad = u.groupBy("report_date").agg(F.bool_or(F.size("violations") > 0).alias("_bad"))
    return u.join(bad, "report_date").withColumn("accepted", ~F.col("_bad")).drop("_bad")


def enrich_report(items: DataFrame, updates: DataFrame) -> DataFrame:
    """Flat report items with accepted updates merged: summary, why_it_matters, category and theme alone may change.
    mode: llm where a report's updates were accepted, partial where they were not, else deterministic."""
    checked = validate_updates(updates, items)
    state = checked.groupBy("report_date").agg(F.bool_and("accepted").alias("_ok"))
    fields = ("summary", "why_it_matters", "category", "theme")
    good = checked.where("accepted").select("report_date", F.coalesce("content_id", F.lit(0)).alias("_c"), F.coalesce("event_id", F.lit(0)).alias("_e"), *(F.trim(f).alias(f"_{f}") for f in fields))
    rows = items.withColumn("_c", F.coalesce("content_id", F.lit(0))).withColumn("_e", F.coalesce("event_id", F.lit(0))).join(good, ["report_date", "_c", "_e"], "left").join(state, "report_date", "left")
    for f in fields:
        rows = rows.withColumn(f, F.coalesce(f"_{f}", f))
    mode = F.when(F.col("_ok"), "llm").when(~F.col("_ok"), "partial").otherwise("deterministic")
    return rows.withColumn("mode", mode).select(*items.columns, "mode")


#: Counts of a report that are never negative.
REPORT_COUNTS = ("sources_attempted", "sources_succeeded", "raw_items", "included_items", "failed_sources")


def validate_report(items: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """(report_date, violation, content_id, event_id) of flat report items; no rows if the report may be shown.

    items may carry sources, an array of structs with a url, which events need. reports (report_date[, stats,
    section_keys]): a report's counts as a struct, and the keys of its sections in order."""

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))

    one = F.col("content_id").isNotNull() != F.col("event_id").isNotNull()
    scheme = F.lower(F.regexp_extract(F.trim("url"), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    tests = [
        (~one, "must have exactly one content_id or event_id"),
        (F.coalesce("content_id", "event_id") <= 0, "id must be positive"),
        *((blank(c), f"{c} must be a non-empty string") for c in ("title", "summary", "source", "url")),
        (~scheme.isin("", "http", "https"), "url must use http(s) or a relative URL"),
        (~F.coalesce(F.col("section").isin(*SECTIONS), F.lit(False)), "unknown section"),
    ]
    if "sources" in items.columns:
        event, none = F.col("event_id").isNotNull(), F.coalesce(F.size("sources"), F.lit(0)) <= 0
        tests += [
            (event & none, "sources must contain at least one source"),
            (event & ~none & F.exists("sources", lambda x: F.coalesce(x["url"], F.lit("")) == ""), "sources must contain database URLs"),
        ]
    found = items.withColumn("violation", F.explode(F.filter(F.array(*(F.when(t, F.lit(name)) for t, name in tests)), lambda x: x.isNotNull())))
    out = found.select("report_date", "violation", "content_id", "event_id")
    if reports is not None:
        wrong = []
        if "stats" in reports.columns:
            held = reports.schema["stats"].dataType.fieldNames()
            wrong += [(F.col("stats")[c] < 0, f"stats.{c} must be a non-negative integer") for c in REPORT_COUNTS if c in held]
        if "section_keys" in reports.columns:
            wrong.append((~F.col("section_keys").eqNullSafe(F.array(*map(F.lit, SECTIONS))), "sections must be complete and in order"))
        said = F.filter(F.array(F.lit(None).cast("string"), *(F.when(t, F.lit(name)) for t, name in wrong)), lambda x: x.isNotNull())
        none_id = F.lit(None).cast("long")
        out = out.unionByName(reports.select("report_date", F.explode(said).alias("violation"), none_id.alias("content_id"), none_id.alias("event_id")))
    for c, other in (("content_id", "event_id"), ("event_id", "content_id")):
        twice = items.where(F.col(c).isNotNull()).groupBy("report_date", c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        out = out.unionByName(twice.select("report_date", F.lit(f"duplicate {c}").alias("violation"), c, F.lit(None).cast("long").alias(other)))
    return out
