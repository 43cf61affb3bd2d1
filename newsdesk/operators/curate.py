"""Curation of events and watch items as batches of commands: (new state, log, rejected)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsdesk.functions.text import normalize_company_name

EVENT_FIELDS = ("event_title", "company_name", "announced_date", "financing_round", "amount_original", "amount_normalized", "currency", "event_summary", "investors", "lead_investors")


#: Rows that one task numbers.
NUMBERED_ROWS = 1_000_000


def numbered(rows: DataFrame, key: str, name: str, after: int, part_rows: int = NUMBERED_ROWS) -> DataFrame:
    """rows with `name`: numbers after `after` in the order of a numeric key. The key's range is cut into parts of about
    part_rows rows; each part is numbered by itself, behind the counted rows of the parts before it."""
    parts = max(1, -(-rows.count() // part_rows))
    cuts = sorted(set(rows.approxQuantile(key, [k / parts for k in range(1, parts)], 0.25 / parts))) if parts > 1 else []
    part = F.lit(0)
    for cut in cuts:
        part = part + F.when(F.col(key) > cut, 1).otherwise(0)
    dealt = rows.withColumn("_part", part)
    before, at = {}, after
    for r in sorted(dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row for each part
        before[r["_part"]] = at
        at += r["n"]
    behind = F.lit(after)
    for k, n in before.items():
        behind = F.when(F.col("_part") == k, F.lit(n)).otherwise(behind)
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return dealt.withColumn(name, (rank + behind).cast("long")).drop("_part")


def first_command(commands: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(first, deferred): the first command of each key by seq, and the others with reason 'deferred'."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    rows = commands.withColumn("_n", n)
    return rows.where("_n = 1").drop("_n"), rows.where("_n > 1").drop("_n").withColumn("reason", F.lit("deferred"))


def snapshot(event: str = "") -> Column:
    """The logged form of an event."""
    names = ("event_id", "event_title", "company_name", "announced_date", "financing_round", "amount_original", "review_status", "locked_by_user")
    return F.to_json(F.struct(*(F.col(f"{event}{n}").alias(n) for n in names)))


def assign_primary(links: DataFrame) -> DataFrame:
    """links with one primary source for each event: the first that is marked, else the first."""
    order = Window.partitionBy("event_id").orderBy(F.desc("is_primary_source"), "event_content_id")
    return links.withColumn("is_primary_source", F.row_number().over(order) == 1)


def revise_events(events: DataFrame, commands: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """commands: (seq, event_id, fields to set with `set_<field>` flags, review_status, locked_by_user,
    expected_updated_at). Absent flag columns mean that the field is not touched. An edit locks the event unless
    it says otherwise; a stale expected_updated_at is a conflict."""
    chosen, later = first_command(commands, "event_id")
    known = chosen.join(events.select("event_id", F.col("updated_at").alias("_at")), "event_id", "left")
    reason = F.when(F.col("_at").isNull(), "unknown event").when(F.col("expected_updated_at").isNotNull() & (F.col("expected_updated_at") != F.col("_at")), "conflict")
    judged = known.withColumn("reason", reason)
    good, bad = judged.where("reason is null").drop("reason", "_at"), judged.where("reason is not null").drop("_at")
    fields = [f for f in EVENT_FIELDS if f"set_{f}" in commands.columns and f in events.columns]
    renamed = good.select("event_id", *(F.col(c).alias(f"_{c}") for c in good.columns if c != "event_id"), F.lit(True).alias("_hit"))
    rows = events.join(renamed, "event_id", "left").withColumn("_before", snapshot())
    touched = F.greatest(*(F.coalesce(F.col(f"_set_{f}"), F.lit(False)) for f in fields), F.col("_review_status").isNotNull(), F.lit(False))
    rows = rows.withColumn("_touched", touched)
    for f in fields:
        rows = rows.withColumn(f, F.when(F.coalesce(F.col(f"_set_{f}"), F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f)))
    if "company_name" in fields:
        rows = rows.withColumn("company_name_normalized", F.when(F.coalesce(F.col("_set_company_name"), F.lit(False)), normalize_company_name(F.col("company_name"))).otherwise(F.col("company_name_normalized")))
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    rows = rows.withColumn("review_status", F.coalesce("_review_status", "review_status"))
    rows = rows.withColumn("locked_by_user", F.when(hit, F.coalesce("_locked_by_user", F.when(F.col("_touched"), True), "locked_by_user")).otherwise(F.col("locked_by_user")))
    rows = rows.withColumn("updated_at", F.when(hit, F.lit(str(as_of)).cast("timestamp_ntz")).otherwise(F.col("updated_at")))
    log = rows.where("_hit").select("event_id", F.lit("revise").alias("operation"), F.col("_before").alias("before"), snapshot().alias("after"))
    return rows.select(*events.columns), log, bad.unionByName(later, allowMissingColumns=True)


def merge_events(events: DataFrame, links: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events, links, log, rejected). commands: (seq, target_id, event_ids). Sources of the merged events move to the
    target; where both have a content the higher score stays. Merged events are excluded and locked. An event
    takes part in the first command that names it; the primary source is then assigned anew."""
    sized = commands.withColumn("event_ids", F.array_distinct("event_ids"))
    fits = (F.size("event_ids") >= 2) & F.array_contains("event_ids", F.col("target_id"))
    rejected = sized.where(~fits).withColumn("reason", F.lit("needs two events, the target among them"))
    pairs = sized.where(fits).select("seq", "target_id", F.explode("event_ids").alias("event_id"))
    pairs = pairs.withColumn("_first", F.min("seq").over(Window.partitionBy("event_id")))
    late = pairs.where("seq > _first").select("seq").distinct()
    missing = pairs.join(events.select("event_id"), "event_id", "left_anti").select("seq").distinct()
    rejected = rejected.unionByName(sized.join(late, "seq", "left_semi").withColumn("reason", F.lit("deferred"))).unionByName(sized.join(missing, "seq", "left_semi").join(late, "seq", "left_anti").withColumn("reason", F.lit("unknown event")))
    moves = pairs.join(late, "seq", "left_anti").join(missing, "seq", "left_anti").select("event_id", "target_id")
    moved = links.join(moves, "event_id", "left").withColumn("_from", F.col("event_id"))
    changed = F.col("target_id").isNotNull() & (F.col("target_id") != F.col("event_id"))
    moved = moved.withColumn("association_source", F.when(changed, "manual").otherwise(F.col("association_source"))).withColumn("is_primary_source", F.col("is_primary_source") & ~changed).withColumn("event_id", F.coalesce("target_id", "event_id"))
    one = Window.partitionBy("event_id", "content_id")
    moved = moved.withColumn("match_score", F.max("match_score").over(one)).withColumn("_n", F.row_number().over(one.orderBy(F.col("_from") != F.col("event_id"), "event_content_id"))).where("_n = 1")
    gone = moves.where("event_id <> target_id").select("event_id", F.col("target_id").alias("_target"))
    kept = moves.where("event_id = target_id").select("event_id", F.lit(True).alias("_kept"))
    rows = events.join(gone, "event_id", "left").join(kept, "event_id", "left").withColumn("_before", snapshot())
    rows = rows.withColumn("review_status", F.when(F.col("_target").isNotNull(), "excluded").otherwise(F.col("review_status"))).withColumn("event_summary", F.when(F.col("_target").isNotNull(), F.concat(F.lit("已合并至事件 #"), F.col("_target").cast("string"))).otherwise(F.col("event_summary")))
    rows = rows.withColumn("locked_by_user", F.col("locked_by_user") | F.col("_target").isNotNull() | F.col("_kept").isNotNull())
    log = rows.where("_target is not null or _kept").select("event_id", F.when(F.col("_target").isNull(), "merge").otherwise("merge_source").alias("operation"), F.col("_before").alias("before"), snapshot().alias("after"))
    return rows.select(*events.columns), assign_primary(moved.select(*links.columns)), log, rejected


def split_events(events: DataFrame, links: DataFrame, drafts: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events, links, log, rejected). commands: (seq, event_id, content_ids, new_title): some, not all, of an event's
    sources move to a new event. drafts: (content_id, and the columns of an event but for event_id) says what an event
    opened by a content is; the first moved source by link id opens it. New ids follow the largest in the order of
    seq; an event is split by the first command that names it; primaries are assigned anew."""
    chosen, late = first_command(commands, "event_id")
    wanted = chosen.select("seq", "event_id", "new_title", F.explode(F.array_distinct("content_ids")).alias("content_id"))
    moved = wanted.join(links.select("event_id", "content_id", "event_content_id"), ["event_id", "content_id"])
    sizes = links.groupBy("event_id").agg(F.count(F.lit(1)).alias("_size"))
    counts = moved.groupBy("seq", "event_id").agg(F.count(F.lit(1)).alias("_moved"), F.min_by("content_id", "event_content_id").alias("_opener"), F.first("new_title").alias("_title"))
    fits = counts.join(sizes, "event_id").where("_moved < _size")
    rejected = chosen.join(fits.select("seq"), "seq", "left_anti").withColumn("reason", F.lit("a split takes some of the sources")).unionByName(late)
    top = events.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    fits = numbered(fits, "seq", "_new", top)
    made = fits.select("_new", F.col("_opener").alias("content_id"), "_title").join(drafts, "content_id")
    made = made.withColumn("event_id", F.col("_new")).withColumn("event_title", F.coalesce("_title", "event_title")).withColumn("locked_by_user", F.lit(True))
    every = events.unionByName(made.select(*(c for c in made.columns if c in events.columns)), allowMissingColumns=True)
    target = moved.join(fits.select("seq", "_new"), "seq").select("event_id", "content_id", "_new")
    rows = links.join(target, ["event_id", "content_id"], "left")
    rows = rows.withColumn("association_source", F.when(F.col("_new").isNotNull(), "manual").otherwise(F.col("association_source"))).withColumn("event_id", F.coalesce("_new", "event_id"))
    log = fits.select("event_id", F.lit("split").alias("operation"), F.concat(F.lit("new_event="), F.col("_new").cast("string")).alias("note")).unionByName(fits.select(F.col("_new").alias("event_id"), F.lit("split_created").alias("operation"), F.concat(F.lit("source_event="), F.col("event_id").cast("string")).alias("note")))
    return every, assign_primary(rows.select(*links.columns)), log, rejected


def move_sources(links: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, rejected). commands: (seq, operation, event_id, content_id) with operation attach, detach or primary.

    attach moves or adds a content with score 100; detach needs the event to keep a source; both are followed by the
    assignment of primaries. One command for each content and each event in a batch."""
    by_content, late = first_command(commands, "content_id")
    by_event, later = first_command(by_content, "event_id")
    sizes = links.groupBy("event_id").agg(F.count(F.lit(1)).alias("_size"))
    own = links.select("content_id", F.col("event_id").alias("_owner"))
    c = by_event.join(sizes, "event_id", "left").join(own, "content_id", "left")
    reason = F.when(F.col("operation").isin("detach", "primary") & ~F.coalesce(F.col("_owner") == F.col("event_id"), F.lit(False)), "not a source of the event").when((F.col("operation") == "detach") & (F.col("_size") <= 1), "an event keeps one source")
    judged = c.withColumn("reason", reason)
    good = judged.where("reason is null").select("content_id", F.col("event_id").alias("_to"), F.col("operation").alias("_op"))
    bad = judged.where("reason is not null").select(*commands.columns, "reason").unionByName(late, allowMissingColumns=True).unionByName(later, allowMissingColumns=True)
    rows = links.join(good, "content_id", "left").where("_op is null or _op <> 'detach'")
    attach, primary = F.coalesce(F.col("_op") == "attach", F.lit(False)), F.coalesce(F.col("_op") == "primary", F.lit(False))
    moving = attach & (F.col("_to") != F.col("event_id"))
    rows = rows.withColumn("is_primary_source", (F.col("is_primary_source") & ~moving) | primary).withColumn("match_score", F.when(moving, 100.0).otherwise(F.col("match_score"))).withColumn("association_source", F.when(moving, "manual").otherwise(F.col("association_source"))).withColumn("event_id", F.when(moving, F.col("_to")).otherwise(F.col("event_id")))
    fresh = good.where("_op = 'attach'").join(links.select("content_id"), "content_id", "left_anti")
    top = links.agg(F.coalesce(F.max("event_content_id"), F.lit(0))).first()[0]
    fresh = numbered(fresh, "content_id", "event_content_id", top)
    fresh = fresh.select("event_content_id", F.col("_to").alias("event_id"), "content_id", F.lit(False).alias("is_primary_source"), F.lit(100.0).alias("match_score"), F.lit("manual").alias("association_source"), F.lit(False).alias("_p"))
    rows = rows.withColumn("_p", primary).select("event_content_id", "event_id", "content_id", "is_primary_source", "match_score", "association_source", "_p").unionByName(fresh)
    order = Window.partitionBy("event_id").orderBy(F.desc("_p"), F.desc("is_primary_source"), "event_content_id")
    return rows.withColumn("is_primary_source", F.row_number().over(order) == 1).drop("_p"), bad


def move_log(before: DataFrame, after: DataFrame, commands: DataFrame) -> DataFrame:
    """(event_id, operation, before, after, note) of the commands that changed an event's sources: its content ids as JSON."""
    ids = lambda links, name: links.groupBy("event_id").agg(F.to_json(F.array_sort(F.collect_list("content_id"))).alias(name))
    both = commands.select("event_id", "operation", F.concat(F.lit("content="), F.col("content_id").cast("string")).alias("note")).join(ids(before, "before"), "event_id", "left").join(ids(after, "after"), "event_id", "left")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select("event_id", "operation", "before", "after", "note")


OPEN_STATUSES = ("watching", "follow_up", "paused")


def active_key(target_type: Column, target_id: Column, status: Column) -> Column:
    """The key that only one unfinished watch item of a target may hold."""
    return F.when(status.isin(*OPEN_STATUSES), F.concat_ws(":", target_type, target_id.cast("string")))


def save_watch_items(items: DataFrame, commands: DataFrame, as_of: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """(items, rejected). commands: (seq, target_type, target_id, priority, status, next_review_date): new items, unless
    their target has an unfinished one already, in the table or earlier in the batch."""
    c = commands.withColumn("active_target_key", active_key(F.col("target_type"), F.col("target_id"), F.col("status")))
    held = items.where("active_target_key is not null").select("active_target_key").distinct()
    first = F.row_number().over(Window.partitionBy("active_target_key").orderBy("seq"))
    open_ = c.where("active_target_key is not null").withColumn("_n", first)
    free = open_.where("_n = 1").join(held, "active_target_key", "left_anti").drop("_n")
    rejected = c.join(free.select("seq"), "seq", "left_anti").where("active_target_key is not null").withColumn("reason", F.lit("同一目标已有未完成关注项"))
    new = free.unionByName(c.where("active_target_key is null"))
    top = items.agg(F.coalesce(F.max("watch_id"), F.lit(0))).first()[0]
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    new = numbered(new, "seq", "watch_id", top).withColumn("updated_at", now).withColumn("completed_at", F.when(F.col("status") == "completed", now))
    return items.unionByName(new.drop("seq"), allowMissingColumns=True), rejected


def update_watch_status(items: DataFrame, commands: DataFrame, as_of: dt.datetime) -> DataFrame:
    """items with new statuses (watch_id, new_status); completed ones free their key and get the time."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    rows = items.join(commands.select("watch_id", "new_status"), "watch_id", "left")
    changed = F.col("new_status").isNotNull()
    rows = rows.withColumn("status", F.coalesce("new_status", "status"))
    rows = rows.withColumn("active_target_key", active_key(F.col("target_type"), F.col("target_id"), F.col("status"))).withColumn("completed_at", F.when(changed, F.when(F.col("status") == "completed", now)).otherwise(F.col("completed_at"))).withColumn("updated_at", F.when(changed, now).otherwise(F.col("updated_at")))
    return rows.drop("new_status")
