"""Operators on small frames; order-dependent ones against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsdesk.functions import similarity
from newsdesk.functions.terms import Terms
from newsdesk.operators import cluster, curate, enrich, filters, ingest, joins, pages, reports, rollups, scoring, taxonomy
from newsdesk.sources import keyed, sinks, tables
from newsdesk.streaming import jobs

T = dt.datetime


def test_financing_needs_all_signals(spark):
    c = spark.createDataFrame([(1, True), (2, True), (3, True), (4, None)], "content_id long, ai_related boolean")
    every = [(i, "content_type", "financing") for i in (1, 2, 3, 4)] + [(1, "ai_financing_relevance", "high"), (3, "ai_financing_relevance", "none"), (4, "ai_financing_relevance", "high")]
    t = spark.createDataFrame(every, "content_id long, tag_key string, tag_value string")
    assert [r.content_id for r in filters.financing_contents(c, t).collect()] == [1]
    t = t.union(spark.createDataFrame([(1, "manual_financing_status", "excluded")], t.schema))
    assert filters.financing_contents(c, t).count() == 0


def test_older_streak_equals_loop(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for s in range(40):
        older = 0
        open_ = True
        for p in range(40):
            kind = rng.random()
            inside, before = kind < 0.1, 0.1 <= kind < 0.85
            rows.append((s, p, inside, before))
            if open_:
                want.add((s, p))
                older = 0 if inside else older + before
                open_ = older < 10
    d = spark.createDataFrame(rows, "source_id long, position long, in_window boolean, before_window boolean").repartition(3)
    for block in (1, 3, 7, 4096):  # a source in many blocks and in one
        assert {(r.source_id, r.position) for r in filters.cut_after_older_streak(d, block=block).collect()} == want
    assert filters.cut_after_older_streak(d.limit(0)).count() == 0


FUND = "content_id long, title string, summary string, shown timestamp_ntz"


def test_two_reports_make_one_cluster(spark):
    rows = [(1, "灵巧手完成A轮融资，金额超亿元", "由甲资本领投", T(2026, 6, 10, 9)), (2, "灵巧手获超亿元A轮融资", "由甲资本领投", T(2026, 6, 11, 9)), (3, "别的公司获5000万元天使轮融资", "", T(2026, 6, 11, 8))]
    items = spark.createDataFrame(rows, FUND)
    found = cluster.cluster_financing(items)
    assert {(r.content_id, r.cluster_id) for r in found.collect()} == {(1, 2), (2, 2), (3, 3)}
    view = cluster.cluster_view(items.withColumn("source_name", F.lit("s")), found).where("cluster_id = 2").first()
    assert view.related_count == 1 and view.primary.content_id == 2


def test_weekly_clusters_hold_every_financing_row(spark):
    from newsdesk.operators.filters import financing_contents
    from newsdesk.plans.catalog import QUERIES
    from newsdesk.plans.frames import frame

    folder = "/root/testdata/sf0.001"
    rows = financing_contents(frame(spark, folder, "d2"), frame(spark, folder, "d5")).select("content_id", "crawl_time").collect()
    shown = {r.content_id: r.crawl_time for r in rows}
    found = {r.content_id: r.cluster_id for r in QUERIES["cl02_clusters"](spark, folder).collect()}
    assert found.keys() == shown.keys()
    week = lambda i: shown[i].isocalendar()[:2]
    assert all(week(i) == week(c) for i, c in found.items())
    assert any(shown[i].date() != shown[c].date() for i, c in found.items())
    details = {r.cluster_id for r in QUERIES["rp03_cluster_detail"](spark, folder).select("cluster_id").collect()}
    assert details == set(found.values())


def test_periods_are_clustered_by_themselves(spark):
    rows = [(1, "灵巧手完成A轮融资，金额超亿元", "", T(2026, 6, 10, 9)), (2, "灵巧手获超亿元A轮融资", "", T(2026, 6, 11, 9)), (3, "灵巧手获超亿元A轮融资", "", T(2026, 6, 15, 9)), (4, "灵巧手获超亿元A轮融资", "", None)]
    items = spark.createDataFrame(rows, FUND)
    week = F.date_trunc("week", F.col("shown"))
    assert {(r.content_id, r.cluster_id) for r in cluster.cluster_financing(items, period=week).collect()} == {(1, 2), (2, 2), (3, 3), (4, 4)}


def loop_over_all(signatures):
    """The rule itself: every item against every cluster."""
    clusters, out = [], []
    for item, s in signatures:
        best, top = None, 0.0
        for k, (_, c) in enumerate(clusters):
            score = cluster.duplicate_score(s, c)
            if score > top:
                best, top = k, score
        if best is not None and top >= cluster.CLUSTER_SCORE:
            for field in cluster.GROWING:
                clusters[best][1][field] = clusters[best][1][field] | s[field]
            out.append((item, clusters[best][0]))
        else:
            clusters.append((item, dict(s)))
            out.append((item, item))
    return out


def signatures_of(items):
    from newsdesk.functions.finance import financing_signature

    rows = items.select("content_id", "shown", financing_signature(F.col("title"), F.col("summary"), F.col("shown")).alias("s")).select("content_id", "shown", "s.*").collect()
    rows.sort(key=lambda r: (r.shown or T(1, 1, 1), r.content_id), reverse=True)
    return [(r.content_id, {k: set(r[k]) for k in cluster.GROWING} | {"title_norm": r.title_norm, "date": r.date}) for r in rows]


@pytest.mark.parametrize("days", [5, 40])
def test_clusters_equal_one_global_loop(spark, days, monkeypatch):
    rng = random.Random(7 + days)
    names = ["星辰科技", "星辰", "灵巧手", "云图", "云图数据", "蓝海", "北斗机器", "南斗机器", "Alpha One", "Alpha"]
    rows = []
    for i in range(220):
        n, a, r = rng.choice(names), rng.choice(["", "5000万元", "1亿美元", "超亿元"]), rng.choice(["A轮", "B轮", ""])
        shown = T(2026, 6, 1) + dt.timedelta(hours=rng.randrange(24 * days)) if rng.random() < 0.95 else None
        rows.append((i, f"{n}{rng.choice(['完成', '获'])}{a}{r}融资{rng.choice(['', '加速研发', '扩张'])}", rng.choice(["", None, "由甲资本领投"]), shown))
    items = spark.createDataFrame(rows + rows[:1], FUND).dropDuplicates(["content_id"]).repartition(3)
    want = set(loop_over_all(signatures_of(items)))
    assert {(r.content_id, r.cluster_id) for r in cluster.cluster_financing(items).collect()} == want
    signatures = [s for _, s in signatures_of(items)]
    monkeypatch.setattr(cluster, "REMEMBERED", 50)  # what is known of clusters is forgotten again and again
    assert set(cluster.fold_clusters([(i, k) for k, (i, _) in enumerate(signatures_of(items))], signatures)) == want
    with pytest.raises(ValueError):
        cluster.cluster_financing(items, threshold=0.7)


def test_names_of_one_length_are_not_parts():
    assert cluster.company_relation({"星辰0001"}, {"星辰0002"}) == "other"
    assert cluster.company_relation({"星辰0001"}, {"星辰00012"}) == "part"
    assert cluster.company_relation({"abc"}, {"abcd"}) == "other"


def test_pairs_equal_the_scores_of_two(spark):
    rng = random.Random(4)
    names = ["星辰科技", "星辰科技智能", "北辰", "海云数据", "Nova Labs"]
    rows = [(i, f"{rng.choice(names)}{rng.choice(['完成', '获'])}{rng.choice(['100万元', '3亿元', ''])}{rng.choice(['A轮', 'B轮', ''])}融资{rng.choice(['', ' 领跑'])}", rng.choice(["由资本一领投", None]), T(2024, 1, 1 + rng.randrange(25)) if i % 9 else None) for i in range(60)]
    items = spark.createDataFrame(rows, FUND)
    known = dict(signatures_of(items))
    from newsdesk.functions.finance import financing_signature

    s = items.select("content_id", financing_signature(F.col("title"), F.col("summary"), F.col("shown")).alias("s"))
    sides = [F.col("a.content_id").alias("l"), F.col("b.content_id").alias("r"), F.col("a.s").alias("left"), F.col("b.s").alias("right")]
    got = cluster.score_pairs(s.alias("a").join(s.alias("b"), F.col("a.content_id") < F.col("b.content_id")).select(*sides)).collect()
    assert len(got) == 60 * 59 // 2 and len({r.score for r in got}) > 10
    assert all(r.score == cluster.duplicate_score(known[r.l], known[r.r]) for r in got)
    e = cluster.event_signature(items)
    told = {r.content_id: {k: set(r[k]) for k in ("companies", "amounts", "rounds", "investors")} | {"title_norm": r.title_norm, "date": r.date} for r in e.collect()}
    e = e.select("content_id", F.struct("companies", "amounts", "rounds", "investors", "title_norm", "date").alias("s"))
    got = cluster.score_pairs(e.alias("a").join(e.alias("b"), F.col("a.content_id") < F.col("b.content_id")).select(*sides), "event").collect()
    assert all((r.score, r.reasons) == cluster.event_match(told[r.l], told[r.r]) for r in got) and len({r.score for r in got}) > 5


def test_ratios_equal_difflib(spark):
    from difflib import SequenceMatcher

    rng = random.Random(3)
    left, right = [], []
    for _ in range(100_000):
        letters = rng.choice(["ab", "abcde", "星辰完成万元轮融资0123456789获A B", "a\U0001f600é"])
        x, y = ("".join(rng.choice(letters) for _ in range(rng.randrange(24))) for _ in "xy")
        if rng.random() < 0.5:
            i = rng.randrange(len(x) + 1)
            y = x[:i] + rng.choice(letters) * rng.randrange(3) + x[i + rng.randrange(3) :]
        left.append(x)
        right.append(y)
    left += ["", "a" * 300, "abc" * 100, "x\0y"]
    right += ["", "a" * 150, "acb" * 100, "x\0z"]
    want = [SequenceMatcher(None, x, y).ratio() for x, y in zip(left, right, strict=True)]
    assert similarity.ratios(left, right).tolist() == want
    d = spark.createDataFrame(list(zip(left[:3000], right[:3000], want[:3000], strict=True)), "x string, y string, r double")
    x, y = F.col("x"), F.col("y")
    assert d.where((similarity.upper_bound(x, y) < F.col("r")) | (similarity.length_bound(x, y) < similarity.upper_bound(x, y))).count() == 0


def test_terms_found_in_one_pass(spark):
    rng = random.Random(2)
    terms = Terms(["ab", "abc", "b", "融资", "融资轮", "Series A"], ["x" * n for n in range(3, 80)])
    texts = ["".join(rng.choice(["a", "b", "c", "融资", "轮", "x" * 9, "series a", " "]) for _ in range(rng.randrange(12))) for _ in range(300)] + [None, ""]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").withColumn("found", terms.found(F.col("t")))
    for lists in (["ab"], ["x" * 70, "融资轮"], ["b", "x" * 79], list(terms.terms), []):
        got = {r.i for r in d.where(terms.any_of(F.col("found"), lists)).collect()}
        assert got == {i for i, t in enumerate(texts) if any(x in (t or "") for x in lists)}
    with pytest.raises(KeyError):
        terms.any_of(F.col("found"), ["unknown"])


def test_events_attach_and_create(spark):
    items = spark.createDataFrame([(1, "灵巧手完成A轮融资", "", T(2026, 8, 1, 9)), (2, "灵巧手获5000万元A轮融资", "", T(2026, 8, 2, 9)), (3, "Alpha完成B轮融资", "", T(2026, 8, 2, 9))], FUND)
    events, links = cluster.build_events(items)
    assert events.count() == 2 and links.count() == 3
    attached = links.where("content_id = 1").first()
    assert attached.event_key == 2 and attached.reasons[0] == "公司名称一致" and attached.match_score >= 70
    assert cluster.build_events(items, links)[0].count() == 0


def test_events_extend_stored_ones(spark):
    kind = "event_id long, event_title string, company_name string, company_name_normalized string, announced_date date, financing_round string, amount_original string, investors array<string>, review_status string, locked_by_user boolean, confidence double"
    held = spark.createDataFrame(
        [
            (2**60 + 1, "灵巧手完成A轮融资", "灵巧手", "灵巧手", dt.date(2026, 8, 1), "A轮", None, None, "pending", False, 0.5),
            (8, "Alpha完成A轮融资", "Alpha", "alpha", dt.date(2026, 8, 1), "A轮", None, None, "confirmed", False, 0.9),
            (9, "Beta完成A轮融资", "Beta", "beta", None, "种子轮", None, None, "pending", False, 0.2),
        ],
        kind,
    )
    items = spark.createDataFrame([(1, "灵巧手完成A轮融资", "", T(2026, 8, 1, 9)), (2, "Alpha完成A轮融资", "", T(2026, 8, 2, 9)), (3, "Beta完成B轮融资", "", T(2026, 8, 2, 9)), (4, "Beta完成B轮融资", "", T(2026, 8, 2, 8)), (5, "x", "", T(2026, 8, 2, 9))], FUND)
    links = spark.createDataFrame([(5, 8)], "content_id long, event_id long")
    events, new, log, stats = cluster.extend_events(items, held, links)
    got = {r.content_id: (r.event_id, r.event_key, r.is_primary_source) for r in new.collect()}
    assert got == {1: (2**60 + 1, None, False), 2: (None, 2, True), 3: (None, 3, True), 4: (None, 3, False)}
    assert stats.first().asDict() == {"scanned": 5, "created": 2, "attached": 2, "skipped": 1, "conflicts": 1}
    assert {r.event_key for r in log.collect()} == {2, 3} and all(r.operation == "candidate_created" for r in log.collect())
    confidence = {r.event_id or r.event_key: r.confidence for r in events.collect()}
    assert confidence[2**60 + 1] >= 0.75 and confidence[8] == 0.9 and events.count() == 5
    assert cluster.event_candidates(items.withColumnRenamed("shown", "crawl_time"), dt.date(2026, 8, 2), start=dt.date(2026, 8, 2)).count() == 4


def test_upsert_knows_old_names(spark):
    held = spark.createDataFrame([("old", "u1", "mine"), ("kept", "u2", "x")], "name string, url string, note string")
    new = spark.createDataFrame([("new", "u9", "theirs"), ("added", "u3", "theirs")], "name string, url string, note string")
    got = joins.upsert(held, new, ["name"], ["url"], ["note"], {"name": {"old": "new"}})
    assert {tuple(r) for r in got.collect()} == {("new", "u9", "mine"), ("kept", "u2", "x"), ("added", "u3", "theirs")}


def test_near_duplicate_titles(spark):
    d = spark.createDataFrame([(1, "a big red fox runs"), (2, "a big red fox runs"), (3, "a big red fox runs!x"), (4, "other words here")], "id long, t string")
    assert [(r.left_id, r.right_id) for r in cluster.near_duplicates(d, "id", F.col("t")).collect()] == [(1, 3)]


def test_score_and_reviews(spark):
    d = spark.createDataFrame([(1, "完成融资", None, "ai_media", True)], "content_id long, title string, summary string, c string, ai boolean")
    s = d.select(scoring.score_content(F.col("title"), F.col("summary"), F.col("c"), F.col("ai"), F.array(F.lit("financing")), F.array(F.lit("x")), F.lit(False)).alias("s")).first()["s"]
    assert s["score"] == 100 and len(s["reasons"]) == 4 and s["confidence"] == 0.77
    state = spark.createDataFrame([(1, 30, 0.4, ["a"], "unread"), (2, 90, 0.4, ["a"], "unread")], "content_id long, score int, confidence double, reasons array<string>, review_status string")
    cmds = spark.createDataFrame([(1, 1, "relevant"), (1, 2, "not_relevant"), (2, 1, "follow_up"), (2, 5, "other")], "content_id long, seq long, decision string")
    new, audit = scoring.apply_reviews(state, cmds)
    got = {r.content_id: r for r in new.collect()}
    assert (got[1].score, got[1].review_status, got[1].reasons) == (20, "ignored", ["人工复核：not_relevant", "人工复核：relevant", "a"])
    assert (got[2].score, got[2].confidence, got[2].review_status) == (90, 0.95, "follow_up")
    assert [(r.previous_status, r.previous_score) for r in audit.where("content_id = 1").orderBy("seq").collect()] == [("unread", 30), ("reviewed", 80)]


def test_week_status(spark):
    runs = spark.createDataFrame([(1, None, T(2026, 6, 15, 9), "partial_success", 1, 0), (2, None, T(2026, 6, 16, 9), "failed", 0, 1), (3, 5, T(2026, 6, 17, 9), "success", 0, 1)], "crawl_run_id long, source_id long, started_at timestamp_ntz, status string, new_items int, failed_items int")
    contents = spark.createDataFrame([(1, T(2026, 6, 15, 9))], "content_id long, crawl_time timestamp_ntz")
    week = rollups.week_status(spark, runs, contents, dt.date(2026, 6, 17))
    assert sorted(r.day for r in rollups.missing_dates(week).collect()) == [dt.date(2026, 6, 16), dt.date(2026, 6, 17)]


def test_sources_without_contents_have_an_empty_page(spark):
    contents = spark.createDataFrame([(i, 1, T(2024, 1, 1), T(2024, 1, 1 + i)) for i in range(12)], "content_id long, source_id long, publish_time timestamp_ntz, crawl_time timestamp_ntz")
    sources = spark.createDataFrame([(1, "a", "ai_media", True), (2, "b", "other", True), (3, "c", "github", False)], "source_id long, source_name string, source_category string, enabled boolean")
    got = rollups.page_per_source(contents, sources, page=2).collect()
    assert {(r.source_id, r.total, r.pages, r.place, r.content_id) for r in got} == {(1, 12, 2, 11, 1), (1, 12, 2, 12, 0), (2, 0, 1, None, None)}


def test_report_checks(spark):
    day = dt.date(2024, 1, 10)
    kind = "report_date date, section string, content_id long, event_id long, title string, summary string, source string, url string, sources array<struct<url:string>>"
    items = spark.createDataFrame([(day, "funding", None, 1, "t", "s", "x", "/e", [("u",)]), (day, "funding", None, 2, "t", "s", "x", "/e", []), (day, "funding", None, 3, "t", "s", "x", "/e", [("u",), ("",)]), (day, "funding", 4, None, "t", "s", "x", "/e", None)], kind)
    reports = spark.createDataFrame([(day, (-1, 0), ["technology", "funding"])], "report_date date, stats struct<raw_items:int,included_items:int>, section_keys array<string>")
    got = {(r.violation, r.event_id) for r in enrich.validate_report(items, reports).collect()}
    assert got == {("sources must contain at least one source", 2), ("sources must contain database URLs", 3), ("stats.raw_items must be a non-negative integer", None), ("sections must be complete and in order", None)}
    good = spark.createDataFrame([(day, (1, 0), ["technology", "industry", "funding"])], reports.schema)
    assert enrich.validate_report(items.where("event_id = 1"), good).count() == 0


def test_watch_conflicts(spark):
    items = spark.createDataFrame([(1, "content", 7, "content:7", "high", "watching", None, None, None)], tables.SCHEMAS["watch_items"])
    cmd = spark.createDataFrame([(1, "content", 7, "low", "watching", None), (2, "content", 8, "low", "paused", None), (3, "content", 8, "low", "watching", None), (4, "content", 7, "low", "completed", None)], "seq long, target_type string, target_id long, priority string, status string, next_review_date date")
    new, rejected = curate.save_watch_items(items, cmd, T(2026, 1, 1))
    assert new.count() == 3 and sorted(r.seq for r in rejected.collect()) == [1, 3]
    done = curate.update_watch_status(new, spark.createDataFrame([(1, "completed")], "watch_id long, new_status string"), T(2026, 1, 2))
    again, rejected = curate.save_watch_items(done, cmd.where("seq = 1"), T(2026, 1, 3))
    assert again.count() == 4 and rejected.count() == 0


def events_and_links(spark):
    ev = spark.createDataFrame([(i, "financing", f"t{i}", f"公司{i}", f"{i}", dt.date(2026, 8, 1), "A轮", None, None, None, [], [], "s", 0.5, "pending", False, T(2026, 8, 1)) for i in (1, 2, 3)], tables.SCHEMAS["financing_events"])
    ln = spark.createDataFrame([(1, 1, 10, True, 80.0, [], "automatic"), (2, 1, 11, False, 70.0, [], "automatic"), (3, 2, 12, True, 90.0, [], "automatic")], tables.SCHEMAS["event_contents"])
    return ev, ln


def test_merge_and_move_sources(spark):
    ev, ln = events_and_links(spark)
    cmds = spark.createDataFrame([(1, 1, [1, 2]), (2, 3, [3, 2]), (3, 1, [1])], "seq long, target_id long, event_ids array<long>")
    new, links, log, rejected = curate.merge_events(ev, ln, cmds)
    got = {r.event_id: r for r in new.collect()}
    assert got[2].review_status == "excluded" and got[2].locked_by_user and got[1].locked_by_user and got[3].review_status == "pending"
    assert sorted((r.event_id, r.content_id, r.is_primary_source) for r in links.collect()) == [(1, 10, True), (1, 11, False), (1, 12, False)]
    assert sorted((r.seq, r.reason[:8]) for r in rejected.collect()) == [(2, "deferred"), (3, "needs tw")] and log.count() == 2
    cmds = spark.createDataFrame([(1, "detach", 2, 12), (2, "detach", 1, 10), (3, "attach", 3, 99)], "seq long, operation string, event_id long, content_id long")
    links, rejected = curate.move_sources(ln, cmds)
    assert sorted((r.event_id, r.content_id, r.is_primary_source) for r in links.collect()) == [(1, 11, True), (2, 12, True), (3, 99, True)]
    assert [r.seq for r in rejected.collect()] == [1]


def test_revise(spark):
    ev, _ = events_and_links(spark)
    cmds = spark.createDataFrame([(1, 1, "灵巧手科技", True, None, None, None), (2, 2, None, False, "confirmed", None, T(2020, 1, 1)), (3, 1, None, False, "confirmed", None, None)], "seq long, event_id long, company_name string, set_company_name boolean, review_status string, locked_by_user boolean, expected_updated_at timestamp_ntz")
    new, log, rejected = curate.revise_events(ev, cmds, T(2026, 9, 1))
    got = {r.event_id: r for r in new.collect()}
    assert (got[1].company_name_normalized, got[1].locked_by_user, got[1].updated_at) == ("灵巧手", True, T(2026, 9, 1))
    assert got[2].review_status == "pending" and log.count() == 1
    assert sorted((r.seq, r.reason) for r in rejected.collect()) == [(2, "conflict"), (3, "deferred")]


ITEMS = "report_date date, section string, content_id long, event_id long, title string, summary string, why_it_matters string, category string, theme string, source string, url string"
UPDATES = "report_date date, content_id long, event_id long, summary string, why_it_matters string, category string, theme string, url string"


def test_enrichment_is_all_or_nothing(spark):
    d1, d2 = dt.date(2026, 8, 1), dt.date(2026, 8, 2)
    items = spark.createDataFrame([(d, "technology", i, None, "t", "s", "w", "technology", "x", "src", "http://u") for d in (d1, d2) for i in (1, 2)], ITEMS)
    updates = spark.createDataFrame([(d1, 1, None, "new", None, "funding", "y", "http://forged"), (d2, 1, None, "new", None, None, None, None), (d2, 999, None, "bad", None, None, None, None)], UPDATES)
    got = {(r.report_date, r.content_id): r for r in enrich.enrich_report(items, updates).collect()}
    assert (got[d1, 1].summary, got[d1, 1].category, got[d1, 1].url, got[d1, 1].mode) == ("new", "funding", "http://u", "llm")
    assert (got[d2, 1].summary, got[d2, 1].mode) == ("s", "partial")
    assert enrich.validate_report(items).count() == 0
    bad = items.withColumn("url", F.lit("ftp://x")).where("content_id = 1").union(items.where("content_id = 1"))
    assert {r.violation for r in enrich.validate_report(bad).collect()} == {"url must use http(s) or a relative URL", "duplicate content_id"}


def test_generated_rows(spark):
    d = spark.createDataFrame([("1", "ok"), ("2", "boom")], "row_id string, payload string")

    def generator(payload):
        if payload == "boom":
            raise ValueError("no")
        return "```json\n{}\n```"

    got = {r.row_id: r for r in enrich.generate_rows(d, generator).collect()}
    assert got["1"].output == "{}" and got["2"].status == "failed" and "ValueError" in got["2"].error
    assert enrich.generate_rows(d, None).where("status = 'not_configured'").count() == 2
    assert enrich.report_text('```\n{"markdown": "# x"}\n```') == "# x"


PAGE = """<html><head><meta property="article:published_time" content="2026-06-11T00:00:00+00:00"><title>Title - 36氪</title></head><body><nav><a href="/login">login or sign up here</a></nav>
<article><h1>Title</h1><p>A paragraph that is longer than twenty characters<p>short</p><a href="/p/1?utm_source=x">A long link text</a><a href="/p/1">Link</a></article></body></html>"""


def test_pages(spark):
    d = spark.createDataFrame([("https://e.com/x", PAGE), ("https://e.com/y", "Just a moment"), ("https://e.com/z", None)], "url string, html string")
    a = pages.extract_articles(d, F.lit("2026-06-12 12:00:00")).collect()
    assert len(a) == 1 and (a[0].title, a[0].publish_time, a[0].publish_time_status) == ("Title", T(2026, 6, 11, 8), "exact")
    assert a[0].clean_text == "A paragraph that is longer than twenty characters"
    links = pages.harvest_links(d, 5).collect()
    assert {(r.href, r.text) for r in links} == {("https://e.com/login", "login or sign up here"), ("https://e.com/p/1", "A long link text")}
    assert [r.href for r in pages.harvest_links(d, 5, "same_host").collect()] == ["https://e.com/p/1"]
    rules = spark.createDataFrame([(1, 1, 2, "/p/", 3, None, None), (1, 2, 1, "/p/", 3, None, "p/1$")], "source_id long, rule_id long, precedence int, pattern string, min_text int, marker string, excluded string")
    l = spark.createDataFrame([(1, "https://e.com/p/1", "abcd"), (1, "https://e.com/p/2", "abcd"), (1, "https://e.com/p/3", "x")], "source_id long, href string, text string")
    assert {(r.href[-1], r.rule_id) for r in pages.match_link_rules(l, rules).collect()} == {("1", 1), ("2", 2)}


def test_ingest(spark):
    s = spark.createDataFrame([(1, "ai_media"), (2, "venture_media"), (3, "github")], "source_id long, source_category string")
    now = T(2026, 8, 17, 9)
    rows = [(1, 1, "https://e.com/a?utm_source=1", "t", None, "body", now, "exact"), (1, 2, "https://e.com/a", "t", None, "body", now, "exact"), (2, 3, "https://e.com/b", "plain news", None, "", now, "exact"), (2, 4, "https://e.com/c", "An AI story", None, "", T(2026, 8, 1), "exact"), (3, 5, "https://e.com/d", "repo", None, "", T(2026, 8, 16), "date_only"), (3, 6, "https://e.com/old", "repo", None, "", now, "exact")]
    items = spark.createDataFrame(rows, "source_id long, position long, url string, title string, summary string, clean_text string, publish_time timestamp_ntz, publish_time_status string")
    held = spark.createDataFrame([("https://e.com/old",)], "canonical_url string")
    labelled = ingest.label_items(items, held, s, T(2026, 8, 17, 10))
    assert {r.position: r.outcome for r in labelled.collect()} == {1: "new", 2: "duplicate", 3: "not_ai", 4: "outside_window", 5: "new", 6: "duplicate"}
    new = ingest.stored_rows(labelled, T(2026, 8, 17, 10)).where("position = 1").first()
    assert new.canonical_url == "https://e.com/a" and new.word_count == 4 and new.expire_at == T(2026, 8, 19, 10) and new.ai_related is True
    assert {(r.tag_key, r.tag_value) for r in ingest.rule_tags(labelled.where("position = 5"), "position").collect()} == {("source_category", "github"), ("content_type", "repo")}


def test_taxonomy_and_upsert(spark):
    e = spark.createDataFrame([(1, "company", "A", None)], tables.SCHEMAS["entities"])
    links = spark.createDataFrame([(5, 1)], "content_id long, entity_id long")
    new = spark.createDataFrame([(5, "company", " A "), (6, "company", "B"), (6, "company", "B"), (6, "alien", "C"), (6, "company", " ")], "content_id long, entity_type string, name string")
    every, after = taxonomy.attach_entities(e, links, new)
    assert every.count() == 2 and {(r.content_id, r.entity_id) for r in after.collect()} == {(5, 1), (6, 2)}
    edited, rejected = taxonomy.apply_taxonomy_edits(every, spark.createDataFrame([(2, "A", None)], "entity_id long, canonical_name string, entity_type string"))
    assert rejected.count() == 1 and edited.where("canonical_name = 'B'").count() == 1
    t = spark.createDataFrame([(1, "a", "mine"), (2, "b", "x")], "id long, v string, note string")
    u = spark.createDataFrame([(1, "A", "n"), (3, "C", "n")], "id long, v string, note string")
    assert sorted(map(tuple, joins.upsert(t, u, ["id"], ["v"], ["note"]).collect())) == [(1, "A", "mine"), (2, "b", "x"), (3, "C", "n")]


def test_report_events_and_versions(spark):
    ev, ln = events_and_links(spark)
    got = reports.report_candidates_for("weekly_financing", dt.date(2026, 8, 1), dt.date(2026, 8, 7), ev.withColumn("review_status", F.when(F.col("event_id") == 1, "confirmed").otherwise("pending")), ev)
    assert [r.target_id for r in got.collect()] == [1]
    rep = spark.createDataFrame([(1, 2)], "report_id long, latest_version int")
    ver = spark.createDataFrame([(1, 1, "success", "a"), (1, 2, "success", "b")], "report_id long, version_number long, generation_status string, markdown_text string")
    new = spark.createDataFrame([(1, 1, "failed", ""), (1, 2, "success", "c"), (1, 3, "failed", "")], "report_id long, seq long, generation_status string, markdown_text string")
    moved, every = reports.add_versions(rep, ver, new)
    assert moved.first().latest_version == 4 and every.count() == 5
    assert rollups.exportable_versions(every).first().version_number == 4


def test_daily_report_leaves_event_contents(spark):
    rows = [(i, i, f"t{i}", f"http://u/{i}", None, "s", "github", T(2026, 8, 17, 9), "exact", T(2026, 8, 17, 9)) for i in (10, 11, 12)]
    c = spark.createDataFrame(rows, "content_id long, source_id long, title string, url string, canonical_url string, summary string, source_category string, publish_time timestamp_ntz, publish_time_status string, crawl_time timestamp_ntz")
    ev, ln = events_and_links(spark)
    ev = ev.withColumn("announced_date", F.lit(dt.date(2026, 8, 17)))
    assert [r.content_id for r in reports.daily_report_items(c, dt.date(2026, 8, 17), ev.where("event_id = 1"), ln).collect()] == [12]
    assert reports.daily_report_items(c, dt.date(2026, 8, 20)).count() == 0
    assert "共收录 3 条情报：技术进展 3 条" in reports.executive_summary(reports.daily_report_items(c, dt.date(2026, 8, 17)), dt.date(2026, 8, 17)).first().executive_summary


def test_sources_and_sinks(spark, tmp_path):
    stories = spark.createDataFrame([(1, '{"id": 5, "type": "story", "time": 1781136000, "text": "a&lt;b"}'), (2, '{"id": 6, "type": "job"}'), (3, "broken")], "rank int, value string")
    s = tables.read_stories(stories).collect()
    assert len(s) == 1 and (s[0].title, s[0].clean_text, s[0].publish_time) == ("Hacker News story 5", "a<b", T(2026, 6, 11, 8))
    feed = tmp_path / "feed.xml"
    feed.write_text('<feed><entry><title>Tool One</title><link rel="alternate" href="https://www.producthunt.com/products/one?utm_source=f"/><content>&lt;p&gt;First&lt;/p&gt;&lt;p&gt;x&lt;/p&gt;</content><published>2026-06-11T00:00:00+00:00</published></entry><entry><title>No</title><link href="https://x/y"/></entry></feed>')
    a = tables.read_atom(spark, str(feed)).collect()
    assert len(a) == 1 and (a[0].url, a[0].summary, a[0].publish_time) == ("https://www.producthunt.com/products/one", "First", T(2026, 6, 11, 8))
    assert spark.createDataFrame([('["a"]',), ("{}",), ("x",), (None,)], "j string").select(tables.json_list(F.col("j")).alias("v")).toPandas().v.map(list).tolist() == [["a"], [], [], []]
    t = {"x": spark.range(5), "y": spark.createDataFrame([("a",), (None,)], "v string")}
    sinks.snapshot_tables(t, str(tmp_path / "snap"))
    assert all(r.ok for r in sinks.verify_snapshot(spark, t, str(tmp_path / "snap")).collect())
    assert not sinks.verify_snapshot(spark, {"x": spark.range(6)}, str(tmp_path / "snap")).first().ok
    spark.range(3).write.parquet(str(tmp_path / "c"))
    assert tables.read_table(spark, "content_cache", str(tmp_path / "c")).columns == ["content_id", "clean_text", "expire_at"]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(i, i % 3, T(2024, 1, 1 + i % 5, (i * 7) % 24)) for i in range(60)]
    d = spark.createDataFrame(rows, "event_id long, source_id long, ts timestamp_ntz")
    folder = tmp_path / "in"
    d.repartition(3).write.parquet(str(folder / "events.parquet"))
    stream = spark.readStream.schema(d.schema).parquet(str(folder / "events.parquet"))
    q = jobs.daily_window_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(map(tuple, jobs.daily_window_counts(d).collect()))
    assert sorted(map(tuple, spark.table("counts").collect())) == want
    loop = {}
    for _, s, ts in rows:
        key = ((ts + dt.timedelta(hours=14)).date(), s)
        loop[key] = loop.get(key, 0) + 1
    assert want == sorted((day, s, n) for (day, s), n in loop.items())


def test_ingest_stream_keeps_one_of_each_url(spark, tmp_path):
    d = spark.createDataFrame([(f"u{i % 4}", T(2024, 1, 1, i)) for i in range(12)], "canonical_url string, crawl_time timestamp_ntz").withColumn("crawl_time", F.to_utc_timestamp("crawl_time", "UTC"))
    d.write.parquet(str(tmp_path / "in"))
    seen = []
    q = jobs.ingest_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), lambda df, n: seen.extend(r.canonical_url for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(seen) == ["u0", "u1", "u2", "u3"]


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    store = jobs.BatchStore(spark, str(tmp_path / "out"), ["k"], "k string, v int")
    batch = lambda *rows: spark.createDataFrame(list(rows), "k string, v int")
    assert store.read().count() == 0
    store(batch(("a", 1), ("b", 1)), 0)
    store(batch(("b", 2), ("c", 2)), 1)
    store(batch(("b", 2), ("c", 2)), 1)  # after a crash behind the write
    assert sorted(map(tuple, store.read().collect())) == [("a", 1), ("b", 1), ("c", 2)]
    (tmp_path / "out" / "batch_id=1" / "_SUCCESS").unlink()  # a crash within the write
    assert sorted(r.k for r in store.read().collect()) == ["a", "b"]
    store(batch(("b", 2), ("c", 3)), 1)
    assert sorted(map(tuple, store.read().collect())) == [("a", 1), ("b", 1), ("c", 3)]
    store(batch(), 2)
    assert store.read().count() == 3


def test_counts_of_batches(spark, tmp_path):
    d = lambda *days: spark.createDataFrame([(f"u{x}", T(2024, 1, x), T(2024, 1, x)) for x in days], "canonical_url string, publish_time timestamp_ntz, crawl_time timestamp_ntz").withColumn("crawl_time", F.col("crawl_time").cast("timestamp"))
    for days in ((20, 21), (19, 5), (6, 18, 20, 7), (25,)):
        d(*days).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d(1).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = jobs.BatchCounts()
    spark.streams.addListener(counts)
    counted = jobs.late_counts(stream, F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-21").cast("timestamp_ntz"))
    jobs.ingest_stream(counted, lambda df, n: df.count(), str(tmp_path / "cp")).awaitTermination()
    assert [tuple(r) for r in counts.rows(spark).collect()] == [(0, 2, 2, 1, 0), (1, 2, 2, 1, 0), (2, 4, 4, 2, 3), (3, 1, 1, 1, 0)]
    spark.streams.removeListener(counts)


def test_stored_table_keeps_untouched_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, f"v{i}", T(2024, 1, 1 + i % 20)) for i in range(200)], "k long, v string, at timestamp_ntz")
    keyed.create_keyed(rows, path, ["k"], 16)
    files = lambda: {(p.parent.name, p.name) for p in (tmp_path / "t").glob("bucket=*/*.parquet")}
    before = files()
    new = spark.createDataFrame([(3, "new", None), (1000, "new", None)], rows.schema)
    assert keyed.upsert_keyed(spark, path, new, ["k"], ["v"], 16)["buckets"] <= 2
    assert 0 < len(before - files()) <= 2 and len(before & files()) >= 14
    now = {r.k: r.v for r in keyed.read_keyed(spark, path).collect()}
    assert now == {i: f"v{i}" for i in range(200)} | {3: "new", 1000: "new"}
    assert keyed.upsert_keyed(spark, path, new.limit(0), ["k"], ["v"], 16) == {"buckets": 0, "rows": 0}
    held = files()
    with pytest.raises(ValueError):  # two rows of a key
        keyed.upsert_keyed(spark, path, new.union(new), ["k"], ["v"], 16)
    assert files() == held
    one = spark.createDataFrame([(5000 + i, "x", T(2020, 1, 1)) for i in range(3)], rows.schema)
    keyed.create_keyed(one, str(tmp_path / "o"), ["k"], 1)
    assert keyed.purge_keyed(spark, str(tmp_path / "o"), ["k"], "at", 10, T(2024, 1, 1))["purged"] == 3
    assert not list((tmp_path / "o").glob("bucket=*"))
    assert keyed.purge_keyed(spark, path, ["k"], "at", 10, T(2024, 1, 15))["purged"] == sum(i % 20 < 4 for i in range(200))


def test_list_hints(spark):
    items = spark.createDataFrame([("https://a.com/1", "T", "s", None, "missing", 7), ("https://openai.com/2", "x" * 121, "s", T(2024, 1, 1), "exact", 8), ("https://a.com/9", "kept", "s", None, "missing", 9)], "url string, title string, summary string, publish_time timestamp_ntz, publish_time_status string, n int")
    links = spark.createDataFrame([("https://a.com/1", "T", 1), ("https://a.com/1", "other 2024-01-02", 2), ("https://openai.com/2", "card 2024-03-04 10:00", 3), ("https://a.com/20240506/3", "gone", 4), ("https://a.com/4", "lost", 5)], "href string, text string, position int")
    got = {r.url: tuple(r)[1:] for r in pages.apply_list_hints(items, links, F.lit("2024-06-01").cast("timestamp_ntz")).collect()}
    assert got == {
        "https://a.com/1": ("T", "s", None, "missing", 7),
        "https://openai.com/2": ("card 2024-03-04 10:00", "s", T(2024, 3, 4, 10), "exact", 8),
        "https://a.com/9": ("kept", "s", None, "missing", 9),
        "https://a.com/20240506/3": ("gone", "gone", T(2024, 5, 6), "estimated", None),
        "https://a.com/4": ("lost", "lost", None, "missing", None),
    }


def test_streak_state_across_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, p, rng.random() < 0.1, rng.random() < 0.8) for s in range(3) for p in range(40)]
    rows = [(s, p, i, b and not i) for s, p, i, b in rows]
    schema = "source_id long, position long, in_window boolean, before_window boolean"
    spark.createDataFrame(rows, schema).createOrReplaceTempView("links")
    for k in range(4):  # ten positions a file, a file a batch
        spark.table("links").where(f"position div 10 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.streak_state(stream).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = filters.cut_after_older_streak(spark.table("links")).select("source_id", "position")
    assert sorted(map(tuple, spark.table("kept").collect())) == sorted(map(tuple, want.collect()))


def test_split_and_rescore(spark):
    ev, ln = events_and_links(spark)
    drafts = spark.createDataFrame([(11, "draft", "公司", "pending")], "content_id long, event_title string, company_name string, review_status string")
    cmds = spark.createDataFrame([(1, 1, [11], None), (2, 2, [12], "x"), (3, 1, [10], None)], "seq long, event_id long, content_ids array<long>, new_title string")
    every, links, log, rejected = curate.split_events(ev, ln, drafts, cmds)
    assert every.where("event_id = 4").first().event_title == "draft" and every.count() == 4
    assert sorted((r.event_id, r.content_id, r.is_primary_source) for r in links.collect()) == [(1, 10, True), (2, 12, True), (4, 11, True)]
    assert sorted(r.seq for r in rejected.collect()) == [2, 3] and log.count() == 2
    d = spark.createDataFrame([(1, 20, 0.9, ["r"], "ignored"), (2, 20, 0.9, ["r"], "unread")], "content_id long, score int, confidence double, reasons array<string>, review_status string")
    computed = F.struct(F.lit(70).alias("score"), F.lit(0.5).alias("confidence"), F.array(F.lit("c")).alias("reasons"))
    assert {r.content_id: r.score for r in scoring.rescore(d, computed).collect()} == {1: 20, 2: 70}


def test_weekly_payload(spark):
    rows = [(1, i, T(2026, 6, i), f"t{i}", f"u{i}", "s", None) for i in (10, 11)] + [(2, 12, T(2026, 6, 9), "t12", "u", "s", "sum")]
    m = spark.createDataFrame(rows, "cluster_id long, content_id long, shown timestamp_ntz, title string, url string, source_name string, summary string")
    p = reports.weekly_payload(m, dt.date(2026, 6, 8), dt.date(2026, 6, 14), 1).first()
    assert (p.raw_news_count, p.event_count, p.input_truncated, len(p.news_items)) == (3, 2, True, 1)
    assert p.news_items[0].primary.content_id == 11 and p.news_items[0].related_count == 1
