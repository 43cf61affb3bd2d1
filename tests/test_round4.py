"""Queries against their SQL on tables made for what a review of round 3 found, and the steps that were changed for it."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from newsdesk.functions import text
from newsdesk.functions.finance import financing_signature
from newsdesk.plans.catalog import ORACLES, QUERIES
from tests.compare import connect, same_rows


def documents(spark, folder, rows):
    """A folder with documents (doc_id, text) and the other tables of the smallest size."""
    at = str(folder)
    made = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made.coalesce(1).write.parquet(f"{at}/documents.parquet")
    for name in ("orders", "customer", "events", "pages"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def test_f5_masks_of_ids_of_four_digits_and_more(spark, tmp_path):
    at = documents(spark, tmp_path / "t", [(i, "text") for i in (7, 999, 1000, 9999, 10000, 123456)])
    same_rows(QUERIES["fn22_redact"](spark, at), connect(at), ORACLES["fn22_redact"])
    four = spark.createDataFrame([("1234",), ("12345",)], "s string")
    assert [r[0] for r in four.select(text.mask(F.col("s"))).collect()] == ["****", "********2345"]


def test_f7_body_is_what_was_collected(spark, tmp_path):
    """Ids that are no longer than a title and have no summary, with a space at the end of the title."""
    # 13 divides the ids whose summary is null; day 9 of January from 10:00 on is minute 12,120 and following ones
    rows = [(i, "word " * 40) for i in range(300, 420)]
    at = documents(spark, tmp_path / "t", rows)
    out = QUERIES["rp08_ingest"](spark, at)
    assert out.where("word_count = 80").count() > 0
    same_rows(out, connect(at), ORACLES["rp08_ingest"])


def test_f6_items_in_order_of_written_titles(spark, tmp_path):
    # ids that are 43,200 apart have the same times
    rows = [(i + 43_200 * k, t) for i in range(330, 366) for k, t in enumerate(("b text", " z text", "a text", "a\n\nz", "a b"))]
    at = documents(spark, tmp_path / "t", rows)
    same_rows(QUERIES["rp01_full_report"](spark, at), connect(at), ORACLES["rp01_full_report"])


def test_f8_words_make_a_candidate_without_tags(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["flt05_candidates"](spark, folder)
    assert got.where("content_id % 5 = 0 and content_id % 4 = 0 and candidate").count() > 0
    same_rows(got, connect(folder), ORACLES["flt05_candidates"])


def test_f1_stored_events_of_one_signature_are_compared_once(spark, monkeypatch):
    """60 items of one text and 500 stored events of 2 signatures are 2 comparisons; the smallest id wins."""
    from newsdesk.operators import cluster

    kind = "event_id long, event_title string, company_name_normalized string, announced_date date, financing_round string, amount_original string, investors array<string>, review_status string, locked_by_user boolean"
    held = spark.createDataFrame([(i, "Alpha完成A轮融资", "alpha", None, "A轮", "500万元" if i % 2 else None, None, "pending", False) for i in range(7, 507)], kind)
    items = spark.createDataFrame([(i, "Alpha完成500万元A轮融资", "", dt.datetime(2026, 8, 1, 9)) for i in range(60)], "content_id long, title string, summary string, shown timestamp_ntz")
    folded = cluster.match_to_events(items, None, held)
    assert {r.event_id for r in folded.select("event_id").collect()} == {7} and folded.count() == 60
    calls, real = [], cluster.event_match
    monkeypatch.setattr(cluster, "event_match", lambda x, y: calls.append(1) or real(x, y))
    sides = {"companies": ["alpha"], "amounts": ["500万元"], "rounds": ["a轮"], "investors": [], "title_norm": "alpha", "date": None}
    texts = pd.DataFrame([sides | {"is_event": e, "event_id": 7 if e else 0, "k1": 0 if e else 5, "k2": 0 if e else 6} for e in (True, False)])
    rows = pd.DataFrame({"content_id": range(60), "shown": [dt.datetime(2026, 8, 1)] * 60, "date": [dt.date(2026, 8, 1)] * 60, "k1": [5] * 60, "k2": [6] * 60})
    assert cluster.fold_events(rows, texts)["event_id"].tolist() == [7] * 60 and len(calls) == 1


def test_f14_a_text_is_worked_on_once(spark):
    from newsdesk.operators import cluster

    items = spark.createDataFrame([(i, "Alpha完成500万元A轮融资" if i % 2 else None, "x" if i % 3 else None, dt.datetime(2026, 8, 1 + i % 9)) for i in range(90)], "content_id long, title string, summary string, shown timestamp_ntz")
    assert cluster.distinct_texts(items, ["title", "summary"])[1].count() == 4
    s = cluster.financing_signatures(items)
    want = items.select("content_id", financing_signature(F.col("title"), F.col("summary"), F.col("shown")).alias("s")).select("content_id", "s.*")
    assert sorted(map(repr, s.select(want.columns).collect())) == sorted(map(repr, want.collect()))


def test_f3_f9_scores_of_rows_are_those_of_their_signatures(spark):
    """Every pair of rows gets what event_match() says of it, dates included, and equal titles are compared once."""
    from newsdesk.operators import cluster

    items = spark.createDataFrame([(i, f"Alpha{i % 2}完成{i % 3}00万元{'AB'[i % 2]}轮融资", "由甲资本领投" if i % 4 else None, dt.datetime(2026, 8, 1 + i % 12) if i % 7 else None) for i in range(60)], "content_id long, title string, summary string, shown timestamp_ntz")
    held = spark.createDataFrame([(i, f"Alpha{i % 2}完成A轮融资" if i % 3 else "zz", f"alpha{i % 2}", dt.date(2026, 8, 1 + i % 5) if i % 4 else None, "A轮", "100万元", ["甲资本"]) for i in range(20)], "event_id long, event_title string, company_name_normalized string, announced_date date, financing_round string, amount_original string, investors array<string>")
    left, right = cluster.event_signature(items), cluster.signature_of_event(held)
    sides = [{(r["content_id"] if "content_id" in d.columns else r["event_id"]): cluster._sides(r.asDict()) for r in d.collect()} for d in (left, right)]
    want = {(i, e): cluster.event_match(x, y) for i, x in sides[0].items() for e, y in sides[1].items() if x["companies"] & y["companies"]}
    got = cluster.event_scores(left, right).collect()
    assert len(got) == len(want) and {(r.content_id, r.event_id): (r.score, r.reasons) for r in got} == want and len({r.score for r in got}) > 4


def test_f4_the_week_in_parts(spark):
    from newsdesk.operators import reports

    kind = "cluster_id long, company string, round string, amount string, project_intro string, investor_intro string, source_names string, links string"
    details = spark.createDataFrame([(i, f"c{i}", "A轮", "1", "p", "i", "s", "") for i in range(30)], kind)
    week = dt.date(2024, 1, 8), dt.date(2024, 1, 14)
    parts = sorted(map(tuple, reports.weekly_sections(details, *week, 44).collect()))
    assert len(parts) == 31 and parts[1][1].startswith("### 1. c29\n\n- 公司：c29\n") and "融资事件数（去重）：30\n- 原始融资新闻数：44" in parts[0][1]
    assert reports.weekly_markdown(details, *week, 44).first()[0] == parts[0][1] + "\n".join(p for _, p in parts[1:])
