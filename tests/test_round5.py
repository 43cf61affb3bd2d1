"""Queries against their SQL on tables made for what a review of round 4 found, and the steps that were changed for it."""

import datetime as dt
import glob
import random
from itertools import combinations

from pyspark.sql import functions as F

from newsdesk.functions.text import title_tokens
from newsdesk.operators import cluster, setjoin
from newsdesk.plans.catalog import ORACLES, QUERIES
from newsdesk.sources import tables
from newsdesk.sources.shared import shared_dir
from tests.compare import connect, same_rows
from tests.test_round4 import documents


def test_f3_stories_of_documents_without_a_text_and_with_references(spark, tmp_path):
    texts = (None, "", " ", "R&amp;D and &copy, &lt x", "&&& a &amp;amp; b", "plain\n text")
    at = documents(spark, tmp_path / "t", [(i, texts[i // 61 % len(texts)]) for i in range(61 * len(texts))])
    same_rows(QUERIES["src03_read_stories"](spark, at), connect(at), ORACLES["src03_read_stories"])


def titles(n):
    """Random titles, of which groups differ in a few letters; short ones and texts without tokens too."""
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(1, 7)))
    base = [" ".join(word() for _ in range(draw.randint(1, 14))) for _ in range(n // 4)]
    out = ["", "a", "ab", "abc", None]
    while len(out) < n:
        text = list(draw.choice(base[:12] if draw.random() < 0.5 else base))
        for _ in range(draw.randint(0, 3)):
            text[draw.randrange(len(text))] = draw.choice("xyz é")
        out.append("".join(text))
    return out


def plain_pairs(spark, rows, percent):
    """All pairs of the smallest ids of equal token sets, by a loop."""
    first = {}
    for r in rows.select("id", title_tokens(F.col("t")).alias("tokens")).where(F.size("tokens") > 0).orderBy("id").collect():
        first.setdefault(frozenset(r.tokens), r.id)
    pairs = combinations(sorted((i, s) for s, i in first.items()), 2)
    return sorted((a, b, len(x & y), len(x | y)) for (a, x), (b, y) in pairs if 100 * len(x & y) >= percent * len(x | y))


def test_f1_near_duplicates_are_all_pairs_in_blocks_too(spark, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(titles(500))), "id long, t string").repartition(4)
    for percent, block in ((80, 8_192), (80, 12), (55, 12), (100, 8_192)):
        monkeypatch.setattr(setjoin, "BLOCK", block)
        got = sorted(map(tuple, cluster.near_duplicates(rows, "id", F.col("t"), percent).collect()))
        assert got == plain_pairs(spark, rows, percent) and (percent == 100 or len(got) > 100)
    assert cluster.near_duplicates(rows.limit(0), "id", F.col("t")).count() == 0


def test_f1_near_duplicates_store_a_row_for_each_set(spark):
    """No row for each pair of a title's tokens."""
    folder = shared_dir(spark).removeprefix("file://")
    before = set(glob.glob(f"{folder}/newsdesk-*"))
    rows = spark.createDataFrame(list(enumerate(titles(300))), "id long, t string")
    assert cluster.near_duplicates(rows, "id", F.col("t")).count() > 50
    made = set(glob.glob(f"{folder}/newsdesk-*")) - before
    assert sum(spark.read.parquet(x).count() for x in made) <= 300


def test_f2_pairs_of_items_and_events_are_made_where_they_are_returned(spark, monkeypatch):
    """Several lists on either side, texts that are broadcast or joined by a shuffle; no exchange stands above the lists' rows."""
    items = spark.createDataFrame([(i, f"Alpha{i % 2}完成{i % 3}00万元{'AB'[i % 2]}轮融资", "由甲资本领投" if i % 4 else None, dt.datetime(2026, 8, 1 + i % 3) if i % 7 else None) for i in range(90)], "content_id long, title string, summary string, shown timestamp_ntz")
    held = spark.createDataFrame([(i, f"Alpha{i % 2}完成A轮融资" if i % 3 else "zz", f"alpha{i % 2}", dt.date(2026, 8, 1 + i % 5) if i % 4 else None, "A轮", "100万元", ["甲资本"]) for i in range(50)], "event_id long, event_title string, company_name_normalized string, announced_date date, financing_round string, amount_original string, investors array<string>")
    monkeypatch.setattr(cluster, "LISTED", 3)
    for few in (0, 20_000):
        monkeypatch.setattr(cluster, "FEW_TEXTS", few)
        left, right = cluster.event_signature(items), cluster.signature_of_event(held)
        sides = [{r[c]: cluster._sides(r.asDict()) for r in d.collect()} for d, c in ((left, "content_id"), (right, "event_id"))]
        want = sorted((i, e, s, "|".join(why)) for i, x in sides[0].items() for e, y in sides[1].items() if x["companies"] & y["companies"] for s, why in [cluster.event_match(x, y)])
        scores = cluster.event_scores(left, right, "|")
        assert sorted(map(tuple, scores.collect())) == want and len(want) == 90 * 25
        above, generated, below = scores._jdf.queryExecution().sparkPlan().toString().partition("Generate")
        assert generated and "Generate" in below.partition("Join")[0] and "Join" not in above and "Exchange" not in above


def test_f3_stories_of_any_length(spark):
    raw = spark.createDataFrame([(1, "t")], "rank long, t string").select("rank", F.to_json(F.struct(F.lit(7).alias("id"), F.lit("story").alias("type"), "t", F.repeat(F.lit("x"), 20_000_100).alias("text"))).alias("value"))
    assert tables.read_stories(raw).select("title", F.length("clean_text")).first() == ("Hacker News story 7", 20_000_100)
