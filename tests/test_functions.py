"""Column functions on small frames, with values worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsdesk.functions import dates, finance, text, times, urls


def value(spark, column, **row):
    schema = ", ".join(f"{k} {'timestamp_ntz' if isinstance(v, dt.datetime) else 'date' if isinstance(v, dt.date) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given, want",
    [
        ("HTTP://M.Example.com/a/b/?utm_source=x&b=2&a=1&c=#frag", "https://example.com/a/b?b=2&a=1"),
        ("https://m.github.com/x", "https://m.github.com/x"),
        ("http://e.com", "https://e.com/"),
        ("http://e.com/p;v=1?q=a+b~*", "https://e.com/p?q=a+b~%2A"),
        ("http://e.com/?q=100%zz", "https://e.com/?q=100%25zz"),
        ("ftp://e.com/x/", "ftp://e.com/x"),
        (None, "/"),
    ],
)
def test_canonicalize_url(spark, given, want):
    assert value(spark, urls.canonicalize_url(F.col("u")), u=given) == want


@pytest.mark.parametrize("given, want", [("/x?y=1", "https://h.com/x?y=1"), ("//o.com/z", "https://o.com/z"), ("c", "https://h.com/a/c"), ("http://q.com", "https://q.com/")])
def test_relative_urls(spark, given, want):
    assert value(spark, urls.canonicalize_url(F.col("u"), F.lit("https://h.com/a/b")), u=given) == want


def test_clean_text_and_cuts(spark):
    assert value(spark, text.clean_text(F.col("t")), t=" a&amp;b 　 c  ") == "a&b c"
    assert value(spark, text.first_chars(F.col("t"), 4), t="abc defg") == "abc..."
    long = "x" * 90 + "。" + "y" * 200
    assert value(spark, text.summary_chars(F.col("t")), t=long) == "x" * 90 + "。"
    assert value(spark, text.summary_chars(F.col("t")), t="x" * 85 + "，" + "y" * 200) == "x" * 85 + "..."
    assert value(spark, text.summary_chars(F.col("t")), t="y" * 200) == "y" * 180 + "..."
    assert value(spark, text.clean_title(F.col("t")), t="News | TechCrunch") == "News"
    assert value(spark, text.clean_card_title(F.col("t")), t="Product Mar 3, 2025 A model Today we show") == "A model"
    assert value(spark, text.redact(F.col("t")), t="api_key: abc, Bearer xyz sk-12345678") == "api_key=<redacted>, Bearer <redacted> <redacted>"
    assert value(spark, text.mask(F.col("t")), t="secret99") == "********et99" and value(spark, text.mask(F.col("t")), t="abc") == "***"


def test_companies_and_tokens(spark):
    assert value(spark, text.normalize_company_name(F.col("t")), t="公司 灵巧手科技") == "灵巧手"
    assert value(spark, text.title_tokens(F.col("t")), t="Ab1 融") == ["1融", "ab", "ab1", "b1"]
    assert value(spark, text.title_tokens(F.col("t")), t="a") == []
    assert "灵巧手" in value(spark, finance.company_candidates(F.col("t")), t="灵巧手完成A轮融资")
    assert value(spark, finance.round_texts(F.col("t")), t="Pre-A轮") == ["Pre-A轮", "Pre-A", "A轮"]
    assert value(spark, finance.investor_texts(F.col("t")), t="由甲资本和乙基金领投") == ["甲资本", "乙基金"]
    assert value(spark, finance.amount_texts(F.col("t")), t="获超亿元、5000万元，数千万") == ["5000万元", "超亿元", "数千万"]


@pytest.mark.parametrize("given, want", [("5000万元", (5e7, "CNY")), ("1.5 billion USD", (1.5e9, "USD")), ("3亿港元", (3e8, "HKD")), ("约2,000万欧元", (2e7, "EUR")), ("超亿元", (None, None)), (None, (None, None))])
def test_parse_amount(spark, given, want):
    assert tuple(value(spark, finance.parse_amount(F.col("t")), t=given)) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("发布于 2026-08-16", ("2026-08-16 00:00", "date_only")),
        ("今天 9:05", ("2026-01-05 09:05", "estimated")),
        ("昨天 23:10", ("2026-01-04 23:10", "estimated")),
        ("3 小时前", ("2026-01-05 09:00", "estimated")),
        ("12-31 10:00", ("2025-12-31 10:00", "estimated")),
        ("3月4日", ("2026-03-04 00:00", "date_only")),
        ("2025年2月30日 then Mar 3, 2025", ("2026-02-30", None)),
        ("Sept 9, 2024", ("2024-09-09 00:00", "exact")),
        ("nothing", (None, "missing")),
    ],
)
def test_date_from_text(spark, given, want):
    got = value(spark, times.date_from_text(F.col("t"), F.lit("2026-01-05 12:00:00")), t=given)
    if want[1] is None:  # an invalid date falls through to the next form
        assert got["ts"] == dt.datetime(2025, 3, 3)
        return
    assert (got["ts"].strftime("%Y-%m-%d %H:%M") if got["ts"] else None, got["status"]) == want


def test_dates(spark):
    assert value(spark, times.parse_datetime(F.col("t")), t="2026-06-11T00:00:00+00:00") == dt.datetime(2026, 6, 11, 8)
    assert value(spark, times.parse_datetime(F.col("t")), t="2026-06-11 07:30:00") == dt.datetime(2026, 6, 11, 7, 30)
    assert value(spark, times.parse_datetime(F.col("t")), t="Thu, 11 Jun 2026 00:00:00 +0000") == dt.datetime(2026, 6, 11, 8)
    assert value(spark, times.parse_datetime(F.col("t")), t="soon") is None
    assert value(spark, times.date_from_url(F.col("t")), t="https://e.com/2026/8/17/x") == dt.date(2026, 8, 17)
    assert value(spark, times.date_from_url(F.col("t")), t="https://e.com/20260231/x") is None
    assert value(spark, times.week_start(F.col("t"), True), t=dt.datetime(2026, 6, 17, 5)) == dt.datetime(2026, 6, 8)


@pytest.mark.parametrize("ts, precision, inside", [((16, 9, 59, 59), "exact", False), ((16, 10, 0, 0), "exact", True), ((17, 9, 59, 59), "exact", True), ((17, 10, 0, 0), "exact", False), ((16, 0, 0, 0), "date_only", True)])
def test_daily_window(spark, ts, precision, inside):
    start, end = times.daily_window(dt.date(2026, 8, 17))
    d, h, m, s = ts
    assert value(spark, times.in_window(F.col("t"), F.col("p"), start, end), t=dt.datetime(2026, 8, d, h, m, s), p=precision) is inside


#: (text, as of 2026-03-31 12:00): forms of dates and what they state
FREE = """
17 Aug 2026 3pm +0800|2026-08-17 15:00
17 aug 2026|2026-08-17
17th August 2026|2026-08-17
August 17, 2026|2026-08-17
Aug. 17 2026|2026-08-17
Aug 17|2026-08-17
17 Aug|2026-08-17
August 2026|2026-08-31
Feb 2026|2026-02-28
2026-8-7|2026-08-07
2026/8/7|2026-08-07
2026.8.7|2026-08-07
8/7/2026|2026-08-07
17/8/2026|2026-08-17
8/17/2026|2026-08-17
8-7-26|2026-08-07
8/7/76|1976-08-07
8/7/75|2075-08-07
20260817|2026-08-17
20260817T1530|2026-08-17 15:30
20260817T153045|2026-08-17 15:30:45
20260817153045|2026-08-17 15:30:45
2026-08-17T15:30:45Z|2026-08-17 23:30:45
2026-08-17T15:30:45+02:00|2026-08-17 21:30:45
2026-08-17 15:30:45.25|2026-08-17 15:30:45.25
2026-08-17 15:30 UTC|2026-08-17 23:30
2026-08-17 15:30 GMT-3|2026-08-17 20:30
2026-08-17 15:30 utc+9|2026-08-18 08:30
Mon, 17 Aug 2026 15:30:00 GMT|2026-08-17 23:30
Monday, August 17, 2026 at 3:30 PM|2026-08-17 15:30
3:30pm 17 August 2026|2026-08-17 15:30
3:30 p.m. Aug 17 2026|2026-08-17 15:30
12am 17 Aug 2026|2026-08-17 00:00
12 pm 17 Aug 2026|2026-08-17 12:00
12:05 am, Aug 17, 2026|2026-08-17 00:05
15:30|2026-03-31 15:30
3pm|2026-03-31 15:00
15:30:45|2026-03-31 15:30:45
Friday|2026-04-03
Tuesday|2026-03-31
Wed 9am|2026-04-01 09:00
8/17|2026-08-17
17/8|2026-08-17
8/2026|2026-08-31
2026-08|2026-08-31
2026|2026-03-31
15|2026-03-15
1st of May|2026-05-01
2nd May 2025|2025-05-02
3rd Sept 2025|2025-09-03
Sep 4th, 2025|2025-09-04
the 5th of June 2025|2025-06-05
Thu Jun 11 2026 07:30:00|2026-06-11 07:30
Thu Jun 11 07:30:00 2026|2026-06-11 07:30
11-Jun-2026 07:30|2026-06-11 07:30
11-Jun-26|2026-06-11
Jun/11/2026|2026-06-11
June 11 2026, 7:30 am -0500|2026-06-11 20:30
(11 June 2026)|2026-06-11
29 Feb 2028|2028-02-29
29 Feb 2026|
31 Jun 2026|
2026-13-40|
13/13/2026|
soon|
11 June or 12 June 2026|
25:00 11 June 2026|
13pm 11 June 2026|
11 June 12 2026 5|
today|
11:00 12:00 1 May 2026|
"""


def test_free_forms(spark):
    rows = [line.rsplit("|", 1) for line in FREE.strip().splitlines()]
    assert len(rows) >= 60
    now = dt.datetime(2026, 3, 31, 12)
    want = [dt.datetime.fromisoformat(w if "." not in w else w.ljust(26, "0")) if w else None for _, w in rows]
    assert [(t, dates.read_date(t, now)) for t, _ in rows] == [(t, w) for (t, _), w in zip(rows, want, strict=True)]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(900, None), (901, "")], "i int, t string")
    got = {r.i: r.x for r in d.select("i", times.parse_datetime(F.col("t"), F.lit("2026-03-31 12:00:00").cast("timestamp_ntz")).alias("x")).collect()}
    assert got == dict(enumerate(want)) | {900: None, 901: None}
    # nothing is filled without a day to fill from
    assert dates.read_date("17 Aug") is None and dates.read_date("3pm") is None and dates.read_date("17 Aug 2026 3pm") == dt.datetime(2026, 8, 17, 15)
