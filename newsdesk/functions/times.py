"""Dates and windows. Times are naive Beijing times (timestamp_ntz); 'now' is always an argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsdesk.functions.dates import free_form

CUTOFF_HOUR = 10
EXACT_STATUSES = ("exact", "verified", "parsed")


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def day_of(ts: Column) -> Column:
    """The report day of a time: windows run from 10:00 to 10:00."""
    return F.to_date(ntz(ts) + F.expr(f"interval {24 - CUTOFF_HOUR} hours"))


def daily_window(day: dt.date) -> tuple[Column, Column]:
    """[day - 1 10:00, day 10:00)."""
    end = dt.datetime.combine(day, dt.time(CUTOFF_HOUR))
    return ntz(F.lit(str(end - dt.timedelta(days=1)))), ntz(F.lit(str(end)))


def in_window(ts: Column, precision: Column, start: Column, end: Column) -> Column:
    """Half-open for exact times; rows with a date only count on both dates that the window touches."""
    whole = F.to_date(ts).between(F.to_date(start), F.to_date(end))
    inside = F.when(F.lower(F.coalesce(precision, F.lit(""))) == "date_only", whole).otherwise((ts >= start) & (ts < end))
    return F.coalesce(inside, F.lit(False))


def time_choice(publish: Column, status: Column, crawl: Column) -> Column:
    """struct(ts, quality): the time a report goes by and where it comes from."""
    s = F.lower(F.coalesce(status, F.lit("missing")))
    s = F.when(F.trim(s) == "", "missing").otherwise(F.trim(s))
    known = publish.isNotNull()

    def choice(ts: Column, quality: str) -> Column:
        return F.struct(ts.alias("ts"), F.lit(quality).alias("quality"))

    return (
        F.when(known & (s == "date_only"), choice(publish, "published_date_only"))
        .when(known & s.isin(*EXACT_STATUSES), choice(publish, "published_exact"))
        .when(known & ~s.isin("missing", "estimated") & crawl.isNull(), choice(publish, "published"))
        .when(crawl.isNotNull() & ~known, choice(crawl, "crawl_time"))
        .when(crawl.isNotNull(), choice(crawl, "crawl_time_fallback"))
        .when(known, choice(publish, "published_unverified"))
        .otherwise(choice(F.lit(None).cast("timestamp_ntz"), "missing"))
    )


def display_time(publish: Column, crawl: Column) -> Column:
    return F.coalesce(F.date_format(F.coalesce(publish, crawl), "yyyy-MM-dd HH:mm"), F.lit("-"))


def week_start(ts: Column, previous: bool = False) -> Column:
    """Monday 00:00 of the week, or of the week before."""
    monday = ntz(F.date_trunc("week", ts))
    return monday - F.expr("interval 7 days") if previous else monday


def date_from_url(url: Column) -> Column:
    """The date in 2026/8/17 or 20260817 forms behind / or -; null if there is none or it is no calendar date."""
    split = [F.regexp_extract(url, r"[/-](20\d{2})[/-](\d{1,2})[/-](\d{1,2})(?:[/.-]|$)", k) for k in (1, 2, 3)]
    joined = [F.regexp_extract(url, r"[/-](20\d{2})(\d{2})(\d{2})(?:[/.-]|$)", k) for k in (1, 2, 3)]
    text = F.when(split[0] != "", F.concat_ws("-", split[0], F.lpad(split[1], 2, "0"), F.lpad(split[2], 2, "0"))).when(joined[0] != "", F.concat_ws("-", *joined))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def parse_datetime(c: Column, as_of: Column | None = None) -> Column:
    """Date text as naive Beijing time: values with an offset are converted, others taken as they are, bad ones null.
    With as_of, a text without all parts of a date takes them from there. The usual forms are read in the JVM, all others by
    free_form()."""
    # a weekday in front says nothing more
    text = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s*(?=\d)", "")
    offset = text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$") & text.rlike(r"\d:\d")
    zoned = None
    for pattern in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSS]XXX", "yyyy-MM-dd'T'HH:mmXXX", "d MMM yyyy HH:mm:ss XX", "yyyy-MM-dd'T'HH:mm:ssXX"):
        got = F.try_to_timestamp(text, F.lit(pattern))
        zoned = got if zoned is None else F.coalesce(zoned, got)
    beijing = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.to_utc_timestamp(zoned, F.current_timezone()).cast("timestamp_ntz"))
    naive = F.expr("null").cast("timestamp_ntz")
    plain = None
    for pattern in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "MMM d, yyyy", "d MMM yyyy"):
        got = F.try_to_timestamp(text, F.lit(pattern))
        plain = got if plain is None else F.coalesce(plain, got)
    filled = naive
    if as_of is not None:
        for given, pattern in ((F.date_format(as_of, "yyyy-"), "yyyy-M-d HH:mm"), (F.date_format(as_of, "yyyy-"), "yyyy-M-d"), (F.date_format(as_of, "yyyy "), "yyyy MMM d HH:mm"), (F.date_format(as_of, "yyyy "), "yyyy MMM d"), (F.date_format(as_of, "yyyy-MM-dd "), "yyyy-MM-dd H:mm")):
            filled = F.coalesce(filled, F.try_to_timestamp(F.concat(given, text), F.lit(pattern)).cast("timestamp_ntz"))
    known = F.when(offset, beijing).otherwise(F.coalesce(plain.cast("timestamp_ntz"), filled))
    # what the usual forms leave over is read token by token
    return F.coalesce(known, free_form(F.when(known.isNull() & (text != ""), text), as_of))


MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _made(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    """A time from its parts as text; null if it is no calendar time. Empty hours and minutes are 0."""
    zero = lambda c: F.lpad(F.when(c == "", "0").otherwise(c), 2, "0")
    text = F.concat_ws(" ", F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.concat_ws(":", zero(hour), zero(minute)))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def date_from_text(c: Column, as_of: Column) -> Column:
    """struct(ts, status): the first date that a text states, forms in this order: today, yesterday, some time ago,
    full numeric, short numeric (last year's if it lies beyond tomorrow), month and day, full, English."""
    text = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    now = ntz(as_of)
    none = F.lit(None).cast("timestamp_ntz")

    def parts(pattern: str, n: int) -> list[Column]:
        return [F.regexp_extract(text, pattern, k) for k in range(1, n + 1)]

    def found(ts: Column, status: Column | str) -> Column:
        return F.when(ts.isNotNull(), F.struct(ts.alias("ts"), (F.lit(status) if isinstance(status, str) else status).alias("status")))

    def on(day: Column, hour: Column, minute: Column) -> Column:
        return F.when(hour != "", _made(F.date_format(day, "yyyy"), F.date_format(day, "MM"), F.date_format(day, "dd"), hour, minute))

    year = F.date_format(now, "yyyy")
    h, m = parts(r"(?:今天|今日)\s*(\d{1,2}):(\d{2})", 2)
    today = found(on(now, h, m), "estimated")
    h, m = parts(r"昨天\s*(\d{1,2}):(\d{2})", 2)
    yesterday = found(on(now - F.expr("interval 1 day"), h, m), "estimated")
    n, unit = parts(r"(\d{1,3})\s*(分钟前|小时前|天前)", 2)
    minutes = n.try_cast("int") * F.when(unit == "分钟前", 1).when(unit == "小时前", 60).otherwise(1440)
    ago = found(now - F.make_dt_interval(F.lit(0), F.lit(0), minutes), "estimated")
    y, mo, d, h, m = parts(r"(?<!\d)(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})(?:日)?(?:\s+(\d{1,2}):(\d{2}))?", 5)
    numeric = found(F.when(y != "", _made(y, mo, d, h, m)), F.when(h != "", "exact").otherwise("date_only"))
    mo, d, h, m = parts(r"(?<!\d)(\d{1,2})[-/.](\d{1,2})(?:\s+(\d{1,2}):(\d{2}))?", 4)
    ts = F.when(mo != "", _made(year, mo, d, h, m))
    ts = F.when(F.to_date(ts) > F.date_add(F.to_date(now), 1), _made((F.year(now) - 1).cast("string"), mo, d, h, m)).otherwise(ts)
    short = found(ts, F.when(h != "", "estimated").otherwise("date_only"))
    mo, d, h, m = parts(r"(?<!\d)(\d{1,2})月(\d{1,2})日(?:\s*(\d{1,2}):(\d{2}))?", 4)
    month_day = found(F.when(mo != "", _made(year, mo, d, h, m)), F.when(h != "", "estimated").otherwise("date_only"))
    y, mo, d, h, m = parts(r"(?<!\d)(20\d{2})年(\d{1,2})月(\d{1,2})日(?:\s*(\d{1,2}):(\d{2}))?", 5)
    full = found(F.when(y != "", _made(y, mo, d, h, m)), F.when(h != "", "exact").otherwise("date_only"))
    name, d, y = parts(r"(?i)\b(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+(\d{1,2}),\s+(20\d{2})\b", 3)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3))).cast("string")
    english = found(F.when(name != "", _made(y, number, d, F.lit(""), F.lit(""))), "exact")
    return F.coalesce(today, yesterday, ago, numeric, short, month_day, full, english, F.struct(none.alias("ts"), F.lit("missing").alias("status")))
