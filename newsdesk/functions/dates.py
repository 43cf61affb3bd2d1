"""Free-form English date texts, read by a small grammar of tokens.

A text is a sequence of times of day, offsets, month and weekday names and numbers, in any order and with any of the usual
separators; a word that is none of these makes it no date. Of numbers without a month's name the first is the
month, unless it is a year or too large; a year has four digits, stands behind day and month, or is above 31. Parts
that are missing come from as_of (its day is cut to the month), and a missing time is midnight. A weekday without a
date is the next such day, as_of's own included. Times with an offset become Beijing times; UTC+3 is a time to which three
hours must be added to reach UTC.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BEIJING = dt.timedelta(hours=8)
MONTHS = {name: k for k in range(1, 13) for name in (calendar.month_name[k].lower(), calendar.month_abbr[k].lower())} | {"sept": 9}
WEEKDAYS = {name: k for k in range(7) for name in (calendar.day_name[k].lower(), calendar.day_abbr[k].lower())} | {"tues": 1, "wednes": 2, "thur": 3, "thurs": 3}
#: Words that say nothing, and zones without an offset.
FILLERS, UNIVERSAL = {"at", "on", "of", "and", "the", "t", "st", "nd", "rd", "th"}, {"z", "utc", "gmt"}
TOKEN = re.compile(
    r"(?P<compact>(?<!\d)(?:19|20)\d{6}(?:t?\d{6}|t?\d{4})?(?!\d))|(?P<clock>\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?)(?:\s*(?P<half>[ap])\.?m\b\.?)?|(?P<hour>\d{1,2})\s*(?P<part>[ap])\.?m\b\.?"
    r"|(?P<number>\d+)|(?P<word>[a-z]+)\.?|(?P<sign>[+-])|(?P<gap>[\s,;/.()]+)"
)
OFFSET = re.compile(r"(utc|gmt)?\s*([+-])\s*(\d{1,2})(?::?(\d{2}))?\)?$")


def _day(year: int, month: int, day: int) -> dt.datetime:
    return dt.datetime(year, month, day)


def _year(n: int, digits: int, near: int) -> int:
    """Two digits stand for the year of that ending that is nearest to `near`."""
    if digits > 2:
        return n
    century = near // 100 * 100
    return min((century + n + k for k in (-100, 0, 100)), key=lambda y: (abs(y - near), y))


def read_date(text: str, as_of: dt.datetime | None = None) -> dt.datetime | None:
    """The time that a text states, naive in Beijing; None if it states none, or not all of its date and as_of is None."""
    try:
        return _read(text.strip().lower(), as_of)
    except (ValueError, OverflowError):
        return None


def _read(text: str, as_of: dt.datetime | None) -> dt.datetime | None:
    clock: tuple[int, int, int, int] | None = None
    offset: dt.timedelta | None = None
    month = weekday = None
    numbers: list[tuple[int, int]] = []
    day = None
    # an offset stands at the end, behind a time
    if (m := OFFSET.search(text)) and re.search(r"\d:\d|\d\s*[ap]\.?m|t\d{4}", text[: m.start()]):
        # behind a zone's name the sign says what must be added to reach it
        ahead = (m[2] == "+") != bool(m[1])
        offset = (1 if ahead else -1) * dt.timedelta(hours=int(m[3]), minutes=int(m[4] or 0))
        text = text[: m.start()]
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return None
        at = m.end()
        if m["compact"]:
            digits = m["compact"].replace("t", "")
            day = _day(int(digits[:4]), int(digits[4:6]), int(digits[6:8]))
            if rest := digits[8:]:
                clock = (int(rest[:2]), int(rest[2:4]), int(rest[4:] or 0), 0)
        elif m["clock"] or m["hour"]:
            if clock:
                return None
            parts = re.split(r"[:.,]", m["clock"] or m["hour"])
            hour, half = int(parts[0]), m["half"] or m["part"]
            if half and not 1 <= hour <= 12:
                return None
            hour = hour % 12 + 12 * (half == "p") if half else hour
            clock = (hour, int(parts[1]) if len(parts) > 1 else 0, int(parts[2]) if len(parts) > 2 else 0, int(parts[3][:6].ljust(6, "0")) if len(parts) > 3 else 0)
        elif m["number"]:
            numbers.append((int(m["number"]), len(m["number"])))
        elif m["word"]:
            word = m["word"]
            if word in MONTHS:
                if month:
                    return None
                month = MONTHS[word]
            elif word in WEEKDAYS:
                weekday = WEEKDAYS[word]
            elif word in UNIVERSAL and clock:
                offset = offset or dt.timedelta()
            elif word not in FILLERS:
                return None
    if day is None:
        day = _date(month, weekday, numbers, clock is not None, as_of)
    elif numbers or month:
        return None
    if day is None:
        return None
    hour, minute, second, micro = clock or (0, 0, 0, 0)
    out = day.replace(hour=hour, minute=minute, second=second, microsecond=micro)
    return out if offset is None else out - offset + BEIJING


def _date(month: int | None, weekday: int | None, numbers: list[tuple[int, int]], timed: bool, as_of: dt.datetime | None) -> dt.datetime | None:
    near, year, day = (as_of or dt.datetime(2000, 1, 1)).year, None, None
    is_year = lambda x: x[1] > 2 or x[0] > 31
    if len(numbers) > 3 - bool(month):
        return None
    if month:
        rest = list(numbers)
        named = [x for x in rest if is_year(x)]
        if len(named) > 1:
            return None
        if named:
            year = _year(*named[0], near)
            rest.remove(named[0])
        if rest:
            day = rest.pop(0)[0]
        if rest:
            year = _year(*rest[0], near)
    elif len(numbers) == 3:
        a, b, c = numbers
        if is_year(a):
            year, month, day = _year(*a, near), b[0], c[0]
        elif a[0] > 12:
            year, month, day = _year(*c, near), b[0], a[0]
        else:
            year, month, day = _year(*c, near), a[0], b[0]
            if day > 31:
                return None
    elif len(numbers) == 2:
        a, b = numbers
        if is_year(a):
            year, month = _year(*a, near), b[0]
        elif is_year(b):
            year, month = _year(*b, near), a[0]
        else:
            month, day = (b[0], a[0]) if a[0] > 12 else (a[0], b[0])
    elif numbers:
        if is_year(numbers[0]):
            year = _year(*numbers[0], near)
        else:
            day = numbers[0][0]
    elif weekday is None and not timed:
        return None
    if as_of is None:
        return _day(year, month, day) if year and month and day else None
    if not (year or month or day) and weekday is not None:
        today = dt.datetime(as_of.year, as_of.month, as_of.day)
        return today + dt.timedelta(days=(weekday - today.weekday()) % 7)
    year, month = year or as_of.year, month or as_of.month
    return _day(year, month, day or min(as_of.day, calendar.monthrange(year, month)[1]))


def free_form(text: Column, as_of: Column | None = None) -> Column:
    """read_date() of a column; null texts stay in the JVM's hands as nulls."""

    # made on use: this module is also imported on executors, where no session is
    @F.arrow_udf("timestamp_ntz")
    def read(texts: pa.Array, days: pa.Array) -> pa.Array:
        out = [read_date(t, d) if t else None for t, d in zip(texts.to_pylist(), days.to_pylist(), strict=True)]
        return pa.array(out, pa.timestamp("us"))

    return read(text, F.lit(None).cast("timestamp_ntz") if as_of is None else as_of.cast("timestamp_ntz"))
