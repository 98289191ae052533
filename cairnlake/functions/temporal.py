"""Dates in queries, records and texts.

Query intent and narrative mentions are rule tables that a small Python matcher walks in order, in Arrow batches.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Fixed values.
MONTHS = "January February March April May June July August September October November December".split()
WEEKDAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
WEEKDAYS_CN = "星期一 星期二 星期三 星期四 星期五 星期六 星期日".split()
HALF_LIFE_DAYS, RECENCY_BONUS = 30, 0.004
SEASON_END = {"spring": 5, "summer": 8, "fall": 11, "autumn": 11, "winter": 2}
MENTIONS, DATE_TAGS, MENTION_CHARS, INTENT_CHARS = 10, 24, 16_000, 4000
POINT, BEFORE, AFTER = "(?:as of|in|during|around|at the end of|by the end of)", "(?:before|until|prior to|by)", "(?:after|since)"
COMPARISON = re.compile(r"\b(previously|used to|originally|currently|nowadays|anymore|any longer|no longer)\b|以前|曾经|过去|目前|如今|眼下", re.I)
RELATIVE = [r"\b(yesterday)\b", r"\b(today)\b", r"\b(tomorrow)\b", r"\b(last|this|next)\s+(week|month|year)\b", "昨天|今天|明天|上周|本周|上个月|本月|这个月|今年|去年|明年"]

MONTH_NUMBER = {m.lower(): i for i, m in enumerate(MONTHS, 1)} | {m[:3].lower(): i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
MONTH = "(" + "|".join([*MONTHS, *(m[:3] for m in MONTHS if m != "May"), "Sept"]) + ")"
YEAR = r"((?:19|20)\d{2})"
SEASON = "(spring|summer|fall|autumn|winter)"
DAY = r"(?:\s+(\d{1,2})(?:st|nd|rd|th)?)?,?"


def utc(*parts: int) -> datetime:
    return datetime(*parts, tzinfo=timezone.utc)


def last_day(year: int, month: int) -> int:
    return calendar.monthrange(year, month)[1]


def closing(year: int, month: int | None = None, day: int | None = None) -> datetime:
    """The last microsecond of a day, month or year."""
    month = month or 12
    return utc(year, month, day or last_day(year, month), 23, 59, 59, 999999)


def opening(year: int, month: int | None = None, day: int | None = None) -> datetime:
    return utc(year, month or 1, day or 1)


def iso(moment: datetime | None) -> str | None:
    return moment and moment.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def _half(g: tuple) -> datetime:
    month = MONTH_NUMBER[g[1].lower()]
    return closing(int(g[2]), month, 15 if g[0].lower() in ("first", "1st") else None)


def _ymd(g: tuple) -> tuple[int, int | None, int | None]:
    return int(g[0]), int(g[1]), g[2] and int(g[2])


def _mdy(g: tuple) -> tuple[int, int | None, int | None]:
    return int(g[2]), MONTH_NUMBER[g[0].lower()], g[1] and int(g[1])


def _y(g: tuple) -> tuple[int, int | None, int | None]:
    return int(g[0]), None, None


def intent_rules() -> list[tuple[re.Pattern, Callable]]:
    """In order of precedence: pattern, and the instant that its groups mean (None: a lower bound, no instant)."""
    rules: list[tuple[str, Callable]] = [
        (rf"\b(first|second|1st|2nd)\s+half\s+of\s+{MONTH}\s+{YEAR}\b", _half),
        (rf"\bbetween\s+{MONTH}\s+and\s+{MONTH}\s+{YEAR}\b", lambda g: closing(int(g[2]), MONTH_NUMBER[g[1].lower()])),
    ]
    season = (rf"\b{POINT}(?:\s+the)?\s+{SEASON}(?:\s+of)?\s+{YEAR}\b", lambda g: closing(int(g[1]), SEASON_END[g[0].lower()]))
    for form, parts in ((r"(\d{4})-(\d{2})(?:-(\d{2}))?", _ymd), (rf"{MONTH}{DAY}\s+{YEAR}", _mdy), (YEAR, _y)):
        if parts is _y:
            rules.append(season)
        rules += [
            (rf"\b{POINT}\s+{form}\b", lambda g, p=parts: closing(*p(g))),
            (rf"\b{BEFORE}\s+{form}\b", lambda g, p=parts: opening(*p(g))),
            (rf"\b{AFTER}\s+{form}\b", lambda g, p=parts: opening(*p(g)) and None),
        ]
    cn = r"(\d{4})\s*年\s*(\d{1,2})\s*月(?:(\d{1,2})\s*日)?"
    rules += [
        (rf"(?:截至(?:到)?|截止到|在|于)\s*{cn}", lambda g: closing(*_ymd(g))),
        (rf"{cn}\s*(?:之前|以前|前)", lambda g: opening(*_ymd(g))),
        (rf"{cn}\s*(?:之后|以后|以来)", lambda g: opening(*_ymd(g)) and None),
    ]
    return [(re.compile(p, re.I), f) for p, f in rules]


INTENT = intent_rules()


def as_of(text: str) -> tuple[str | None, str]:
    """The instant that the first fitting rule gives, and what it matched. Impossible dates pass to the next rule."""
    for pattern, instant in INTENT:
        if m := pattern.search(text):
            try:
                g = m.groups()
                if len(g) == 3 and g[2] and g[2].isdigit() and len(g[2]) <= 2 and int(g[2]) == 0:
                    continue
                return iso(instant(g)), m.group(0)
            except (ValueError, KeyError, OverflowError):
                continue
    return None, ""


def anchored(expression: str, now: datetime) -> datetime | None:
    """A relative expression held against now; for reports only."""
    text = re.sub(r"\s+", " ", expression.lower())
    days = {"today": 0, "今天": 0, "yesterday": -1, "昨天": -1, "tomorrow": 1, "明天": 1}
    if text in days:
        d = now + timedelta(days=days[text])
        return closing(d.year, d.month, d.day)
    cn = {"上周": "last week", "本周": "this week", "上个月": "last month", "本月": "this month", "这个月": "this month", "今年": "this year", "去年": "last year", "明年": "next year"}
    way, _, unit = cn.get(text, text).partition(" ")
    step = {"last": -1, "this": 0, "next": 1}.get(way)
    if step is None:
        return None
    if unit == "week":
        d = now + timedelta(days=7 * step + 6 - now.weekday())
        return closing(d.year, d.month, d.day)
    if unit == "month":
        y, m = divmod(now.year * 12 + now.month - 1 + step, 12)
        return closing(y, m + 1)
    return closing(now.year + step)


def intent_of(text: str | None, now: datetime) -> tuple:
    """(has_temporal_intent, as_of, comparison, relative_expression, relative_as_of, matched)"""
    if not text or not text.strip():
        return False, None, False, None, None, ""
    text = text[:INTENT_CHARS]
    at, matched = as_of(text)
    comparison = bool(COMPARISON.search(text))
    relative = next((m.group(0) for p in RELATIVE if (m := re.search(p, text, re.I))), None)
    return bool(at or matched or comparison or relative), at, comparison, relative, relative and iso(anchored(relative, now)), matched


INTENT_TYPE = T.StructType(
    [T.StructField("has_temporal_intent", T.BooleanType()), T.StructField("as_of", T.StringType()), T.StructField("comparison", T.BooleanType())]
    + [T.StructField(x, T.StringType()) for x in ("relative_expression", "relative_as_of", "matched")]
)


def temporal_intent(text: Column, now: str) -> Column:
    moment = datetime.fromisoformat(now.replace("Z", "+00:00"))

    @pandas_udf(INTENT_TYPE)
    def extract(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([intent_of(t, moment) for t in x], columns=INTENT_TYPE.names)

    return extract(text)


def _date(year: int | None, month: int, day: int | None) -> tuple | None:
    """(kind, year, month, day) if there is such a date."""
    if not 1 <= month <= 12 or (day is not None and not 1 <= day <= last_day(year or 2001, month)) or (year is not None and not 1900 <= year <= 2099):
        return None
    return ("date" if day and year else "month_day" if day else "month_year"), year, month, day


NARRATIVE = [
    (re.compile(rf"\b{YEAR}-(\d{{2}})-(\d{{2}})\b"), lambda g: _date(int(g[0]), int(g[1]), int(g[2]))),
    (re.compile(rf"\b{MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:\s*,?\s*{YEAR})?\b", re.I), lambda g: _date(g[2] and int(g[2]), MONTH_NUMBER[g[0].lower()], int(g[1]))),
    (re.compile(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?(?:\s+of)?\s+{MONTH}(?:\s*,?\s*{YEAR})?\b", re.I), lambda g: _date(g[2] and int(g[2]), MONTH_NUMBER[g[1].lower()], int(g[0]))),
    (re.compile(rf"\b(?:the\s+)?{SEASON}(?:\s+of)?\s+{YEAR}\b", re.I), lambda g: ("season_year", int(g[1]), None, {"autumn": "fall"}.get(g[0].lower(), g[0].lower()))),
    (re.compile(r"((?:19|20)\d{2})\s*年\s*(\d{1,2})\s*月(?:(\d{1,2})\s*日)?"), lambda g: _date(int(g[0]), int(g[1]), g[2] and int(g[2]))),
    (re.compile(rf"\b{MONTH}\s*,?\s*{YEAR}\b", re.I), lambda g: _date(int(g[1]), MONTH_NUMBER[g[0].lower()], None)),
    (re.compile(rf"\b{YEAR}\b"), lambda g: ("year", int(g[0]), None, None)),
]


def mentions(text: str | None) -> list[tuple]:
    """Date mentions in order: (kind, year, month, day or season). Richer rules claim their text first, valid or not."""
    text = (text or "")[:MENTION_CHARS]
    claimed: list[tuple[int, int]] = []
    hits = []
    for pattern, read in NARRATIVE:
        free = [m for m in pattern.finditer(text) if not any(a < m.end() and m.start() < b for a, b in claimed)]
        claimed += [m.span() for m in free]
        hits += [(m.start(), got) for m in free if (got := read(m.groups()))]
    return list(dict.fromkeys(got for _, got in sorted(hits, key=lambda h: h[0])))[:MENTIONS]


def season_of(month: int) -> str:
    return ("winter", "spring", "summer", "fall")[month % 12 // 3]


def forms(mention: tuple) -> list[str]:
    kind, year, month, day = mention
    named = lambda s: [f"{s} {year}"] + ([f"autumn {year}"] if s == "fall" else [])
    if kind == "year":
        return [str(year)]
    if kind == "season_year":
        return [*named(day), str(year)]
    name = MONTHS[month - 1]
    if kind == "month_day":
        return [f"{name} {day}"]
    if kind == "month_year":
        return [f"{name} {year}", f"{year:04d}-{month:02d}", *named(season_of(month)), str(year)]
    return [f"{year:04d}-{month:02d}-{day:02d}", f"{name} {day}, {year}", f"{name} {year}", *named(season_of(month)), str(year)]


def date_tags_of(text: str | None) -> list[str]:
    first = {x.lower(): x for m in reversed(mentions(text)) for x in reversed(forms(m))}
    ordered = dict.fromkeys(x.lower() for m in mentions(text) for x in forms(m))
    return [first[x] for x in ordered][:DATE_TAGS]


def date_tags(text: Column) -> Column:
    @pandas_udf(T.ArrayType(T.StringType()))
    def tags(x: pd.Series) -> pd.Series:
        return x.map(date_tags_of)

    return tags(text)


def recency_bonus(recorded_at: Column, now: str) -> Column:
    """Halves every 30 days; the future counts as now."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(recorded_at.cast("timestamp"))) / 1e6
    return F.coalesce(RECENCY_BONUS * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age) / (HALF_LIFE_DAYS * 86400.0)), F.lit(0.0))


def time_text(days: Column, now: str) -> Column:
    """Date expressions of an array of days (ascending), as queries put them, relative ones held against now."""
    today = F.to_date(F.lit(now).cast("timestamp"))

    def of(day: Column) -> Column:
        delta = F.datediff(today, day)
        month, weekday = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day)), F.weekday(day) + 1
        y, m, d = (f(day).cast("string") for f in (F.year, F.month, F.dayofmonth))
        months = F.year(day) * 12 + F.month(day) == F.year(today) * 12 + F.month(today)
        said = [
            (delta == 0, ["今天", "today"]), (delta == 1, ["昨天", "yesterday"]), (delta == 2, ["前天"]), (delta == -1, ["明天", "tomorrow"]),
            (delta.between(0, 6), ["本周", "this week"]), (delta.between(7, 13), ["上周", "last week"]), (months, ["本月", "这个月", "this month"]),
            (F.year(day) == F.year(today), ["今年", "this year"]), (F.year(today) - F.year(day) == 1, ["去年", "last year"]),
        ]
        none = F.array().cast("array<string>")
        fixed = F.array(
            F.date_format(day, "yyyy-MM-dd"), F.concat(y, F.lit("年"), m, F.lit("月"), d, F.lit("日")), F.concat(y, F.lit("年"), m, F.lit("月")),
            F.concat(month, F.lit(" "), d, F.lit(", "), y), F.concat(month, F.lit(" "), y),
            F.element_at(F.array(*map(F.lit, WEEKDAYS_CN)), weekday), F.element_at(F.array(*map(F.lit, WEEKDAYS)), weekday),
        )
        return F.concat(fixed, *[F.when(c, F.array(*map(F.lit, words))).otherwise(none) for c, words in said])

    return F.array_join(F.array_distinct(F.flatten(F.transform(days, of))), " ")


def parse_time(text: Column) -> Column:
    """ISO text, with Z, an offset or no zone (UTC), or the spaced form with an offset; null if it is none of them."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z")))


def iso_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def from_millis(ms: Column) -> Column:
    """Milliseconds to a timestamp; null outside the years 1 to 9999."""
    return F.when(ms.between(-62135596800000, 253402300799999), F.timestamp_millis(ms))
