"""Dates in texts with their positions, by expressions: between the matches of a pattern lie parts, whose lengths add up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeframe.functions.text import MONTH_NAMES, MONTHS

# How a date is written, and the words that tell an auction's from others within so many characters before it.
MONTH_DATE = rf"(?i)(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH_NAMES})\w*,?\s+(\d{{4}})"
SLASH_DATE = r"\b(\d{1,2})[/.](\d{1,2})[/.](20\d{2})\b"
AUCTION_WORDS = r"(?i)auction|sale date|bidding|ends?\b"
LOOK_BACK = 80


def _named(value: Column, body) -> Column:
    """``body`` of a value that it names more than once: the value is worked out once."""
    return F.transform(F.array(value), body)[0]


def positions(text: Column, pattern: str) -> Column:
    """Array of (at, match): where each match of a pattern begins, counted from 0."""
    both = F.struct(F.split(text, pattern).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    none = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<at:int,match:string>>").alias("found"))

    def step(parts: Column):
        def add(a: Column, m: Column) -> Column:
            at = a["next"] + F.length(F.get(parts, F.size(a["found"])))
            return F.struct((at + F.length(m)).alias("next"), F.array_append(a["found"], F.struct(at.alias("at"), m.alias("match"))).alias("found"))

        return add

    return _named(both, lambda b: F.aggregate(b["matches"], none, step(b["parts"]), lambda a: a["found"]))


def dates_in(text: Column) -> Column:
    """Array of (at, day) of the dates that there are, in the order of the text; null texts have none."""
    def day(m: Column, pattern: str, month) -> Column:
        part = lambda n: F.regexp_extract(m["match"], pattern, n)
        return F.struct(m["at"].alias("at"), F.concat_ws("-", part(3), F.lpad(month(part(2)).cast("string"), 2, "0"), F.lpad(part(1), 2, "0")).try_cast("date").alias("day"))

    named = lambda t: F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(t, 1, 3)))
    written = F.transform(positions(text, MONTH_DATE), lambda m: day(m, MONTH_DATE, named))
    slashed = F.transform(positions(text, SLASH_DATE), lambda m: day(m, SLASH_DATE, lambda t: t))
    return F.array_sort(F.filter(F.coalesce(F.concat(written, slashed), F.array().cast("array<struct<at:int,day:date>>")), lambda d: d["day"].isNotNull()))


def auction_day(text: Column, as_of: Column) -> Column:
    """The first date from yesterday on that an auction word precedes within 80 characters, else the first such date."""
    def of(t: Column) -> Column:
        coming = F.filter(dates_in(t), lambda d: d["day"] >= F.date_sub(as_of.cast("date"), 1))
        before = lambda d: F.substr(t, F.greatest(d["at"] - LOOK_BACK, F.lit(0)) + 1, F.least(d["at"], F.lit(LOOK_BACK)))
        return _named(coming, lambda c: F.coalesce(F.get(F.filter(c, lambda d: before(d).rlike(AUCTION_WORDS)), F.lit(0))["day"], F.get(c, F.lit(0))["day"]))

    return _named(text, of)
