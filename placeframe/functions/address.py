"""Address keys for duplicate resolution and for certificates, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeframe.functions.numeric import _c
from placeframe.functions.text import ADDRESS_NOISE

# Words that do not tell streets apart; what counts as a house number; abbreviated street words.
STOP_WORDS = ("edinburgh", "the", "and", "flat", "at", "of", "city", "midlothian", "lothian", "east", "west", "scotland", "united", "kingdom", "uk")
ANY_POSTCODE = r"(?iU)\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b"
HOUSE_NUMBER = r"\b(plot\d+|\d+[a-z]?)\b"
SHORT_WORDS = (("road", "rd"), ("street", "st"), ("avenue", "ave"))


def tidy_postcode(code) -> Column:
    return F.regexp_replace(F.trim(F.upper(F.coalesce(_c(code), F.lit("")))), r"(?U)\s+", " ")


def _numbers(text: Column) -> Column:
    """House numbers of a text, those of zeros only left out."""
    return F.filter(F.regexp_extract_all(text, F.lit(HOUSE_NUMBER), F.lit(1)), lambda n: F.ltrim(n, F.lit("0")) != "")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it names more than once: the value is worked out once."""
    return F.transform(F.array(value), body)[0]


def home_key(address, code) -> Column:
    """struct(postcode, numbers, words): sorted distinct house numbers and street words.

    The street is the first comma part with a number. Its numbers also come from the part before (a house's name) and,
    where it is nothing but a number, from the part after. Without a number the first two parts name the house.
    """
    clean = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce(_c(address), F.lit("")), ADDRESS_NOISE, ""), ANY_POSTCODE, ""))
    tidy = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\bplot\s+(\d+)", "plot$1"), r"\b\d+/\d+\b", " "))
    parts = F.filter(F.transform(F.split(clean, ","), tidy), lambda p: p != "")
    has = lambda parts: F.transform(parts, lambda p: (F.size(_numbers(p)) > 0).cast("int"))

    def key(parts: Column, i: Column) -> Column:
        own = F.get(parts, i)
        bare = F.btrim(F.regexp_replace(own, HOUSE_NUMBER, ""), F.lit(" -&and")) == ""
        numbered = F.concat_ws(" ", F.when(i > 0, F.get(parts, i - 1)), own, F.when(bare, F.get(parts, i + 1)))
        named = F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
        # A street that is nothing but a number has its words in the next part only through the numbers' segment; words are
        # those of the part that holds the number.
        street = F.when(i >= 0, own).otherwise(named)
        words = F.filter(F.regexp_extract_all(F.regexp_replace(street, HOUSE_NUMBER, " "), F.lit("([a-z]+)"), F.lit(1)), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 1))
        return F.struct(tidy_postcode(code).alias("postcode"), F.array_sort(F.array_distinct(_numbers(F.when(i >= 0, numbered).otherwise(named)))).alias("numbers"), F.array_sort(F.array_distinct(words)).alias("words"))

    return _once(parts, lambda parts: _once((F.array_position(has(parts), 1) - 1).cast("int"), lambda i: key(parts, i)))


def certificate_key(address) -> Column:
    """struct(number, words) of the text before the first comma: the last house number and the other words."""
    t = F.replace(F.lower(F.split(F.coalesce(_c(address), F.lit("")), ",")[0]), F.lit("&"), F.lit(" and "))
    for word, short in SHORT_WORDS:
        t = F.regexp_replace(t, rf"\b({word})\b", short)
    words = F.filter(F.split(F.regexp_replace(t, "[^a-z0-9/ ]+", " "), r"\s+"), lambda w: w != "")
    number = lambda w: w.rlike(r"^\d+[a-z]?$")
    return F.struct(F.try_element_at(F.filter(words, number), F.lit(-1)).alias("number"), F.array_distinct(F.filter(words, lambda w: ~number(w))).alias("words"))


def certificate_matches(home: Column, cert: Column) -> Column:
    """Same number and a shared street word; a house without a number shares all street words but one."""
    shared, street = F.size(F.array_intersect(home["words"], cert["words"])), F.size(home["words"])
    by_number = home["number"].isNotNull() & home["number"].eqNullSafe(cert["number"]) & ((shared > 0) | (street == 0))
    by_name = home["number"].isNull() & (street > 0) & (shared >= F.greatest(F.lit(1), street - 1))
    return by_number | by_name
