"""Numeric, geographic, date and display functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeframe.config import DATA_ZONES, EARTH_RADIUS_M, TRAVEL


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def half_even(x, digits: int = 0) -> Column:
    return F.bround(_c(x), digits)


def half_up(x) -> Column:
    """Round halves towards plus infinity, as browsers do."""
    return F.floor(_c(x) + 0.5)


def truncated(x) -> Column:
    """Whole part, as an INT."""
    return _c(x).cast("int")


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    a, b, c, d = (F.radians(_c(x).cast("double")) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def walk_seconds(metres, travel=TRAVEL) -> Column:
    return _c(metres) * travel.detour / (travel.walk_kmh / 3.6)


def cycle_minutes(metres, travel=TRAVEL) -> Column:
    return _c(metres) * travel.detour / (travel.cycle_kmh / 3.6) / 60


def clock_seconds(text) -> Column:
    """'25:10' or '25:10:30' to seconds since midnight; null where it is no clock time. The text is looked at once, whatever it is made of."""
    part = lambda p, i: F.try_element_at(p, F.lit(i)).try_cast("int")
    seconds = lambda p: part(p, 1) * 3600 + part(p, 2) * 60 + F.coalesce(part(p, 3), F.lit(0))
    return F.transform(F.array(F.split(F.trim(_c(text)), ":")), seconds)[0]


def decile(rank, zones: int = DATA_ZONES) -> Column:
    """1 to 10 from a rank out of ``zones``; null for what is no positive number."""
    r = _c(rank).cast("string").try_cast("double")
    return F.when(r > 0, F.least(F.lit(10), F.greatest(F.lit(1), F.ceil(r / (zones / 10)).cast("int"))))


def first_number(text) -> Column:
    """The first number in a text, thousands separators removed."""
    found = F.regexp_extract(_c(text).cast("string"), r"-?\d[\d,]*\.?\d*", 0)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def floor_area(value, unit=None) -> Column:
    """Whole square metres from a number and a unit; null outside 25 to 2000 (judged before rounding)."""
    n = first_number(value)
    feet = F.coalesce(_c(unit).rlike("(?i)ft|feet|FTK"), F.lit(False)) if unit is not None else F.lit(False)
    m2 = F.when(feet, n * 0.092903).otherwise(n)
    return F.when(m2.between(25, 2000), F.bround(m2, 0).cast("int"))


def acres(size, unit) -> Column:
    """Acres to two places from a size in acres or hectares; null outside 0.01 to 500."""
    a = _c(size).cast("double") * F.when(F.lower(_c(unit)).startswith("h"), 2.471).otherwise(1.0)
    return F.when(a.between(0.01, 500), F.bround(a, 2))


def versus_percent(price, base) -> Column:
    return F.bround(100 * (_c(price) - _c(base)) / F.nullif(_c(base), F.lit(0)), 0).cast("int")


def price_per_m2(price, area) -> Column:
    return F.when(F.coalesce(_c(area), F.lit(0)) != 0, half_up(_c(price) / F.nullif(_c(area), F.lit(0))).cast("int"))


def price_per_acre(price, plot_acres) -> Column:
    return half_up(_c(price) / F.nullif(_c(plot_acres), F.lit(0)))


def acres_to_m2(plot_acres) -> Column:
    return half_up(_c(plot_acres) * 4047)


def beds_bucket(beds, top: int = 5) -> Column:
    """Null stays null: ``least`` alone would skip it."""
    return F.when(_c(beds).isNotNull(), F.least(_c(beds), F.lit(top)))


def bucket(value, stops: list[float]) -> Column:
    """Index of the first stop that the value is below; the last one beyond all (and for null, null)."""
    v = _c(value)
    below = reduce(lambda w, s: w.when(v < s[1], s[0]), enumerate(stops[1:-1], 1), F.when(v < stops[0], 0)) if len(stops) > 1 else F.when(v.isNotNull(), 0)
    return F.when(v.isNotNull(), below.otherwise(len(stops) - 1))


# Upper ends of the colour classes of price, minutes and difference from the area.
PRICE_STOPS, TIME_STOPS, VS_STOPS = [200_000, 300_000, 400_000, 550_000, 750_000, 1e12], [15, 25, 35, 45, 999], [-15, -5, 5, 15, 1e9]


def minutes_text(m) -> Column:
    v = _c(m).cast("int")
    return F.when(v.isNull(), "–").when(v >= 60, F.concat(F.floor(v / 60).cast("string"), F.lit(" h "), F.pmod(v, F.lit(60)).cast("string"), F.lit(" min"))).otherwise(F.concat(v.cast("string"), F.lit(" min")))


def pounds(n) -> Column:
    """£1.25m, £1m, £350k. Millions are rounded by their exact binary value; true halves go up."""
    v = _c(n).cast("double")
    tie = F.pmod(v, F.lit(125_000.0)) == 0
    m = F.replace(F.format_number(F.when(tie, F.floor(v / 10_000 + 0.5) / 100).otherwise(v / 1_000_000), 2), F.lit(","), F.lit(""))
    return F.when(v >= 1_000_000, F.concat(F.lit("£"), F.regexp_replace(m, r"\.?0+$", ""), F.lit("m"))).otherwise(F.concat(F.lit("£"), half_up(v / 1000).cast("string"), F.lit("k")))


def pounds_full(n) -> Column:
    return F.concat(F.lit("£"), F.format_number(_c(n), 0))


def days_ago(day, now) -> Column:
    """Whole days from a date (midnight UTC) to ``now``, a timestamp."""
    return F.floor((F.unix_timestamp(_c(now)) - F.unix_timestamp(_c(day).cast("timestamp"))) / 86_400)


def deadline(auction_date, closing_date, also_auction) -> Column:
    """Auction day, else closing date, else the day of the first attached auction."""
    return F.coalesce(_c(auction_date), _c(closing_date), F.try_element_at(_c(also_auction), F.lit(1))["date"])


def round_points(points, digits: int = 5) -> Column:
    """Coordinates of an array of (x, y) points to ``digits`` places."""
    return F.transform(_c(points), lambda p: F.struct(F.bround(p["x"], digits).alias("x"), F.bround(p["y"], digits).alias("y")))


def round_polygons(polys, digits: int = 5) -> Column:
    return F.transform(_c(polys), lambda rings: F.transform(rings, lambda ring: round_points(ring, digits)))


def in_bbox(lat, lng, box: dict[str, float]) -> Column:
    return _c(lat).between(box["south"], box["north"]) & _c(lng).between(box["west"], box["east"])
