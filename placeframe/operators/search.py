"""Faceted search: a filter specification that is a URL hash, a predicate and an order."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field, fields
from functools import reduce
from urllib.parse import parse_qsl, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.functions.numeric import deadline, price_per_m2
from placeframe.functions.text import house_type

REJECTED = "Rejected"
# Map layers and whether they show at first; settings that change the view, not the result.
LAYERS = {"simd": False, "tram": True, "rail": True, "tramProposed": True, "bus": False, "catchTop": True, "catchAll": False, "primary": False, "primaryRc": False, "areas": False}
VIEW = frozenset({"colourBy", "sort", "simdDomain", "basemap", "allBus", "show", "layers"})
SORTS = ("price_asc", "price_desc", "time", "newest", "soonest", "value", "ppsqm")


def list_of(s: str) -> list[str]:
    return [x for x in s.split(",") if x]


def toggle_in(s: str, value: str) -> str:
    xs = list_of(s)
    return ",".join([x for x in xs if x != value] if value in xs else [*xs, value])


@dataclass(frozen=True)
class FilterSpec:
    """0, '' and False are off; names are those of the hash."""

    minPrice: float = 0
    maxPrice: float = 0
    minBeds: float = 0
    maxBeds: float = 0
    minBaths: float = 0
    minArea: float = 0
    types: str = ""
    garage: bool = False
    maxMins: float = 0
    topSchool: bool = False
    school: str = ""
    topPrimary: bool = False
    primary: str = ""
    region: str = ""
    minSimd: float = 0
    q: str = ""
    newOnly: bool = False
    list: str = ""
    hideRejected: bool = True
    saleType: str = ""
    show: str = "homes"
    motivated: bool = False
    needsWork: bool = False
    closingDate: bool = False
    reduced: bool = False
    colourBy: str = "price"
    sort: str = "time"
    layers: dict = field(default_factory=lambda: dict(LAYERS))
    simdDomain: str = "decile"
    allBus: bool = False
    basemap: str = "light"

    def to_hash(self) -> str:
        """Only what differs from the defaults."""
        out = []
        for name, value, default in self._settings():
            if value != default:
                out.append((name, ("1" if value else "0") if isinstance(default, bool) else value if isinstance(default, str) else f"{value:g}" if value < 1e6 else str(int(value) if value == int(value) else value)))
        on = lambda layers: ",".join(sorted(k for k, v in layers.items() if v))
        if on(self.layers) != on(LAYERS):
            out.append(("layers", on(self.layers) or "none"))
        return urlencode(out)

    @classmethod
    def from_hash(cls, text: str) -> FilterSpec:
        """Unknown names are ignored and bad numbers are 0; 'detached=1' is an older form of types=detached."""
        given: dict[str, str] = {}
        for k, v in parse_qsl(text.removeprefix("#"), keep_blank_values=True):
            given.setdefault(k, v)
        out: dict = {}
        for f in fields(cls):
            if f.name not in given or f.name == "layers":
                continue
            v = given[f.name]
            if f.type == "bool":
                out[f.name] = v == "1"
            elif f.type == "float":
                try:
                    out[f.name] = float(v) if float(v) == float(v) else 0
                except ValueError:
                    out[f.name] = 0
            else:
                out[f.name] = v
        if given.get("detached") == "1" and "types" not in given:
            out["types"] = "detached"
        if "layers" in given:
            on = set(given["layers"].split(","))
            out["layers"] = {k: k in on for k in LAYERS}
        return cls(**out)

    def _settings(self):
        plain = cls_defaults()
        return [(k, v, plain[k]) for k, v in asdict(self).items() if k != "layers"]

    def active_count(self) -> int:
        """How many settings narrow the result."""
        return sum(v != d for k, v, d in self._settings() if k not in VIEW)


def cls_defaults() -> dict:
    return asdict(FilterSpec())


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def is_reduced(history: str | Column = "price_history") -> Column:
    h = F.col(history) if isinstance(history, str) else history
    return F.coalesce(F.try_element_at(h, F.lit(-1))["price"] < F.try_element_at(h, F.lit(-2))["price"], F.lit(False))


def is_new(first_seen: str | Column, now: Column, days: int = 7) -> Column:
    """Less than ``days`` since midnight (UTC) of the day it was first seen."""
    c = F.col(first_seen) if isinstance(first_seen, str) else first_seen
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(c.cast("timestamp")) < days * 86_400, F.lit(False))


def tokens(q: str) -> list[str]:
    return [w for w in re.split(r"[\s,]+", q.lower()) if w]


def contains_all(text: Column, q: str) -> Column:
    return reduce(lambda a, b: a & b, [F.lower(text).contains(w) for w in tokens(q)], F.lit(True))


def predicate(spec: FilterSpec, now: Column) -> Column:
    """The conjunction of the active settings (saved lists are joins, see :func:`search`)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    terms: list[Column] = []
    add = lambda on, make: terms.append(make()) if on else None
    add(spec.minPrice, lambda: F.col("price") >= spec.minPrice)
    add(spec.maxPrice, lambda: F.col("price") <= spec.maxPrice)
    add(spec.minBeds, lambda: n("bedrooms") >= spec.minBeds)
    add(spec.maxBeds, lambda: n("bedrooms") <= spec.maxBeds)
    add(spec.minBaths, lambda: n("bathrooms") >= spec.minBaths)
    add(spec.minArea, lambda: n("floor_area_m2") >= spec.minArea)
    add(spec.types, lambda: house_type("property_type", "detached").isin(list_of(spec.types)))
    add(spec.garage, lambda: F.coalesce(F.col("garage"), F.lit(False)))
    add(spec.maxMins, lambda: F.col("travel.best_min") <= spec.maxMins)
    add(spec.topSchool, lambda: n("top_school_rank") != 0)
    add(spec.school, lambda: _text("catchment").isin(list_of(spec.school)) | _text("catchment_rc").isin(list_of(spec.school)))
    add(spec.topPrimary, lambda: F.coalesce(F.col("top_primary"), F.lit(False)))
    add(spec.primary, lambda: _text("primary").isin(list_of(spec.primary)) | _text("primary_rc").isin(list_of(spec.primary)))
    add(spec.region, lambda: _text("region").isin(list_of(spec.region)))
    add(spec.minSimd, lambda: F.coalesce(F.col("simd.decile"), F.lit(0)) >= spec.minSimd)
    add(tokens(spec.q), lambda: contains_all(F.concat_ws(" ", _text("address"), _text("title"), _text("postcode")), spec.q))
    add(spec.newOnly, lambda: is_new("first_seen", now))
    plot, lot = F.col("kind").eqNullSafe("plot"), F.col("source").eqNullSafe("auction")
    add(spec.show == "homes", lambda: ~plot)
    add(spec.show == "plots", lambda: plot)
    add(spec.saleType == "auction", lambda: lot | (F.coalesce(F.size("also_auction"), F.lit(0)) > 0))
    add(spec.saleType == "private", lambda: ~lot)
    add(spec.motivated, lambda: F.coalesce(F.array_contains("flags", "motivated"), F.lit(False)))
    add(spec.needsWork, lambda: F.coalesce(F.array_contains("flags", "needs_work"), F.lit(False)))
    add(spec.closingDate, lambda: F.col("closing_date").isNotNull())
    add(spec.reduced, is_reduced)
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def ordering(by: str, tie: str | None = "ord") -> list[Column]:
    """The sort keys of a mode; ``tie`` keeps equal rows in their order of entry."""
    keys = {
        "price_asc": lambda: F.col("price").asc_nulls_last(),
        "price_desc": lambda: F.col("price").desc_nulls_last(),
        "time": lambda: F.col("travel.best_min").asc_nulls_last(),
        "newest": lambda: F.col("first_seen").desc_nulls_last(),
        "soonest": lambda: deadline(F.col("auction.date"), F.col("closing_date"), F.col("also_auction")).asc_nulls_last(),
        "value": lambda: F.coalesce(F.col("area.vs_pct"), F.lit(0)).asc(),
        "ppsqm": lambda: price_per_m2("price", "floor_area_m2").asc_nulls_last(),
    }
    return [keys[by](), *([F.col(tie)] if tie else [])]


def search(listings: DataFrame, spec: FilterSpec, now: Column, saved: DataFrame | None = None, limit: int | None = 400, tie: str | None = "ord") -> DataFrame:
    """Filter, order and limit. ``saved``: (list, id), for the chosen list and for hiding rejected homes."""
    out = listings.where(predicate(spec, now))
    if saved is not None and spec.list:
        out = out.join(saved.where(F.col("list") == spec.list).select("id").distinct(), "id", "left_semi")
    if saved is not None and spec.hideRejected and spec.list != REJECTED:
        out = out.join(saved.where(F.col("list") == REJECTED).select("id").distinct(), "id", "left_anti")
    out = out.orderBy(*ordering(spec.sort, tie))
    return out.limit(limit) if limit else out


def by_id(listings: DataFrame, home: str) -> DataFrame:
    return listings.where(F.col("id") == home)
