"""Schemas of the tables that the daily run keeps, as DDL."""

from __future__ import annotations

HISTORY = "array<struct<date:date,price:int>>"
AUCTION = "struct<house:string,date:date,basis:string>"
CERTIFICATE = "struct<band:string>"
_HOME = (
    "id string, url string, title string, address string, postcode string, district string, lat double, lng double, price int, price_qualifier string, bedrooms int, bathrooms int, "
    f"floor_area_m2 int, property_type string, detached boolean, garage boolean, image string, epc {CERTIFICATE}, flags array<string>, closing_date date, plot_acres double"
)
#: What a parsed page gives.
LISTING = _HOME
#: A listing with what the daily run knows of it.
STATE = f"{_HOME}, price_history {HISTORY}, first_seen date, fetched date, last_seen date, active boolean, excluded string, kind string, source string, auction {AUCTION}, approx_location boolean, parser_version int, plot_parsed boolean"
#: An auction lot.
LOT = f"{_HOME}, source string, auction {AUCTION}, not_a_home boolean, kind string, price_history {HISTORY}, first_seen date, fetched date, active boolean, excluded string"
FOUND = "id string, url string, hint string, ord long"
PAGE = "id string, url string, html string"
