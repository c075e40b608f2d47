"""Parameters of the analytics; every function takes them as arguments with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# Map area, destination, districts by region, travel parameters, main bus routes, data zones ranked.
BBOX = {"west": -3.66, "south": 55.80, "east": -2.48, "north": 56.08}
DESTINATION = (55.95196, -3.18992)
REGION_DISTRICTS = {
    "Edinburgh": ["EH1", "EH2", "EH3", "EH4", "EH5", "EH6", "EH7", "EH8", "EH9", "EH10", "EH11", "EH12", "EH13", "EH14", "EH15", "EH16", "EH17", "EH28", "EH29", "EH30"],
    "Midlothian": ["EH18", "EH19", "EH20", "EH22", "EH23", "EH24", "EH25", "EH26"],
    "East Lothian": ["EH21", "EH31", "EH32", "EH33", "EH34", "EH35", "EH39", "EH41", "EH42"],
    "West Lothian": ["EH27", "EH49", "EH52", "EH53", "EH54"],
    "Fife": ["KY3", "KY11"],
}
MAIN_ROUTES = ["3", "5", "10", "11", "16", "22", "25", "26", "31", "37", "44"]
DATA_ZONES = 6976
EARTH_RADIUS_M = 6_371_000.0


# Fixed values, like those above: the defaults of travel and of what is kept (least bedrooms, ages, caps, parser version).
@dataclass(frozen=True)
class Travel:
    arrive_by: tuple[str, ...] = ("08:30", "08:40", "08:50", "09:00", "09:10")
    walk_kmh: float = 4.8
    detour: float = 1.3
    access_m: float = 1200
    transfer_m: float = 300
    buffer_s: int = 60
    destination_radius_m: float = 450
    cycle_kmh: float = 15
    rail_access_m: float = 2500
    destination: tuple[float, float] = DESTINATION


@dataclass(frozen=True)
class Rules:
    """What is kept: districts, least bedrooms, ages and caps of the crawl."""

    districts: tuple[str, ...] = field(default_factory=lambda: tuple(d for ds in REGION_DISTRICTS.values() for d in ds))
    min_bedrooms: int = 2
    refetch_days: int = 7
    max_fetches: int = 1500
    max_lots: int = 200
    parser_version: int = 4


TRAVEL, RULES = Travel(), Rules()
