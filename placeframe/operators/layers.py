"""Map layers: attribute discovery, deprivation zones, catchments, routes and their lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.config import DATA_ZONES, MAIN_ROUTES
from placeframe.functions.numeric import decile
from placeframe.functions.text import primary_name, relation_lines, route_label, route_order, school_key, tidy_school
from placeframe.operators import lines
from placeframe.session import materialise

# Fixed values, which must be these for the right columns to be found: how publishers name the columns of deprivation zones
# and certificates, by priority.
DOMAINS = {"income": r"inc\w*rank", "employment": r"emp\w*rank", "health": r"(hlth|health)\w*rank", "education": r"edu\w*rank", "access": r"acc\w*rank", "crime": r"crime\w*rank", "housing": r"hous\w*rank"}
DOMAIN_WORDS = r"inc|emp|edu|hlth|health|acc|crime|hous|pop|work"
ZONE = (r"^data_?zone$", r"^dz(_?code)?$", r"datazone", r"^dz")
ZONE_NAME = (r"^(dz_?)?name$", r"name")
COUNCIL = (r"^la_?name$", r"council", r"^laname")
OVERALL = (r"^rank(v2)?$", r"^simd\d*(v\d)?_?rank$", r"^simd", r"rank")
CERTIFICATE = {
    "postcode": (r"^postcode$",),
    "address1": (r"^address_?1$", r"^address$"),
    "address2": (r"^address_?2$",),
    "floor_area": (r"total_?floor_?area", r"floor.?area"),
    "band": (r"^current_?energy_?(efficiency_?)?(rating|band)$", r"current.*(rating|band)"),
    "date": (r"lodgement_?date", r"inspection_?date", r"date"),
}


def find_column(names: Sequence[str], *patterns: str) -> str | None:
    """The first name that the first matching pattern finds: patterns come before columns."""
    return next((n for p in patterns for n in names if re.search(p, n, re.I)), None)


def zone_columns(names: Sequence[str]) -> dict[str, str | None]:
    overall = [n for n in names if re.search("rank", n, re.I) and not re.search(DOMAIN_WORDS, n, re.I)]
    return {"dz": find_column(names, *ZONE), "name": find_column(names, *ZONE_NAME), "la": find_column(names, *COUNCIL), "rank": find_column(overall, *OVERALL), **{d: find_column(names, p) for d, p in DOMAINS.items()}}


def deprivation_zones(raw: DataFrame, zones: int = DATA_ZONES) -> DataFrame:
    """feature_id, dz, name, la, rank, decile, a decile for each domain, and polys, whatever the publisher's column names."""
    found = zone_columns([c for c in raw.columns if c not in ("feature_id", "polys")])
    col = lambda k, kind: F.col(f"`{found[k]}`").cast(kind) if found[k] else F.lit(None).cast(kind)
    rank = col("rank", "string").try_cast("double")
    return raw.select("feature_id", col("dz", "string").alias("dz"), col("name", "string").alias("name"), col("la", "string").alias("la"), rank.cast("int").alias("rank"), decile(rank, zones).alias("decile"), *[decile(col(d, "string"), zones).alias(d) for d in DOMAINS], "polys")


def certificate_columns(raw: DataFrame) -> DataFrame:
    """Certificates under common names; columns that are missing are null."""
    found = {k: find_column(raw.columns, *p) for k, p in CERTIFICATE.items()}
    return raw.select(*[(F.col(f"`{c}`") if c else F.lit(None)).cast("string").alias(k) for k, c in found.items()])


def top_school(df: DataFrame, tops: DataFrame, school: str = "school", sector: str | Column | None = "sector") -> DataFrame:
    """Add top_rank: the rank of the first listed top school whose match is part of the name, of the same sector.

    tops: (ord, rank, match, sector), a list of some ten rows; it is broadcast, and the containment test is a nested loop
    over those rows only.
    """
    if tops.count() > 1000:
        raise ValueError("the list of top schools is meant to be short")
    name = F.replace(F.lower(F.col(school)), F.lit("’"), F.lit("'"))
    small = F.broadcast(tops.select(F.col("ord").alias("__o"), F.col("rank").alias("__r"), F.col("match").alias("__m"), F.coalesce("sector", F.lit("ND")).alias("__s")))
    same = F.lit(True) if sector is None else (F.col(sector) if isinstance(sector, str) else sector) == F.col("__s")
    keyed = df.withColumn("__id", F.monotonically_increasing_id())
    hits = keyed.join(small, name.contains(F.col("__m")) & same, "left")
    others = [c for c in df.columns]
    return hits.groupBy("__id", *others).agg(F.min_by("__r", "__o").alias("top_rank")).drop("__id")


def sector_of_name(school: str = "school") -> Column:
    """The sector that a school's name suggests."""
    return F.when(F.lower(F.col(school)).rlike(r"\brc\b|catholic|st thomas|st augustine|holy rood"), "RC").otherwise("ND")


def secondary_layer(raw: DataFrame, tops: DataFrame) -> DataFrame:
    """(feature_id, school, sector, top_rank, polys) of raw secondary catchments."""
    named = raw.select("feature_id", F.col("school").alias("__raw"), "sector")
    ranked = top_school(named, tops, "__raw").select("feature_id", tidy_school("__raw").alias("school"), "sector", "top_rank")
    return ranked.join(raw.select("feature_id", "polys"), "feature_id")


def primary_layer(raw: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """(feature_id, school, sector, stages, score, top, polys); raw: register name and note. Of equal keys the last score counts."""
    school, stages = primary_name("school_name", "note")
    best = scores.groupBy(school_key("name").alias("__k")).agg(F.max_by("score", "ord").alias("score"))
    out = raw.select("feature_id", school.alias("school"), "sector", stages.alias("stages"), "polys").withColumn("__j", school_key("school"))
    return out.join(best, F.col("__j") == F.col("__k"), "left").withColumn("top", F.col("score") >= threshold).drop("__j", "__k")


def school_counts(homes: DataFrame, all_homes: DataFrame, tops: DataFrame) -> DataFrame:
    """Top schools with the register's name and how many of ``homes`` are in their catchment."""
    from placeframe.operators.stats import facet_counts, facet_values

    names = top_school(facet_values(all_homes, "catchment", "catchment_rc").withColumnRenamed("value", "school"), tops, "school", sector_of_name())
    first = names.where("top_rank is not null").groupBy("top_rank").agg(F.min("school").alias("school"))
    counts = facet_counts(homes, "catchment", "catchment_rc").withColumnRenamed("value", "school")
    return tops.join(first, F.col("rank") == F.col("top_rank"), "left").drop("top_rank").join(counts, "school", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def merged_routes(elements: DataFrame, tolerance: float, key: Column, counted: bool = False) -> DataFrame:
    """(ref, name, colour, lines) of the relations with one key: lines merged, simplified and rounded to five places.

    ``counted``: lines is their number, and no row holds the lines of a route.
    """
    own = elements.select(key.alias("ref"), F.coalesce(F.col("tags")["name"], F.lit("")).alias("name"), F.col("tags")["colour"].alias("colour"), "ord", relation_lines("members").alias("ways"))
    own = materialise(own, "routes")
    named = own.groupBy("ref").agg(F.min_by("name", "ord").alias("name"), F.min_by("colour", "ord").alias("colour"))
    one = own.select(F.col("ref").alias("key"), "ord", F.posexplode("ways").alias("at", "points")).select("key", F.struct("ord", "at").alias("line"), "points")
    thin = lines.simplified(lines.merged(one), tolerance).withColumnRenamed("key", "ref")
    if counted:
        return named.join(thin.groupBy("ref").agg(F.count(F.lit(1)).cast("int").alias("lines")), "ref")
    rounded = F.transform("points", lambda p: F.struct(F.round(p["x"], 5).alias("x"), F.round(p["y"], 5).alias("y")))
    shape = thin.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("chain", rounded.alias("points")))).alias("of"))  # the lines of a route
    return named.join(shape, "ref").select("ref", "name", "colour", F.transform("of", lambda x: x["points"]).alias("lines"))


def bus_routes(elements: DataFrame, main: Sequence[str] = tuple(MAIN_ROUTES), counted: bool = False) -> DataFrame:
    """Bus routes in natural order of their numbers."""
    bus = elements.where(F.col("tags")["route"] == "bus")
    key = F.coalesce(F.nullif(F.col("tags")["ref"], F.lit("")), F.col("tags")["name"], F.lit("?"))
    return merged_routes(bus, 0.00006, key, counted).withColumns({"name": route_label("name"), "main": F.col("ref").isin(list(main))}).orderBy(route_order("ref"))


def tram_layer(elements: DataFrame, name: str = "Trams", counted: bool = False) -> DataFrame:
    """The tram line, then its stops: (kind, name, lines, x, y)."""
    line = merged_routes(elements.where(F.col("tags")["route"] == "tram"), 0.00003, F.lit(name), counted).select(F.lit("line").alias("kind"), F.lit(name).alias("name"), "lines", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    stops = elements.where("type = 'node'").select(F.lit("stop").alias("kind"), F.coalesce(F.col("tags")["name"], F.lit("")).alias("name"), F.lit(None).cast(line.schema["lines"].dataType).alias("lines"), F.bround("lon", 5).alias("x"), F.bround("lat", 5).alias("y"))
    return line.unionByName(stops)


def rail_layer(elements: DataFrame, counted: bool = False) -> DataFrame:
    return merged_routes(elements.where(F.col("tags")["route"] == "train"), 0.00008, F.lit("Railway"), counted).select(F.lit("line").alias("kind"), F.col("ref").alias("name"), "lines")


def station_points(stations: DataFrame) -> DataFrame:
    return stations.select(F.lit("station").alias("kind"), "name", "minutes", F.col("trains_per_hour").alias("per_hour"), F.col("lng").alias("x"), F.col("lat").alias("y"))


def map_homes(homes: DataFrame) -> DataFrame:
    """What the map needs of each home."""
    label = F.concat(F.coalesce(F.col("bedrooms").cast("string"), F.lit("?")), F.lit(" bed"))
    return homes.select("id", "lng", "lat", "price", F.coalesce(F.col("travel.best_min"), F.lit(999)).alias("mins"), F.coalesce(F.col("area.vs_pct"), F.lit(0)).alias("vs"), (F.coalesce(F.col("top_school_rank"), F.lit(0)) != 0).alias("top"), F.col("source").eqNullSafe("auction").alias("lot"), F.col("kind").eqNullSafe("plot").alias("plot"), label.alias("label"))


def shown_features(layer: DataFrame, kind: str, all_bus: bool = False, rc: bool = False) -> DataFrame:
    """Attribute filters of the map: main bus routes, top catchments by sector, one copy of stage-split primaries, lines or stops."""
    if kind == "bus":
        return layer if all_bus else layer.where("main")
    if kind == "catchTop":
        return layer.where((F.coalesce("top_rank", F.lit(0)) != 0) & (F.col("sector") == ("RC" if rc else "ND")))
    if kind == "primary":
        return layer.where((F.coalesce("stages", F.lit("")) != "P5-P7") & (F.col("sector") == ("RC" if rc else "ND")))
    return layer.where(F.col("kind") == kind)
