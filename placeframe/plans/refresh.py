"""The daily refresh as one lazy plan: state and layers in, enriched listings and area statistics out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.config import REGION_DISTRICTS, TRAVEL, Travel
from placeframe.functions.text import strip_address_noise
from placeframe.operators import linkage, spatial, stats, transit
from placeframe.session import materialise

# The columns of a listing that results keep.
COLUMNS = ("id", "url", "title", "address", "postcode", "district", "lat", "lng", "price", "price_qualifier", "bedrooms", "bathrooms", "floor_area_m2", "property_type", "detached", "garage", "image", "first_seen", "price_history", "approx_location", "flags", "closing_date", "source", "auction", "kind", "plot_acres", "epc")
_KEPT = ("detached", "garage")


@dataclass
class Inputs:
    """Optional tables; what is missing is left out of the result."""

    zones: DataFrame | None = None
    secondary: DataFrame | None = None
    primary: DataFrame | None = None
    certificates: DataFrame | None = None
    profiles: DataFrame | None = None
    stops: DataFrame | None = None
    stations: DataFrame | None = None
    previous: DataFrame | None = None


def regions(spark) -> DataFrame:
    return spark.createDataFrame([(d, r) for r, ds in REGION_DISTRICTS.items() for d in ds], "district string, region string")


def usable(listings: DataFrame) -> DataFrame:
    """Rows with a position and a price, the kept columns only."""
    rows = listings.where(F.col("lat").isNotNull() & (F.coalesce(F.col("price"), F.lit(0)) != 0))
    return rows.select([c for c in COLUMNS if c in listings.columns])


def strip_empty(df: DataFrame) -> DataFrame:
    """Null for empty texts, zeros, false flags and empty arrays (two flags are always kept)."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f.name), f.dataType.typeName()
        if f.name in _KEPT:
            c = F.coalesce(c, F.lit(False))
        elif kind == "string":
            c = F.nullif(c, F.lit(""))
        elif kind in ("integer", "long", "double", "float", "short"):
            c = F.nullif(c, F.lit(0).cast(f.dataType))
        elif kind == "boolean":
            c = F.when(c, True)
        elif kind == "array":
            c = F.when(F.size(c) > 0, c)
        out.append(c.alias(f.name))
    return df.select(out)


def enrich(listings: DataFrame, inputs: Inputs, as_of: Column, travel: Travel = TRAVEL) -> tuple[DataFrame, DataFrame]:
    """(enriched listings, area statistics). Duplicates are resolved after enrichment and before the statistics."""
    df = usable(listings)
    if "source" in df.columns:
        df = df.withColumn("address", F.when(F.col("source") == "auction", strip_address_noise("address")).otherwise(F.col("address")))
    if "closing_date" in df.columns:
        df = df.withColumn("closing_date", F.when(F.col("closing_date") >= as_of.cast("date"), F.col("closing_date")))
    if inputs.certificates is not None:
        df = linkage.apply_certificates(df, inputs.certificates)
    df = df.join(regions(df.sparkSession).withColumnRenamed("district", "__rd"), F.col("district") == F.col("__rd"), "left").drop("__rd")
    if inputs.zones is not None:
        df = spatial.first_hit(df, inputs.zones, "id", "feature_id", [c for c in inputs.zones.columns if c not in ("feature_id", "polys", "la")], "simd")
    if inputs.secondary is not None:
        df = spatial.secondary_catchments(df, inputs.secondary)
    if inputs.primary is not None:
        df = spatial.primary_catchments(df, inputs.primary)
    df = transit.journeys(df, travel, inputs.profiles, inputs.stops, inputs.stations)
    if inputs.profiles is None and inputs.previous is not None:
        df = transit.keep_last_transit(df, inputs.previous)
    df = df.withColumns({"lat": F.bround("lat", 5), "lng": F.bround("lng", 5)})
    df = materialise(strip_empty(df), "enriched")
    df = materialise(linkage.resolve_duplicates(df), "resolved")
    areas = stats.area_stats(stats.comparable(df), extra=[F.col("lat").alias("lat"), F.col("lng").alias("lng")])
    areas = materialise(areas, "areas")
    compared = stats.compare(df, areas, skip=F.col("kind").eqNullSafe("plot"))
    area = F.when(F.col("base").isNotNull(), F.struct(F.col("base").alias("median"), "basis", "vs_pct"))
    return compared.withColumn("area", area).drop("base", "basis", "vs_pct"), areas
