"""The daily run: listing state and auction lots are brought up to date, enriched and written, each step on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe import schemas
from placeframe.config import RULES
from placeframe.functions.html import parse_listings, parse_lots
from placeframe.operators import state as S
from placeframe.operators.layers import map_homes
from placeframe.plans.refresh import Inputs, enrich
from placeframe.session import materialise
from placeframe.sources import sinks
from placeframe.sources.files import read_or_empty


def _fit(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema, missing ones null."""
    empty = df.sparkSession.createDataFrame([], ddl)
    return df.select([(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in empty.schema.fields])


def update_listings(path: str, found: DataFrame, pages: DataFrame, complete: bool, unsure: DataFrame | None, postcodes: DataFrame | None, as_of: Column, rules=RULES) -> DataFrame:
    """Read what is due of the pages, upsert, classify, place, and write the state table; returns the active listings.

    found: schemas.FOUND of this run's searches; pages: schemas.PAGE, at least of the listings that are due. Raises if no
    search found anything, or if pages were read and none of them told a price and a place.
    """
    spark = found.sparkSession
    if not found.limit(1).count():
        raise RuntimeError("no listings found on any search page")
    state = read_or_empty(spark, path, schemas.STATE)
    due = S.todo(found, state, as_of, rules)
    fresh = materialise(_fit(parse_listings(pages.join(due.select("id"), "id", "left_semi"), as_of), schemas.LISTING).withColumns({"parser_version": F.lit(rules.parser_version), "plot_parsed": F.lit(True)}), "fresh")
    read = fresh.agg(F.count(F.lit(1)), F.count_if((F.coalesce("price", F.lit(0)) != 0) & (F.col("lat").isNotNull() | F.col("postcode").isNotNull()))).first()
    if read[0] and not read[1]:
        raise RuntimeError("pages were read, but none could be parsed")
    merged = _fit(S.upsert(state, fresh, as_of), schemas.STATE)
    out = S.classify(merged, found, complete, unsure, as_of, rules)
    if postcodes is not None:
        out = S.geocode(out, postcodes)
    out = S.collect_garbage(S.outside_map(out))
    sinks.swap_table(_fit(out, schemas.STATE), path)
    return spark.read.schema(schemas.STATE).parquet(path).where("active")


def update_lots(path: str, pages: DataFrame, house: str, complete: bool, as_of: Column, rules=RULES) -> DataFrame:
    """Upsert the lots of a catalogue's pages (schemas.PAGE), apply their lifecycle and write them; returns the active ones."""
    spark = pages.sparkSession
    fresh = materialise(_fit(parse_lots(pages, house, as_of), "id string, " + schemas.LOT.split(", ", 1)[1]).drop("price_history", "first_seen", "fetched", "active", "excluded"), "fresh-lots")
    merged = _fit(S.upsert(read_or_empty(spark, path, schemas.LOT), fresh, as_of), schemas.LOT)
    seen = fresh.select(F.col("id").alias("__id"), F.lit(True).alias("seen"))
    out = S.lot_lifecycle(merged.join(seen, F.col("id") == F.col("__id"), "left"), as_of, complete, rules)
    sinks.swap_table(_fit(out, schemas.LOT), path)
    return spark.read.schema(schemas.LOT).parquet(path).where("active")


def area_labels(areas: DataFrame) -> DataFrame:
    """A point per district with its median and count, for the map."""
    return areas.where("beds is null").select("district", "median", "count", F.col("lng").alias("x"), F.col("lat").alias("y"))


def run_day(run: sinks.Run, out: str, homes: DataFrame, lots: DataFrame | None, inputs: Inputs, as_of: Column) -> None:
    """Enrich active listings and lots and write listings, areas, the map's homes and the run's document."""
    def work():
        all_ = homes.unionByName(lots, allowMissingColumns=True) if lots is not None else homes
        listings, areas = enrich(all_, inputs, as_of)
        sinks.swap_table(listings, f"{out}/listings")
        sinks.swap_table(areas, f"{out}/areas")
        spark = homes.sparkSession
        done = spark.read.parquet(f"{out}/listings")
        with_rank = done if "top_school_rank" in done.columns else done.withColumn("top_school_rank", F.lit(None).cast("int"))
        sinks.swap_table(map_homes(with_rank), f"{out}/map")
        run.counters |= {"listings": done.count(), "duplicates": done.where("notes is not null").count()}

    run.step("enrich", work)
    spark = homes.sparkSession
    sinks.write_document(spark.createDataFrame([(run.document(),)], "value string"), f"{out}/meta")
