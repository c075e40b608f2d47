"""Facet counts under changing filters, from bitmaps.

The values of each facet are bitmaps over row numbers, in buckets of 32,768. A set of filters is, bucket by bucket, the union of
the chosen values of each column and the intersection of the columns; what that shares with a value's bitmap is counted. The
table is read once, whatever is asked of it later. Null and empty values are in no facet; a row number stands for one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeframe.session import materialise


def index(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """(facet, value, bucket, bits) of each value of the columns, written; ``row`` numbers the rows from 0 or more."""
    each = df.select((F.col(row) + 1).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")).where("f.value <> ''")
    bits = each.groupBy("f.facet", "f.value", F.expr("bitmap_bucket_number(row)").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("bitmap_bit_position(row)")).alias("bits"))
    return materialise(bits, "facets")


def counts(bitmaps: DataFrame, filters: list[dict[str, list[str]]], facets: list[str]) -> DataFrame:
    """(filter, facet, value, n): for each set of filters, column to chosen values, how many rows each value of the facets has left.

    Values that no row has left are not listed. Without filters all rows count.
    """
    spark = bitmaps.sparkSession
    chosen = [(n, len(f), c, v) for n, f in enumerate(filters) for c, values in f.items() for v in values]
    wanted = spark.createDataFrame(chosen, "filter int, needed int, facet string, value string")
    either = bitmaps.join(wanted, ["facet", "value"]).groupBy("filter", "needed", "facet", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    all_of = either.groupBy("filter", "needed", "bucket").agg(F.bitmap_and_agg("bits").alias("left"), F.count(F.lit(1)).alias("met")).where("met = needed")
    shown = bitmaps.where(F.col("facet").isin(facets))
    both = shown.join(all_of.select("filter", "bucket", "left"), "bucket").select("filter", "facet", "value", "bucket", F.explode(F.array("bits", "left")).alias("bits"))
    parts = both.groupBy("filter", "facet", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits")).select("filter", "facet", "value", F.bitmap_count("bits").alias("n"))
    free = [n for n, f in enumerate(filters) if not f]
    if free:
        parts = parts.unionByName(shown.select(F.explode(F.array(*map(F.lit, free))).alias("filter"), "facet", "value", F.bitmap_count("bits").alias("n")))
    return parts.groupBy("filter", "facet", "value").agg(F.sum("n").alias("n")).where("n > 0")
