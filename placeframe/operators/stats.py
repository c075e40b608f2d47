"""Grouped statistics: district medians, comparisons, facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeframe.functions.numeric import beds_bucket, versus_percent
from placeframe.functions.text import district_order
from placeframe.session import discard, materialise

#: Comparables that a size bucket needs before its median is used.
MIN_COMPARABLES = 3


def comparable(listings: DataFrame) -> DataFrame:
    """Homes that feed the averages: neither auction lots (an opening bid is no asking price) nor plots."""
    return listings.where((F.coalesce(F.col("source"), F.lit("")) != "auction") & (F.coalesce(F.col("kind"), F.lit("")) != "plot"))


def area_stats(df: DataFrame, district: str = "district", price: str = "price", beds: str = "bedrooms", extra: list[Column] | None = None) -> DataFrame:
    """district, beds (null: all sizes), count, median and mean, from one aggregation with grouping sets.

    Rows need a district and a non-zero price; a null number of bedrooms counts for the district alone.
    """
    rows = df.where(F.col(district).isNotNull() & (F.col(district) != "") & (F.coalesce(F.col(price), F.lit(0)) != 0))
    base = rows.select(F.col(district).alias("district"), beds_bucket(F.col(beds)).alias("beds"), F.col(price).alias("price"), *(extra or []))
    names = [c for c in base.columns if c not in ("district", "beds", "price")]
    sets = base.groupingSets([[F.col("district")], [F.col("district"), F.col("beds")]], F.col("district"), F.col("beds"))
    out = sets.agg(
        F.grouping_id().alias("__g"),
        F.count(F.lit(1)).alias("count"),
        F.median("price").cast("int").alias("median"),
        F.avg("price").cast("int").alias("mean"),
        *[F.bround(F.avg(c), 5).alias(c) for c in names],
    )
    return out.where((F.col("__g") == 1) | F.col("beds").isNotNull()).select("district", F.when(F.col("__g") == 0, F.col("beds")).alias("beds"), "count", "median", "mean", *names)


def nested_by_beds(stats: DataFrame) -> DataFrame:
    """One row per district with by_beds, a map from size to (count, median), in district order."""
    whole = stats.where("beds is null").drop("beds")
    sizes = stats.where("beds is not null").groupBy("district").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("beds").cast("string").alias("key"), F.struct("count", "median").alias("value"))))).alias("by_beds"))
    empty = F.create_map().cast("map<string,struct<count:bigint,median:int>>")
    return whole.join(sizes, "district", "left").withColumn("by_beds", F.coalesce("by_beds", empty)).orderBy(*district_order("district"))


def compare(df: DataFrame, stats: DataFrame, district: str = "district", price: str = "price", beds: str = "bedrooms", skip: Column | None = None) -> DataFrame:
    """Add base, basis and vs_pct: against the median of district and size, or of the district where too few are alike.

    ``stats`` has a row per district and size: as many as there are districts, whatever the number of listings. The joins
    are left to the planner, which broadcasts it by its measured size.
    """
    key = F.when(F.coalesce(F.col(beds), F.lit(0)) != 0, beds_bucket(F.col(beds)))
    sized = stats.where("beds is not null").select(F.col("district").alias("__d"), F.col("beds").alias("__b"), F.col("count").alias("__n"), F.col("median").alias("__size_median"))
    whole = stats.where("beds is null").select(F.col("district").alias("__w"), F.col("median").alias("__median"))
    joined = df.withColumn("__key", key).join(whole, F.col(district) == F.col("__w"), "left").join(sized, (F.col(district) == F.col("__d")) & (F.col("__key") == F.col("__b")), "left")
    enough = F.coalesce(F.col("__n") >= MIN_COMPARABLES, F.lit(False))
    allowed = F.col("__median").isNotNull() if skip is None else F.col("__median").isNotNull() & ~skip
    base = F.when(allowed, F.when(enough, F.col("__size_median")).otherwise(F.col("__median")))
    basis = F.when(allowed, F.when(enough, F.concat(F.col("__key").cast("int").cast("string"), F.lit("-bed"))).otherwise("all"))
    return joined.withColumn("base", base).withColumn("basis", basis).withColumn("vs_pct", versus_percent(price, F.col("base"))).drop("__key", "__w", "__median", "__d", "__b", "__n", "__size_median")


def exact_medians(df: DataFrame, column: str, keys: list[str] | None = None, at_once: int = 100_000) -> DataFrame:
    """The keys, n and the exact median of the non-null values of each group, however large it is.

    A sketch brackets the two middle ranks of each group, one pass counts what lies below and within, and the next bracket lies
    within that, until no bracket holds more than ``at_once`` different values; those, with their counts, are put in order. A
    bracket that misses is widened on that side to the last one. No task holds a group.
    """
    keys = keys or []
    value = F.col(column).cast("double")
    rows = df.where(value.isNotNull()).select(*keys, value.alias("v"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    both = lambda a, b: reduce(lambda x, y: x & y, same(a, b), F.lit(True))
    # lo and hi: all of a group lies below them, within [lo, hi] or above; below: how many lie below.
    whole = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    now = materialise(whole.withColumn("below", F.lit(0).cast("long")), "medians")
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)

    def inside() -> DataFrame:
        return rows.alias("a").join(now.alias("b"), both("a", "b") & F.col("v").between(F.col("lo"), F.col("hi"))).select(*[F.col(f"a.{k}").alias(k) for k in keys], "v", "n", "lo", "hi", "below")

    while True:
        sketch = inside().groupBy(*keys, "n", "lo", "hi", "below").agg(F.approx_count_distinct("v").alias("different"), F.count(F.lit(1)).alias("within"), F.percentile_approx("v", [q / 100 for q in range(101)], 1000).alias("hundredths"))
        sketch = materialise(sketch, "medians-sketch")
        if sketch.where(F.col("different") > at_once).isEmpty():
            break
        near = lambda rank, more: F.get("hundredths", F.greatest(F.lit(0), F.least(F.lit(100), (F.floor(100 * (rank - F.col("below")) / F.col("within")) + more).cast("int"))))
        many = F.col("different") > at_once
        tight = sketch.select(*keys, "n", "lo", "hi", "below", F.when(many, near(first, -2)).otherwise(F.col("lo")).alias("a"), F.when(many, near(second, 3)).otherwise(F.col("hi")).alias("b"))
        joined = rows.alias("a").join(tight.alias("b"), both("a", "b")).select(*[F.col(f"a.{k}").alias(k) for k in keys], "v", "n", "lo", "hi", F.col("b.a").alias("x"), F.col("b.b").alias("y"))
        passed = joined.groupBy(*keys, "n", "lo", "hi", "x", "y").agg(F.count_if(F.col("v") < F.col("x")).alias("under"), F.count_if(F.col("v") <= F.col("y")).alias("upto"), F.count_if(F.col("v") < F.col("lo")).alias("were"))
        low, high = F.col("under") <= first, F.col("upto") > second
        after = passed.select(*keys, "n", F.when(low, F.col("x")).otherwise(F.col("lo")).alias("lo"), F.when(high, F.col("y")).otherwise(F.col("hi")).alias("hi"), F.when(low, F.col("under")).otherwise(F.col("were")).alias("below"))
        now = materialise(after, "medians")
        discard(sketch)
    counted = inside().groupBy(*keys, "n", "below", "v").agg(F.count(F.lit(1)).alias("times"))
    w = Window.partitionBy(*keys).orderBy("v")  # at most ``at_once`` values
    upto = counted.withColumn("upto", F.col("below") + F.sum("times").over(w))
    middle = upto.groupBy(*keys, "n").agg(F.min(F.when(F.col("upto") > first, F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > second, F.col("v"))).alias("b"))
    return middle.select(*keys, "n", ((F.col("a") + F.col("b")) / 2).alias("median"))


def global_median(df: DataFrame, column: str) -> DataFrame:
    """One row: the median, 0 of nothing."""
    return exact_medians(df, column).agg(F.coalesce(F.max("median"), F.lit(0.0)).alias("median"))


def facet_counts(df: DataFrame, *columns: str) -> DataFrame:
    """value, n over one or several columns: a row with one value in both counts twice."""
    return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")).where("value is not null and value <> ''").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def facet_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("value")).where("value is not null and value <> ''").distinct().orderBy("value")


def last_score(df: DataFrame, pairs: list[tuple[str, str]], order: str) -> DataFrame:
    """name, score: the score of the last row (by ``order``) that has one for the name, over (name, score) column pairs."""
    long = df.select(F.col(order).alias("__o"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(n).alias("name"), F.col(s).cast("double").alias("score")) for i, (n, s) in enumerate(pairs)])).alias("p"))
    return long.where("p.name is not null and p.score is not null").groupBy(F.col("p.name").alias("name")).agg(F.max_by("p.score", F.struct("__o", "p.i")).alias("score"))


def reason_histogram(df: DataFrame, reason: str = "excluded") -> DataFrame:
    """Counts of exclusion reasons, all districts one reason."""
    return df.where(F.col(reason).isNotNull()).select(F.when(F.col(reason).startswith("district"), "district").otherwise(F.col(reason)).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def match_rates(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def bar_share(df: DataFrame, value: str) -> DataFrame:
    """Add bar_pct, the value as a percentage of the largest (1 at least). Meant for a result table of groups."""
    top = df.agg(F.greatest(F.max(value), F.lit(1)).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn("bar_pct", 100 * F.col(value) / F.col("__top")).drop("__top")


def areas_table(stats: DataFrame, min_beds: int = 0) -> DataFrame:
    """Districts by median, dearest first, of all sizes or of one."""
    beds = min(min_beds, 5)
    chosen = stats.where(F.col("beds") == beds) if beds else stats.where("beds is null")
    return bar_share(chosen.select("district", "count", "median"), "median").orderBy(F.desc("median"), "district")


# The order in which regions are shown.
REGION_ORDER = ("Edinburgh", "Midlothian", "East Lothian", "West Lothian", "Fife")


def region_order(column: str) -> list[Column]:
    place = F.array_position(F.array(*map(F.lit, REGION_ORDER)), F.col(column))
    return [F.when(place > 0, place).otherwise(len(REGION_ORDER) + 1), F.col(column)]


def newest_per_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the greatest by ``order`` (nulls lowest): an aggregation with map-side combine, no window."""
    fields = [c for c in df.columns if c not in (key, *order)]
    best = df.groupBy(key).agg(F.max(F.struct(*order, *fields)).alias("__best"))
    return best.select(key, *[F.col(f"__best.{c}").alias(c) for c in (*order, *fields)])


def clusters(df: DataFrame, lat: str = "lat", lng: str = "lng", cell: float = 0.01) -> DataFrame:
    """Points per grid cell, with their mean position."""
    cy, cx = F.floor(F.col(lat) / cell), F.floor(F.col(lng) / cell)
    return df.groupBy(cy.alias("cy"), cx.alias("cx")).agg(F.count(F.lit(1)).alias("n"), F.avg(lat).alias("lat"), F.avg(lng).alias("lng"))


def same_spot(df: DataFrame, lat: str = "lat", lng: str = "lng", digits: int = 5) -> DataFrame:
    """Homes at one spot, cheapest first: for a picker. Only spots with more than one."""
    return df.groupBy(F.bround(lat, digits).alias("lat"), F.bround(lng, digits).alias("lng")).agg(F.sort_array(F.collect_list(F.struct("price", "id"))).alias("homes")).where(F.size("homes") > 1)


def with_gap(df: DataFrame, partition: str, order: list[str], value: str) -> DataFrame:
    """Add the previous value in order and whether it changed (the first one did)."""
    w = Window.partitionBy(partition).orderBy(*order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("changed", ~F.coalesce(F.col("previous") == F.col(value), F.lit(False)))
