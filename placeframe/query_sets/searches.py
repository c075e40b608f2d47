"""Faceted search, its orders and its codec, over listings made of the parts.

The columns of a listing are expressions that both SQL dialects read alike; each query's SQL states its own condition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeframe.operators import search, stats
from placeframe.registry import literal, query, table

NOW = "2026-03-01 12:00:00"
#: name: expression over k (the part's key), n (its size) and price.
COLUMNS = {
    "id": "CAST(k AS STRING)",
    "ord": "CAST(k AS INT)",
    "price": "CAST(100000 + (k * 37) % 900 * 1000 AS INT)",
    "bedrooms": "CASE WHEN k % 11 <> 0 THEN CAST(n % 7 AS INT) END",
    "bathrooms": "CASE WHEN k % 5 <> 0 THEN CAST(n % 4 AS INT) END",
    "floor_area_m2": "CASE WHEN k % 4 <> 0 THEN CAST(40 + n * 3 AS INT) END",
    "property_type": "CASE k % 6 WHEN 0 THEN 'Semi-detached' WHEN 1 THEN 'Detached villa' WHEN 2 THEN 'End-terrace' WHEN 3 THEN 'bungalow' WHEN 4 THEN 'villa' END",
    "detached": "k % 12 = 4",
    "garage": "CASE WHEN k % 3 <> 0 THEN k % 3 = 1 END",
    "best_min": "CASE WHEN k % 10 <> 0 THEN CAST(n + 5 AS INT) END",
    "top_school_rank": "CASE WHEN k % 4 <> 1 THEN CAST(k % 4 AS INT) END",
    "catchment": "CASE WHEN k % 5 <> 4 THEN CONCAT('School ', CAST(k % 5 AS STRING)) END",
    "catchment_rc": "CASE WHEN k % 3 = 0 THEN CONCAT('School ', CAST(k % 7 AS STRING)) END",
    "top_primary": "CASE WHEN k % 3 <> 2 THEN k % 3 = 0 END",
    "primary_name": "CASE WHEN k % 6 <> 5 THEN CONCAT('Primary ', CAST(k % 6 AS STRING)) END",
    "primary_rc": "CASE WHEN k % 4 = 0 THEN CONCAT('Primary ', CAST(k % 9 AS STRING)) END",
    "region": "CASE k % 4 WHEN 0 THEN 'Edinburgh' WHEN 1 THEN 'Fife' WHEN 2 THEN 'Midlothian' END",
    "decile": "CASE WHEN k % 9 <> 0 THEN CAST(1 + n % 10 AS INT) END",
    "address": "CONCAT(CAST(n AS STRING), CASE WHEN k % 2 = 0 THEN ' High Street' ELSE ' Mill Lane' END)",
    "title": "CASE WHEN k % 5 = 0 THEN 'House near the Mill' END",
    "postcode": "CONCAT('EH', CAST(k % 17 AS STRING), ' 1AB')",
    "first_seen": "CASE WHEN k % 13 <> 0 THEN CAST('2026-02-15' AS DATE) + CAST(n % 14 AS INT) END",
    "kind": "CASE WHEN k % 8 = 0 THEN 'plot' END",
    "source": "CASE WHEN k % 7 = 0 THEN 'auction' END",
    "n_also": "CAST(k % 6 AS INT)",
    "motivated": "k % 5 = 1",
    "needs_work": "k % 4 = 2",
    "closing_date": "CASE WHEN k % 6 = 0 THEN CAST('2026-03-05' AS DATE) + CAST(n % 20 AS INT) END",
    "auction_date": "CASE WHEN k % 7 = 0 THEN CAST('2026-03-01' AS DATE) + CAST(n % 30 AS INT) END",
    "last_price": "CAST(100000 + (k * 37) % 900 * 1000 AS INT)",
    "earlier_price": "CASE WHEN k % 3 <> 1 THEN CAST(100000 + (k * 41) % 900 * 1000 AS INT) END",
    "vs_pct": "CASE WHEN k % 6 <> 0 THEN CAST(n - 25 AS INT) END",
}
_FROM = "(SELECT p_partkey AS k, p_size AS n FROM part)"
LISTINGS = "l AS (SELECT " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in COLUMNS.items()) + f" FROM {_FROM} p)"


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size AS n")
    df = p.selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()]).withColumnRenamed("primary_name", "primary")
    point = lambda c: F.struct(F.lit("2025-01-01").cast("date").alias("date"), F.col(c).alias("price"))
    return df.withColumns({
        "travel": F.struct("best_min"), "simd": F.struct("decile"), "area": F.struct("vs_pct"), "auction": F.when(F.col("auction_date").isNotNull(), F.struct(F.col("auction_date").alias("date"))),
        "also_auction": F.when(F.col("n_also") > 3, F.array(F.struct(F.date_add(F.lit("2026-04-01").cast("date"), F.col("n_also")).alias("date")))),
        "flags": F.when(F.col("motivated") | F.col("needs_work"), F.array_compact(F.array(F.when(F.col("motivated"), "motivated"), F.when(F.col("needs_work"), "needs_work")))),
        "price_history": F.when(F.col("earlier_price").isNotNull(), F.array(point("earlier_price"), point("last_price"))).otherwise(F.array(point("last_price"))),
    })


#: name: hash and condition.
FILTERS = {
    "filter_beds": ("minBeds=1&maxBeds=3&show=all", "coalesce(bedrooms, 0) >= 1 AND coalesce(bedrooms, 0) <= 3"),
    "filter_max_beds": ("maxBeds=2&show=all", "coalesce(bedrooms, 0) <= 2"),
    "filter_baths_and_area": ("minBaths=2&minArea=100&show=all", "bathrooms >= 2 AND floor_area_m2 >= 100"),
    "filter_types": ("types=detached,cottage&show=all", "CASE WHEN property_type = 'Semi-detached' THEN 'semi' WHEN property_type = 'Detached villa' OR detached THEN 'detached' WHEN property_type = 'End-terrace' THEN 'terraced' WHEN property_type = 'bungalow' THEN 'cottage' ELSE 'other' END IN ('detached', 'cottage')"),
    "filter_old_detached": ("detached=1&show=all", "property_type = 'Detached villa' OR (detached AND property_type IS DISTINCT FROM 'Semi-detached')"),
    "filter_garage": ("garage=1&show=all", "garage IS TRUE"),
    "filter_minutes": ("maxMins=30&show=all", "best_min <= 30"),
    "filter_top_school": ("topSchool=1&show=all", "coalesce(top_school_rank, 0) <> 0"),
    "filter_school": ("school=School+1,School+6&show=all", "coalesce(catchment, '') IN ('School 1', 'School 6') OR coalesce(catchment_rc, '') IN ('School 1', 'School 6')"),
    "filter_top_primary": ("topPrimary=1&show=all", "top_primary IS TRUE"),
    "filter_primary": ("primary=Primary+2,Primary+8&show=all", "coalesce(primary_name, '') IN ('Primary 2', 'Primary 8') OR coalesce(primary_rc, '') IN ('Primary 2', 'Primary 8')"),
    "filter_region": ("region=Fife,Midlothian&show=all", "region IN ('Fife', 'Midlothian')"),
    "filter_decile": ("minSimd=7&show=all", "coalesce(decile, 0) >= 7"),
    "filter_words": ("q=MILL,+lane&show=all", "contains(lower(concat_ws(' ', address, coalesce(title, ''), postcode)), 'mill') AND contains(lower(concat_ws(' ', address, coalesce(title, ''), postcode)), 'lane')"),
    "filter_new": ("newOnly=1&show=all", f"epoch(TIMESTAMP '{NOW}') - epoch(first_seen::TIMESTAMP) < 604800"),
    "filter_homes": ("", "kind IS NULL"),
    "filter_plots": ("show=plots", "kind = 'plot'"),
    "filter_auction": ("saleType=auction&show=all", "source = 'auction' OR n_also > 3"),
    "filter_private": ("saleType=private&show=all", "source IS NULL"),
    "filter_motivated": ("motivated=1&show=all", "motivated"),
    "filter_needs_work": ("needsWork=1&show=all", "needs_work"),
    "filter_closing_date": ("closingDate=1&show=all", "closing_date IS NOT NULL"),
    "filter_reduced": ("reduced=1&show=all", "earlier_price IS NOT NULL AND last_price < earlier_price"),
    "filter_together": ("minPrice=200000&maxPrice=700000&minBeds=2&region=Edinburgh&garage=1", "price >= 200000 AND price <= 700000 AND coalesce(bedrooms, 0) >= 2 AND region = 'Edinburgh' AND garage IS TRUE AND kind IS NULL"),
    "filter_bad_numbers": ("minPrice=abc&minBeds=NaN&unknown=1&show=all", "true"),
}
for _name, (_hash, _where) in FILTERS.items():
    query(f"WITH {LISTINGS} SELECT id FROM l WHERE {_where}", _name)(lambda spark, sf_dir, h=_hash: search.search(listings(spark, sf_dir), search.FilterSpec.from_hash(h), F.lit(NOW).cast("timestamp"), limit=None).select("id"))

#: mode: sort key.
ORDERS = {
    "price_asc": "price", "price_desc": "price DESC", "time": "best_min NULLS LAST", "newest": "first_seen DESC NULLS LAST",
    "soonest": "coalesce(auction_date, closing_date, CASE WHEN n_also > 3 THEN DATE '2026-04-01' + n_also END) NULLS LAST",
    "value": "coalesce(vs_pct, 0)", "ppsqm": "floor(price / floor_area_m2::DOUBLE + 0.5) NULLS LAST",
}
for _mode, _key in ORDERS.items():
    query(f"WITH {LISTINGS} SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY {_key}, ord) - 1 AS place FROM l) WHERE place < 400", f"sort_{_mode}")(
        lambda spark, sf_dir, m=_mode: search.search(listings(spark, sf_dir), search.FilterSpec(show="all", sort=m), F.lit(NOW).cast("timestamp")).select("id", F.monotonically_increasing_id().alias("place"))
    )


@query(f"WITH {LISTINGS} SELECT id FROM l WHERE ord % 3 = 0 AND kind IS NULL")
def filter_saved_list(spark, sf_dir):
    df = listings(spark, sf_dir)
    saved = df.select(F.when(F.col("ord") % 3 == 0, "Shortlist").otherwise("Rejected").alias("list"), "id")
    return search.search(df, search.FilterSpec(list="Shortlist"), F.lit(NOW).cast("timestamp"), saved.unionByName(saved), limit=None).select("id")


@query(f"WITH {LISTINGS} SELECT id FROM l WHERE ord % 3 <> 0 AND kind IS NULL")
def filter_hide_rejected(spark, sf_dir):
    df = listings(spark, sf_dir)
    saved = df.where("ord % 3 = 0").select(F.lit("Rejected").alias("list"), "id")
    return search.search(df, search.FilterSpec(), F.lit(NOW).cast("timestamp"), saved, limit=None).select("id")


@query(f"WITH {LISTINGS} SELECT id FROM l WHERE id = '42'")
def home_by_id(spark, sf_dir):
    return search.by_id(listings(spark, sf_dir), "42").select("id")


_SPECS = [
    ("", "", 0), ("minPrice=250000&types=semi,detached&q=main+st", "minPrice=250000&types=semi%2Cdetached&q=main+st", 3), ("hideRejected=0&sort=newest&show=plots", "hideRejected=0&show=plots&sort=newest", 1),
    ("layers=none", "layers=none", 0), ("layers=tram,rail,tramProposed,catchTop", "", 0), ("garage=1&detached=1&reduced=1&minBeds=x", "types=detached&garage=1&reduced=1", 3), ("maxMins=45&layers=bus,simd", "maxMins=45&layers=bus%2Csimd", 1),
]


@query(literal({"given": "VARCHAR", "hash": "VARCHAR", "active": "INT", "again": "BOOLEAN"}, [(g, h, n, True) for g, h, n in _SPECS]))
def filter_codec(spark, sf_dir):
    specs = [(g, search.FilterSpec.from_hash(g)) for g, _, _ in _SPECS]
    rows = [(g, s.to_hash(), s.active_count(), search.FilterSpec.from_hash("#" + s.to_hash()) == s) for g, s in specs]
    return spark.createDataFrame(rows, "given string, hash string, active int, again boolean")


@query(literal({"list": "VARCHAR", "value": "VARCHAR", "out": "VARCHAR", "n": "INT"}, [("a,b", "a", "b", 2), ("", "x", "x", 0), ("a,,b", "c", "a,b,c", 2), ("x", "x", "", 1)]))
def multi_values(spark, sf_dir):
    rows = [(s, v, search.toggle_in(s, v), len(search.list_of(s))) for s, v in (("a,b", "a"), ("", "x"), ("a,,b", "c"), ("x", "x"))]
    return spark.createDataFrame(rows, "list string, value string, out string, n int")


# ---------------------------------------------------------------- statistics over the same listings


@query(f"WITH {LISTINGS} SELECT region AS value, count(*) AS n FROM l WHERE region IS NOT NULL GROUP BY region")
def facet_by_region(spark, sf_dir):
    return stats.facet_counts(listings(spark, sf_dir), "region")


@query(f"WITH {LISTINGS} SELECT value, count(*) AS n FROM (SELECT catchment AS value FROM l UNION ALL SELECT catchment_rc FROM l) WHERE value IS NOT NULL GROUP BY value")
def facet_by_school(spark, sf_dir):
    return stats.facet_counts(listings(spark, sf_dir), "catchment", "catchment_rc")


@query(f"WITH {LISTINGS} SELECT value, count(*) AS n FROM (SELECT primary_name AS value FROM l UNION ALL SELECT primary_rc FROM l) WHERE value IS NOT NULL GROUP BY value")
def facet_by_primary(spark, sf_dir):
    return stats.facet_counts(listings(spark, sf_dir), "primary", "primary_rc")


@query(f"WITH {LISTINGS}, s AS (SELECT ord, 0 AS i, primary_name AS name, n_also + 0.5 AS score FROM l UNION ALL SELECT ord, 1, primary_rc, n_also + 1.5 FROM l), b AS (SELECT name, arg_max(score, (ord, i))::DOUBLE AS score FROM s WHERE name IS NOT NULL GROUP BY name) SELECT name, score, row_number() OVER (ORDER BY score DESC, name) - 1 AS place FROM b")
def last_score_by_primary(spark, sf_dir):
    df = listings(spark, sf_dir).withColumns({"a": F.col("n_also") + 0.5, "b": F.col("n_also") + 1.5})
    best = stats.last_score(df, [("primary", "a"), ("primary_rc", "b")], "ord")
    return best.orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "name").coalesce(1).select("name", "score", F.monotonically_increasing_id().alias("place"))


@query(f"WITH {LISTINGS}, c AS (SELECT postcode AS district, least(bedrooms, 5) AS beds, price FROM l WHERE source IS NULL AND kind IS NULL) SELECT district, count(*) AS count, trunc(median(price))::INT AS median FROM c GROUP BY district")
def comparable_homes(spark, sf_dir):
    df = stats.comparable(listings(spark, sf_dir)).withColumnRenamed("postcode", "district")
    return stats.area_stats(df).where("beds is null").select("district", "count", "median")


@query(f"WITH {LISTINGS}, a AS (SELECT split_part(postcode, ' ', 1) AS district, count(*) AS count, trunc(median(price))::INT AS median FROM l GROUP BY 1) SELECT district, count, median, 100 * median / greatest(max(median) OVER (), 1)::DOUBLE AS bar_pct, row_number() OVER (ORDER BY median DESC, district) - 1 AS place FROM a")
def areas_by_median(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("district", F.split("postcode", " ")[0])
    return stats.areas_table(stats.area_stats(df)).coalesce(1).select("district", "count", "median", "bar_pct", F.monotonically_increasing_id().alias("place"))


@query(f"WITH {LISTINGS} SELECT split_part(postcode, ' ', 1) AS district, count(*) AS count, trunc(median(price))::INT AS median FROM l WHERE bedrooms >= 5 GROUP BY 1")
def areas_of_large_homes(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("district", F.split("postcode", " ")[0])
    return stats.areas_table(stats.area_stats(df), min_beds=7).select("district", "count", "median")


@query(f"WITH {LISTINGS} SELECT district, beds, count, median FROM (SELECT split_part(postcode, ' ', 1) AS district, least(bedrooms, 5)::VARCHAR AS beds, count(*) AS count, trunc(median(price))::INT AS median FROM l WHERE bedrooms IS NOT NULL GROUP BY ALL)")
def nested_area_stats(spark, sf_dir):
    df = listings(spark, sf_dir).withColumn("district", F.split("postcode", " ")[0])
    nested = stats.nested_by_beds(stats.area_stats(df))
    return nested.select("district", F.explode("by_beds").alias("beds", "v")).select("district", "beds", "v.count", "v.median")


@query(f"WITH {LISTINGS} SELECT count(*) AS total, count(*) FILTER (bathrooms IS NOT NULL) AS baths, count(*) FILTER (floor_area_m2 IS NOT NULL) AS area FROM l")
def match_rates(spark, sf_dir):
    return stats.match_rates(listings(spark, sf_dir), baths=F.col("bathrooms").isNotNull(), area=F.col("floor_area_m2").isNotNull())


_REGIONS = ("Borders", "Fife", "Angus", "Edinburgh", "West Lothian", "Midlothian", "East Lothian")


@query(f"WITH r AS (SELECT {list(_REGIONS)}[c_nationkey % 7 + 1] AS region, count(*) AS n FROM customer GROUP BY 1) SELECT region, n, row_number() OVER (ORDER BY CASE region WHEN 'Edinburgh' THEN 1 WHEN 'Midlothian' THEN 2 WHEN 'East Lothian' THEN 3 WHEN 'West Lothian' THEN 4 WHEN 'Fife' THEN 5 ELSE 6 END, region)::INT AS place FROM r")
def region_sort(spark, sf_dir):
    region = F.get(F.array(*map(F.lit, _REGIONS)), F.col("c_nationkey") % 7)
    n = table(spark, sf_dir, "customer").groupBy(region.alias("region")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(*stats.region_order("region"))))  # seven regions


@query(f"WITH {LISTINGS}, p AS (SELECT id, price, round_even(55.9 + (ord % 50) / 1000.0, 5) AS lat, round_even(-3.2 + (ord % 7) / 1000.0, 5) AS lng FROM l) SELECT id, price, place FROM (SELECT id, price, row_number() OVER (PARTITION BY lat, lng ORDER BY price, id) - 1 AS place, count(*) OVER (PARTITION BY lat, lng) AS m FROM p) WHERE m > 1")
def homes_at_one_spot(spark, sf_dir):
    df = listings(spark, sf_dir).withColumns({"lat": 55.9 + (F.col("ord") % 50) / 1000.0, "lng": -3.2 + (F.col("ord") % 7) / 1000.0})
    return stats.same_spot(df).select(F.posexplode("homes").alias("place", "h")).select("h.id", "h.price", F.col("place").cast("long").alias("place"))
