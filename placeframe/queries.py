"""Queries over the driver's tables that exercise the operators, each with DuckDB SQL where SQL can express it.

Stand-ins: a listing is a part (its brand the district, its size the number of bedrooms, its retail price the price); price
histories are the events of a user; positions are computed from keys by whole-number arithmetic inside the map area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.functions import numeric as N
from placeframe.functions import text as X
from placeframe.operators import search, spatial, state, stats
from placeframe.registry import QUERIES, SQL, query, table  # noqa: F401


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("district"), F.expr("p_size div 10").cast("int").alias("bedrooms"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("property_type"), F.col("p_name").alias("title"))


_PARTS = "p AS (SELECT p_partkey AS id, p_brand AS district, (p_size // 10)::INT AS bedrooms, p_retailprice AS price, p_type AS property_type, p_name AS title FROM part)"
_STATS = f"{_PARTS}, d AS (SELECT district, count(*) AS n, trunc(median(price))::INT AS med, trunc(avg(price))::INT AS mean FROM p GROUP BY district), b AS (SELECT district, least(bedrooms, 5) AS beds, count(*) AS n, trunc(median(price))::INT AS med FROM p GROUP BY ALL)"
_COMPARED = f"{_STATS}, c AS (SELECT p.id, p.district, p.bedrooms, p.price, CASE WHEN b.n >= 3 THEN b.med ELSE d.med END AS base, CASE WHEN b.n >= 3 THEN least(p.bedrooms, 5)::VARCHAR || '-bed' ELSE 'all' END AS basis FROM p JOIN d USING (district) LEFT JOIN b ON b.district = p.district AND p.bedrooms <> 0 AND b.beds = least(p.bedrooms, 5)), v AS (SELECT *, round_even(100 * (price - base) / base, 0)::INT AS vs_pct FROM c)"


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = parts(spark, sf_dir)
    return stats.compare(df, stats.area_stats(df))


@query(f"WITH {_STATS} SELECT district, n AS count, med AS median, mean FROM d")
def area_stats(spark, sf_dir):
    return stats.area_stats(parts(spark, sf_dir)).where("beds is null").select("district", "count", "median", "mean")


@query(f"WITH {_STATS} SELECT district, beds, n AS count, med AS median FROM b")
def area_by_beds(spark, sf_dir):
    return stats.area_stats(parts(spark, sf_dir)).where("beds is not null").select("district", "beds", "count", "median")


@query(f"WITH {_COMPARED} SELECT id, base, basis, vs_pct FROM v")
def vs_area_pct(spark, sf_dir):
    return _compared(spark, sf_dir).select("id", "base", "basis", "vs_pct")


@query(f"WITH {_COMPARED} SELECT id, district, bedrooms, price, base, vs_pct FROM v ORDER BY vs_pct, id LIMIT 400")
def cheapest_vs_area(spark, sf_dir):
    return _compared(spark, sf_dir).select("id", "district", "bedrooms", "price", "base", "vs_pct").orderBy("vs_pct", "id").limit(400)


@query("SELECT p_partkey AS id, p_retailprice AS price FROM part WHERE p_retailprice >= 950 AND p_retailprice <= 1800 AND p_size // 10 >= 2 AND p_size // 10 <= 4 AND p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 5)")
def faceted_search(spark, sf_dir):
    spec = search.FilterSpec.from_hash("minPrice=950&maxPrice=1800&minBeds=2&maxBeds=4&show=all")
    brands = parts(spark, sf_dir).select("district").distinct().orderBy("district").limit(5)
    return parts(spark, sf_dir).where(search.predicate(spec, F.lit(None).cast("timestamp"))).join(brands, "district", "left_semi").select("id", "price")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion') AND contains(lower(text), 'ing')")
def text_search_all_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(search.contains_all(F.col("text"), "THE, tion ing")).select("doc_id")


@query("SELECT value, count(*) AS n FROM (SELECT l_returnflag AS value FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem) GROUP BY value")
def facet_counts_two_columns(spark, sf_dir):
    return stats.facet_counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT DISTINCT value FROM (SELECT l_returnflag AS value FROM lineitem UNION ALL SELECT l_linestatus FROM lineitem) WHERE value IS NOT NULL AND value <> ''")
def distinct_two_columns(spark, sf_dir):
    return stats.facet_values(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT coalesce(median(o_totalprice), 0.0)::DOUBLE AS median FROM orders")
def global_median(spark, sf_dir):
    return stats.global_median(table(spark, sf_dir, "orders"), "o_totalprice")


_SERIES = "s AS (SELECT user_id, ts, event_id, floor(value)::BIGINT AS price, lag(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)"


def _series(spark, sf_dir):
    return stats.with_gap(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.floor("value").alias("price")), "user_id", ["ts", "event_id"], "price")


@query(f"WITH {_SERIES} SELECT user_id, event_id, price FROM s WHERE previous IS NULL OR previous <> price")
def price_history_changes(spark, sf_dir):
    return _series(spark, sf_dir).where("changed").select("user_id", "event_id", "price")


@query(f"WITH {_SERIES} SELECT user_id, event_id, price, previous FROM s WHERE price < previous")
def price_reduced(spark, sf_dir):
    return _series(spark, sf_dir).where(F.col("price") < F.col("previous")).select("user_id", "event_id", "price", "previous")


@query("SELECT user_id, (max(CASE WHEN rn = 1 THEN price END) < max(CASE WHEN rn = 2 THEN price END)) IS TRUE AS reduced FROM (SELECT user_id, floor(value)::INT AS price, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY user_id")
def price_reduced_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.floor("value").cast("int").alias("price")))).alias("price_history"))
    return e.select("user_id", search.is_reduced().alias("reduced"))


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-20 12:00:00') - epoch(date_trunc('day', ts)) < 604800")
def new_within_7_days(spark, sf_dir):
    return table(spark, sf_dir, "events").where(search.is_new(F.date_trunc("day", F.col("ts")), F.lit("2024-01-20 12:00:00").cast("timestamp"))).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F') AND (o_orderdate::DATE < DATE '1998-01-01' - 7) ORDER BY o_orderkey LIMIT 1500")
def staleness_todo(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    known = o.select(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "F", "flat").alias("excluded"), F.lit(True).alias("plot_parsed"), F.col("o_orderdate").cast("date").alias("fetched"), F.lit(4).alias("parser_version"))
    found = o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("https://example.org/x").alias("url"), F.lit("").alias("hint"), F.col("o_orderkey").alias("ord"))
    return state.todo(found, known, F.lit("1998-01-01").cast("date")).select(F.col("ord").alias("o_orderkey"))


@query("WITH o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice)::INT AS price, o_orderstatus, o_orderkey % 2 AS half FROM orders), s AS (SELECT o_custkey, arg_max(price, o_orderkey) AS price, arg_max(o_orderstatus, o_orderkey) AS status FROM o WHERE half = 0 GROUP BY 1), f AS (SELECT o_custkey, arg_max(price, o_orderkey) AS price, arg_max(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, o_orderkey) AS status FROM o WHERE half = 1 GROUP BY 1) SELECT coalesce(s.o_custkey, f.o_custkey)::VARCHAR AS id, coalesce(f.price, s.price) AS price, coalesce(nullif(f.status, ''), s.status) AS status, (CASE WHEN s.price IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN f.price IS NOT NULL AND f.price <> 0 AND f.price IS DISTINCT FROM s.price THEN 1 ELSE 0 END)::INT AS n_history FROM s FULL OUTER JOIN f ON s.o_custkey = f.o_custkey")
def state_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderkey", F.floor("o_totalprice").cast("int").alias("price"), F.col("o_orderstatus").alias("status"))
    newest = lambda df: stats.newest_per_key(df, "id", "o_orderkey").drop("o_orderkey")
    even = newest(o.where("o_orderkey % 2 = 0"))
    old = even.withColumns({"price_history": F.array(F.struct(F.lit("2024-01-01").cast("date").alias("date"), F.col("price"))), "first_seen": F.lit("2024-01-01").cast("date"), "fetched": F.lit("2024-01-01").cast("date")})
    new = newest(o.where("o_orderkey % 2 = 1")).withColumn("status", F.when(F.col("status") == "P", "").otherwise(F.col("status")))
    out = state.upsert(old, new, F.lit("2024-01-02"))
    return out.select("id", "price", "status", F.size("price_history").alias("n_history"))


@query("SELECT p_partkey AS id, CASE WHEN p_type LIKE '%STANDARD%' THEN 'flat' WHEN p_size // 10 < 2 THEN (p_size // 10)::VARCHAR || ' bedroom' WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'district ' || p_brand END AS reason FROM part")
def lifecycle_reason(spark, sf_dir):
    from placeframe.config import Rules

    p = parts(spark, sf_dir)
    kind = F.when(F.col("property_type").contains("STANDARD"), "flat").otherwise("house")
    reason = X.rejection(F.lit(""), kind, "bedrooms", "district", rules=Rules(districts=("Brand#11", "Brand#12", "Brand#13")))
    return p.select("id", reason.alias("reason"))


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN p_size // 10 < 2 THEN (p_size // 10)::VARCHAR || ' bedroom' WHEN p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13') THEN 'district' END AS reason FROM part) WHERE reason IS NOT NULL GROUP BY reason")
def reason_histogram(spark, sf_dir):
    from placeframe.config import Rules

    reason = X.rejection(F.lit(""), F.lit("house"), "bedrooms", "district", rules=Rules(districts=("Brand#11", "Brand#12", "Brand#13")))
    return stats.reason_histogram(parts(spark, sf_dir).withColumn("excluded", reason))


def _points(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.select(k, (55.80 + F.pmod(k * 7919, F.lit(2800)) / 10_000.0).alias("lat"), (-3.66 + F.pmod(k * 104_729, F.lit(11_800)) / 10_000.0).alias("lng"))


def _points_sql(tab: str, key: str) -> str:
    return f"(SELECT {key}, 55.80 + (({key} * 7919) % 2800)::DOUBLE / 10000.0 AS lat, -3.66 + (({key} * 104729) % 11800)::DOUBLE / 10000.0 AS lng FROM {tab})"


_HAVERSINE = "2 * 6371000.0 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lng) - radians(a.lng)) / 2), 2)))"
_PAIRS = f"pairs AS (SELECT a.c_custkey, b.s_suppkey, {_HAVERSINE} AS m FROM {_points_sql('customer', 'c_custkey')} a, {_points_sql('supplier', 's_suppkey')} b)"


@query(f"WITH {_PAIRS} SELECT c_custkey, s_suppkey, round(m, 3) AS metres FROM pairs WHERE m <= 1200")
def distance_band_join(spark, sf_dir):
    c, s = _points(table(spark, sf_dir, "customer"), "c_custkey"), _points(table(spark, sf_dir, "supplier"), "s_suppkey")
    s = s.withColumnsRenamed({"lat": "slat", "lng": "slng"})
    return spatial.within(c, s, 1200, right_at=("slat", "slng")).select("c_custkey", "s_suppkey", F.round("distance_m", 3).alias("metres"))


@query(f"WITH {_PAIRS} SELECT c_custkey, arg_min(s_suppkey, (m, s_suppkey)) AS s_suppkey, round(min(m), 3) AS metres FROM pairs WHERE m <= 2500 GROUP BY c_custkey")
def haversine_nearest(spark, sf_dir):
    c, s = _points(table(spark, sf_dir, "customer"), "c_custkey"), _points(table(spark, sf_dir, "supplier"), "s_suppkey")
    s = s.withColumnsRenamed({"lat": "slat", "lng": "slng"})
    best = spatial.nearest(c, s, "c_custkey", ["s_suppkey"], 2500, right_at=("slat", "slng"))
    return best.select("c_custkey", "nearest.s_suppkey", F.round("nearest.distance_m", 3).alias("metres"))


def _squares(spark: SparkSession) -> DataFrame:
    """Rectangles over part of the map area, one with a hole; neighbours overlap."""
    def ring(w, s, e, n):
        return [(w, s), (e, s), (e, n), (w, n), (w, s)]

    rows = [(i, f"School {i}", "RC" if i % 3 == 0 else "ND", i if i % 2 else None, ["", "P1-P4", "P5-P7"][i % 3], [[ring(-3.60 + 0.1 * i, 55.83, -3.455 + 0.1 * i, 55.99)]]) for i in range(8)]
    rows.append((8, "School 8", "ND", None, "", [[ring(-3.5, 55.9, -3.0, 56.05), ring(-3.4, 55.95, -3.2, 56.0)]]))
    return spark.createDataFrame(rows, "feature_id int, school string, sector string, top_rank int, stages string, polys array<array<array<struct<x:double,y:double>>>>")


_BOXES = "boxes AS (SELECT i::INT AS feature_id, 'School ' || i AS school, CASE WHEN i % 3 = 0 THEN 'RC' ELSE 'ND' END AS sector, CASE WHEN i % 2 = 1 THEN i::INT END AS top_rank, CASE i % 3 WHEN 0 THEN '' WHEN 1 THEN 'P1-P4' ELSE 'P5-P7' END AS stages, -3.60 + 0.1 * i AS w, 55.83 AS s, -3.455 + 0.1 * i AS e, 55.99 AS n, false AS hole FROM range(8) r(i) UNION ALL SELECT 8, 'School 8', 'ND', NULL, '', -3.5, 55.9, -3.0, 56.05, true)"
_INSIDE = f"hits AS (SELECT c_custkey, feature_id, school, sector, top_rank, stages FROM {_points_sql('customer', 'c_custkey')} a, boxes WHERE lng >= w::DOUBLE AND lng <= e::DOUBLE AND lat >= s::DOUBLE AND lat <= n::DOUBLE AND NOT (hole AND lng > -3.4 AND lng < -3.2 AND lat > 55.95 AND lat < 56.0))"


def _shifted(spark, sf_dir):
    """Customers a little off the rectangles' sides, so that no result hangs on the last bit of a coordinate."""
    p = _points(table(spark, sf_dir, "customer"), "c_custkey")
    return p.withColumns({"lat": F.col("lat") + 0.000031, "lng": F.col("lng") + 0.000017})


_INSIDE = _INSIDE.replace("lng >= w", "lng + 0.000017 >= w").replace("lng <= e", "lng + 0.000017 <= e").replace("lat >= s", "lat + 0.000031 >= s").replace("lat <= n", "lat + 0.000031 <= n").replace("lng > -3.4", "lng + 0.000017 > -3.4").replace("lng < -3.2", "lng + 0.000017 < -3.2").replace("lat > 55.95", "lat + 0.000031 > 55.95").replace("lat < 56.0)", "lat + 0.000031 < 56.0)")


@query(f"WITH {_BOXES}, {_INSIDE} SELECT c_custkey, feature_id FROM hits")
def point_in_polygon(spark, sf_dir):
    return spatial.point_in_polygon(_shifted(spark, sf_dir), _squares(spark)).select("c_custkey", "feature_id")


#: A comb of 300 teeth over the whole map, and a small square for each part.
_COMB = "c AS (SELECT c_custkey, lat + 0.000031 AS lat, lng + 0.000017 AS lng FROM " + _points_sql("customer", "c_custkey") + "), q AS (SELECT p_partkey, lat, lng FROM " + _points_sql("part", "p_partkey") + ")"


@query(f"WITH {_COMB} SELECT c_custkey, -1::BIGINT AS feature_id FROM c WHERE lng > -3.66 AND lng < -2.46 AND lat > 55.8 AND lat < 55.85 + 0.2 * (1 - abs((lng + 3.66) / 0.002 % 2 - 1)) UNION ALL SELECT c_custkey, p_partkey FROM c, q WHERE c.lng >= q.lng AND c.lng <= q.lng + 0.003 AND c.lat >= q.lat AND c.lat <= q.lat + 0.003")
def adaptive_cover(spark, sf_dir):
    teeth = F.transform(F.sequence(F.lit(600), F.lit(0)), lambda k: F.struct((-3.66 + k * 0.002).alias("x"), (55.85 + F.when(k % 2 == 1, 0.2).otherwise(0.0)).alias("y")))
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    comb = spark.range(1).select(F.lit(-1).cast("long").alias("feature_id"), F.array(F.array(F.concat(F.array(corner(-3.66, 55.8), corner(-2.46, 55.8)), teeth))).alias("polys"))
    at = lambda dx, dy: F.struct((F.col("lng") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    squares = _points(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("feature_id"), F.array(F.array(F.array(at(0.0, 0.0), at(0.003, 0.0), at(0.003, 0.003), at(0.0, 0.003)))).alias("polys"))
    return spatial.at_shared_places(_shifted(spark, sf_dir), comb.unionByName(squares)).select("c_custkey", "feature_id")


@query(f"WITH {_BOXES}, {_INSIDE} SELECT c_custkey, arg_max(school, feature_id) FILTER (sector <> 'RC') AS catchment, arg_max(school, feature_id) FILTER (sector = 'RC') AS catchment_rc, min(top_rank) AS top_school_rank FROM hits GROUP BY c_custkey")
def catchment_collapse(spark, sf_dir):
    out = spatial.secondary_catchments(_shifted(spark, sf_dir), _squares(spark), key="c_custkey")
    return out.where("catchment is not null or catchment_rc is not null").select("c_custkey", "catchment", "catchment_rc", "top_school_rank")


@query(f"WITH {_BOXES}, {_INSIDE}, f AS (SELECT DISTINCT c_custkey, sector, stages, school FROM hits), g AS (SELECT c_custkey, sector, first(school ORDER BY stages, school) AS school FROM f GROUP BY ALL) SELECT c_custkey, max(school) FILTER (sector = 'ND') AS \"primary\", max(school) FILTER (sector = 'RC') AS primary_rc FROM g GROUP BY c_custkey")
def primary_collapse(spark, sf_dir):
    layer = _squares(spark).withColumns({"score": F.lit(80.0), "top": F.lit(False)})
    out = spatial.primary_catchments(_shifted(spark, sf_dir), layer, key="c_custkey")
    return out.where("primary is not null or primary_rc is not null").select("c_custkey", "primary", "primary_rc")


@query("WITH m(ord, rank, word) AS (VALUES (0, 1, 'green'), (1, 2, 'blue'), (2, 3, 'a')), h AS (SELECT p_partkey, min(ord) AS ord FROM part JOIN m ON contains(lower(p_name), word) GROUP BY 1) SELECT p.p_partkey, m.rank AS top_rank FROM part p LEFT JOIN h USING (p_partkey) LEFT JOIN m USING (ord)")
def substring_theta_join(spark, sf_dir):
    from placeframe.operators.layers import top_school

    words = spark.createDataFrame([(0, 1, "green", "ND"), (1, 2, "blue", "ND"), (2, 3, "a", "ND")], "ord int, rank int, match string, sector string")
    return top_school(table(spark, sf_dir, "part").select("p_partkey", "p_name"), words, "p_name", None).select("p_partkey", "top_rank")


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice FROM orders GROUP BY o_custkey")
def latest_record_per_key(spark, sf_dir):
    return stats.newest_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN r > 0 THEN least(10, greatest(1, ceil(r / 697.6)))::INT END AS decile, CASE WHEN o_totalprice < 200000 THEN 0 WHEN o_totalprice < 300000 THEN 1 WHEN o_totalprice < 400000 THEN 2 WHEN o_totalprice < 550000 THEN 3 WHEN o_totalprice < 750000 THEN 4 ELSE 5 END AS bucket FROM (SELECT *, o_orderkey % 7000 AS r FROM orders)")
def decile_and_buckets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", N.decile(F.pmod("o_orderkey", F.lit(7000))).alias("decile"), N.bucket("o_totalprice", N.PRICE_STOPS).cast("int").alias("bucket"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.page_title("html").alias("title"))


@query("SELECT doc_id, try_cast(replace(nullif(regexp_extract(text, '-?\\d[\\d,]*\\.?\\d*', 0), ''), ',', '') AS DOUBLE) AS number FROM documents")
def number_extraction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.first_number("text").alias("number"))


@query("SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name), '\\b(?:primary|school|rc|nd|the|ps)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS name FROM customer")
def name_normalize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.school_key("c_name").alias("name"))


@query("SELECT cy, cx, count(*) AS n FROM (SELECT floor(lat / 0.05)::BIGINT AS cy, floor(lng / 0.05)::BIGINT AS cx FROM " + _points_sql("customer", "c_custkey") + ") GROUP BY ALL")
def grid_clusters(spark, sf_dir):
    return stats.clusters(_points(table(spark, sf_dir, "customer"), "c_custkey"), cell=0.05).select("cy", "cx", "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, median(l_extendedprice)::DOUBLE AS median FROM lineitem GROUP BY ALL")
def exact_group_medians(spark, sf_dir):
    return stats.exact_medians(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"], at_once=500)


#: Searches: with long tokens, with a short one beside, with short ones alone, beyond ASCII, and for what is nowhere.
_SEARCHES = ("the tion, ING", "erble an", "e n", "éau QUE", "schung", "zzzz the", "###")


@query(f"WITH s(search, words) AS (VALUES {', '.join(f'({n}, {search.tokens(q)})' for n, q in enumerate(_SEARCHES))}) SELECT search::INT AS search, doc_id AS id FROM s, documents WHERE text IS NOT NULL AND len(list_filter(words, lambda w: NOT contains(lower(text), w))) = 0")
def text_index_search(spark, sf_dir):
    from placeframe.operators import textindex

    docs = table(spark, sf_dir, "documents")
    return textindex.search(docs, textindex.index(docs, "doc_id", "text"), list(_SEARCHES), "doc_id", "text")


#: Ten sets of filters over orders: by status, priority, year and band of price.
_FACETS = {"status": ("o_orderstatus", "o_orderstatus"), "priority": ("o_orderpriority", "o_orderpriority"), "year": ("CAST(year(o_orderdate) AS STRING)", "year(o_orderdate)::VARCHAR"), "band": ("CAST(CAST(floor(o_totalprice / 50000) AS INT) AS STRING)", "floor(o_totalprice / 50000)::INT::VARCHAR")}
_FILTERS = [{}, {"status": ["F"]}, {"status": ["F", "O"]}, {"priority": ["1-URGENT", "5-LOW"]}, {"year": ["1997"]}, {"year": ["1996", "1997"], "status": ["P"]}, {"band": ["0", "1", "2"], "priority": ["2-HIGH"]}, {"band": ["3"], "year": ["1995", "1998"], "status": ["O"]}, {"status": ["none"]}, {"status": ["F"], "priority": ["5-LOW"], "year": ["1999"], "band": ["4", "5"]}]


def _facet_sql() -> str:
    rows = "r AS (SELECT o_orderkey, " + ", ".join(f"{e} AS {c}" for c, (_, e) in _FACETS.items()) + " FROM orders)"
    sets = [f"SELECT {n}::INT AS filter, * FROM r WHERE " + (" AND ".join(f"{c} IN ({', '.join(repr(v) for v in values)})" for c, values in f.items()) or "true") for n, f in enumerate(_FILTERS)]
    counted = [f"SELECT filter, '{c}' AS facet, {c} AS value, count(*) AS n FROM k GROUP BY ALL" for c in _FACETS]
    return f"WITH {rows}, k AS ({' UNION ALL '.join(sets)}) {' UNION ALL '.join(counted)}"


@query(_facet_sql())
def facet_bitmaps(spark, sf_dir):
    from placeframe.operators import bitmaps

    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *[f"{e} AS {c}" for c, (e, _) in _FACETS.items()])
    return bitmaps.counts(bitmaps.index(rows, "o_orderkey", list(_FACETS)), _FILTERS, list(_FACETS))


#: Points of the unit square in order; each in turn leads if no leader before it is within 60 pixels at zoom 9.
_R = 60 / (512 * 2**9)
_LEAD = "p AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) AS i, lng / 360 + 0.5 AS x, 0.5 - 0.25 * ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / pi() AS y FROM " + _points_sql("customer", "c_custkey") + f"), g AS (SELECT 0::BIGINT AS i, []::DOUBLE[][] AS lead UNION ALL SELECT p.i, CASE WHEN len(list_filter(lead, lambda q: (q[1] - x) * (q[1] - x) + (q[2] - y) * (q[2] - y) <= {_R * _R!r})) = 0 THEN list_append(lead, [x, y, id]) ELSE lead END FROM g JOIN p ON p.i = g.i + 1), l AS (SELECT unnest(arg_max(lead, i)) AS q FROM g), a AS (SELECT id, x, y, min(q[3]::BIGINT) AS leader FROM p, l WHERE (q[1] - x) * (q[1] - x) + (q[2] - y) * (q[2] - y) <= {_R * _R!r} AND q[3] <= id GROUP BY ALL)"


@query(f"WITH RECURSIVE {_LEAD} SELECT 9::INT AS zoom, leader AS id, count(*) AS n, round(avg(x), 9) AS x, round(avg(y), 9) AS y FROM a GROUP BY leader")
def radius_clusters(spark, sf_dir):
    from placeframe.operators import clusters

    found = clusters.by_zoom(_points(table(spark, sf_dir, "customer"), "c_custkey"), range(9, 10), 60, key="c_custkey")
    return found.select("zoom", "id", "n", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


# More queries, by subject; each module registers its own.
from placeframe.query_sets import days, homes, layers, pages, saved_lists, searches, texts, timetables  # noqa: E402, F401
