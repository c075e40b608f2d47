"""Map layers: column discovery, zones, catchments, routes, stations, and what the map shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeframe.functions.text import route_order
from placeframe.operators import layers, lines, stats
from placeframe.plans.daily import area_labels
from placeframe.query_sets.searches import LISTINGS, listings
from placeframe.registry import query, table, turns, turns_sql
from placeframe.session import materialise

POLYS = "array<array<array<struct<x:double,y:double>>>>"
_SQUARE = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]]


@query("SELECT p_partkey AS id, 'Z' || p_partkey AS dz, 'City' AS la, rank, CASE WHEN rank > 0 THEN least(10, greatest(1, ceil(rank / 697.6)))::INT END AS decile, least(10, greatest(1, ceil(p_size * 140 / 697.6)))::INT AS income, CASE WHEN p_size % 2 = 0 THEN 5 END::INT AS health, NULL::INT AS crime FROM (SELECT *, CASE WHEN p_partkey % 10 <> 0 THEN (p_partkey * 31 % 6976)::INT END AS rank FROM part)")
def deprivation_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), F.col("p_size")
    raw = p.select(k.alias("feature_id"), F.concat(F.lit("Z"), k.cast("string")).alias("DataZone"), F.lit("n").alias("DZName"), F.lit("City").alias("LAName"), F.when(k % 10 != 0, (k * 31 % 6976).cast("string")).otherwise("n/a").alias("SIMD2020v2_Rank"), (n * 140).alias("SIMD2020_Income_Rank"), F.when(n % 2 == 0, "3000").otherwise("*").alias("HlthRank"), F.lit(None).cast(POLYS).alias("polys"))
    return layers.deprivation_zones(raw).select(F.col("feature_id").alias("id"), "dz", "la", "rank", "decile", "income", "health", "crime")


@query("SELECT p_partkey::VARCHAR AS postcode, 'a' AS address1, NULL::VARCHAR AS address2, p_size::VARCHAR AS floor_area, 'C' AS band, '2024-01-01' AS date FROM part")
def certificate_columns(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("POSTCODE"), F.lit("a").alias("ADDRESS1"), F.col("p_size").alias("TOTAL_FLOOR_AREA"), F.lit("C").alias("CURRENT_ENERGY_RATING"), F.lit("2024-01-01").alias("LODGEMENT_DATE"), F.lit("2020").alias("INSPECTION_DATE"))
    return layers.certificate_columns(raw)


_TOPS = [(0, 1, "james gillespie", "ND"), (1, 2, "boroughmuir", "ND"), (2, 3, "st thomas", "RC"), (3, 4, "royal", None)]
_SCHOOLS = [(0, "JAMES GILLESPIE'S HIGH SCHOOL", "ND"), (1, "Boroughmuir High School", "RC"), (2, "St Thomas of Aquin’s RC High School", "RC"), (3, "Royal High", "ND"), (4, "Castlebrae", "ND"), (5, "Royal James Gillespie", "ND")]


def _tops(spark):
    return spark.createDataFrame(_TOPS, "ord int, rank int, match string, sector string")


_NAMED = {"school": "VARCHAR", "sector": "VARCHAR", "top_rank": "INT"}
_LAYER = [("James Gillespie'S High School", "ND", 1), ("Boroughmuir High School", "RC", None), ("St Thomas of Aquin’s RC High School", "RC", 3), ("Royal High", "ND", 4), ("Castlebrae", "ND", None), ("Royal James Gillespie", "ND", 1)]


@query(turns_sql(_NAMED, _LAYER))
def secondary_layer(spark, sf_dir):
    """A school a customer."""
    raw = turns(spark, sf_dir, [(n, s, _SQUARE) for _, n, s in _SCHOOLS], f"school string, sector string, polys {POLYS}").withColumn("feature_id", F.col("k"))
    return layers.secondary_layer(raw.drop("turn", "k"), _tops(spark)).select(F.col("feature_id").alias("k"), "school", "sector", "top_rank")


@query(turns_sql({"school": "VARCHAR", "sector": "VARCHAR"}, [(s, "RC" if i == 2 else "ND") for i, s, _ in _SCHOOLS]))
def sector_of_school_name(spark, sf_dir):
    return turns(spark, sf_dir, [(s,) for _, s, _ in _SCHOOLS], "school string").select("k", "school", layers.sector_of_name().alias("sector"))


@query(turns_sql({"school": "VARCHAR", "stages": "VARCHAR", "score": "DOUBLE", "top": "BOOLEAN"}, [("Castle Primary", None, 91.0, True), ("Canaan Lane Primary", "P1-P4", 70.0, False), ("St Peter'S Rc Primary", None, None, None), ("Unknown", None, None, None)]))
def primary_layer(spark, sf_dir):
    raw = turns(spark, sf_dir, [("CASTLE PRIMARY SCHOOL", "ND", None, _SQUARE), ("x", "ND", "For P1-P4 Pupils Only - Canaan Lane Primary School", _SQUARE), ("ST PETER'S RC PRIMARY SCHOOL", "RC", None, _SQUARE), (None, "ND", None, _SQUARE)], f"school_name string, sector string, note string, polys {POLYS}")
    scores = spark.createDataFrame([(0, "Castle Primary School", 80.0), (1, "The Castle P.S", 60.0), (2, "Castle PS", 91.0), (3, "Canaan Lane Primary", 70.0)], "ord int, name string, score double")
    return layers.primary_layer(raw.withColumn("feature_id", F.col("k")).drop("turn", "k"), scores, 75.0).select(F.col("feature_id").alias("k"), "school", "stages", "score", "top")


@query(f"WITH {LISTINGS}, v AS (SELECT catchment AS s FROM l WHERE price < 500000 UNION ALL SELECT catchment_rc FROM l WHERE price < 500000), t(ord, rank, match) AS (VALUES (0, 1, 'school 1'), (1, 2, 'school 5'), (2, 3, 'nothing')) SELECT rank, CASE rank WHEN 1 THEN 'School 1' WHEN 2 THEN 'School 5' END AS school, (SELECT count(*) FROM v WHERE s = CASE rank WHEN 1 THEN 'School 1' WHEN 2 THEN 'School 5' END) AS n FROM t")
def top_school_counts(spark, sf_dir):
    homes = listings(spark, sf_dir)
    tops = spark.createDataFrame([(0, 1, "school 1", "ND"), (1, 2, "school 5", "ND"), (2, 3, "nothing", "ND")], "ord int, rank int, match string, sector string")
    return layers.school_counts(homes.where("price < 500000"), homes, tops).select("rank", "school", "n")


# ---------------------------------------------------------------- routes: an order is a relation, its hops from part to part are ways

#: Kind of a route by order: two of ten are trams and trains. Ways run from one line's part to the next one's.
_HOPS = """o AS (SELECT o_orderkey AS ord, CASE o_orderkey % 10 WHEN 8 THEN 'tram' WHEN 9 THEN 'train' ELSE 'bus' END AS route, CASE WHEN o_orderkey % 41 = 0 THEN 'Night' ELSE (o_orderkey % 41)::VARCHAR END AS ref FROM orders),
hop AS (SELECT * FROM (SELECT l_orderkey AS ord, row_number() OVER w AS n, l_partkey AS a, lead(l_partkey) OVER w AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) WHERE b IS NOT NULL),
line AS (SELECT route, CASE route WHEN 'bus' THEN ref WHEN 'tram' THEN 'Trams' ELSE 'Railway' END AS key, row_number() OVER (ORDER BY ord, n) AS id, a, b FROM hop JOIN o USING (ord))"""
#: Way 2 * id goes from a to b, way 2 * id + 1 back. A way goes on where two ends meet; chains are walked from ways that none leads to.
_CHAINS = f"""{_HOPS}, ends AS (SELECT key, 2 * id AS e, a AS node FROM line UNION ALL SELECT key, 2 * id + 1, b FROM line),
two AS (SELECT min(e) AS x, max(e) AS y FROM ends GROUP BY key, node HAVING count(*) = 2), goes AS (SELECT xor(x, 1) AS way, y AS next FROM two UNION ALL SELECT xor(y, 1), x FROM two),
walk AS (SELECT e AS first, e AS way, 0 AS step FROM ends WHERE e NOT IN (SELECT next FROM goes) UNION ALL SELECT first, next, step + 1 FROM walk JOIN goes USING (way)),
last AS (SELECT first, arg_max(way, step) AS last FROM walk GROUP BY first), chosen AS (SELECT first FROM last WHERE first // 2 < last // 2 OR (first // 2 = last // 2 AND first % 2 = 0)),
round AS (SELECT e AS first, e AS way FROM ends WHERE e NOT IN (SELECT way FROM walk) UNION SELECT first, next FROM round JOIN goes USING (way)), ring AS (SELECT first FROM round GROUP BY first HAVING min(way) = first AND first % 2 = 0),
about AS (SELECT first, first AS way, 0 AS step FROM ring UNION ALL SELECT about.first, next, step + 1 FROM about JOIN goes USING (way) WHERE next <> about.first),
placed AS (SELECT * FROM walk SEMI JOIN chosen USING (first) UNION ALL SELECT * FROM about),
chain AS (SELECT route, key, first // 2 AS chain, count(*) AS n, string_agg(CASE WHEN way % 2 = 0 THEN a ELSE b END, '-' ORDER BY step) AS head, arg_max(CASE WHEN way % 2 = 0 THEN b ELSE a END, step) AS tail FROM placed JOIN line ON line.id = way // 2 GROUP BY ALL)"""


def _hops(spark, sf_dir):
    """ord, n, a, b: the ways of each order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    hops = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), F.row_number().over(w).alias("n"), F.col("l_partkey").alias("a"), F.lead("l_partkey").over(w).alias("b"))
    return hops.where("b is not null").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord")), "ord")


def _elements(spark, sf_dir):
    """Relations of ways between parts, and parts as nodes."""
    at = lambda c: F.struct((F.col(c) * F.col(c) % 1009).cast("double").alias("lat"), F.col(c).cast("double").alias("lon"))
    way = F.struct(F.lit("way").alias("type"), F.when(F.col("n") % 2 == 0, "forward").otherwise("").alias("role"), F.array(at("a"), at("b")).alias("geometry"))
    stop = F.struct(F.lit("node").alias("type"), F.lit("stop").alias("role"), F.lit(None).cast("array<struct<lat:double,lon:double>>").alias("geometry"))
    members = _hops(spark, sf_dir).groupBy("ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", way.alias("way")))), lambda x: x["way"]).alias("ways"))  # seven lines of an order
    route = F.when(F.col("ord") % 10 == 8, "tram").when(F.col("ord") % 10 == 9, "train").otherwise("bus")
    ref = F.when(F.col("ord") % 41 == 0, "").otherwise((F.col("ord") % 41).cast("string"))
    name = F.when(F.col("ord") % 41 == 0, "Night").otherwise(F.concat(F.lit("Bus "), ref, F.lit(": Ocean => Gyle")))
    relations = members.select("ord", F.lit("relation").alias("type"), F.create_map(F.lit("route"), route, F.lit("ref"), ref, F.lit("name"), name).alias("tags"), F.concat("ways", F.array(stop)).alias("members"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.lit("node").alias("type"), F.create_map(F.lit("name"), F.concat(F.lit("Stop "), F.col("p_name"))).alias("tags"), F.lit(None).cast(relations.schema["members"].dataType).alias("members"), (F.col("p_partkey") / 7).alias("lat"), F.lit(-3.1).alias("lon"))
    return relations.unionByName(nodes)


@query(f"WITH RECURSIVE {_CHAINS}, r AS (SELECT key AS ref, count(*)::INT AS lines FROM chain WHERE route = 'bus' GROUP BY key) SELECT ref, CASE WHEN ref = 'Night' THEN 'Night' ELSE 'Ocean ↔ Gyle' END AS name, ref IN ('3', '5', '10', '11', '16', '22', '25', '26', '31', '37', '44') AS main, lines, row_number() OVER (ORDER BY try_cast(ref AS INT) NULLS LAST, ref)::INT AS place FROM r")
def bus_routes(spark, sf_dir):
    out = layers.bus_routes(_elements(spark, sf_dir), counted=True)
    place = F.row_number().over(Window.orderBy(route_order("ref")))  # some forty routes
    return out.select("ref", "name", "main", "lines", place.alias("place"))


@query(f"WITH RECURSIVE {_CHAINS} SELECT 'line' AS kind, key AS name, count(*)::INT AS lines, NULL::DOUBLE AS y FROM chain WHERE route <> 'bus' GROUP BY key UNION ALL SELECT 'stop', 'Stop ' || p_name, NULL, round_even(p_partkey / 7, 5)::DOUBLE FROM part UNION ALL SELECT 'station', s_name, NULL, s_acctbal FROM supplier")
def tram_and_rail(spark, sf_dir):
    elements = materialise(_elements(spark, sf_dir), "elements")
    tram = layers.tram_layer(elements, counted=True).select("kind", "name", "lines", "y")
    rail = layers.rail_layer(elements, counted=True).select("kind", "name", "lines", F.lit(None).cast("double").alias("y"))
    stations = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("lat"), F.lit(-3.3).alias("lng"), F.lit(12).alias("minutes"), F.lit(4).alias("trains_per_hour"))
    return tram.unionByName(rail).unionByName(layers.station_points(stations).select("kind", "name", F.lit(None).cast("int").alias("lines"), "y"))


@query(f"WITH RECURSIVE {_CHAINS} SELECT key, (n + 1)::INT AS points, head || '-' || tail AS path FROM chain")
def line_merging(spark, sf_dir):
    hops = _hops(spark, sf_dir)
    key = F.when(F.col("ord") % 10 == 8, "Trams").when(F.col("ord") % 10 == 9, "Railway").when(F.col("ord") % 41 == 0, "Night").otherwise((F.col("ord") % 41).cast("string"))
    point = lambda c: F.struct(F.col(c).alias("x"), F.lit(0).alias("y"))
    merged = lines.merged(hops.select(key.alias("key"), F.struct("ord", "n").alias("line"), F.array(point("a"), point("b")).alias("points")))
    return merged.select("key", F.size("points").alias("points"), F.concat_ws("-", F.transform("points", lambda p: p["x"].cast("string"))).alias("path"))


#: Each user's events in order are a line; a stretch is halved at its farthest point, the first of equals, while that is more than 20 away.
_THIN = """p AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS y FROM events), n AS (SELECT k, max(pos) AS n FROM p GROUP BY k),
cut AS (SELECT k, 0::BIGINT AS i, n AS j FROM n UNION ALL SELECT h.k, CASE c WHEN 0 THEN i ELSE m END, CASE c WHEN 0 THEN m ELSE j END FROM (SELECT c.k, c.i, c.j, arg_max(p.pos, (off(p.pos - c.i, p.y - a.y, c.j - c.i, b.y - a.y), -p.pos)) AS m, max(off(p.pos - c.i, p.y - a.y, c.j - c.i, b.y - a.y)) AS o
  FROM cut c JOIN p a ON a.k = c.k AND a.pos = c.i JOIN p b ON b.k = c.k AND b.pos = c.j JOIN p ON p.k = c.k AND p.pos > c.i AND p.pos < c.j GROUP BY c.k, c.i, c.j) h, (VALUES (0), (1)) v(c) WHERE o > 20)"""
_OFF = "sqrt(pow(({x}) - greatest(0.0, least(1.0, (({x}) * ({dx}) + ({y}) * ({dy})) / (({dx}) * ({dx}) + ({dy}) * ({dy})))) * ({dx}), 2) + pow(({y}) - greatest(0.0, least(1.0, (({x}) * ({dx}) + ({y}) * ({dy})) / (({dx}) * ({dx}) + ({dy}) * ({dy})))) * ({dy}), 2))"
_THIN = _THIN.replace("off(p.pos - c.i, p.y - a.y, c.j - c.i, b.y - a.y)", _OFF.format(x="p.pos - c.i", y="p.y - a.y", dx="c.j - c.i", dy="b.y - a.y"))


@query(f"WITH RECURSIVE {_THIN}, s AS (SELECT k, i AS pos FROM cut UNION SELECT k, j FROM cut) SELECT k AS user_id, count(*)::INT AS points, string_agg(pos, ',' ORDER BY pos) AS kept FROM s GROUP BY k")
def line_simplification(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("at"), "value")
    point = F.struct(F.col("at").cast("double").alias("x"), F.col("value").alias("y"))
    whole = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", point.alias("p")))), lambda v: v["p"]).alias("points"))  # one line
    thin = lines.simplified(whole, 20.0, ("user_id",))
    return thin.select("user_id", F.size("points").alias("points"), F.concat_ws(",", F.transform("points", lambda p: p["x"].cast("long").cast("string"))).alias("kept"))


@query("WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part), s AS (SELECT k, n % 4 AS rank, CASE WHEN k % 3 = 0 THEN 'RC' ELSE 'ND' END AS sector, ['', 'P1-P4', 'P5-P7'][k % 3 + 1] AS stages FROM p) SELECT 'bus' AS kind, k FROM p WHERE k % 5 = 0 UNION ALL SELECT 'all', k FROM p UNION ALL SELECT 'top', k FROM s WHERE rank <> 0 AND sector = 'ND' UNION ALL SELECT 'top rc', k FROM s WHERE rank <> 0 AND sector = 'RC' UNION ALL SELECT 'primary', k FROM s WHERE stages <> 'P5-P7' AND sector = 'ND' UNION ALL SELECT 'stop', k FROM p WHERE k % 2 = 1")
def shown_features(spark, sf_dir):
    """Parts as bus routes, schools and features of a line."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"))
    bus = p.withColumn("main", F.col("k") % 5 == 0)
    schools = p.withColumns({"top_rank": F.when(F.col("n") % 4 != 0, F.col("n") % 4), "sector": F.when(F.col("k") % 3 == 0, "RC").otherwise("ND"), "stages": F.when(F.col("k") % 3 == 1, "P1-P4").when(F.col("k") % 3 == 2, "P5-P7")})
    kinds = p.withColumn("kind", F.when(F.col("k") % 2 == 1, "stop").otherwise("line"))
    parts = [("bus", layers.shown_features(bus, "bus")), ("all", layers.shown_features(bus, "bus", all_bus=True)), ("top", layers.shown_features(schools, "catchTop")), ("top rc", layers.shown_features(schools, "catchTop", rc=True)), ("primary", layers.shown_features(schools, "primary")), ("stop", layers.shown_features(kinds, "stop"))]
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "k") for kind, df in parts])


@query(f"WITH {LISTINGS} SELECT id, price, coalesce(best_min, 999) AS mins, coalesce(vs_pct, 0) AS vs, coalesce(top_school_rank, 0) <> 0 AS top, source IS NOT NULL AS lot, kind IS NOT NULL AS plot, coalesce(bedrooms::VARCHAR, '?') || ' bed' AS label FROM l")
def map_homes(spark, sf_dir):
    df = listings(spark, sf_dir).withColumns({"lat": F.lit(55.9), "lng": F.lit(-3.1)})
    return layers.map_homes(df).select("id", "price", "mins", "vs", "top", "lot", "plot", "label")


@query(f"WITH {LISTINGS}, d AS (SELECT split_part(postcode, ' ', 1) AS district, price, 55.8 + (ord % 40) / 100.0 AS lat, -3.0 - (ord % 7) / 100.0 AS lng FROM l) SELECT district, trunc(median(price))::INT AS median, count(*) AS count, round_even(avg(lng), 5)::DOUBLE AS x, round_even(avg(lat), 5)::DOUBLE AS y FROM d GROUP BY 1")
def area_label_points(spark, sf_dir):
    df = listings(spark, sf_dir).withColumns({"district": F.split("postcode", " ")[0], "lat": 55.8 + (F.col("ord") % 40) / 100.0, "lng": -3.0 - (F.col("ord") % 7) / 100.0})
    areas = stats.area_stats(df, extra=[F.col("lat").alias("lat"), F.col("lng").alias("lng")])
    return area_labels(areas).select("district", "median", "count", "x", "y")
