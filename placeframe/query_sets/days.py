"""The daily run end to end, the files it reads and writes, and the streaming form of the upsert."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.functions import numeric as N
from placeframe.plans import refresh
from placeframe.query_sets.layers import POLYS
from placeframe.registry import literal, query, table, today
from placeframe.session import fresh_path, write_file
from placeframe.sources import files, sinks


# ---------------------------------------------------------------- enrichment

#: A listing per part. Every 13th has no position, every 17th no price; auction lots and plots are among them.
_COLUMNS = {
    "id": "CAST(k AS STRING)", "address": "CONCAT(CASE WHEN k % 7 = 0 THEN 'Auction Details - ' ELSE '' END, CAST(k AS STRING), ' Sample Road')", "district": "CONCAT('EH', CAST(k % 30 AS STRING))",
    "lat": "CASE WHEN k % 13 <> 0 THEN 55.70 + CAST(k * 7919 % 4000 AS DOUBLE) / 10000.0 + 0.000031 END", "lng": "-3.60 + CAST(k * 104729 % 9000 AS DOUBLE) / 10000.0 + 0.000017",
    "price": "CASE WHEN k % 17 <> 0 THEN CAST(100000 + (k * 37) % 900 * 1000 AS INT) ELSE 0 END", "bedrooms": "CASE WHEN k % 11 <> 0 THEN CAST(n % 7 AS INT) END", "source": "CASE WHEN k % 7 = 0 THEN 'auction' END", "kind": "CASE WHEN k % 9 = 0 THEN 'plot' END",
    "closing_date": "CASE WHEN k % 2 = 0 THEN CAST('2026-08-20' AS DATE) + CAST(n AS INT) END",
}
_LISTINGS = "l AS (SELECT k, " + ", ".join(f"{e.replace('STRING', 'VARCHAR')} AS {c}" for c, e in _COLUMNS.items()) + " FROM (SELECT p_partkey AS k, p_size AS n FROM part) p)"
_ZONES = [(i, -3.6 + 0.1 * i, -3.6 + 0.1 * i + 0.15) for i in range(8)]


def _layer(spark: SparkSession) -> DataFrame:
    ring = lambda w, e: [(w, 55.8), (e, 55.8), (e, 56.0), (w, 56.0), (w, 55.8)]
    rows = [(i, f"Z{i}", 1 + i, f"School {i}", "RC" if i % 3 == 0 else "ND", i if i % 2 else None, "", f"Primary {i}", 60.0 + 5 * i, i > 5, [[ring(w, e)]]) for i, w, e in _ZONES]
    return spark.createDataFrame(rows, f"feature_id int, dz string, decile int, school string, sector string, top_rank int, stages string, primary string, score double, top boolean, polys {POLYS}")


_ZONE_SQL = "z AS (SELECT i::INT AS i, -3.6 + 0.1 * i AS w, -3.6 + 0.1 * i + 0.15 AS e FROM range(8) r(i))"
_ENRICH = f"""WITH {_LISTINGS}, {_ZONE_SQL}, u AS (SELECT * FROM l WHERE lat IS NOT NULL AND price <> 0),
h AS (SELECT k, i FROM u, z WHERE lng BETWEEN w::DOUBLE AND e::DOUBLE AND lat BETWEEN 55.8 AND 56.0),
g AS (SELECT k, min(i) AS zone, max(i) FILTER (i % 3 <> 0) AS nd, max(i) FILTER (i % 3 = 0) AS rc, min(i) FILTER (i % 2 = 1) AS top, min('Primary ' || i) FILTER (i % 3 <> 0) AS p_nd, min('Primary ' || i) FILTER (i % 3 = 0) AS p_rc FROM h GROUP BY k),
c AS (SELECT district, CASE WHEN bedrooms > 0 THEN least(bedrooms, 5) END AS beds, price FROM u WHERE source IS NULL AND kind IS NULL), d AS (SELECT district, trunc(median(price))::INT AS med FROM c GROUP BY 1), b AS (SELECT district, beds, count(*) AS n, trunc(median(price))::INT AS med FROM c GROUP BY 1, 2),
m AS (SELECT u.*, d.med AS dm, b.n AS bn, b.med AS bm, 2 * 6371000.0 * asin(sqrt(pow(sin((radians(55.95196) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(55.95196)) * pow(sin((radians(-3.18992) - radians(lng)) / 2), 2))) AS metres FROM u LEFT JOIN d USING (district) LEFT JOIN b ON b.district = u.district AND b.beds = least(u.bedrooms, 5) AND u.bedrooms <> 0),
base AS (SELECT *, CASE WHEN kind IS NULL AND dm IS NOT NULL THEN CASE WHEN coalesce(bn, 0) >= 3 THEN bm ELSE dm END END AS base FROM m)
SELECT base.id, CASE WHEN source IS NULL THEN address ELSE k || ' Sample Road' END AS address, price, nullif(bedrooms, 0) AS bedrooms, CASE WHEN closing_date >= DATE '2026-09-01' THEN closing_date::VARCHAR END AS closing_date,
CASE WHEN k % 30 BETWEEN 1 AND 17 THEN 'Edinburgh' WHEN k % 30 IN (18, 19, 20, 22, 23, 24, 25, 26) THEN 'Midlothian' WHEN k % 30 = 21 THEN 'East Lothian' WHEN k % 30 = 27 THEN 'West Lothian' WHEN k % 30 >= 28 THEN 'Edinburgh' END AS region,
'Z' || zone AS dz, (zone + 1)::INT AS decile, 'School ' || nd AS catchment, 'School ' || rc AS catchment_rc, top::INT AS top_school_rank, p_nd AS "primary", p_rc AS primary_rc,
round_even(metres * 1.3 / (4.8 / 3.6) / 60, 0)::INT AS walk_min, base AS median, CASE WHEN base IS NOT NULL THEN CASE WHEN coalesce(bn, 0) >= 3 THEN least(bedrooms, 5) || '-bed' ELSE 'all' END END AS basis, CASE WHEN base IS NOT NULL THEN round_even(100 * (price - base) / base::DOUBLE, 0)::INT END AS vs_pct FROM base LEFT JOIN g USING (k)"""


@query(_ENRICH)
def daily_enrichment(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size AS n").selectExpr(*[f"{e} AS {c}" for c, e in _COLUMNS.items()])
    none = {"postcode": F.lit(""), "url": F.lit("u"), "first_seen": today(), "price_history": F.array(F.struct(today().alias("date"), F.lit(1).alias("price"))), "extra": F.lit("dropped"), "auction": F.lit(None).cast("struct<house:string,date:date,basis:string>")}
    layer = _layer(spark)
    inputs = refresh.Inputs(zones=layer.select("feature_id", "dz", "decile", "polys"), secondary=layer.select("feature_id", "school", "sector", "top_rank", "polys"), primary=layer.select("feature_id", F.col("primary").alias("school"), "sector", "stages", "score", "top", "polys"))
    out, _ = refresh.enrich(p.withColumns(none), inputs, today())
    return out.select("id", "address", "price", "bedrooms", F.col("closing_date").cast("string").alias("closing_date"), "region", "simd.dz", "simd.decile", "catchment", "catchment_rc", "top_school_rank", "primary", "primary_rc", "travel.walk_min", "area.median", "area.basis", "area.vs_pct")


@query(f"WITH {_LISTINGS} SELECT district, count(*) AS count, trunc(median(price))::INT AS median, trunc(avg(price))::INT AS mean FROM l WHERE lat IS NOT NULL AND price <> 0 AND source IS NULL AND kind IS NULL GROUP BY district")
def daily_area_stats(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size AS n").selectExpr(*[f"{e} AS {c}" for c, e in _COLUMNS.items()])
    p = p.withColumns({"postcode": F.lit(""), "url": F.lit("u"), "first_seen": today(), "price_history": F.array(F.struct(today().alias("date"), F.lit(1).alias("price")))})
    return refresh.enrich(p, refresh.Inputs(), today())[1].where("beds is null").select("district", "count", "median", "mean")


@query(f"WITH {_LISTINGS} SELECT id FROM l WHERE lat IS NOT NULL AND price <> 0")
def usable_listings(spark, sf_dir):
    p = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size AS n").selectExpr(*[f"{e} AS {c}" for c, e in _COLUMNS.items()], "1 AS secret")
    out = refresh.usable(p)
    if "secret" in out.columns:
        raise ValueError("only listed columns are kept")
    return out.select("id")


@query("SELECT nullif(o_orderkey, 0) AS id, nullif(o_orderstatus, '') AS status, nullif(o_orderkey % 3, 0)::INT AS n, o_orderkey % 2 = 0 AS garage, CASE WHEN o_orderkey % 5 = 0 THEN true END AS flag, CASE WHEN o_orderkey % 4 <> 0 THEN 1 END::INT AS m FROM orders")
def empty_values_stripped(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("status"), (k % 3).cast("int").alias("n"), F.when(k % 3 != 1, k % 2 == 0).otherwise(F.when(k % 2 == 0, True)).alias("garage"), (k % 5 == 0).alias("flag"), F.when(k % 4 != 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("list"))
    return refresh.strip_empty(o).select("id", "status", "n", "garage", "flag", F.when(F.col("list").isNotNull(), F.size("list")).alias("m"))


@query("SELECT id, name, balance, segment FROM (SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier)")
def homes_and_lots(spark, sf_dir):
    """Listings and lots together, as a day's run puts them; read back from the table that it wrote."""
    homes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    lots = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    path = fresh_path(spark, "both")
    sinks.swap_table(homes, path)
    sinks.swap_table(spark.read.parquet(path).unionByName(lots, allowMissingColumns=True), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- files


def _put(spark: SparkSession, name: str, data: bytes) -> str:
    return write_file(spark, f"{fresh_path(spark, 'file')}/{name}", data)


@query("SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT - 1 AS ord, c_name AS name, (c_custkey % 60)::INT AS minutes FROM customer")
def configuration_files(spark, sf_dir):
    """A configuration of each nation's customers as stations, written and read; missing and broken ones are the caller's default."""
    c = table(spark, sf_dir, "customer")
    one = F.struct("c_custkey", F.struct(F.col("c_name").alias("name"), (F.col("c_custkey") % 60).alias("minutes")).alias("s"))
    docs = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.to_json(F.struct(F.lit(1).alias("x"), F.transform(F.array_sort(F.collect_list(one)), lambda v: v["s"]).alias("stations"))).alias("value"))
    path = fresh_path(spark, "configuration")
    sinks.write_documents(docs, path, "nation")
    if files.read_json_or(spark, path + "/none", "none") != "none" or files.read_json_or(spark, _put(spark, "b.json", b"{broken"), "none") != "none" or files.read_or_empty(spark, path + "/none", "id int").count():
        raise ValueError("what is not there has no rows")
    per = [files.read_config(spark, f"{path}/nation={r[0]}", "stations", "name string, minutes int").select(F.lit(r[0]).alias("nation"), "ord", "name", "minutes") for r in docs.select("nation").collect()]  # 25 nations
    return reduce(DataFrame.unionByName, per)


def _zip(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "."), text)
    return out.getvalue()


@query(literal({"stop_id": "VARCHAR", "stop_name": "VARCHAR", "stop_lat": "VARCHAR", "stop_lon": "VARCHAR"}, [("a", "Far, north", "55.9", None), ("b", "", "55.8", None)]))
def timetable_files(spark, sf_dir):
    path = _put(spark, "feed.zip", _zip(stops__txt='﻿stop_id,stop_name,other,stop_lat\na,"Far, north",x,55.9\nb,,y,55.8\n'))
    feed = files.read_timetable(spark, path)
    if feed["trips"].count():
        raise ValueError("a missing member has no rows")
    return feed["stops"]


@query(literal({"postcode": "VARCHAR", "address1": "VARCHAR", "floor_area": "VARCHAR", "band": "VARCHAR", "date": "VARCHAR"}, [("EH1 1AA", "1 High St", "90", "C", "2024-01-01"), ("EH2 1AA", "2 Mill Ln", "80", "D", "2023-01-01")]))
def certificate_files(spark, sf_dir):
    one = "About these data\nPOSTCODE,ADDRESS1,TOTAL_FLOOR_AREA,CURRENT_ENERGY_RATING,LODGEMENT_DATE\nEH1 1AA,1 High St,90,C,2024-01-01\n"
    two = "Lodgement_Date,Address1,Postcode,Total_Floor_Area,Current_Energy_Rating\n2023-01-01,2 Mill Ln,EH2 1AA,80,D\n"
    path = _put(spark, "epc.zip", _zip(a__csv=one, b__CSV=two, note__txt="POSTCODE\nx\n"))
    return files.certificate_zip(spark, path).select("postcode", "address1", "floor_area", "band", "date")


_CORNER = "round_even(-3.4 + (k % 1000) / 7000.0, 5)::DOUBLE"


@query(f"SELECT c_name AS name, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 END::INT AS polygons, CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END::INT AS rings, CASE WHEN k % 3 < 2 THEN {_CORNER} END AS x FROM (SELECT c_custkey AS k, c_name FROM customer)")
def feature_files(spark, sf_dir):
    """A layer of polygons, multi-polygons and points in a document a nation, made as text and read."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.bround(-3.4 + (F.col("c_custkey") % 1000) / 7000.0, 5).alias("x"))
    ring = lambda dx: F.array(*[F.array(F.col("x") + dx + u, F.lit(55.0) + v) for u, v in ((0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.0))])
    kind = F.get(F.array(F.lit("Polygon"), F.lit("MultiPolygon"), F.lit("Point")), (F.col("k") % 3).cast("int"))
    coords = F.when(F.col("k") % 3 == 0, F.to_json(F.array(ring(0.0), ring(0.02)))).when(F.col("k") % 3 == 1, F.to_json(F.array(F.array(ring(0.0)), F.array(ring(0.5))))).otherwise("[1.0, 2.0]")
    feature = F.concat(F.lit('{"type": "Feature", "properties": '), F.to_json(F.struct("name")), F.lit(', "geometry": {"type": "'), kind, F.lit('", "coordinates": '), coords, F.lit("}}"))
    docs = c.groupBy("nation").agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.concat_ws(", ", F.collect_list(feature)), F.lit("]}")).alias("value"))
    path = fresh_path(spark, "features")
    sinks.write_documents(docs, path, "nation")
    f = files.read_features(spark, f"{path}/nation=*", "name:string")
    first = F.get("polys", F.lit(0))
    some = lambda c: F.when(F.col("polys").isNotNull(), c)
    return f.select("name", some(F.size("polys")).alias("polygons"), some(F.size(first)).alias("rings"), some(F.get(F.get(first, F.lit(0)), F.lit(0))["x"]).alias("x"))


@query("SELECT o_orderkey::VARCHAR AS name, count(*)::INT AS lines FROM orders JOIN (SELECT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey WHERE l_linenumber % 3 <> 0 GROUP BY 1 UNION ALL SELECT 'Stop ' || p_partkey, 0 FROM part")
def element_files(spark, sf_dir):
    """An order is a relation, its lines are ways, every third of which is a platform; parts are nodes. Fifty documents."""
    from placeframe.functions.text import relation_lines

    at = lambda x: F.struct(F.lit(1.0).alias("lat"), x.cast("double").alias("lon"))
    way = F.struct(F.lit("way").alias("type"), F.when(F.col("l_linenumber") % 3 == 0, "platform").otherwise("").alias("role"), F.array(at(F.col("l_partkey")), at(F.col("l_partkey") + 1)).alias("geometry"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    relations = table(spark, sf_dir, "lineitem").join(orders, "l_orderkey").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(way).alias("members")).where(F.exists("members", lambda m: m["role"] == ""))  # seven lines
    relations = relations.select("k", F.struct(F.lit("relation").alias("type"), F.struct(F.col("k").cast("string").alias("name")).alias("tags"), "members").alias("e")).select("k", F.to_json("e").alias("e"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.to_json(F.struct(F.lit("node").alias("type"), F.struct(F.concat(F.lit("Stop "), F.col("p_partkey").cast("string")).alias("name")).alias("tags"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))).alias("e"))
    docs = relations.unionByName(nodes).groupBy((F.col("k") % 50).alias("part")).agg(F.concat(F.lit('{"elements": ['), F.concat_ws(", ", F.collect_list("e")), F.lit("]}")).alias("value"))
    path = fresh_path(spark, "elements")
    sinks.write_documents(docs, path, "part")
    e = files.read_elements(spark, f"{path}/part=*")
    return e.select(F.col("tags")["name"].alias("name"), F.coalesce(F.size(relation_lines("members")), F.lit(0)).alias("lines"))


@query(f"WITH c AS (SELECT c_custkey AS k, c_name AS name FROM customer) SELECT 'polygon' AS layer, name, 1::INT AS polygons, {_CORNER} AS x FROM c UNION ALL SELECT 'point', name, NULL, NULL FROM c")
def geojson_documents(spark, sf_dir):
    """Two layers of the customers, written as a document a nation without hidden columns, and read."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), k.alias("_secret"), (-3.4 + (k % 1000) / 7000.0).alias("x"), F.lit(55.123456789).alias("y"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    squares = c.withColumn("polys", F.array(F.array(F.array(at(0.0, 0.0), at(0.1, 0.0), at(0.1, 0.1), at(0.0, 0.0))))).drop("x", "y")
    out = []
    for layer, docs in (("polygon", sinks.feature_collection(squares, by="nation")), ("point", sinks.feature_collection(c, "points", by="nation"))):
        path = fresh_path(spark, "documents")
        sinks.write_documents(docs, path, "nation")
        f = files.read_features(spark, f"{path}/nation=*", "name:string, _secret:string").where("_secret is null")
        out.append(f.select(F.lit(layer).alias("layer"), "name", F.when(F.col("polys").isNotNull(), F.size("polys")).alias("polygons"), F.get(F.get(F.get("polys", F.lit(0)), F.lit(0)), F.lit(0))["x"].alias("x")))
    return out[0].unionByName(out[1])


@query("WITH t AS (SELECT 'customer' AS step, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'nowhere', NULL) SELECT step, n, n IS NULL AS failed, CASE WHEN n IS NOT NULL THEN strftime(date_trunc('minute', (SELECT max(ts) FROM events)), '%Y-%m-%dT%H:%MZ') END AS at, true AS stale, (SELECT max(ts) - min(ts) >= INTERVAL 7 DAY FROM events) AS due FROM t")
def run_metadata(spark, sf_dir):
    """Three steps of a run as of the last event, one of which fails; its document is written and read."""
    first, last = table(spark, sf_dir, "events").agg(F.min("ts"), F.max("ts")).first()
    run = sinks.Run(last)
    counts = {name: run.step(name, lambda name=name: table(spark, sf_dir, name).count()) for name in ("customer", "orders", "nowhere")}
    path = fresh_path(spark, "meta")
    sinks.write_document(spark.createDataFrame([(run.document(),)], "value string"), path)
    said = files.read_json_or(spark, path, {})
    rows = [(name, n, name in said["errors"], said["sources"].get(name), run.stale(last), sinks.due(first.isoformat(), last)) for name, n in counts.items()]
    return spark.createDataFrame(rows, "step string, n long, failed boolean, at string, stale boolean, due boolean")


@query("SELECT o_orderkey AS id, round_even((o_orderkey % 1000) / 7000.0, 5)::DOUBLE AS x, round_even(55 + (o_orderkey % 777) / 7770.7, 5)::DOUBLE AS y FROM orders")
def rounded_points(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(k.alias("id"), F.array(F.array(F.array(F.struct(((k % 1000) / 7000.0).alias("x"), (55 + (k % 777) / 7770.7).alias("y"))))).alias("polys"))
    p = F.get(F.get(F.get(N.round_polygons("polys"), F.lit(0)), F.lit(0)), F.lit(0))
    return o.select("id", p["x"].alias("x"), p["y"].alias("y"))


@query("SELECT count(*) AS n, count(*) AS ids, true AS in_area, true AS same FROM part")
def synthetic_listings(spark, sf_dir):
    """As many as there are parts."""
    n = table(spark, sf_dir, "part").count()
    a, b = files.synthetic_listings(spark, n), files.synthetic_listings(spark, n)
    inside = F.col("lat").between(55.85, 56.0) & F.col("lng").between(-3.4, -3.0) & F.col("bedrooms").between(2, 5)
    return a.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.min(inside).alias("in_area")).withColumn("same", F.lit(a.exceptAll(b).count() == 0))
