"""Listing state, lots, certificates, duplicates and positions, over listings made of the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from placeframe.config import BBOX, Rules
from placeframe.operators import linkage, spatial, stats
from placeframe.operators import state as S
from placeframe.registry import answers, cases, literal, query, table, today, turns, turns_sql

_RULES = Rules(districts=("EH1", "EH28"))
_POINTS = "SELECT c_custkey AS k, 55.60 + (c_custkey * 7919 % 6000)::DOUBLE / 10000.0 AS lat, -3.90 + (c_custkey * 104729 % 16000)::DOUBLE / 10000.0 AS lng FROM customer"


def points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("k"), (55.60 + F.pmod(k * 7919, F.lit(6000)) / 10_000.0).alias("lat"), (-3.90 + F.pmod(k * 104_729, F.lit(16_000)) / 10_000.0).alias("lng"))


# ---------------------------------------------------------------- state


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 55.9 ELSE 55.0 + c_nationkey / 100.0 END::DOUBLE AS lat, c_custkey % 3 = 2 AND c_custkey % 2 = 0 AND c_nationkey < 20 AS approx FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 3 = 1 OR (c_custkey % 2 = 0 AND c_nationkey < 20 AND c_custkey % 3 = 2)) UNION ALL SELECT c_custkey, NULL, false FROM customer WHERE c_custkey % 3 = 0 OR (c_custkey % 3 = 2 AND NOT (c_custkey % 2 = 0 AND c_nationkey < 20))")
def geocoded(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    rows = c.select(k.alias("k"), F.when(k % 3 == 1, 55.9).alias("lat"), F.when(k % 3 == 1, -3.1).alias("lng"), F.when(k % 3 != 0, F.concat(F.lit("EH"), F.col("c_nationkey").cast("string"))).alias("postcode"), (k % 2 == 0).alias("active"))
    look = spark.range(20).select(F.concat(F.lit("EH"), F.col("id").cast("string")).alias("postcode"), (55.0 + F.col("id") / 100.0).alias("lat"), F.lit(-3.2).alias("lng"))
    return S.geocode(rows, look).select("k", "lat", F.coalesce("approx_location", F.lit(False)).alias("approx"))


@query(f"SELECT k, CASE WHEN k % 2 = 0 AND k % 9 <> 0 AND NOT (lat >= {BBOX['south']} AND lat <= {BBOX['north']} AND lng >= {BBOX['west']} AND lng <= {BBOX['east']}) THEN 'outside map area' END AS excluded, k % 2 = 0 AND (k % 9 = 0 OR (lat >= {BBOX['south']} AND lat <= {BBOX['north']} AND lng >= {BBOX['west']} AND lng <= {BBOX['east']})) AS active FROM ({_POINTS})")
def outside_map_area(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"active": F.col("k") % 2 == 0, "excluded": F.lit(None).cast("string"), "lat": F.when(F.col("k") % 9 != 0, F.col("lat"))})
    return S.outside_map(p).select("k", "excluded", "active")


@query("SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 OR o_orderkey % 3 = 0")
def state_garbage(spark, sf_dir):
    k = F.col("o_orderkey")
    why = F.when(k % 4 == 1, S.KEPT).when(k % 4 == 2, "flat").when(k % 4 == 3, "district EH99")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), why.alias("excluded"), F.when(k % 3 == 0, True).alias("__seen"))
    return S.collect_garbage(rows).select("k")


_SEEN = "s AS (SELECT p_partkey AS k, p_size AS n, p_partkey % 3 <> 0 AS seen, p_partkey % 2 = 0 AS active, CASE p_partkey % 4 WHEN 0 THEN 'EH1' WHEN 1 THEN 'EH28' WHEN 2 THEN 'EH99' END AS district FROM part)"


def _classified(spark, sf_dir, complete, unsure):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("k"), F.col("p_size").alias("bedrooms"))
    district = F.when(F.col("k") % 4 == 0, "EH1").when(F.col("k") % 4 == 1, "EH28").when(F.col("k") % 4 == 2, "EH99")
    rows = p.withColumns({"district": district, "active": F.col("k") % 2 == 0, "title": F.lit("House"), "property_type": F.when(F.col("k") % 5 == 0, "plot of land for sale").otherwise("villa"), "last_seen": F.lit("2026-01-01").cast("date"), "excluded": F.lit(None).cast("string")})
    found = p.where("k % 3 <> 0").select("id", F.concat(F.lit("https://x.example/property/a-"), F.when(F.col("k") % 11 == 0, "eh99-1ab").otherwise("eh1-1ab"), F.lit("/36000001")).alias("url"), F.lit("").alias("hint"))
    return S.classify(rows, found, complete, unsure, today(), _RULES).select("k", "excluded", "kind", F.col("last_seen").cast("string").alias("last_seen"), "active")


def _classified_sql(doubt: str) -> str:
    other = "CASE WHEN k % 5 <> 0 AND n < 2 THEN n || ' bedroom' WHEN district = 'EH99' THEN 'district EH99' END"
    return f"WITH {_SEEN}, r AS (SELECT *, CASE WHEN seen AND k % 11 = 0 THEN 'district EH99' WHEN NOT seen AND NOT (active AND {doubt}) THEN 'no longer listed' ELSE {other} END AS why FROM s) SELECT k, why AS excluded, CASE WHEN k % 5 = 0 THEN 'plot' END AS kind, CASE WHEN seen THEN '2026-09-01' ELSE '2026-01-01' END AS last_seen, why IS NULL AS active FROM r"


@query(_classified_sql("false"))
def classified_complete(spark, sf_dir):
    return _classified(spark, sf_dir, True, None)


@query(_classified_sql("true"))
def classified_incomplete(spark, sf_dir):
    return _classified(spark, sf_dir, False, None)


@query(_classified_sql("coalesce(district = 'EH28', false)"))
def classified_unsure_district(spark, sf_dir):
    return _classified(spark, sf_dir, True, spark.createDataFrame([("EH28",), ("EH28",)], "district string"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 10 = 2 THEN 'not a home or plot' WHEN p_partkey % 10 = 3 THEN CASE WHEN p_partkey % 4 = 0 THEN 'district EH99' END WHEN p_size < 2 THEN p_size || ' bedroom' WHEN p_partkey % 4 = 0 THEN 'district EH99' END AS excluded FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 10 <> 1")
def lot_lifecycle(spark, sf_dir):
    k = F.col("k")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("bedrooms"))
    lots = p.withColumns({
        "seen": F.when(k % 10 != 0, True), "auction": F.struct(F.when(k % 10 == 1, F.date_sub(today(), 1)).when(k % 10 == 4, today()).alias("date")), "not_a_home": F.when(k % 20 == 2, True), "address": F.when(k % 20 == 12, "Lock-up 5").otherwise("5 High Street"),
        "kind": F.when(k % 10 == 3, "plot"), "title": F.lit("House at auction"), "property_type": F.lit("house"), "district": F.when(k % 4 == 0, "EH99").otherwise("EH1"),
    })
    return S.lot_lifecycle(lots, today(), True, _RULES).select("k", "excluded")


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN 'EH1' ELSE 'EH28' END AS district, count(*) AS n FROM part GROUP BY 1")
def district_members(spark, sf_dir):
    from placeframe.plans.refresh import regions

    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, "EH1").otherwise("EH28").alias("district"))
    return p.join(regions(spark), "district").groupBy("district").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r(region, n) AS (VALUES ('Edinburgh', 20), ('Midlothian', 8), ('East Lothian', 9), ('West Lothian', 5), ('Fife', 2)) SELECT c_mktsegment AS segment, region, (n * count(*))::BIGINT AS n FROM r, customer GROUP BY c_mktsegment, region, n")
def region_of_district(spark, sf_dir):
    """Every customer looks at every district."""
    from placeframe.plans.refresh import regions

    every = [r[0] for r in regions(spark).select("district").distinct().collect()]
    looks = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("segment"), F.explode(F.array(*map(F.lit, every))).alias("district"))
    return looks.join(F.broadcast(regions(spark)), "district").groupBy("segment", "region").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- certificates

#: Certificates of the customers' homes: two or three for most, of other days, areas and bands; some of a neighbour.
_CERTS = "c AS (SELECT c_custkey AS k, 'EH' || (c_custkey % 9) || ' 1AB' AS postcode, c_custkey || ' Sample Road' AS address FROM customer), e AS (SELECT k, postcode, v.* FROM c, (VALUES ('2024-06-12', 100, 'C'), ('2019-01-01', 80, 'D'), ('2026-01-01', 60, 'A')) v(day, area, band) WHERE NOT (v.day = '2026-01-01' AND k % 3 <> 0) AND k % 7 <> 0)"


def _certificates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    code = F.concat(F.lit("EH"), (F.col("k") % 9).cast("string"), F.lit(" 1AB"))
    days = F.array(*[F.struct(F.lit(d).alias("date"), F.lit(a).alias("floor_area_m2"), F.lit(b).alias("band")) for d, a, b in (("2024-06-12", 100, "C"), ("2019-01-01", 80, "D"), ("2026-01-01", 60, "A"))])
    certs = c.where("k % 7 <> 0").select("k", code.alias("postcode"), F.explode(days).alias("v")).where("not (v.date = '2026-01-01' and k % 3 <> 0)")
    certs = certs.select("postcode", F.concat(F.col("k").cast("string"), F.lit(" SAMPLE RD, Edinburgh")).alias("address"), "v.floor_area_m2", "v.band", "v.date")
    other = c.select(code.alias("postcode"), F.concat(F.col("k").cast("string"), F.lit(" Other Street")).alias("address"), F.lit(999).alias("floor_area_m2"), F.lit("G").alias("band"), F.lit("2026-08-01").alias("date"))
    homes = c.select(F.col("k").cast("string").alias("id"), F.concat(F.col("k").cast("string"), F.lit(" Sample Road")).alias("address"), F.concat(F.lit("eh"), (F.col("k") % 9).cast("string"), F.lit("  1ab")).alias("postcode"), F.when(F.col("k") % 2 == 0, 50).alias("floor_area_m2"))
    return homes, certs.unionByName(other)


@query(f"WITH {_CERTS}, b AS (SELECT k, max((day, area, band)) AS best FROM e GROUP BY k) SELECT k::VARCHAR AS id, struct_extract(best, 3) AS band, struct_extract(best, 1) AS day, CASE WHEN k % 2 = 0 THEN 50 ELSE struct_extract(best, 2) END::INT AS area, CASE WHEN k % 2 = 1 AND best IS NOT NULL THEN 'EPC' END AS source FROM c LEFT JOIN b USING (k)")
def certificate_match(spark, sf_dir):
    out = linkage.apply_certificates(*_certificates(spark, sf_dir))
    return out.select("id", F.col("epc.band").alias("band"), F.col("epc.date").alias("day"), F.col("floor_area_m2").alias("area"), F.col("floor_area_source").alias("source"))


@query(answers(area=("INT", ["n + 100", "NULL", "NULL", "34"]), band=("VARCHAR", ["'C'", "'D'", "NULL", "'A'"]), place=("VARCHAR", ["n || ' High St'", "'1 Mill Lane Flat 2'", "''", "'x'"])) + " WHERE id % 5 <> 4")
def certificate_rows(spark, sf_dir):
    df = cases(spark, sf_dir, address1=["{n} High St", " 1 Mill Lane", None, "x"], address2=["", "Flat 2 ", None, None], floor_area=["", "10", "many", "34.2"], band=[" c", "D", "Z", "A+"], date=["2024-06-12T00:00"] * 4)
    df = df.withColumns({"postcode": F.when(F.col("id") % 5 == 4, "EH99 1AA").otherwise("eh1  1ab"), "floor_area": F.when(F.col("id") % 4 == 0, (F.col("n") + 100).cast("string")).otherwise(F.col("floor_area"))})
    # The key travels in the date, as certificates have no id.
    out = linkage.certificates(df.withColumn("date", F.lpad(F.col("id").cast("string"), 10, "0")), ["EH1"])
    return out.select(F.col("date").cast("long").alias("id"), F.col("floor_area_m2").alias("area"), "band", F.col("address").alias("place"))


# ---------------------------------------------------------------- duplicates

HOMES = "id string, address string, postcode string, price int, bedrooms int, url string, source string, auction struct<house:string,date:date,basis:string>, first_seen date, price_history array<struct<date:date,price:int>>"


def _home(i, address, postcode, price, source=None, beds=3, day=None, seen=1):
    at = dt.date(2026, 1, seen)
    return (i, address, postcode, price, beds, f"u{i}", source, ("House", day and dt.date(2026, 10, day), "Guide price") if source else None, at, [(at, price)])


def crowd(spark):
    """Every way in which two records of a postcode may relate."""
    rows = [
        _home("100", "70 Kingston Avenue, Edinburgh", "EH16 5SW", 400), _home("101", "70 Kingston Avenue", "EH16 5SW", 390, seen=20), _home("auc-1", "70 and 70a Kingston Avenue", "EH16 5SW", 300, "auction"),
        _home("200", "Rose Cottage, Main Street", "EH27 8AA", 250, beds=2), _home("auc-2", "Rose Cottage, Main Street, Kirknewton", "EH27 8AA", 200, "auction", beds=2), _home("auc-3", "Rose Cottage, Main Street", "EH27 8AA", 210, "auction", beds=4),
        _home("300", "1 High Street", "EH1 1AA", 500), _home("301", "1 Other Road", "EH1 1AA", 510), _home("302", "1a High Street", "EH1 1AA", 520), _home("303", "1 High Street", "EH1 1AB", 530),
        _home("auc-4", "9 Mill Lane", "EH2 1AA", 100, "auction", day=20), _home("auc-5", "9 Mill Lane", "EH2 1AA", 110, "auction", day=10), _home("auc-6", "9 and 11 Mill Lane", "EH2 1AA", 120, "auction", day=5),
        _home("9", "2 Quay", "EH3 1AA", 600), _home("10", "2 Quay", "EH3 1AA", 610, seen=2), _home("11", "2 Quay, Edinburgh", "EH3 1AA", 620, seen=3), _home("x1", "4 Quay", "EH3 1AA", 630, seen=5), _home("x2", "4 Quay", "EH3 1AA", 640, seen=4),
        _home("601", "8 Green", "EH5 1AA", 901), _home("602", "8 Green", "EH5 1AA", 902, seen=2), _home("603", "8 Green", "EH5 1AA", 903, seen=3), _home("auc-8", "8 Green", "EH5 1AA", 77, "auction"),
        _home("400", "3 Park", "", 700), _home("401", "3 Park", "", 710), _home("500", "The Fulton, Edgelaw View", "EH4 1AA", 800), _home("501", "The Fulton, Edgelaw View", "EH4 1AA", 810),
    ]
    return spark.createDataFrame(rows, HOMES)


_KEPT_HOMES = [
    # id, relisted, prices of the series, first seen, attached auctions, lots it is in, listings it overlaps
    ("101", True, "400,390", 1, 0, 1, 0), ("auc-1", None, "300", 1, 0, 0, 1), ("200", None, "250", 1, 1, 0, 0), ("auc-3", None, "210", 1, 0, 0, 0),
    ("300", None, "500", 1, 0, 0, 0), ("301", None, "510", 1, 0, 0, 0), ("302", None, "520", 1, 0, 0, 0), ("303", None, "530", 1, 0, 0, 0),
    ("auc-5", None, "110", 1, 1, 0, 0), ("auc-6", None, "120", 1, 0, 0, 0), ("11", True, "600,610,620", 1, 0, 0, 0), ("x1", True, "640,630", 4, 0, 0, 0),
    ("603", True, "901,902,903", 1, 1, 0, 0),
    ("400", None, "700", 1, 0, 0, 0), ("401", None, "710", 1, 0, 0, 0), ("500", None, "800", 1, 0, 0, 0), ("501", None, "810", 1, 0, 0, 0),
]


#: Each customer has the whole crowd in postcodes of its own.
_OWN = "CASE WHEN regexp_matches({0}, '^[0-9]+$') THEN (c_custkey * 1000 + try_cast({0} AS BIGINT))::VARCHAR ELSE {0} || '-' || c_custkey END"


def _crowds(spark, sf_dir):
    own = lambda c: F.when(c.rlike("^[0-9]+$"), (F.col("c_custkey") * 1000 + c.try_cast("bigint")).cast("string")).otherwise(F.concat(c, F.lit("-"), F.col("c_custkey").cast("string")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a few MB of customers are one task
    made = table(spark, sf_dir, "customer").select("c_custkey").repartition(tasks, "c_custkey").crossJoin(F.broadcast(crowd(spark)))  # thirty rows
    return made.withColumns({"id": own(F.col("id")), "postcode": F.when(F.col("postcode") == "", "").otherwise(F.concat("postcode", F.lit(" "), F.col("c_custkey").cast("string")))}).drop("c_custkey")


@query(f"SELECT {_OWN.format('id')} AS id, relisted, series, seen, auctions, lots, overlapping FROM customer, ({literal({'id': 'VARCHAR', 'relisted': 'BOOLEAN', 'series': 'VARCHAR', 'seen': 'INT', 'auctions': 'INT', 'lots': 'INT', 'overlapping': 'INT'}, _KEPT_HOMES)}) v")
def duplicate_homes(spark, sf_dir):
    out = linkage.resolve_duplicates(_crowds(spark, sf_dir))
    some = lambda c: F.coalesce(F.size(c), F.lit(0))
    prices = F.concat_ws(",", F.transform("price_history", lambda h: h["price"].cast("string")))
    return out.select("id", "relisted", prices.alias("series"), F.dayofmonth("first_seen").alias("seen"), some("also_auction").alias("auctions"), some("in_auction_lot").alias("lots"), some("overlaps_listing").alias("overlapping"))


@query(f"SELECT {_OWN.format('id')} AS id, house, price, url, address FROM customer, ({literal({'id': 'VARCHAR', 'house': 'VARCHAR', 'price': 'INT', 'url': 'VARCHAR', 'address': 'VARCHAR'}, [('200', 'House', 200, 'uauc-2', 'Rose Cottage, Main Street, Kirknewton'), ('auc-5', 'House', 100, 'uauc-4', '9 Mill Lane'), ('101', 'House', 300, 'uauc-1', '70 and 70a Kingston Avenue'), ('auc-1', None, 390, 'u101', '70 Kingston Avenue'), ('603', 'House', 77, 'uauc-8', '8 Green')])}) v")
def duplicate_references(spark, sf_dir):
    out = linkage.resolve_duplicates(_crowds(spark, sf_dir))
    kind = out.schema["also_auction"].dataType
    lots = out.select("id", F.explode(F.concat(F.coalesce("also_auction", F.array().cast(kind)), F.coalesce("in_auction_lot", F.array().cast(kind)))).alias("r")).select("id", "r.house", "r.price", "r.url", "r.address")
    homes = out.select("id", F.explode("overlaps_listing").alias("r")).select("id", F.lit(None).cast("string").alias("house"), "r.price", "r.url", "r.address")
    return lots.unionByName(homes)


@query("SELECT c_custkey::VARCHAR AS id, (c_custkey + 1 - c_custkey % 3) AS pair FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey + 1 NOT IN (SELECT c_custkey FROM customer)")
def relisted_homes(spark, sf_dir):
    """Customers k and k + 1 (k % 3 = 1) share an address: the greater id stays."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer")
    pair = k + 1 - k % 3
    number = F.when(k % 3 == 0, k).otherwise(pair)
    homes = c.select(k.cast("string").alias("id"), F.concat(number.cast("string"), F.when(k % 3 == 0, " Solo Road").otherwise(" Pair Road")).alias("address"), F.concat(F.lit("EH"), (F.col("c_nationkey") * 0 + pair % 50).cast("string"), F.lit(" 1AA")).alias("postcode"), F.lit(1).alias("price"), F.lit(3).alias("bedrooms"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("struct<house:string,date:date,basis:string>").alias("auction"), today().alias("first_seen"), F.array(F.struct(today().alias("date"), F.lit(1).alias("price"))).alias("price_history"))
    return linkage.resolve_duplicates(homes).select("id", (F.col("id").cast("long") + 1 - F.col("id").cast("long") % 3).alias("pair"))


# ---------------------------------------------------------------- positions


def _rings(spark):
    square = lambda w, s, e, n, turn=1: [(w, s), (w, n), (e, n), (e, s), (w, s)][::turn]
    rows = [(0, [square(-3.6, 55.7, -3.2, 56.1), square(-3.5, 55.8, -3.3, 56.0, -1)]), (1, [square(-3.1, 55.7, -2.9, 55.9, -1)]), (2, [square(-2.8, 55.7, -2.6, 55.9), square(-2.8, 56.0, -2.6, 56.1), [(-2.7, 55.75), (-2.65, 55.75), (-2.7, 55.75)]])]
    raw = spark.createDataFrame(rows, "feature_id int, rings array<array<struct<x:double,y:double>>>")
    return raw.select("feature_id", spatial.polygons_from_rings(F.col("rings")).alias("polys"))


_OFF = f"(SELECT k, lat + 0.000031 AS lat, lng + 0.000017 AS lng FROM ({_POINTS}))"


@query(f"SELECT k, CASE WHEN lng BETWEEN -3.6 AND -3.2 AND lat BETWEEN 55.7 AND 56.1 THEN 0 WHEN lng BETWEEN -3.1 AND -2.9 AND lat BETWEEN 55.7 AND 55.9 THEN 1 ELSE 2 END::INT AS feature_id FROM {_OFF} WHERE (lng BETWEEN -3.6 AND -3.2 AND lat BETWEEN 55.7 AND 56.1 AND NOT (lng BETWEEN -3.5 AND -3.3 AND lat BETWEEN 55.8 AND 56.0)) OR (lng BETWEEN -3.1 AND -2.9 AND lat BETWEEN 55.7 AND 55.9) OR (lng BETWEEN -2.8 AND -2.6 AND (lat BETWEEN 55.7 AND 55.9 OR lat BETWEEN 56.0 AND 56.1))")
def rings_with_holes(spark, sf_dir):
    p = points(spark, sf_dir).withColumns({"lat": F.col("lat") + 0.000031, "lng": F.col("lng") + 0.000017})
    return spatial.point_in_polygon(p, _rings(spark), boundary="half_open").select("k", "feature_id")


_PLACES = {"inside": (0.1, 0.1), "right side": (1.0, 0.5), "left side": (0.0, 0.5), "corner": (1.0, 1.0), "hole side": (0.25, 0.5), "hole right side": (0.75, 0.5), "hole": (0.5, 0.5), "outside": (1.5, 0.5)}


@query(f"SELECT mode, p.k, point FROM ({turns_sql({'point': 'VARCHAR'}, [(n,) for n in _PLACES])}) p JOIN (VALUES ('closed', ['inside', 'right side', 'left side', 'corner', 'hole side', 'hole right side']), ('half_open', ['inside', 'left side', 'hole right side'])) m(mode, hits) ON list_contains(hits, point)")
def boundary_modes(spark, sf_dir):
    """A square with a hole, and customers at its sides."""
    ring = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n), (w, s)]
    layer = spark.createDataFrame([(0, [[ring(0.0, 0.0, 1.0, 1.0), ring(0.25, 0.25, 0.75, 0.75)]])], "feature_id int, polys array<array<array<struct<x:double,y:double>>>>")
    pts = turns(spark, sf_dir, [(n, x, y) for n, (x, y) in _PLACES.items()], "point string, lng double, lat double").drop("turn")
    out = [spatial.point_in_polygon(pts, layer, boundary=m).select(F.lit(m).alias("mode"), "k", "point") for m in ("closed", "half_open")]
    return out[0].unionByName(out[1])


@query(f"WITH h AS (SELECT k, x.i AS zone FROM {_OFF} p, (SELECT i::INT AS i, -3.9 + i * 0.2 AS w, -3.9 + i * 0.2 + 0.3 AS e FROM range(8) r(i)) x WHERE lng BETWEEN w AND e AND lat BETWEEN 55.6 AND 56.3) SELECT p.k, 'zone ' || min(zone) AS dz FROM {_OFF} p LEFT JOIN h USING (k) GROUP BY p.k")
def first_zone(spark, sf_dir):
    ring = lambda w, e: [(w, 55.6), (e, 55.6), (e, 56.3), (w, 56.3), (w, 55.6)]
    zones = spark.createDataFrame([(i, f"zone {i}", [[ring(-3.9 + i * 0.2, -3.9 + i * 0.2 + 0.3)]]) for i in range(8)], "feature_id int, dz string, polys array<array<array<struct<x:double,y:double>>>>")
    p = points(spark, sf_dir).withColumns({"lat": F.col("lat") + 0.000031, "lng": F.col("lng") + 0.000017})
    return spatial.first_hit(p, zones, "k", "feature_id", ["dz"], "simd").select("k", "simd.dz")


@query(f"SELECT 'zone ' || k AS name FROM ({_POINTS}) WHERE -3.05 >= lng AND -3.05 < lng + 0.4 AND 55.9 >= lat AND 55.9 < lat + 0.3")
def layers_at_point(spark, sf_dir):
    """A zone per customer."""
    at = lambda dx, dy: F.struct((F.col("lng") + dx).alias("x"), (F.col("lat") + dy).alias("y"))
    zones = points(spark, sf_dir).select(F.concat(F.lit("zone "), F.col("k").cast("string")).alias("name"), F.array(F.array(F.array(at(0.0, 0.0), at(0.4, 0.0), at(0.4, 0.3), at(0.0, 0.3)))).alias("polys"))
    return spatial.at_point(zones, -3.05, 55.9, boundary="half_open").select("name")


@query("SELECT id, price FROM (SELECT p_partkey::VARCHAR AS id, floor(p_retailprice)::INT AS price, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey DESC) AS r FROM part) WHERE r = 1")
def newest_of_brand(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_retailprice", "p_partkey")
    return stats.newest_per_key(p, "p_brand", "p_retailprice", "p_partkey").select(F.col("p_partkey").cast("string").alias("id"), F.floor("p_retailprice").cast("int").alias("price"))
