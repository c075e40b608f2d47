"""Timetables: service days, hops, footpaths, latest departures and journeys."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from placeframe.config import TRAVEL
from placeframe.operators import transit
from placeframe.registry import query, table
from placeframe.session import materialise

# ---------------------------------------------------------------- service days: a service per supplier, exceptions from events

_DAYS = "days AS (SELECT (DATE '2026-09-01' + i::INT) AS day FROM range(1, 15) r(i)), s AS (SELECT s_suppkey AS k, strftime(DATE '2026-08-25' + (s_suppkey % 14)::INT, '%Y%m%d') AS a, strftime(DATE '2026-09-08' + (s_suppkey % 9)::INT, '%Y%m%d') AS b FROM supplier)"
#: A service runs on weekday w (0: Monday) if bit w of its key is set.
_BASE = "base AS (SELECT day, k FROM days JOIN s ON strftime(day, '%Y%m%d') BETWEEN a AND b WHERE (k >> (isodow(day) - 1)) % 2 = 1)"
_LAST = "x AS (SELECT k, day, event_id, event_id % 3 <> 0 AS adds FROM (SELECT 1 + user_id % (SELECT count(*) FROM supplier) AS k, DATE '2026-09-01' + (event_id % 16)::INT AS day, event_id FROM events)), last AS (SELECT day, k, arg_max(adds, event_id) AS adds FROM x JOIN days USING (day) GROUP BY day, k)"
_ACTIVE = f"{_DAYS}, {_BASE}, {_LAST}, active AS (SELECT coalesce(base.day, last.day) AS day, coalesce(base.k, last.k) AS k FROM base FULL JOIN last ON base.day = last.day AND base.k = last.k WHERE coalesce(last.adds, true))"


def _services(spark: SparkSession, sf_dir: str):
    k = F.col("s_suppkey")
    day = lambda start, step: F.date_format(F.date_add(F.lit(start).cast("date"), (k % step).cast("int")), "yyyyMMdd")
    runs = [F.when(F.expr(f"shiftright(s_suppkey, {i})") % 2 == 1, "1").otherwise("0").alias(w) for i, w in enumerate(transit.WEEKDAYS)]
    calendar = table(spark, sf_dir, "supplier").select(k.cast("string").alias("service_id"), *runs, day("2026-08-25", 14).alias("start_date"), day("2026-09-08", 9).alias("end_date"))
    n = calendar.count()
    e = table(spark, sf_dir, "events").select((1 + F.col("user_id") % n).cast("string").alias("service_id"), F.date_format(F.date_add(F.lit("2026-09-01").cast("date"), (F.col("event_id") % 16).cast("int")), "yyyyMMdd").alias("date"), F.when(F.col("event_id") % 3 != 0, "1").otherwise("2").alias("exception_type"), F.col("event_id").alias("ord"))
    return calendar, e


@query(f"WITH {_ACTIVE} SELECT day, k::VARCHAR AS service_id FROM active")
def active_services(spark, sf_dir):
    days = spark.range(1, 15).select(F.date_add(F.lit("2026-09-01").cast("date"), F.col("id").cast("int")).alias("day"))
    return transit.active_services(*_services(spark, sf_dir), days)


@query(f"WITH {_ACTIVE} SELECT day, count(DISTINCT k) AS n FROM active WHERE isodow(day) IN (2, 3, 4) GROUP BY day ORDER BY n DESC, day LIMIT 1")
def service_day(spark, sf_dir):
    return transit.pick_service_day(*_services(spark, sf_dir), F.lit("2026-09-01"))


# ---------------------------------------------------------------- trips and hops: a trip per order, its lines the stops

_STOPS = "stops AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 56.5 ELSE 55.85 + (p_partkey * 7919 % 2000)::DOUBLE / 10000.0 END AS lat, -3.4 + (p_partkey * 104729 % 4000)::DOUBLE / 10000.0 AS lng FROM part)"


def _stops(spark, sf_dir):
    k = F.col("p_partkey")
    lat = F.when(k % 4 == 0, 56.5).otherwise(55.85 + F.pmod(k * 7919, F.lit(2000)) / 10_000.0)
    return table(spark, sf_dir, "part").select(k.cast("string").alias("stop_id"), F.col("p_name").alias("stop_name"), lat.cast("string").alias("stop_lat"), (-3.4 + F.pmod(k * 104_729, F.lit(4000)) / 10_000.0).cast("string").alias("stop_lon"))


def _trips(spark, sf_dir):
    o = F.col("l_orderkey")
    t = 21_600 + F.pmod(o * 131, F.lit(14_400)) + F.col("l_linenumber") * 120
    two = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    clock = lambda s: F.concat_ws(":", two(s / 3600), two(s / 60 % 60), two(s % 60))
    times = table(spark, sf_dir, "lineitem").select(o.cast("string").alias("trip_id"), F.col("l_partkey").cast("string").alias("stop_id"), F.col("l_linenumber").cast("string").alias("stop_sequence"), F.when(F.col("l_linenumber") != 3, clock(t)).otherwise("").alias("arrival_time"), F.when(F.col("l_linenumber") != 5, clock(t + 20)).alias("departure_time"))
    running = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("trip_id"), F.concat(F.lit("R"), (F.col("o_orderkey") % 9).cast("string")).alias("route"))
    return materialise(times, "timetable"), running


_LO, _HI = transit.window_of(TRAVEL)
_HOPS = f"{_STOPS}, t AS (SELECT l_orderkey AS trip, l_partkey AS stop, l_linenumber AS seq, 21600 + l_orderkey * 131 % 14400 + l_linenumber * 120 AS t FROM lineitem), c AS (SELECT trip, stop, seq, CASE WHEN seq = 3 THEN t + 20 ELSE t END AS arr, CASE WHEN seq = 5 THEN t ELSE t + 20 END AS dep FROM t JOIN stops ON stops.k = t.stop WHERE lat < 56.08), h AS (SELECT trip, row_number() OVER w AS seq, stop AS u, dep, lead(stop) OVER w AS v, lead(arr) OVER w AS arr FROM c WHERE dep >= {_LO - 3600} AND arr <= {_HI} WINDOW w AS (PARTITION BY trip ORDER BY seq, arr, dep, stop::VARCHAR))"


@query(f"WITH {_HOPS} SELECT trip::VARCHAR AS trip, u::VARCHAR AS u, v::VARCHAR AS v, dep::INT AS dep, arr::INT AS arr, 'R' || (trip % 9) AS route FROM h WHERE u <> v AND arr >= dep AND dep BETWEEN {_LO} AND {_HI}")
def consecutive_hops(spark, sf_dir):
    stops = transit.stops_in_area(_stops(spark, sf_dir))
    hops = transit.connections(*_trips(spark, sf_dir), stops)
    name = lambda c: stops.select(F.col("stop").alias(c), F.col("stop_id").alias(f"{c}_id"))
    return hops.join(name("u"), "u").join(name("v"), "v").select("trip", F.col("u_id").alias("u"), F.col("v_id").alias("v"), "dep", "arr", "route")


@query("SELECT o_orderkey::VARCHAR AS trip_id, CASE WHEN o_orderkey % 7 = 6 THEN '?' WHEN o_orderkey % 7 = 0 THEN 'Tram' WHEN o_orderkey % 7 < 4 THEN 'S' || (o_orderkey % 7) WHEN o_orderkey % 7 = 4 THEN 'Long 4' ELSE '5' END AS route FROM orders WHERE o_custkey % 3 < 2")
def trip_routes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    trips = o.select((F.col("o_orderkey") % 7).cast("string").alias("route_id"), (F.col("o_custkey") % 3).cast("string").alias("service_id"), F.col("o_orderkey").cast("string").alias("trip_id"))
    routes = spark.createDataFrame([(str(i), f"S{i}" if i < 4 else "", "Long 4" if i == 4 else "", "0" if i == 0 else "3") for i in range(6)], "route_id string, route_short_name string, route_long_name string, route_type string")
    return transit.trip_routes(trips, routes, spark.createDataFrame([("0",), ("1",), ("1",)], "service_id string"))


_METRES = "2 * 6371000.0 * asin(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lng) - radians(a.lng)) / 2), 2)))"


@query(f"WITH {_STOPS} SELECT a.k::VARCHAR AS u, b.k::VARCHAR AS x, round({_METRES} * 1.3 / (4.8 / 3.6), 2) AS walk_s FROM stops a, stops b WHERE a.k <> b.k AND a.lat < 56.08 AND b.lat < 56.08 AND {_METRES} <= 300")
def footpaths(spark, sf_dir):
    stops = transit.stops_in_area(_stops(spark, sf_dir))
    near = transit.footpaths(stops, also=("stop_id",), digits=2)
    return near.select(F.col("u_stop_id").alias("u"), F.col("x_stop_id").alias("x"), "walk_s")


@query(f"WITH {_STOPS} SELECT a.k::VARCHAR AS stop_id, round({_METRES} * 1.3 / (4.8 / 3.6), 2) AS walk_s FROM stops a, (SELECT 55.95196 AS lat, -3.18992 AS lng) b WHERE {_METRES} <= 2000")
def stops_near_destination(spark, sf_dir):
    stops = transit.stops_in_area(_stops(spark, sf_dir))
    return transit.to_destination(stops, replace(TRAVEL, destination_radius_m=2000)).join(stops, "stop").select("stop_id", F.round("walk_s", 2).alias("walk_s"))


# ---------------------------------------------------------------- latest departures: all hops of the morning, destination within 2 km

_W = "1.3 / (4.8 / 3.6)"
_LATER = "(b.dep, b.arr, b.seq, -b.u, -b.v) <= (a.dep, a.arr, a.seq, -a.u, -a.v)"
#: Rides that lead on to others; those from which the destination is reached in time; each stop's best; each trip's last catch and when that arrives.
_LABELS = f"""{_HOPS}, hop AS (SELECT row_number() OVER () AS id, trip, seq, u, v, dep, arr FROM h WHERE u <> v AND arr >= dep AND dep BETWEEN {_LO} AND {_HI}),
foot AS (SELECT a.k AS u, b.k AS x, {_METRES} * {_W} AS s FROM stops a, stops b WHERE a.k <> b.k AND a.lat < 56.08 AND b.lat < 56.08 AND {_METRES} <= 300),
around AS (SELECT u, x, s FROM foot UNION ALL SELECT k, k, 0 FROM stops), dest AS (SELECT a.k, {_METRES} * {_W} AS s FROM stops a, (SELECT 55.95196 AS lat, -3.18992 AS lng) b WHERE {_METRES} <= 2000),
target AS (SELECT 30600 + 600 * i AS target FROM range(5) r(i)),
leads AS (SELECT a.id AS later, b.id AS id FROM hop a JOIN hop b USING (trip) WHERE a.id <> b.id AND {_LATER} UNION ALL SELECT a.id, b.id FROM hop a JOIN around ON around.u = a.u JOIN hop b ON b.v = around.x WHERE a.dep - around.s >= b.arr + 60),
ok AS (SELECT target, hop.id FROM hop JOIN dest ON dest.k = hop.v, target WHERE arr + s <= target AND dep <= target UNION SELECT target, leads.id FROM ok JOIN leads ON leads.later = ok.id),
offer AS (SELECT target, around.x AS stop, dep - around.s AS latest, trip, seq, u, v, dep, arr FROM ok JOIN hop USING (id) JOIN around USING (u)),
label AS (SELECT * FROM offer QUALIFY row_number() OVER (PARTITION BY target, stop ORDER BY latest DESC, dep DESC, arr DESC, seq DESC, u, v, trip::VARCHAR DESC) = 1),
catch AS (SELECT ok.target, hop.trip, CASE WHEN hop.arr + dest.s <= ok.target THEN hop.arr + dest.s END AS reach, label.trip AS next FROM ok JOIN hop USING (id) LEFT JOIN dest ON dest.k = hop.v LEFT JOIN label ON label.target = ok.target AND label.stop = hop.v AND label.latest >= hop.arr + 60
  WHERE hop.arr + dest.s <= ok.target OR label.trip IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ok.target, hop.trip ORDER BY hop.dep DESC, hop.arr DESC, hop.seq DESC, hop.u, hop.v) = 1),
reach AS (SELECT target, trip, reach FROM catch WHERE reach IS NOT NULL UNION ALL SELECT catch.target, catch.trip, reach.reach FROM reach JOIN catch ON catch.target = reach.target AND catch.next = reach.trip AND catch.reach IS NULL),
best AS (SELECT target, stop, latest, reach AS arrival, 'R' || (trip % 9) AS route, u AS board FROM label JOIN reach USING (target, trip))"""


def network(spark, sf_dir):
    """Stops, and when to leave them."""
    near = replace(TRAVEL, destination_radius_m=2000)
    stops = materialise(transit.with_places(transit.stops_in_area(_stops(spark, sf_dir))), "stops")
    hops = transit.connections(*_trips(spark, sf_dir), stops)
    return stops, transit.latest_departures(hops, transit.place_paths(stops), transit.to_destination(stops, near), near, stops)


@query(f"WITH RECURSIVE {_LABELS} SELECT target::INT AS target, stop::VARCHAR AS stop_id, round(latest, 3)::DOUBLE AS latest, round(arrival, 3)::DOUBLE AS arrival, route, board::VARCHAR AS board FROM best")
def reverse_scan(spark, sf_dir):
    stops, labels = network(spark, sf_dir)
    boards = stops.select(F.col("stop").alias("board_stop"), F.col("stop_id").alias("board"))
    return labels.join(stops.select("stop", "stop_id"), "stop").join(boards, "board_stop").select("target", "stop_id", F.round("latest", 3).alias("latest"), F.round("arrival", 3).alias("arrival"), "route", "board")


_HOMES = "homes AS (SELECT c_custkey AS id, 55.80 + ((c_custkey * 7919) % 2800)::DOUBLE / 10000.0 AS lat, -3.66 + ((c_custkey * 104729) % 11800)::DOUBLE / 10000.0 AS lng FROM customer)"


def _homes(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (55.80 + F.pmod(k * 7919, F.lit(2800)) / 10_000.0).alias("lat"), (-3.66 + F.pmod(k * 104_729, F.lit(11_800)) / 10_000.0).alias("lng"))


_JOURNEY = f"""WITH RECURSIVE {_HOMES}, {_LABELS}, name AS (SELECT p_partkey AS stop, p_name AS name FROM part),
access AS (SELECT a.id, b.k AS stop, {_METRES} AS m FROM homes a, stops b WHERE b.lat < 56.08 AND {_METRES} <= 1200), options AS (SELECT id, target, latest - m * {_W} AS leave, arrival, m, route, board, stop FROM access JOIN best USING (stop)),
per AS (SELECT id, target, arg_max(arrival - leave, leave) AS took, arg_max(m, leave) AS m, arg_max(route, leave) AS route, arg_max(board, leave) AS board FROM options GROUP BY id, target),
pt AS (SELECT id, avg(took) / 60 AS pt, arg_min('Walk ' || round_even(m * {_W} / 60, 0)::INT || ' min to ' || name || ', then bus ' || route, target) AS how FROM per JOIN name ON name.stop = board GROUP BY id),
station AS (SELECT * FROM (VALUES (0, 'Hill', 55.97, -3.30, 12, 4), (1, 'Shore', 55.94, -3.07, 9, 2)) v(ord, name, lat, lng, minutes, per_hour)),
near AS (SELECT a.id, b.*, {_METRES} AS m FROM homes a, station b WHERE {_METRES} <= 2500), rail AS (SELECT id, min(m * {_W} / 60 + 30.0 / per_hour + minutes) AS rail, arg_min('Walk ' || round_even(m * {_W} / 60, 0)::INT || ' min to ' || name || ' station, then train', m * {_W} / 60 + 30.0 / per_hour + minutes) AS rail_how FROM near GROUP BY id),
walk_all AS (SELECT a.id, {_METRES} AS m FROM homes a, (SELECT 55.95196 AS lat, -3.18992 AS lng) b), j AS (SELECT id, m, m * {_W} / 60 AS walk, pt, how, rail, rail_how FROM walk_all LEFT JOIN pt USING (id) LEFT JOIN rail USING (id))
SELECT id, round_even(walk, 0)::INT AS walk_min, round_even(m * 1.3 / (15 / 3.6) / 60, 0)::INT AS cycle_min, round_even(m / 1000, 1)::DOUBLE AS km, round_even(pt, 0)::INT AS pt_min, how AS pt_how, round_even(rail, 0)::INT AS rail_min, rail_how, round_even(least(walk, pt, rail), 0)::INT AS best_min, CASE least(walk, pt, rail) WHEN walk THEN 'Walk' WHEN pt THEN how ELSE rail_how END AS best_how FROM j"""


@query(_JOURNEY)
def journey(spark, sf_dir):
    stops, profiles = network(spark, sf_dir)
    stations = spark.createDataFrame([(0, "Hill", 55.97, -3.30, 12, 4), (1, "Shore", 55.94, -3.07, 9, 2)], "ord int, name string, lat double, lng double, minutes int, trains_per_hour int")
    return transit.journeys(_homes(spark, sf_dir), profiles=profiles, stops=stops, stations=stations).select("id", "travel.*")


@query(f"WITH {_HOMES}, w AS (SELECT a.id, round_even({_METRES} * {_W} / 60, 0)::INT AS walk FROM homes a, (SELECT 55.95196 AS lat, -3.18992 AS lng) b), p AS (SELECT id, walk, CASE WHEN id % 3 = 0 THEN (id % 60)::INT END AS m FROM w) SELECT id, m AS pt_min, CASE WHEN m < walk THEN m ELSE walk END AS best_min, CASE WHEN m < walk THEN 'bus' ELSE 'Walk' END AS best_how FROM p")
def last_transit_kept(spark, sf_dir):
    homes = transit.journeys(_homes(spark, sf_dir))
    previous = homes.select("id", F.when(F.col("id") % 3 == 0, (F.col("id") % 60).cast("int")).alias("pt_min"), F.lit("bus").alias("pt_how"))
    return transit.keep_last_transit(homes, previous).select("id", "travel.pt_min", "travel.best_min", "travel.best_how")
