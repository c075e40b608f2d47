import datetime as dt

import pytest
from pyspark.sql import functions as F

from placeframe.operators import layers, lines, linkage, saved, search, spatial, state, stats
from placeframe.plans import refresh
from placeframe.sources import files, remote, sinks
from tests.samples import small_network

DAY = F.lit("2026-10-01").cast("date")
NOW = F.lit("2026-10-01 12:00:00").cast("timestamp")
LISTING = (
    "id string, ord int, address string, title string, postcode string, district string, price int, bedrooms int, bathrooms int, floor_area_m2 int, property_type string, detached boolean, garage boolean, "
    "first_seen date, closing_date date, source string, kind string, flags array<string>, price_history array<struct<date:date,price:int>>, auction struct<house:string,date:date,basis:string>, "
    "also_auction array<struct<date:date>>, travel struct<best_min:int>, area struct<vs_pct:int>, simd struct<decile:int>, top_school_rank int, catchment string, catchment_rc string, top_primary boolean, primary string, primary_rc string, region string"
)


def listing(spark, *rows):
    names = [c.strip().split()[0] for c in _split(LISTING)]
    base = {n: None for n in names}
    data = [tuple((base | {"ord": i, "price": 300_000, "travel": (30,), "garage": False, "detached": False} | r)[n] for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, LISTING)


def _split(ddl):
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i])
            at = i + 1
    return [*out, ddl[at:]]


def ids(df):
    return [r["id"] for r in df.collect()]


def test_area_stats_and_comparison(spark):
    rows = [(str(i), "EH10", p, 3) for i, p in enumerate((300_000, 350_000, 400_000, 450_000))] + [("9", "EH10", 600_000, None), ("x", None, 1, 1)]
    df = spark.createDataFrame(rows, "id string, district string, price int, bedrooms int")
    s = stats.area_stats(df)
    got = {(r.district, r.beds): (r["count"], r["median"]) for r in s.collect()}
    assert got == {("EH10", None): (5, 400_000), ("EH10", 3): (4, 375_000)}
    out = {r.id: (r.base, r.basis, r.vs_pct) for r in stats.compare(df, s).collect()}
    assert out["0"] == (375_000, "3-bed", -20) and out["9"] == (400_000, "all", 50) and out["x"] == (None, None, None)
    nested = stats.nested_by_beds(s).first()
    assert nested.by_beds["3"]["count"] == 4


def test_hash_round_trip():
    f = search.FilterSpec(minPrice=250_000, types="semi,detached", hideRejected=False, q="main st", layers={**search.LAYERS, "bus": True})
    assert search.FilterSpec.from_hash("#" + f.to_hash()) == f
    assert search.FilterSpec().to_hash() == "" and search.FilterSpec.from_hash("minBeds=abc&detached=1") == search.FilterSpec(types="detached")
    assert f.active_count() == 4 and search.toggle_in("a,b", "a") == "b"


def test_faceted_predicate(spark):
    df = listing(
        spark, {"id": "a", "bedrooms": 3, "address": "5 Main Street", "flags": ["motivated"], "first_seen": dt.date(2026, 9, 28)},
        {"id": "b", "address": "6 High Street", "price_history": [(dt.date(2026, 1, 1), 320_000), (dt.date(2026, 2, 1), 300_000)]},
        {"id": "c", "kind": "plot", "price": 90_000}, {"id": "d", "source": "auction", "price": 150_000, "bedrooms": 2, "auction": ("H", dt.date(2026, 10, 8), "Guide price")},
    )
    found = lambda h, **kw: sorted(ids(search.search(df, search.FilterSpec.from_hash(h), NOW, **kw)))
    assert found("") == ["a", "b", "d"] and found("show=plots") == ["c"] and found("show=all&maxPrice=160000") == ["c", "d"]
    assert found("minBeds=1") == ["a", "d"] and found("maxBeds=2") == ["b", "d"]
    assert found("q=STREET, main") == ["a"] and found("motivated=1") == ["a"] and found("newOnly=1") == ["a"] and found("reduced=1") == ["b"]
    assert found("saleType=auction") == ["d"] and found("saleType=private") == ["a", "b"]
    lists = spark.createDataFrame([("Rejected", "a"), ("Shortlist", "b")], "list string, id string")
    assert found("", saved=lists) == ["b", "d"] and found("list=Shortlist", saved=lists) == ["b"] and found("list=Rejected", saved=lists) == ["a"]
    order = lambda s: ids(search.search(df, search.FilterSpec.from_hash(f"show=all&sort={s}"), NOW))
    assert order("price_asc") == ["c", "d", "a", "b"] and order("price_desc") == ["a", "b", "d", "c"] and order("soonest")[0] == "d" and order("newest")[0] == "a"


SQUARE = lambda w, s, e, n: [[(w, s), (e, s), (e, n), (w, n), (w, s)]]
POLYS = "array<array<array<struct<x:double,y:double>>>>"


@pytest.mark.parametrize("boundary", ["closed", "half_open"])
def test_the_cover_gives_what_every_edge_gives(spark, boundary):
    import math
    import random

    rng = random.Random(9)
    ring = lambda x, y, r, n: [(x + r * rng.uniform(0.6, 1) * math.cos(2 * math.pi * k / n), y + r * rng.uniform(0.6, 1) * math.sin(2 * math.pi * k / n)) for k in range(n)]
    grid = [(float(x), float(y)) for x, y in ((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4))]
    layer = [(0, [[ring(2, 2, 3, 400), ring(2, 2, 1, 60)]]), (1, [[ring(-3, 1, 1, 30)], [ring(3, -3, 0.7, 9), ring(3, -3, 0.2, 5)]]), (2, [[grid]]), (3, [[[(0.5, 0.5), (0.75, 0.5), (0.75, 0.75)]]]), (4, [[[(1.0, 1.0), (1.0, 1.0)]]]), (5, [])]
    polygons = spark.createDataFrame(layer, "feature_id int, polys array<array<array<struct<x:double,y:double>>>>")
    at = [(rng.uniform(-5, 6), rng.uniform(-5, 6)) for _ in range(600)] + [(x / 4, y / 4) for x in range(-2, 19) for y in range(-2, 19)] + [p for _, polys in layer for rings in polys for r in rings for p in r[:40]] + [(None, 1.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "id int, lng double, lat double")
    edges = polygons.withColumn("e", F.transform("polys", lambda p: F.transform(p, spatial._edges)))
    want = points.join(edges, spatial.contains(F.col("e"), F.col("lng"), F.col("lat"), boundary)).select("id", "feature_id")
    for cell_edges in (12, 3):
        covered = spatial.cover(polygons, cell_edges=cell_edges)
        got = spatial.point_in_polygon(points, polygons, boundary=boundary, covered=covered).select("id", "feature_id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert max(r.n for r in covered.where("feature_id = 0").select(F.aggregate("__rings", F.lit(0), lambda n, r: n + F.size(r["edges"])).alias("n")).collect()) < 40


def test_point_in_polygon_modes(spark):
    layer = spark.createDataFrame([(0, [SQUARE(0.0, 0.0, 0.1, 0.1) + SQUARE(0.04, 0.04, 0.06, 0.06)])], f"feature_id int, polys {POLYS}")
    pts = spark.createDataFrame([(1, 0.01, 0.01), (2, 0.05, 0.05), (3, 0.1, 0.05), (4, 0.0, 0.05), (5, 0.04, 0.05), (6, 0.2, 0.2)], "id int, lng double, lat double")
    assert sorted(ids(spatial.point_in_polygon(pts, layer))) == [1, 3, 4, 5]
    assert sorted(ids(spatial.point_in_polygon(pts, layer, boundary="half_open"))) == [1, 4]
    assert spatial.at_point(layer, 0.01, 0.01).count() == 1


def test_shared_places_are_covered_and_tested_once(spark, tmp_path, monkeypatch):
    from placeframe import queries

    given, cover, pairs = [], spatial.cover, spatial.point_in_polygon

    def covering(polygons, *a, **kw):
        given.append(("shapes", polygons.count()))
        return cover(polygons, *a, **kw)

    def testing(points, *a, **kw):
        given.append(("places", points.count()))
        return pairs(points, *a, **kw)

    monkeypatch.setattr(spatial, "cover", covering)
    shapes = [[SQUARE(0.0, 0.0, 0.4, 0.4) + SQUARE(0.1, 0.1, 0.2, 0.2)], [SQUARE(-0.3, -0.3, 0.2, 0.2)], [SQUARE(0.1, -0.2, 0.3, 0.3), SQUARE(-0.4, 0.1, -0.1, 0.4)]]
    layer = spark.createDataFrame([(i, f"n{i}", shapes[i % 3]) for i in range(24)] + [(30, "none", None), (31, "empty", []), (32, "minus", [SQUARE(-0.0, -0.0, 0.4, 0.4) + SQUARE(0.1, 0.1, 0.2, 0.2)])], f"feature_id int, name string, polys {POLYS}")
    at = [(x / 20, y / 20) for x in range(-9, 10) for y in range(-9, 10)]
    pts = spark.createDataFrame([(i, *at[i % len(at)]) for i in range(2 * len(at))] + [(-1, None, 0.1), (-2, 0.1, None), (-3, -0.0, 0.05)], "id int, lng double, lat double")
    for boundary in ("closed", "half_open"):
        want = pairs(pts, layer, boundary=boundary)
        given.clear()
        monkeypatch.setattr(spatial, "point_in_polygon", testing)
        got = spatial.at_shared_places(pts, layer, boundary=boundary)
        monkeypatch.setattr(spatial, "point_in_polygon", pairs)
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert given == [("shapes", 5), ("places", len(at))]
    # Keys 165,200 apart have one position.
    keys = [k + 165_200 * i for k in range(20) for i in range(2)]
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        spark.createDataFrame([(k,) for k in keys], f"{key} long").write.parquet(f"{tmp_path}/{name}.parquet")
    given.clear()
    rows = {tuple(r) for r in queries.adaptive_cover(spark, str(tmp_path)).collect()}
    assert given == [("shapes", 21)] and {(a, b) for a in keys for b in keys if (a - b) % 165_200 == 0} <= rows
    assert all(((c + 165_200) % 330_400, f) in rows for c, f in rows)


def test_rings_with_holes(spark):
    shell, hole = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0), (0.0, 0.0)], [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 6.0), (3.0, 3.0)]
    df = spark.createDataFrame([([shell, hole],), ([hole],), ([hole[:3]],)], "rings array<array<struct<x:double,y:double>>>")
    got = [r[0] for r in df.select(spatial.polygons_from_rings(F.col("rings"))).collect()]
    assert [len(got[0]), len(got[0][0])] == [1, 2] and len(got[1]) == 1 and got[2] is None


def test_primary_notes(spark):
    rows = [(0, "Canaan Lane Primary", "ND", "P1-P4", 95.0, True), (1, "South Morningside Primary", "ND", "P5-P7", 90.0, True), (2, "St Peter's RC Primary", "RC", None, None, None)]
    layer = spark.createDataFrame([(*r, [SQUARE(-3.3, 55.9, -3.2, 56.0)]) for r in rows], f"feature_id int, school string, sector string, stages string, score double, top boolean, polys {POLYS}")
    r = spatial.primary_catchments(spark.createDataFrame([("1", 55.95, -3.25), ("2", 50.0, 0.0)], "id string, lat double, lng double"), layer).orderBy("id").collect()
    assert r[0].primary == "Canaan Lane Primary" and r[0].primary_note == "P1–P4 only; P5–P7 at South Morningside Primary" and r[0].top_primary and r[0].primary_rc == "St Peter's RC Primary"
    assert r[1].primary is None


HOMES = "id string, address string, postcode string, price int, bedrooms int, url string, source string, auction struct<house:string,date:date,basis:string>, first_seen date, price_history array<struct<date:date,price:int>>"


def home(i, address, source=None, beds=3, postcode="EH16 5SW", date=None, seen="2026-01-01", price=300_000):
    return (i, address, postcode, price, beds, f"u{i}", source, ("House", date and dt.date.fromisoformat(date), "Guide price") if source else None, dt.date.fromisoformat(seen), [(dt.date.fromisoformat(seen), price)])


def resolve(spark, *rows):
    return {r.id: r for r in linkage.resolve_duplicates(spark.createDataFrame(list(rows), HOMES)).collect()}


def test_duplicates(spark):
    got = resolve(spark, home("100", "70 Kingston Avenue"), home("101", "70 Kingston Avenue, Edinburgh", seen="2026-02-01", price=290_000))
    assert list(got) == ["101"] and got["101"].relisted and len(got["101"].price_history) == 2 and got["101"].first_seen == dt.date(2026, 1, 1)
    assert set(resolve(spark, home("100", "70 Kingston Avenue"), home("101", "70a Kingston Avenue"))) == {"100", "101"}
    assert set(resolve(spark, home("100", "70 Kingston Avenue"), home("101", "70 Other Road"))) == {"100", "101"}
    got = resolve(spark, home("100", "70 Kingston Avenue"), home("auc-1", "70 Kingston Avenue", "auction"))
    assert list(got) == ["100"] and got["100"].also_auction[0].house == "House"
    got = resolve(spark, home("100", "70 Kingston Avenue"), home("auc-1", "70 and 70a Kingston Avenue", "auction"))
    assert set(got) == {"100", "auc-1"} and got["100"].in_auction_lot and got["auc-1"].overlaps_listing[0].id == "100"
    got = resolve(spark, home("auc-1", "5 High Street", "auction", date="2026-11-01"), home("auc-2", "5 High Street", "auction", date="2026-10-01"))
    assert list(got) == ["auc-2"]
    assert set(resolve(spark, home("100", "The Fulton, Edgelaw View"), home("101", "The Fulton, Edgelaw View"))) == {"100", "101"}
    assert list(resolve(spark, home("100", "Rose Cottage, Main Street"), home("auc-1", "Rose Cottage, Main Street", "auction"))) == ["100"]


def test_certificates(spark):
    raw = spark.createDataFrame([("EH4  1AB", "12 Sample Rd", "", "134.2", "c", "2024-06-12"), ("EH4 1AB", "12 Sample Road", None, "10", "D", "2015-01-01"), ("EH99 1AA", "1 Far St", "", "90", "B", "2020-01-01"), ("Postcode", "Address", "", "Area", "Band", "Date")], "postcode string, address1 string, address2 string, floor_area string, band string, date string")
    certs = linkage.certificates(raw, ["EH4"])
    assert certs.count() == 2
    homes = spark.createDataFrame([("1", "12 Sample Road", "EH4 1AB", None), ("2", "12 Sample Road", "EH4 1AB", 120), ("3", "14 Sample Road", "EH4 1AB", None)], "id string, address string, postcode string, floor_area_m2 int")
    got = {r.id: r for r in linkage.apply_certificates(homes, certs).collect()}
    assert (got["1"].floor_area_m2, got["1"].floor_area_source, got["1"].epc.band, got["1"].epc.date) == (134, "EPC", "C", "2024-06-12")
    assert got["2"].floor_area_m2 == 120 and got["2"].floor_area_source is None and got["3"].epc is None


def test_upsert_keeps_and_appends(spark):
    old = spark.createDataFrame([("1", 300_000, "kept", [(dt.date(2026, 1, 1), 300_000)], dt.date(2026, 1, 1), dt.date(2026, 1, 1)), ("2", 5, "gone", [], dt.date(2026, 1, 1), dt.date(2026, 1, 1))], "id string, price int, title string, price_history array<struct<date:date,price:int>>, fetched date, first_seen date")
    new = spark.createDataFrame([("1", 290_000, ""), ("3", 100, "new")], "id string, price int, title string")
    got = {r.id: r for r in state.upsert(old, new, DAY).collect()}
    assert got["1"].title == "kept" and [p.price for p in got["1"].price_history] == [300_000, 290_000] and got["1"].first_seen == dt.date(2026, 1, 1) and got["1"].fetched == dt.date(2026, 10, 1)
    assert got["2"].fetched == dt.date(2026, 1, 1) and got["3"].first_seen == dt.date(2026, 10, 1)


def test_classify_with_incomplete_search(spark):
    schema = "id string, title string, property_type string, bedrooms int, district string, active boolean, excluded string, kind string, last_seen date, lat double, lng double"
    rows = [("1", "3 bed house", "", 3, "EH4", True, None, None, None, 55.9, -3.2), ("2", "3 bed house", "", 3, "KY3", True, None, None, None, 10.0, 0.0), ("3", "3 bed house", "", 3, "EH4", True, None, None, None, 55.9, -3.2), ("4", "2 bed flat", "", 2, "EH4", False, "flat", None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    found = spark.createDataFrame([("1", "https://x.example/property/a-eh4-1ab/36000001", "")], "id string, url string, hint string")
    unsure = spark.createDataFrame([("KY3",)], "district string")
    got = {r.id: (r.active, r.excluded) for r in state.classify(df, found, True, unsure, DAY).collect()}
    assert got == {"1": (True, None), "2": (True, None), "3": (False, "no longer listed"), "4": (False, "no longer listed")}
    out = state.outside_map(state.classify(df, found, True, unsure, DAY))
    assert {r.id: r.excluded for r in out.collect()}["2"] == "outside map area"
    assert set(ids(state.collect_garbage(out))) == {"1", "3", "4"}


def test_journey_uses_the_direct_bus(spark):
    from placeframe.operators import transit

    stops, profiles = small_network(spark)
    homes = spark.createDataFrame([("1", 55.9905, -3.3005), ("2", 55.8, -2.5)], "id string, lat double, lng double")
    a, b = transit.journeys(homes, profiles=profiles, stops=stops).orderBy("id").select("travel.*").collect()
    assert a.pt_min is not None and a.pt_min < 30 and "bus 22" in a.pt_how and "Far" in a.pt_how and a.best_how == a.pt_how
    assert b.pt_min is None and b.best_how == "Walk"


def best_rides(hops, paths, walks, targets, buffer_s=60):
    """Each target's labels, by asking of every ride again and again whether it leads anywhere."""
    out = {}
    for target in targets:
        ends, labels = {}, {}  # trip: (rank of the last ride that catches, arrival); stop: (latest, rank, arrival, route, board)
        while True:
            before = dict(labels), dict(ends)
            for dep, arr, u, v, trip, n, _ in hops:
                reach = arr + walks[v] if v in walks and arr + walks[v] <= target else labels[v][2] if v in labels and labels[v][0] >= arr + buffer_s else None
                if reach is not None and dep <= target and (trip not in ends or ends[trip][0] <= (dep, arr, n, -u, -v)):
                    ends[trip] = (dep, arr, n, -u, -v), reach
            for dep, arr, u, v, trip, n, route in hops:
                if trip in ends and (dep, arr, n, -u, -v) <= ends[trip][0]:
                    for x, walk in [(u, 0), *[(x, w) for y, x, w in paths if y == u]]:
                        way = (dep - walk, (dep, arr, n, -u, -v, trip), ends[trip][1], route, u)
                        if x not in labels or labels[x][:2] <= way[:2]:
                            labels[x] = way
            if (labels, ends) == before:
                break
        out |= {(target, x): (w[0], w[2], w[3], w[4]) for x, w in labels.items()}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_latest_departures_equal_plain_search(spark, seed):
    import random

    from placeframe.operators import transit

    rng = random.Random(seed)
    hops = []
    for trip in range(60):
        t, at = rng.randrange(23_400, 32_000, 60), rng.sample(range(25), 6)
        for n, (u, v) in enumerate(zip(at, at[1:], strict=False)):
            arr = t + rng.choice((0, 60, 120, 240))
            hops.append((t, arr, u, v, f"t{trip}", n, f"r{trip % 7}"))
            t = arr + rng.choice((0, 30, 60))
    paths = [(u, x, float(rng.randrange(30, 300))) for u in range(25) for x in range(25) if u != x and rng.random() < 0.08]
    walks = {3: 60.0, 4: 200.5}
    got = transit.latest_departures(spark.createDataFrame(hops, "dep int, arr int, u long, v long, trip string, seq int, route string"), spark.createDataFrame(paths, "u long, x long, walk_s double"), spark.createDataFrame(list(walks.items()), "stop long, walk_s double"))
    want = best_rides(hops, paths, walks, (30_600, 31_200, 31_800, 32_400, 33_000))
    assert {(r.target, r.stop): (r.latest, r.arrival, r.route, r.board_stop) for r in got.collect()} == want and len(want) > 60


def test_latest_departures_of_nothing(spark):
    from placeframe.operators import transit

    hops = spark.createDataFrame([(30_000, 30_100, 1, 2, "t", 0, "r")], "dep int, arr int, u long, v long, trip string, seq int, route string")
    nowhere = spark.createDataFrame([], "stop long, walk_s double")
    paths = spark.createDataFrame([], "u long, x long, walk_s double")
    assert transit.latest_departures(hops, paths, nowhere).count() == 0
    near = spark.createDataFrame([(2, 10.0)], "stop long, walk_s double")
    assert transit.latest_departures(hops.limit(0), paths, near).count() == 0
    assert {(r.target, r.latest, r.arrival) for r in transit.latest_departures(hops, paths, near).collect()} == {(t, 30_000.0, 30_110.0) for t in range(30_600, 33_001, 600)}


def test_stops_of_a_place_have_labels_in_common(spark):
    import random

    from placeframe.operators import transit

    rng = random.Random(5)
    stops = transit.with_places(spark.createDataFrame([(i, f"s{i}", f"Stop {i}", 55.9 + i % 8 * 0.002, -3.2) for i in range(64)], "stop long, stop_id string, name string, lat double, lng double"))
    assert transit.place_paths(stops).count() == 14 and {(r.stop, r.place) for r in stops.select("stop", "place").collect()} == {(i, i % 8) for i in range(64)}
    hops = []
    for trip in range(80):
        t, at = rng.randrange(23_400, 32_000, 60), rng.sample(range(64), 4)
        for n, (u, v) in enumerate(zip(at, at[1:], strict=False)):
            hops.append((t, t + 90, u, v, f"t{trip}", n, "r", u % 8, v % 8))
            t += 120
    conns = spark.createDataFrame(hops, "dep int, arr int, u long, v long, trip string, seq int, route string, pu long, pv long")
    near = spark.createDataFrame([(3, 60.0)], "stop long, walk_s double")
    single = transit.latest_departures(conns, transit.footpaths(stops), near).collect()
    assert sorted(transit.latest_departures(conns, transit.place_paths(stops), near, stops=stops).collect()) == sorted(single) and len(single) == 5 * 64


def test_service_day(spark):
    from placeframe.operators import transit

    week = dict.fromkeys(transit.WEEKDAYS, "1")
    cal = spark.createDataFrame([{"service_id": "s", "start_date": "20260101", "end_date": "20261231", **week}, {"service_id": "t", "start_date": "20260101", "end_date": "20261231", **week}])
    off = spark.createDataFrame([("t", "20261006", "2")], "service_id string, date string, exception_type string")
    r = transit.pick_service_day(cal, off, DAY).first()
    assert (str(r.day), r.n) == ("2026-10-07", 2)


def test_columns_by_pattern():
    names = ["OBJECTID", "DataZone", "DZ_Name", "LAName", "IncRankv2", "Rankv2", "CrimeRank"]
    got = layers.zone_columns(names)
    assert (got["dz"], got["name"], got["la"], got["rank"], got["income"], got["crime"], got["health"]) == ("DataZone", "DZ_Name", "LAName", "Rankv2", "IncRankv2", "CrimeRank", None)


def test_lines_merge(spark):
    p = lambda *ks: [(float(k), 0.0) for k in ks]
    cases = {
        "joined": ([p(0, 1), p(1, 2), p(2, 3)], [[0, 1, 2, 3]]), "turned": ([p(1, 0), p(1, 2)], [[0, 1, 2]]), "branch": ([p(0, 1), p(1, 2), p(1, 3)], [[0, 1], [1, 2], [1, 3]]), "ring": ([p(0, 1), p(2, 1), p(2, 0)], [[0, 1, 2, 0]]),
        "alone": ([p(0, 1, 0), p(5, 6)], [[0, 1, 0], [5, 6]]), "points": ([p(4), p(7, 7)], [[7, 7]]), "long": ([p(k, k + 1) if k % 3 else p(k + 1, k) for k in range(40)], [list(range(41))]), "longer ring": ([p(k, (k + 1) % 37) for k in range(37)], [[*range(37), 0]]),
    }
    rows = [(name, 100 * i + j, line) for i, (name, (own, _)) in enumerate(cases.items()) for j, line in enumerate(own)]
    df = spark.createDataFrame(rows, "key string, line long, points array<struct<x:double,y:double>>").repartition(3)
    got = {}
    for r in lines.merged(df).collect():
        got.setdefault(r.key, []).append([int(q.x) for q in r.points])
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, (_, v) in cases.items()}
    assert lines.merged(df.limit(0)).count() == 0


def plain_thin(line, tolerance):
    if len(line) < 3:
        return line
    (x1, y1), (x2, y2) = line[0], line[-1]
    n = (x2 - x1) ** 2 + (y2 - y1) ** 2

    def off(q):
        t = min(1.0, max(0.0, ((q[0] - x1) * (x2 - x1) + (q[1] - y1) * (y2 - y1)) / n)) if n else 0.0
        return ((q[0] - x1 - t * (x2 - x1)) ** 2 + (q[1] - y1 - t * (y2 - y1)) ** 2) ** 0.5

    k = max(range(1, len(line) - 1), key=lambda i: (off(line[i]), -i))
    return [line[0], line[-1]] if off(line[k]) <= tolerance else plain_thin(line[: k + 1], tolerance)[:-1] + plain_thin(line[k:], tolerance)


def test_rounds_of_lines_end_with_the_longest_chain_or_ring(spark, monkeypatch):
    """However many lines there are: rings of two and three and chains of three among 600 lines by themselves."""
    written, write = [], lines.materialise
    monkeypatch.setattr(lines, "materialise", lambda df, name: written.append(name) or write(df, name))
    ways = [(f"k{i}", 10 * i + j, a, b) for i in range(20) for j, (a, b) in enumerate([(0, 1), (1, 0), (2, 3), (3, 4), (4, 2), (5, 6), (7, 6), (7, 8)])] + [("alone", 1000 + i, 2 * i, 2 * i + 1) for i in range(600)]
    df = spark.createDataFrame([(k, n, [(float(a), 0.0), (float(b), 0.0)]) for k, n, a, b in ways], "key string, line int, points array<struct<x:double,y:double>>")
    got = lines.merged(df).collect()
    assert sorted((r.chain % 10, [int(p.x) for p in r.points]) for r in got if r.key == "k7") == [(0, [0, 1, 0]), (2, [2, 3, 4, 2]), (5, [5, 6, 7, 8])]
    assert len(got) == 660 and written.count("lines-jumps") <= 5


def test_counted_routes_hold_no_lines(spark):
    at = "struct<lat:double,lon:double>"
    rel = [(i, "relation", {"route": "tram", "name": "T"}, [("way", "", [(float(i), 0.0), (float(i) + 0.4, 0.0)])], None, None) for i in range(4)]
    df = spark.createDataFrame(rel, f"ord long, type string, tags map<string,string>, members array<struct<type:string,role:string,geometry:array<{at}>>>, lat double, lon double")
    out = layers.tram_layer(df, counted=True)
    assert [r.lines for r in out.collect()] == [4] == [len(r.lines) for r in layers.tram_layer(df).collect()] and "collect_list" not in _plan(out)


def test_lines_simplify(spark):
    import random

    rng = random.Random(2)
    own = [[(0.0, 0.0), (1.0, 0.00001), (2.0, 0.0)], [(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)], [(0.0, 0.0), (1.0, 0.0)], [(3.0, 3.0), (4.0, 4.0), (3.0, 3.0)], [(float(i), rng.random()) for i in range(120)]]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(own)], "key string, chain long, points array<struct<x:double,y:double>>")
    assert {r.chain: [(q.x, q.y) for q in r.points] for r in lines.simplified(df, 0.3).collect()} == {i: plain_thin(x, 0.3) for i, x in enumerate(own)}


def test_exact_medians_in_narrow_brackets(spark):
    import random
    from statistics import median

    rng = random.Random(5)
    groups = {"a": [rng.random() for _ in range(3001)], "b": [float(rng.randrange(5)) for _ in range(900)], "c": [1.0, 2.0], "d": [7.0] * 50, "e": [0.0] * 400 + [rng.random() for _ in range(401)], None: [rng.gauss(0, 1e6) for _ in range(800)]}
    df = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values] + [("a", None), ("f", None)], "k string, v double").repartition(4)
    for at_once in (20, 100_000):
        assert {r.k: (r.n, r.median) for r in stats.exact_medians(df, "v", ["k"], at_once).collect()} == {k: (len(v), median(v)) for k, v in groups.items()}
    everything = [v for values in groups.values() for v in values]
    assert stats.exact_medians(df, "v", at_once=30).first().median == median(everything) and stats.global_median(df, "v").first().median == median(everything)
    assert stats.global_median(df.where("k = 'f'"), "v").first().median == 0.0 and stats.exact_medians(df.limit(0), "v", ["k"]).count() == 0


def test_text_index_looks_at_few_and_misses_none(spark):
    from placeframe.operators import textindex

    rows = [(n, f"home {n} on Mill Lane {'near the RIVER' if n % 50 == 0 else ''} {'é' * (n % 3)}") for n in range(9000)] + [(-5, "river mill"), (10_000, None), (10_001, ""), (10_002, "mi ll")]
    df = spark.createDataFrame(rows, "k long, t string")
    postings = textindex.index(df, "k", "t")
    searches = ["river", "MILL, river", "éé", "home 77", "é river", "nothing like it", ""]
    want = {(n, k) for n, q in enumerate(searches) for k, t in rows if t is not None and all(w in t.lower() for w in search.tokens(q))}
    assert {tuple(r) for r in textindex.search(df, postings, searches, "k", "t").collect()} == want
    looked = {r.search: r["count"] for r in textindex.candidates(postings, searches).groupBy("search").count().collect()}
    assert looked[0] == 181 and looked.get(5, 0) == 0 and max(r.n for r in postings.select(F.size("ids").alias("n")).collect()) <= textindex.BUCKET


def test_facets_from_bitmaps(spark):
    from placeframe.operators import bitmaps

    rows = [(n, "abc"[n % 3], str(n % 7) if n % 11 else None, "" if n % 2 else "x") for n in range(0, 70_000, 17)]
    df = spark.createDataFrame(rows, "n long, a string, b string, c string")
    filters = [{}, {"a": ["a", "b"]}, {"a": ["c"], "b": ["1", "2"]}, {"c": ["x"], "a": ["a"]}, {"a": ["none"]}]
    want = {}
    for k, f in enumerate(filters):
        for r in rows:
            own = dict(zip("abc", r[1:], strict=True))
            if all(own[c] in values for c, values in f.items()):
                for c in "abc":
                    if own[c]:
                        want[k, c, own[c]] = want.get((k, c, own[c]), 0) + 1
    assert {(r.filter, r.facet, r.value): r.n for r in bitmaps.counts(bitmaps.index(df, "n", ["a", "b", "c"]), filters, ["a", "b", "c"]).collect()} == want


def test_commands_of_many_users_fold(spark):
    rows = [("u", "h", "Shortlist", "toggle", 1), ("u", "h", "Viewing", "toggle", 2), ("u", "h", "Rejected", "toggle", 3), ("v", "h", "Shortlist", "toggle", 1), ("v", "h", "Shortlist", "toggle", 2), ("u", "i", "Rejected", "toggle", 4), ("u", "i", "Viewing", "toggle", 5), ("w", "h", "Viewing", "remove", 1), ("w", "i", "Viewing", "toggle", 9), ("w", "i", "Shortlist", "toggle", 3)]
    got = {(r.user, r.id): r.lists for r in saved.fold(spark.createDataFrame(rows, "user string, id string, list string, action string, ord int").repartition(3)).collect()}
    assert got == {("u", "h"): ["Rejected"], ("v", "h"): [], ("u", "i"): ["Viewing"], ("w", "h"): [], ("w", "i"): ["Shortlist", "Viewing"]}


def test_many_homes_of_a_postcode(spark):
    """Three thousand homes of one postcode; pairs at one number, and a chain of relists at another."""
    rows = [home(str(1000 + n), f"{1 + n // 2} High Street") for n in range(3000)] + [home(str(9000 + n), "5000 High Street") for n in range(6)]
    got = resolve(spark, *rows)
    assert sorted(map(int, got)) == [*range(1001, 4000, 2), 9005] and len(got["9005"].price_history) >= 1


def test_clusters_of_three_zooms(spark):
    import random

    from placeframe.operators import clusters

    rng = random.Random(3)
    rows = [(n, 55.9 + rng.gauss(0, 0.03), -3.2 + rng.gauss(0, 0.05)) for n in rng.sample(range(5000), 300)] + [(9000, None, 1.0)]
    df = spark.createDataFrame(rows, "id long, lat double, lng double")
    x, y = clusters.projected(F.col("lng"), F.col("lat"))
    now = {r.id: (r.x, r.y, 1) for r in df.where("lat is not null").select("id", x.alias("x"), y.alias("y")).collect()}
    want = {}
    for zoom in (12, 11, 10):
        r, lead, of = 50 / (512 * 2**zoom), [], {}
        for i in sorted(now):
            mine = next((j for j in lead if (now[i][0] - now[j][0]) ** 2 + (now[i][1] - now[j][1]) ** 2 <= r * r), None)
            if mine is None:
                lead.append(i)
            of.setdefault(i if mine is None else mine, []).append(now[i])
        now = {i: (sum(p[0] * p[2] for p in own) / sum(p[2] for p in own), sum(p[1] * p[2] for p in own) / sum(p[2] for p in own), sum(p[2] for p in own)) for i, own in of.items()}
        want |= {(zoom, i): (p[2], round(p[0], 9), round(p[1], 9)) for i, p in now.items()}
    got = {(r.zoom, r.id): (r.n, round(r.x, 9), round(r.y, 9)) for r in clusters.by_zoom(df, range(10, 13)).collect()}
    assert got == want and len({k for k in want if k[0] == 10}) < len({k for k in want if k[0] == 12}) < 300


def test_near_places_in_the_far_north(spark):
    a = spark.createDataFrame([(1, 70.0, 20.0), (2, 88.0, -30.0), (3, -70.0, 0.0)], "i int, lat double, lng double")
    b = spark.createDataFrame([(1, 70.0, 20.028), (2, 88.0, -30.5), (3, -70.01, 0.02), (4, None, 1.0)], "j int, lat double, lng double")
    got = {(r.i, r.j): r.distance_m for r in spatial.within(a, b, 1200).drop("lat", "lng").collect()}
    assert set(got) == {(1, 1)} and 1000 < got[1, 1] < 1100
    assert {(r.i, r.j) for r in spatial.within(a, b, 2000).collect()} == {(1, 1), (2, 2), (3, 3)}


def test_saved_lists(spark):
    homes = listing(spark, {"id": "a", "title": "A"}, {"id": "b"}).withColumns({"url": F.lit("u"), "image": F.lit("i")})
    s = saved.from_state(spark, None)
    s, on = s.toggle("Shortlist", homes, "a")
    assert on and ids(s.saved_ids()) == ["a"]
    s, _ = s.toggle("Rejected", homes, "a")
    assert ids(s.ids("Shortlist")) == [] and ids(s.ids("Rejected")) == ["a"]
    s, made = s.add_list(" Later ")
    assert made and s.names() == ["Shortlist", "Viewing", "Later", "Rejected"] and not s.delete_list("Rejected")[1]
    s = s.save_search("one", "x=1").save_search("one", "x=2")
    back = saved.decode(spark, s.export())
    assert back.names() == s.names() and back.searches.select("hash").first()[0] == "x=2" and saved.decode(spark, "!!") is None
    other, _ = saved.from_state(spark, None).toggle("Viewing", homes, "b")
    assert ids(other.merge(back).ids("Rejected")) == ["a"]
    assert ids(s.gone("Rejected", homes.where("id = 'b'"))) == ["a"]


def test_enrich_end_to_end(spark):
    rows = [(str(36_000_000 + i), f"{i + 1} Main Street", "EH10 4AA", "EH10", 55.93, -3.21, 300_000 + 50_000 * i, 3) for i in range(4)] + [("36000009", "9 Main Street", "EH10 4AA", "EH10", None, None, 1, 3)]
    df = spark.createDataFrame(rows, "id string, address string, postcode string, district string, lat double, lng double, price int, bedrooms int")
    df = df.withColumns({"source": F.lit(None).cast("string"), "kind": F.lit(None).cast("string"), "url": F.lit("u"), "first_seen": DAY, "price_history": F.array().cast("array<struct<date:date,price:int>>"), "detached": F.lit(False), "garage": F.lit(True), "closing_date": F.lit("2026-09-01").cast("date")})
    previous = spark.createDataFrame([("36000000", 9, "bus 9")], "id string, pt_min int, pt_how string")
    out, areas = refresh.enrich(df, refresh.Inputs(previous=previous), DAY)
    got = {r.id: r for r in out.collect()}
    assert len(got) == 4 and got["36000000"].area.median == 375_000 and got["36000000"].area.basis == "3-bed" and got["36000000"].travel.pt_min == 9 and got["36000000"].travel.best_how == "bus 9"
    assert got["36000001"].region == "Edinburgh" and got["36000001"].closing_date is None and areas.count() == 2


def test_sources_and_sinks(spark, tmp_path):
    import io
    import json
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("stops.txt", "﻿stop_id,stop_name,stop_lat,stop_lon\na,A,55.9,-3.2\n")
        z.writestr("certs.csv", "x\nOSG,ADDRESS1,ADDRESS2,POSTCODE,CURRENT_ENERGY_RATING,TOTAL_FLOOR_AREA,LODGEMENT_DATE\no,12 S Rd,,EH4 1AB,C,134,2024-06-12\n")
    (tmp_path / "f.zip").write_bytes(data.getvalue())
    feed = files.read_timetable(spark, str(tmp_path / "f.zip"))
    assert feed["stops"].first().stop_name == "A" and feed["trips"].count() == 0
    assert files.certificate_zip(spark, str(tmp_path / "f.zip")).first().band == "C"
    df = spark.createDataFrame([(1, "s", [SQUARE(0.0, 0.0, 1.0, 1.0)])], f"feature_id int, school string, polys {POLYS}")
    doc = json.loads(sinks.feature_collection(df).first()[0])
    assert doc["features"][0]["properties"] == {"school": "s"} and doc["features"][0]["geometry"]["type"] == "MultiPolygon"
    sinks.write_document(sinks.feature_collection(df), str(tmp_path / "layer"))
    back = files.read_features(spark, str(tmp_path / "layer"), "school:string")
    assert back.first().school == "s" and len(back.first().polys[0][0]) == 5
    table = str(tmp_path / "t")
    sinks.swap_table(spark.range(3), table)
    sinks.swap_table(spark.read.parquet(table).where("id > 0"), table)
    assert spark.read.parquet(table).count() == 2
    assert files.read_json_or(spark, str(tmp_path / "none.json"), {"d": 1}) == {"d": 1}
    assert files.read_or_empty(spark, str(tmp_path / "none"), "id int").count() == 0
    assert files.synthetic_listings(spark).count() == 220
    run = sinks.Run(dt.datetime(2026, 10, 1, tzinfo=dt.UTC))
    run.step("bad", lambda: 1 / 0)
    run.step("good", lambda: 1)
    assert "ZeroDivisionError" in run.errors["bad"] and run.sources["good"] and run.stale(run.as_of)


def test_crawl_and_fetch():
    pages = {"https://x/s": '<a href="/property/a-eh4-1ab/36000001">a</a><a rel="next" href="/s2">n</a>', "https://x/s2": '<a href="/property/b-eh4-1ab/36000002">b</a>'}

    def get(url):
        if url == "https://x/bad":
            raise OSError("down")
        return pages.get(url)

    from placeframe.functions.html import listing_ident

    links = lambda html, url: {i: u for u in __import__("re").findall('href="([^"]+)"', html) if (i := listing_ident(u))}
    found, complete, unsure = remote.crawl([{"url": "https://x/s"}, {"url": "https://x/bad", "districts": ["KY3"]}], get, links)
    assert sorted(f[0] for f in found) == ["36000001", "36000002"] and complete and unsure == {"KY3"}
    assert remote.crawl([{"url": "https://x/bad"}], get, links)[1] is False
    import urllib.error

    calls = []

    def opener(url, timeout):
        calls.append(url)
        raise urllib.error.HTTPError(url, 503, "busy", None, None)

    with pytest.raises(urllib.error.HTTPError):
        remote.fetch("https://x/y", opener=opener, sleep=lambda s: None)
    assert len(calls) == 3
    assert remote.first_that_works([lambda: (_ for _ in ()).throw(OSError("a")), lambda: 2]) == 2


def test_stream_upserts(spark, tmp_path):
    from placeframe.streaming.upserts import upsert_stream

    src, st = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([("1", 300, dt.datetime(2026, 1, 1)), ("1", 290, dt.datetime(2026, 1, 2))], "id string, price int, ts timestamp").write.parquet(src)
    schema = "id string, price int, price_history array<struct<date:date,price:int>>, fetched date, first_seen date"
    stream = spark.readStream.schema("id string, price int, ts timestamp").parquet(src)
    upsert_stream(stream, st, schema, str(tmp_path / "cp"), F.lit("2026-10-01")).awaitTermination()
    r = spark.read.parquet(st).collect()
    assert [(x.id, x.price) for x in r] == [("1", 290)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_districts_are_broadcast_not_the_customers(spark, tmp_path):
    from placeframe.query_sets import homes

    spark.range(10).select(F.col("id").alias("c_custkey"), F.lit("A").alias("c_mktsegment")).write.parquet(str(tmp_path / "customer.parquet"))
    plan = _plan(homes.region_of_district(spark, str(tmp_path)))
    assert "BroadcastHashJoin" in plan and "BuildLeft" not in plan


def test_certificates_meet_by_more_than_the_postcode(spark):
    import random

    from placeframe.functions.address import certificate_key, certificate_matches

    rng = random.Random(5)
    text = lambda: " ".join([rng.choice(("", "1", "2", "3b")), *rng.sample(("Rose", "Mill", "Park", "Old", "Rd", "Green"), rng.randrange(6))]).strip()
    homes = spark.createDataFrame([(i, text(), f"EH{i % 2} 1AA", None) for i in range(150)], "id int, address string, postcode string, floor_area_m2 int")
    certs = spark.createDataFrame([(f"EH{i % 2} 1AA", text(), 50 + i, "C", f"2020-01-{i % 28 + 1:02d}") for i in range(120)], "postcode string, address string, floor_area_m2 int, band string, date string")
    out = linkage.match_certificates(homes, certs)
    got = {r.id: r["__epc"] and (r["__epc"].date, r["__epc"].floor_area_m2) for r in out.collect()}
    pairs = homes.where("address <> ''").select("id", "postcode", certificate_key("address").alias("h")).join(certs.select("postcode", certificate_key("address").alias("c"), "date", F.col("floor_area_m2").alias("area")), "postcode").where(certificate_matches(F.col("h"), F.col("c")))
    want = {r.id: (r.b.date, r.b.area) for r in pairs.groupBy("id").agg(F.max(F.struct("date", "area")).alias("b")).collect()}
    assert len(want) > 50 and got == {i: want.get(i) for i in range(150)}
    assert all("," in line.split("]")[0] for line in _plan(out).splitlines() if "SortMergeJoin [__pc" in line)
    assert "SortMergeJoin [__pc" in _plan(out)


def test_clusters_of_many_points_in_one_place_write_no_pairs(spark, monkeypatch):
    from placeframe.operators import clusters

    written, write = [], clusters.materialise
    monkeypatch.setattr(clusters, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    monkeypatch.setattr(clusters, "discard", lambda *frames: None)
    points = spark.range(400).select("id", (F.col("id") % 3 * 1.0).alias("x"), F.lit(0.0).alias("y"))
    assert {(r.id, r.leader) for r in clusters.leaders(points, 1.0).collect()} == {(i, 0 if i % 3 < 2 else 2 if i == 2 else 1 if i % 3 == 1 else 2) for i in range(400)}
    assert max(df.count() for df in written) <= 400


def test_places_spread_over_cells_are_not_broadcast(spark):
    left = spark.range(50).select(F.col("id").alias("k"), F.lit(55.9).alias("lat"), (F.col("id") / 1000 - 3.2).alias("lng"))
    right = spark.range(4).select(F.col("id").alias("s"), F.lit(55.9).alias("slat"), (F.col("id") / 100 - 3.2).alias("slng"))
    out = spatial.nearest(left, right, "k", ["s"], 2500, right_at=("slat", "slng"))
    clear = [k for k in range(50) if k % 10 != 5]  # not between two
    got = {r.k: r.nearest.s for r in out.collect()}
    assert [got[k] for k in clear] == [min(range(4), key=lambda s: abs(k - 10 * s)) for k in clear]
    assert out.count() == 50 and "BroadcastHashJoin" not in _plan(spatial.within(left, right, 2500, right_at=("slat", "slng")))


def test_footpaths_work_out_distances_between_places(spark):
    from placeframe.operators import transit

    stops = spark.createDataFrame([(i, f"s{i}", 55.9 + i % 3 * 0.002, -3.2) for i in range(12)], "stop long, stop_id string, lat double, lng double")
    got = {(r.u, r.x): (round(r.walk_s, 3), r.u_stop_id, r.x_stop_id) for r in transit.footpaths(stops, also=("stop_id",)).collect()}
    assert set(got) == {(u, x) for u in range(12) for x in range(12) if u != x and abs(u % 3 - x % 3) < 2}
    assert all(got[u, x][1:] == (f"s{u}", f"s{x}") and (got[u, x][0] == 0) == (u % 3 == x % 3) for u, x in got)


def test_footpaths_round_between_places_and_deal_crowded_ones_into_parts(spark, monkeypatch):
    from placeframe.operators import transit

    stops = spark.createDataFrame([(i, 55.9 + i % 3 * 0.002, -3.2) for i in range(30)], "stop long, lat double, lng double")
    whole = {(r.u, r.x): r.walk_s for r in transit.footpaths(stops).collect()}
    monkeypatch.setattr(transit, "CROWD", 4, raising=False)
    out = transit.footpaths(stops, digits=2)
    rows = out.collect()
    assert len(rows) == len(whole) and {(r.u, r.x): r.walk_s for r in rows} == {k: round(v, 2) for k, v in whole.items()}
    assert out.rdd.getNumPartitions() == 8 * spark.sparkContext.defaultParallelism


def test_duplicates_are_joined_by_sorting_not_from_the_driver(spark, monkeypatch):
    from placeframe.query_sets.homes import crowd

    plans, write = [], linkage.materialise
    monkeypatch.setattr(linkage, "materialise", lambda df, name: plans.append(_plan(df)) or write(df, name))
    out = linkage.resolve_duplicates(crowd(spark))
    assert out.count() == 17 and len(plans) > 5 and not [p for p in [*plans, _plan(out)] if "BroadcastHashJoin" in p]


def test_duplicates_with_a_repeated_id_come_to_an_end(spark):
    from placeframe.query_sets.homes import crowd

    listings = crowd(spark).where("id in ('9', '10', '11')")
    out = linkage.resolve_duplicates(listings.unionByName(listings.where("id = '9'"))).collect()
    assert [(r.id, [h.price for h in r.price_history]) for r in out] == [("11", [600, 610, 620])]
