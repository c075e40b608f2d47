"""Spatial joins on grids: equi-joins on cells, then an exact test. No nested loops and no Python.

Polygons are ARRAY<ARRAY<ARRAY<STRUCT<x,y>>>>: polygons of rings of points, the first ring the shell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.config import EARTH_RADIUS_M
from placeframe.functions.numeric import haversine_m
from placeframe.session import discard, materialise

CELL = 0.01


def _edges(ring: Column) -> Column:
    """Consecutive point pairs of a ring, closed."""
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.struct(F.get(ring, i)["x"].alias("x1"), F.get(ring, i)["y"].alias("y1"), F.get(ring, F.pmod(i + 1, F.greatest(n, F.lit(1))))["x"].alias("x2"), F.get(ring, F.pmod(i + 1, F.greatest(n, F.lit(1))))["y"].alias("y2")))


def _odd(edges: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses an odd number of edges (half-open: lower and left boundaries are inside)."""
    crossed = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]))
    return F.pmod(F.size(crossed), F.lit(2)) == 1


def _on(edges: Column, x: Column, y: Column) -> Column:
    """Whether the point lies on an edge."""
    def at(e: Column) -> Column:
        cross = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (F.abs(cross) <= 1e-12) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return F.exists(edges, at)


def contains(polys_edges: Column, x: Column, y: Column, boundary: str = "closed") -> Column:
    """Point in any polygon, outside its holes. closed: all boundaries count as inside; half_open: as :func:`_odd` says."""
    def inside(rings: Column) -> Column:
        shell = F.get(rings, F.lit(0))
        holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1)))
        plain = _odd(shell, x, y) & ~F.exists(holes, lambda h: _odd(h, x, y))
        return plain | F.exists(rings, lambda r: _on(r, x, y)) if boundary == "closed" else plain

    return F.exists(polys_edges, inside)


#: A cell with more edges is divided into four, down to a side of 2^-FINEST.
CELL_EDGES, FINEST = 12, 30
#: Where in a cell its reference point lies: off the places that corners of polygons are put at.
_AT = (0.38196601125, 0.61803398875)


def _crossings(edges: Column, along: str, at: Column, a: Column, b: Column) -> Column:
    """How many edges cross the line at ``at`` between a and b; along x: the line is level."""
    u, v = ("x", "y") if along == "x" else ("y", "x")
    lo, hi = F.least(a, b), F.greatest(a, b)

    def cuts(e: Column) -> Column:
        p = (e[f"{u}2"] - e[f"{u}1"]) * (at - e[f"{v}1"]) / F.nullif(e[f"{v}2"] - e[f"{v}1"], F.lit(0.0)) + e[f"{u}1"]
        return ((e[f"{v}1"] > at) != (e[f"{v}2"] > at)) & (p > lo) & (p <= hi)

    return F.size(F.filter(edges, cuts))


def _side(ring: Column, xr: Column, yr: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) is within a ring, as _odd says, from the side of a point of the same cell: up or down first, then level."""
    return ring["inside"] != (F.pmod(_crossings(ring["edges"], "y", xr, yr, y) + _crossings(ring["edges"], "x", y, xr, x), F.lit(2)) == 1)


def _touching(edges: Column, x0: Column, y0: Column, size: Column) -> Column:
    """The edges that meet a cell, and those that miss it by a hair."""
    x1, y1, hair = x0 + size, y0 + size, 1e-11

    def meets(e: Column) -> Column:
        near = (F.least(e["x1"], e["x2"]) <= x1 + hair) & (F.greatest(e["x1"], e["x2"]) >= x0 - hair) & (F.least(e["y1"], e["y2"]) <= y1 + hair) & (F.greatest(e["y1"], e["y2"]) >= y0 - hair)
        side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        corners = (side(x0, y0), side(x0, y1), side(x1, y0), side(x1, y1))
        return near & (F.least(*corners) <= hair) & (F.greatest(*corners) >= -hair)

    return F.filter(edges, meets)


def cover(polygons: DataFrame, polys: str = "polys", cell_edges: int = CELL_EDGES) -> DataFrame:
    """The polygons' columns and an adaptive grid, written: a row for each cell (__z, __cx, __cy), of side 2^-__z, that may hold points of theirs.

    A polygon begins with the four cells at most of its box's size. A cell that more edges cross than ``cell_edges`` is divided, and
    each part keeps the edges that cross it and the side of each ring on which its reference point lies. Cells that no edge
    crosses are wholly in or out; those within stay, without edges. So a polygon over the whole map is a few large cells inside and
    small ones along its boundary, and a point is tested against a dozen edges. A corner where more edges meet ends at the least
    side. Each round deals what is crowded to all tasks and divides it, row by row.
    """
    points = F.flatten(F.transform(polys, lambda p: F.get(p, F.lit(0))))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    rings = F.flatten(F.transform(polys, lambda p, i: F.transform(p, lambda r, k: F.struct(i.alias("poly"), k.alias("ring"), _edges(r).alias("edges")))))
    own = [c for c in polygons.columns if c != polys]
    boxed = polygons.select(*own, F.array_min(xs).alias("__x0"), F.array_max(xs).alias("__x1"), F.array_min(ys).alias("__y0"), F.array_max(ys).alias("__y1"), rings.alias("__rings")).where("__x0 is not null")
    width = F.greatest(F.col("__x1") - F.col("__x0"), F.col("__y1") - F.col("__y0"))
    out = boxed.withColumn("__z", F.when(width > 0, F.least(F.lit(FINEST), -F.ceil(F.log2(width)).cast("int"))).otherwise(FINEST))
    span = lambda a, b: F.sequence(F.floor(F.col(a) * F.pow(F.lit(2.0), "__z")), F.floor(F.col(b) * F.pow(F.lit(2.0), "__z")))
    out = out.withColumn("__cx", F.explode(span("__x0", "__x1"))).withColumn("__cy", F.explode(span("__y0", "__y1")))
    side = F.pow(F.lit(2.0), -F.col("__z"))
    place = lambda c, k: (F.col(c) + _AT[k]) * side
    corner = F.col("__cx") * side, F.col("__cy") * side
    cell = ["__z", "__cx", "__cy"]

    def kept(inside) -> Column:
        return _alive(F.transform("__rings", lambda r: F.struct(r["poly"].alias("poly"), r["ring"].alias("ring"), inside(r).alias("inside"), _touching(r["edges"], *corner, side).alias("edges"))))

    first = out.select(*own, *cell, kept(lambda r: _odd(r["edges"], place("__cx", 0), place("__cy", 1))).alias("__rings"))
    now = materialise(first.where(F.size("__rings") > 0), "cover")
    edges = F.aggregate("__rings", F.lit(0), lambda n, r: n + F.size(r["edges"]))
    crowded = (edges > cell_edges) & (F.col("__z") < FINEST)
    two, tasks = F.array(F.lit(0), F.lit(1)), polygons.sparkSession.sparkContext.defaultParallelism
    while not now.where(crowded).isEmpty():
        parts = now.where(crowded).select(*own, place("__cx", 0).alias("__xr"), place("__cy", 1).alias("__yr"), (F.col("__z") + 1).alias("__z"), (F.col("__cx") * 2).alias("__bx"), (F.col("__cy") * 2).alias("__by"), F.explode(two).alias("__i"), "__rings")
        parts = parts.select("*", (F.col("__bx") + F.col("__i")).alias("__cx"), F.explode(two).alias("__j")).withColumn("__cy", F.col("__by") + F.col("__j")).repartition(tasks, "__cx", "__cy")
        divided = parts.select(*own, *cell, kept(lambda r: _side(r, F.col("__xr"), F.col("__yr"), place("__cx", 0), place("__cy", 1))).alias("__rings")).where(F.size("__rings") > 0)
        after = materialise(now.where(~crowded).unionByName(divided), "cover")
        discard(now)
        now = after
    return now


def _named(value: Column, body) -> Column:
    """``body`` of a value that it names more than once: the value is worked out once."""
    return F.transform(F.array(value), body)[0]


def _alive(rings: Column) -> Column:
    """Without rings that are far off, and polygons of which no shell is left."""
    own = F.filter(rings, lambda r: r["inside"] | (F.size(r["edges"]) > 0))
    return _named(own, lambda own: F.filter(own, lambda r: (r["ring"] == 0) | F.exists(own, lambda s: (s["poly"] == r["poly"]) & (s["ring"] == 0))))


def _within(rings: Column, xr: Column, yr: Column, x: Column, y: Column, boundary: str) -> Column:
    """As :func:`contains`, from a cell's rings."""
    sides = F.transform(rings, lambda r: F.struct(r["poly"].alias("poly"), r["ring"].alias("ring"), _side(r, xr, yr, x, y).alias("inside")))
    plain = _named(sides, lambda sides: F.exists(sides, lambda s: (s["ring"] == 0) & s["inside"] & ~F.exists(sides, lambda h: (h["poly"] == s["poly"]) & (h["ring"] > 0) & h["inside"])))
    return plain | F.exists(rings, lambda r: _on(r["edges"], x, y)) if boundary == "closed" else plain


def point_in_polygon(points: DataFrame, polygons: DataFrame, lng: str = "lng", lat: str = "lat", polys: str = "polys", boundary: str = "closed", covered: DataFrame | None = None) -> DataFrame:
    """Join each point with the polygons that contain it: an equi-join on cells, then the edges of that cell.

    A point looks for the cell that holds it at each size from the largest to the smallest that there is; a polygon's cells do not
    overlap, so no pair comes twice. ``covered``: a :func:`cover` of the polygons that is used again.
    """
    x, y = F.col(lng), F.col(lat)
    right = cover(polygons, polys) if covered is None else covered
    sizes = sorted(r[0] for r in right.select("__z").distinct().collect())  # of some sixty
    left = points.withColumn("__pz", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")))
    scale = F.pow(F.lit(2.0), F.col("__pz"))
    left = left.withColumns({"__px": F.floor(x * scale), "__py": F.floor(y * scale)})
    near = (F.col("__pz") == F.col("__z")) & (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy"))
    side = F.pow(F.lit(2.0), -F.col("__z"))
    inside = _within(F.col("__rings"), (F.col("__cx") + _AT[0]) * side, (F.col("__cy") + _AT[1]) * side, x, y, boundary)
    return left.join(right, near & inside).drop("__pz", "__px", "__py", "__z", "__cx", "__cy", "__rings")


def at_shared_places(points: DataFrame, polygons: DataFrame, lng: str = "lng", lat: str = "lat", polys: str = "polys", boundary: str = "closed") -> DataFrame:
    """As :func:`point_in_polygon`, for many points at one position and many features of one shape.

    Each distinct shape is covered once and each distinct position tested once; hits are spread to the features of their shape, and
    those to the points of their position, by equi-joins. The result may hold the product of both tables; covers, tests and what is
    written grow with the distinct shapes and positions only.
    """
    own = [c for c in polygons.columns if c != polys]
    # Ids that hang on the order of tasks are written before they are used.
    shapes = materialise(polygons.select(F.col(polys).alias("__polys")).distinct().withColumn("__shape", F.monotonically_increasing_id()), "shapes")
    places = points.select(F.col(lng).alias("__x"), F.col(lat).alias("__y")).where("__x is not null and __y is not null").distinct()
    # Covers and hits are small in their files, and Spark would broadcast them from the driver.
    covered = cover(shapes, "__polys")
    hits = materialise(point_in_polygon(places, shapes, "__x", "__y", "__polys", boundary, covered.hint("merge")), "hits")
    discard(covered)
    # Features meet their shape by its hash; the shapes themselves are compared but not sorted.
    keyed = shapes.withColumn("__key", F.xxhash64("__polys")).hint("merge")
    features = polygons.join(keyed, (F.xxhash64(polys) == F.col("__key")) & (F.col(polys) <= F.col("__polys")) & (F.col(polys) >= F.col("__polys"))).select(*own, F.col("__shape").alias("__own"))
    found = hits.hint("merge").join(features, F.col("__shape") == F.col("__own")).select("__x", "__y", *own)
    return points.join(found.hint("merge"), (F.col(lng) == F.col("__x")) & (F.col(lat) == F.col("__y"))).drop("__x", "__y")


def first_hit(points: DataFrame, polygons: DataFrame, key: str, order: str, fields: list[str], name: str, **kw) -> DataFrame:
    """Add ``name``, a struct of the fields of the containing polygon that is first by ``order`` (null without one)."""
    hits = point_in_polygon(points.select(key, kw.get("lng", "lng"), kw.get("lat", "lat")), polygons, **kw)
    best = hits.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias(name))
    return points.join(best, key, "left")


def secondary_catchments(points: DataFrame, polygons: DataFrame, key: str = "id", order: str = "feature_id") -> DataFrame:
    """catchment and catchment_rc with ranks, and top_school_rank.

    Of several hits in a sector the last one names the school; the rank is the last that is given, and the overall rank is
    the best of all hits.
    """
    hits = point_in_polygon(points.select(key, "lng", "lat"), polygons)
    ranked = lambda c: F.max_by("top_rank", F.when(c & (F.coalesce("top_rank", F.lit(0)) != 0), F.col(order)))
    named = lambda c: F.max_by("school", F.when(c, F.col(order)))
    rc = F.col("sector") == "RC"
    per = hits.groupBy(key).agg(named(~rc).alias("catchment"), named(rc).alias("catchment_rc"), ranked(~rc).alias("catchment_rank"), ranked(rc).alias("catchment_rc_rank"), F.min(F.when(F.col("top_rank") != 0, F.col("top_rank"))).alias("top_school_rank"))
    some = lambda v, c: F.when(F.col(c).isNotNull(), F.col(v))
    per = per.withColumn("catchment_rank", some("catchment_rank", "catchment")).withColumn("catchment_rc_rank", some("catchment_rc_rank", "catchment_rc"))
    return points.join(per, key, "left")


def primary_catchments(points: DataFrame, polygons: DataFrame, key: str = "id") -> DataFrame:
    """primary and primary_rc, with score, note and whether a school is among the best.

    Where stages are split, the school that takes the youngest children is the catchment school; the others are noted.
    """
    hits = point_in_polygon(points.select(key, "lng", "lat"), polygons)
    per = hits.groupBy(key, "sector").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("stages", F.lit("")).alias("stages"), "school", F.col("score").cast("double").alias("score"), F.coalesce("top", F.lit(False)).alias("top")))).alias("hs"))
    first = F.get("hs", F.lit(0))
    dash = lambda s: F.replace(s, F.lit("-"), F.lit("–"))
    rest = F.filter(F.slice("hs", 2, F.greatest(F.size("hs") - 1, F.lit(1))), lambda h: h["stages"] != "")
    note = F.when((first["stages"] != "") & (F.size(rest) > 0), F.concat(dash(first["stages"]), F.lit(" only; "), F.concat_ws(", ", F.transform(rest, lambda h: F.concat(dash(h["stages"]), F.lit(" at "), h["school"])))))
    per = per.select(key, "sector", first["school"].alias("school"), first["score"].alias("score"), first["top"].alias("top"), note.alias("note"))
    nd, rc = F.col("sector") == "ND", F.col("sector") == "RC"
    pick = lambda c, v, n: F.max(F.when(c, F.col(v))).alias(n)
    wide = per.groupBy(key).agg(pick(nd, "school", "primary"), pick(nd, "score", "primary_score"), pick(nd, "note", "primary_note"), pick(rc, "school", "primary_rc"), pick(rc, "score", "primary_rc_score"), pick(rc, "note", "primary_rc_note"), F.bool_or((nd | rc) & F.col("top")).alias("top_primary"))
    return points.join(wide, key, "left")


def _cells_about(max_m: float, cell: float, lat: Column | None = None) -> Column:
    """Cells to look at on each side so that none within the distance is missed: up and down, or at a latitude to the sides."""
    metres = math.radians(cell) * EARTH_RADIUS_M
    if lat is None:
        return F.lit(math.ceil(max_m / metres))
    # The pole-most place that is near enough has the narrowest cells.
    most = F.least(F.lit(89.99), F.abs(lat) + math.degrees(max_m / EARTH_RADIUS_M))
    return F.least(F.lit(math.ceil(360 / cell)), F.ceil(F.lit(max_m / metres) / F.cos(F.radians(most)))).cast("int")


def within(left: DataFrame, right: DataFrame, max_m: float, left_at: tuple[str, str] = ("lat", "lng"), right_at: tuple[str, str] = ("lat", "lng"), cell: float = CELL, how: str = "inner") -> DataFrame:
    """Pairs at most ``max_m`` apart, with their distance. The right side is spread over neighbouring cells (more of them to the
    sides the nearer it is to a pole), so keep it the smaller one; column names must differ apart from the positions, which the
    right side gives up for ``__lat``, ``__lng``. Places on the two sides of the date line are no neighbours."""
    steps = lambda n: F.sequence(-n, n)
    named = right.withColumnsRenamed({right_at[0]: "__lat", right_at[1]: "__lng"}).where("__lat is not null and __lng is not null")
    spread = named.withColumn("__dy", F.explode(steps(_cells_about(max_m, cell)))).withColumn("__dx", F.explode(steps(_cells_about(max_m, cell, F.col("__lat")))))
    spread = spread.withColumn("__cy", F.floor(F.col("__lat") / cell) + F.col("__dy")).withColumn("__cx", F.floor(F.col("__lng") / cell) + F.col("__dx")).drop("__dy", "__dx")
    # Spark does not see how many cells a row goes to and would broadcast all of them from the driver.
    spread = spread.hint("merge")
    base = left.withColumn("__py", F.floor(F.col(left_at[0]) / cell)).withColumn("__px", F.floor(F.col(left_at[1]) / cell))
    d = haversine_m(left_at[0], left_at[1], "__lat", "__lng")
    joined = base.join(spread, (F.col("__py") == F.col("__cy")) & (F.col("__px") == F.col("__cx")) & (d <= max_m), how)
    return joined.withColumn("distance_m", d).drop("__cy", "__cx", "__py", "__px", "__lat", "__lng")


def nearest(left: DataFrame, right: DataFrame, key: str, fields: list[str], max_m: float, rank: Column | None = None, **kw) -> DataFrame:
    """For each left key the struct of ``fields`` of the best right row within reach: least ``rank`` (distance), then ``fields``."""
    by = F.struct(rank if rank is not None else F.col("distance_m"), *fields)
    best = lambda pairs: pairs.groupBy(key).agg(F.min_by(F.struct(*fields, "distance_m"), by).alias("nearest"))
    if rank is not None:
        return best(within(left, right, max_m, **kw))
    # By distance, what is found within a short reach is the nearest; the others look farther.
    found, todo = None, left
    for reach in (max_m / 16, max_m / 4, max_m):
        near = best(within(todo, right, reach, **kw | {"cell": 1.001 * math.degrees(reach / EARTH_RADIUS_M)}))
        near = materialise(near, "nearest") if reach < max_m else near
        found = near if found is None else found.unionByName(near)
        seen = near.select(F.col(key).alias("__key"))
        todo = todo.join(seen, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    return found


def at_point(layer: DataFrame, lng: float, lat: float, **kw) -> DataFrame:
    """The features of a layer at one point."""
    point = layer.sparkSession.range(1).select(F.lit(float(lng)).alias("lng"), F.lit(float(lat)).alias("lat"))
    return point_in_polygon(point, layer, **kw).drop("lng", "lat")


def polygons_from_rings(rings: Column) -> Column:
    """Polygons from rings of (x, y) points: clockwise rings are shells, the others holes of the shell that contains their
    first point; rings of fewer than four points go. Without a shell all rings are shells. Overlapping shells stay apart."""
    area = lambda ring: F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])
    whole = F.filter(rings, lambda r: F.size(r) >= 4)
    shells, holes = F.filter(whole, lambda r: area(r) < 0), F.filter(whole, lambda r: area(r) >= 0)
    middle = lambda h: (F.get(h, F.lit(0)), F.get(h, F.lit(2)))

    def of(shell: Column) -> Column:
        own = F.filter(holes, lambda h: _odd(_edges(shell), (middle(h)[0]["x"] + middle(h)[1]["x"]) / 2, (middle(h)[0]["y"] + middle(h)[1]["y"]) / 2))
        return F.concat(F.array(shell), own)

    return F.when(F.size(shells) > 0, F.transform(shells, of)).when(F.size(whole) > 0, F.transform(whole, lambda r: F.array(r)))
