"""Clusters of points for each zoom of a map: leaders within a radius, from the deepest zoom upwards.

At each zoom, in the order of their numbers, a point that no earlier leader has taken becomes a leader and takes all points within
the radius. A cluster has the weight of its points and their centre, and is a point of the next zoom under its leader's number. So a
point is a leader if and only if none of its lower neighbours is, which is settled in rounds: what has no open lower point in the
cells about it leads, what has a lower leader does not. The least open point leads in each round, so the rounds end.

Points are projected to the unit square of the map (Mercator); the radius is in pixels of tiles of 512. Points meet leaders on a
grid: an equi-join on 25 cells. Repeated numbers are not allowed; points without a position take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.session import discard, materialise

TILE = 512


def projected(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Places on the unit square, from west to east and north to south."""
    s = F.sin(F.radians(lat))
    return lng / 360 + 0.5, F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 - 0.25 * F.log((1 + s) / (1 - s)) / math.pi))


#: Side of a cell in radii: less than 1 / sqrt(2), so that the points of a cell are neighbours and one of them at most leads.
_SIDE = 0.7


def _cells(points: DataFrame, side: float) -> DataFrame:
    return points.withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)})


def _about(cells: DataFrame) -> DataFrame:
    """Each row in its own cell and the 24 about it, which hold all that is within the radius."""
    near = F.explode(F.array(*map(F.lit, range(-2, 3))))
    out = cells.withColumn("dx", near).withColumn("dy", near)
    return out.withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}).drop("dx", "dy").hint("merge")


def leaders(points: DataFrame, radius: float) -> DataFrame:
    """(id, leader) of each point (id, x, y).

    A round looks at the least open number of each cell. One that is less than those of all cells within reach has no open lower
    neighbour and leads; what lies within the radius of new leaders is no longer open. So points meet leaders, of which a
    cell has one at most, never all their neighbours, however many lie in one place.
    """
    side = radius * _SIDE
    own = materialise(_cells(points.select("id", "x", "y"), side), "clusters-points")
    open_, lead = own, None
    close = lambda: (F.col("x") - F.col("lx")) * (F.col("x") - F.col("lx")) + (F.col("y") - F.col("ly")) * (F.col("y") - F.col("ly")) <= radius * radius
    named = lambda df: df.select(F.col("id").alias("low"), F.col("x").alias("lx"), F.col("y").alias("ly"), "cx", "cy")
    while not open_.isEmpty():
        least = materialise(open_.groupBy("cx", "cy").agg(F.min(F.struct("id", "x", "y")).alias("p")), "clusters-least")
        lowest = _about(least.select("cx", "cy", F.col("p.id").alias("low"))).groupBy("cx", "cy").agg(F.min("low").alias("low"))
        fresh = materialise(least.join(lowest, ["cx", "cy"]).where(F.col("p.id") == F.col("low")).select("p.*", "cx", "cy"), "clusters-lead")
        taken = open_.join(_about(named(fresh)), ["cx", "cy"]).where(close()).select("id")
        left = materialise(open_.join(taken.distinct(), "id", "left_anti"), "clusters-open")
        discard(least, None if open_ is own else open_)
        lead = fresh if lead is None else lead.unionByName(fresh)
        open_ = left
    if lead is None:
        return own.select("id", F.col("id").alias("leader"))
    near = own.join(_about(named(lead)), ["cx", "cy"]).where((F.col("low") <= F.col("id")) & close())
    return near.groupBy("id").agg(F.min("low").alias("leader"))


def by_zoom(points: DataFrame, zooms: range, radius_px: float = 50, key: str = "id", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """(zoom, id, n, x, y): clusters of the zooms, each under its leader's number, deepest zoom first; x and y on the unit square."""
    x, y = projected(F.col(lng), F.col(lat))
    now = points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(F.col(key).alias("id"), x.alias("x"), y.alias("y"), F.lit(1).cast("long").alias("n"))
    out = None
    for zoom in sorted(zooms, reverse=True):
        own = materialise(now, "clusters-level")
        of = leaders(own, radius_px / (TILE * 2**zoom))
        joined = own.join(of, "id").groupBy(F.col("leader").alias("id")).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y"), F.sum("n").alias("n"))
        now = materialise(joined, "clusters")
        level = now.select(F.lit(zoom).alias("zoom"), "id", "n", "x", "y")
        out = level if out is None else out.unionByName(level)
    return out
