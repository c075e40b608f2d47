"""Lines that meet end to end become one, and lose the points that they can do without. Rounds over tables; no line is joined in Python.

A line can be travelled both ways: a way is a line and whether it is travelled back. Where exactly two ends of lines of one key meet, the
way that comes in goes on with the one that leads out. Which ways make up one chain, and in what order, is found by pointer
jumping: each way knows one before it, then the one 2, 4, 8 before, until it knows the first; a round looks at unsettled ways only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.session import discard, materialise


def _ranked(ways: DataFrame) -> DataFrame:
    """(way, head, steps, ring): the first way of each way's chain, or the least of its ring, and how many steps it lies back.

    ways: (way, before), those that have one before them; the way before a first one is in no row. Rounds double the distance and
    go on with what has not ended, so there are as many as the longest chain or ring has binary digits, and two. Going back by twice a
    distance meets the same least way in both halves only where it goes round.
    """
    state = materialise(ways.select("way", "before", F.lit(None).cast(ways.schema["way"].dataType).alias("head"), F.lit(1).alias("steps"), F.lit(False).alias("ring"), F.struct(F.col("before").alias("way"), F.lit(1).alias("back")).alias("least")), "lines-jumps")
    reach, done, kept = 1, [], [state]
    while True:
        open_ = state.where("head is null")
        ahead = state.select(F.col("way").alias("before"), F.lit(True).alias("known"), F.col("before").alias("b2"), F.col("head").alias("h2"), F.col("steps").alias("s2"), F.col("ring").alias("r2"), F.col("least").alias("l2"))
        met = open_.join(ahead, "before", "left")
        far = F.struct(F.col("l2.way").alias("way"), (F.col("l2.back") + reach).alias("back"))
        # Where the way met is known to go round, the distance by now goes about the whole ring.
        round_ = F.col("known") & F.when(F.col("h2").isNotNull(), F.col("r2")).otherwise(F.col("least.way") == F.col("l2.way"))
        itself = F.col("least.way") == F.col("way")
        # A way that nothing is known of is a first one; one whose chain is settled settles this one.
        head = F.when(F.col("known").isNull(), F.col("before")).when(round_, F.col("least.way")).when(F.col("h2").isNotNull(), F.col("h2"))
        steps = F.when(F.col("known").isNull(), F.lit(reach)).when(round_, F.when(itself, 0).otherwise(F.col("least.back"))).when(F.col("h2").isNotNull(), F.col("s2") + reach)
        own = F.struct("way", F.when(head.isNull(), F.col("b2")).alias("before"), head.alias("head"), F.coalesce(steps, F.lit(2 * reach)).alias("steps"), F.coalesce(round_, F.lit(False)).alias("ring"), F.least("least", far).alias("least"))
        # What has ended before and was met here may be met once more.
        seen = F.when(F.col("h2").isNotNull(), F.struct(F.col("before").alias("way"), F.col("b2").alias("before"), F.col("h2").alias("head"), F.col("s2").alias("steps"), F.col("r2").alias("ring"), F.col("l2").alias("least")))
        both = met.select(F.explode(F.array_compact(F.array(F.struct(own.alias("row"), F.lit(True).alias("fresh")), F.when(F.col("h2").isNotNull(), F.struct(seen.alias("row"), F.lit(False).alias("fresh")))))).alias("x"))
        after = materialise(both.select("x.row.*", "x.fresh"), "lines-jumps")
        done.append(after.where("fresh and head is not null").select("way", "head", "steps", "ring"))
        kept.append(after)
        if after.where("head is null").isEmpty():
            break
        state, reach = after.drop("fresh"), 2 * reach
    out = materialise(reduce(DataFrame.unionByName, done), "lines-ranked")
    discard(*kept)
    return out


def chains(lines: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, chain, place, line, back) from (key, line, a, b): lines in the order of their chain, and whether they are travelled backwards.

    a and b, of any type, are a line's ends; a line belongs to one key. Ends meet within a key, and go on where two meet; where one or
    three and more do, chains end. Chains are numbered in the order of their first lines, the lesser of their two ends' lines; a ring begins
    with its least line, forwards. A line whose own ends meet is a ring of itself. ``also``: columns of lines that follow.
    """
    given = materialise(lines.select("key", "line", "a", "b", *also), "lines")
    # Numbers in the order of lines: ways and ends are whole numbers from here on, 2 * id forwards or at the beginning, 2 * id + 1 back or at the end.
    line = materialise(given.repartitionByRange("line").sortWithinPartitions("line").withColumn("id", F.monotonically_increasing_id()), "lines-numbered")
    discard(given)
    ends = line.select("key", F.explode(F.array(F.struct((2 * F.col("id")).alias("e"), F.col("a").alias("node")), F.struct((2 * F.col("id") + 1).alias("e"), F.col("b").alias("node")))).alias("x")).select("key", "x.e", "x.node")
    two = ends.groupBy("key", "node").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("x"), F.max("e").alias("y")).where("n = 2")
    # A way in by one end goes on by the other: the way that ends at an end is back where that is the beginning, and the way that begins there forwards.
    into = lambda e: F.col(e).bitwiseXOR(F.lit(1))
    goes = two.select(F.explode(F.array(F.struct(into("x").alias("before"), F.col("y").alias("way")), F.struct(into("y").alias("before"), F.col("x").alias("way")))).alias("p")).select("p.before", "p.way")
    ranked = _ranked(goes)
    # A line knows where it stands either way; a way that has none before it is the first of its own.
    told = lambda c, back: F.max(F.when(F.col("way") % 2 == back, F.col(c))).alias(f"{c}{back}")
    sides = ranked.groupBy(F.shiftright("way", 1).alias("id")).agg(told("head", 0), told("steps", 0), told("head", 1), told("steps", 1), F.max("ring").alias("ring"))
    known = line.join(sides, "id", "left")
    there, back = F.coalesce("head0", 2 * F.col("id")), F.coalesce("head1", 2 * F.col("id") + 1)
    first, last = F.shiftright(there, 1), F.shiftright(back, 1)
    # Of the two ways along a chain, that whose first line is the lesser (the last is the first of the other); of the two about a ring, that with its least line forwards.
    forwards = F.when(F.coalesce("ring", F.lit(False)), there % 2 == 0).otherwise((first < last) | ((first == last) & (there % 2 == 0)))
    chosen = known.withColumn("fwd", forwards)
    return chosen.select("key", F.when(F.col("fwd"), first).otherwise(last).alias("chain"), F.coalesce(F.when(F.col("fwd"), F.col("steps0")).otherwise(F.col("steps1")), F.lit(0)).alias("place"), "line", F.when(F.col("fwd"), 0).otherwise(1).alias("back"), *also)


def merged(lines: DataFrame) -> DataFrame:
    """(key, chain, points) from (key, line, points): the points of a chain's lines in order, those where lines meet once; chain is its first line."""
    usable = lines.where(F.size("points") > 1).withColumns({"a": F.get("points", F.lit(0)), "b": F.try_element_at("points", F.lit(-1))})
    turned = chains(usable, ("points",)).select("key", "chain", "place", "line", F.when(F.col("back") == 1, F.reverse("points")).otherwise(F.col("points")).alias("points"))
    own = F.when(F.col("place") == 0, F.col("points")).otherwise(F.slice("points", 2, F.size("points") - 1))
    parts = turned.groupBy("key", "chain").agg(F.array_sort(F.collect_list(F.struct("place", "line", own.alias("points")))).alias("parts"))  # one line
    return parts.select("key", F.get("parts", F.lit(0))["line"].alias("chain"), F.flatten(F.transform("parts", lambda p: p["points"])).alias("points"))


def _off(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a stretch."""
    dx, dy = x2 - x1, y2 - y1
    norm = dx * dx + dy * dy
    t = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / norm))).otherwise(F.lit(0.0))
    ax, ay = px - x1 - t * dx, py - y1 - t * dy
    return F.sqrt(ax * ax + ay * ay)


def simplified(lines: DataFrame, tolerance: float, keys: tuple[str, ...] = ("key", "chain")) -> DataFrame:
    """The keys and points of each line, without points that lie within the tolerance of what stays.

    All stretches of all lines are halved at once: a point between two that stay, the farthest from the stretch between them
    and beyond the tolerance, stays too (the first of equals). Rounds go on with the lines of which a stretch was halved; a round
    is an expression of the line's row, so nothing is shuffled or sorted.
    """
    plain = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    rows = lines.where(F.size("points") > 0).select(*keys, plain.alias("points"))
    stretch = "array<struct<i:int,j:int>>"
    end = F.size("points") - 1
    whole = F.array(F.struct(F.lit(0).alias("i"), end.alias("j"))).cast(stretch)
    all_ = materialise(rows.withColumns({"stay": F.array(F.lit(0), end), "open": F.when(end > 1, whole).otherwise(F.array().cast(stretch))}), "lines-kept")
    done, now = all_.where(F.size("open") == 0).select(*keys, "points"), all_.where(F.size("open") > 0)

    def farthest(s: Column) -> Column:
        a, b = F.get("points", s["i"]), F.get("points", s["j"])

        def farther(best: Column, at: Column) -> Column:
            p = F.get("points", at)
            off = _off(p["x"], p["y"], a["x"], a["y"], b["x"], b["y"])
            return F.when(off > best["off"], F.struct(off.alias("off"), at.alias("at"))).otherwise(best)

        best = F.aggregate(F.sequence(s["i"] + 1, s["j"] - 1), F.struct(F.lit(float(tolerance)).alias("off"), F.lit(-1).alias("at")), farther)
        return F.struct(s["i"].alias("i"), s["j"].alias("j"), best["at"].alias("at"))

    while not now.isEmpty():
        cut = now.withColumn("cut", F.filter(F.transform("open", farthest), lambda c: c["at"] >= 0))
        halves = F.flatten(F.transform("cut", lambda c: F.array(F.struct(c["i"].alias("i"), c["at"].alias("j")), F.struct(c["at"].alias("i"), c["j"].alias("j")))))
        after = materialise(cut.select(*keys, "points", F.concat("stay", F.transform("cut", lambda c: c["at"])).alias("stay"), F.filter(halves, lambda h: h["j"] - h["i"] > 1).cast(stretch).alias("open")), "lines-kept")
        done = done.unionByName(after.where(F.size("open") == 0).select(*keys, F.transform(F.array_sort("stay"), lambda at: F.get("points", at)).alias("points")))
        now = after.where(F.size("open") > 0)
    return done
