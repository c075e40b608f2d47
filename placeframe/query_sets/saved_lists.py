"""Saved lists and searches of one user, over customers as homes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeframe.operators import saved
from placeframe.registry import literal, query, table

_C = "c AS (SELECT c_custkey AS k, c_custkey::VARCHAR AS id, c_name AS title, floor(abs(c_acctbal))::INT AS price FROM customer)"
#: Every third customer is on the Shortlist, those that leave 1 on Viewing, every fifth of the rest rejected; a quarter is gone since.
_I = f"{_C}, i AS (SELECT CASE k % 3 WHEN 0 THEN 'Shortlist' WHEN 1 THEN 'Viewing' ELSE 'Rejected' END AS list, id, k, k % 7 <> 0 AS shot FROM c WHERE k % 3 < 2 OR k % 5 = 0), live AS (SELECT * FROM c WHERE k % 4 <> 0)"


def homes(spark: SparkSession, sf_dir: str, more: int = 0) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("id"), F.lit("").alias("address"), F.col("c_name").alias("title"), (F.floor(F.abs("c_acctbal")) + more).cast("int").alias("price"), F.lit("u").alias("url"), F.lit("i").alias("image"))


def state(spark: SparkSession, sf_dir: str) -> saved.Saved:
    h = homes(spark, sf_dir)
    name = F.when(F.col("k") % 3 == 0, "Shortlist").when(F.col("k") % 3 == 1, "Viewing").otherwise("Rejected")
    items = h.where("k % 3 < 2 OR k % 5 = 0").select(name.alias("list"), "id", F.col("k").cast("int").alias("pos"), F.when(F.col("k") % 7 != 0, saved.snapshot()).alias("snap"))
    lists = spark.createDataFrame([(n, i) for i, n in enumerate(saved.DEFAULT_LISTS)], "list string, pos int")
    return saved.Saved(lists, items, spark.createDataFrame([("cheap", "maxPrice=1", 0), ("big", "minBeds=5", 1)], "name string, hash string, pos int"))


def live(spark, sf_dir, more: int = 0) -> DataFrame:
    return homes(spark, sf_dir, more).where("k % 4 <> 0")


@query(f"WITH {_I} SELECT live.id, title FROM live JOIN i USING (id) WHERE list = 'Shortlist'")
def saved_live(spark, sf_dir):
    return state(spark, sf_dir).live("Shortlist", live(spark, sf_dir)).select("id", "title")


@query(f"WITH {_I} SELECT i.id, c.title, c.price FROM i JOIN c USING (id) WHERE list = 'Shortlist' AND shot AND i.id NOT IN (SELECT id FROM live)")
def saved_gone(spark, sf_dir):
    return state(spark, sf_dir).gone("Shortlist", live(spark, sf_dir)).select("id", "snap.title", "snap.price")


@query(f"WITH {_I} SELECT i.list, i.id, CASE WHEN i.k % 4 <> 0 THEN c.price + 7 WHEN shot THEN c.price END AS price FROM i JOIN c USING (id)")
def saved_refresh(spark, sf_dir):
    return state(spark, sf_dir).refresh(live(spark, sf_dir, 7)).items.select("list", "id", "snap.price")


@query(f"WITH {_I} SELECT DISTINCT id FROM i WHERE list <> 'Rejected'")
def saved_ids(spark, sf_dir):
    return state(spark, sf_dir).saved_ids()


@query(f"WITH {_I} SELECT count(DISTINCT id) AS homes FROM i")
def saved_homes_count(spark, sf_dir):
    return saved.shared_homes(state(spark, sf_dir))


@query(f"WITH {_I} SELECT list, id FROM i WHERE id <> '3' UNION ALL SELECT 'Rejected', '3'")
def saved_toggle_rejected(spark, sf_dir):
    return state(spark, sf_dir).toggle("Rejected", homes(spark, sf_dir), "3")[0].items.select("list", "id")


@query(f"WITH {_I} SELECT list, id FROM i WHERE NOT (id = '5' AND list = 'Rejected') UNION ALL SELECT 'Viewing', '5'")
def saved_toggle_on(spark, sf_dir):
    return state(spark, sf_dir).toggle("Viewing", homes(spark, sf_dir), "5")[0].items.select("list", "id")


@query(f"WITH {_I} SELECT list, id FROM i WHERE NOT (id = '6' AND list = 'Shortlist')")
def saved_toggle_off(spark, sf_dir):
    return state(spark, sf_dir).toggle("Shortlist", homes(spark, sf_dir), "6")[0].items.select("list", "id")


@query(f"WITH {_I} SELECT list, id FROM i WHERE NOT (id = '9' AND list = 'Shortlist')")
def saved_remove(spark, sf_dir):
    return state(spark, sf_dir).remove("Shortlist", "9").items.select("list", "id")


@query(literal({"step": "INT", "names": "VARCHAR", "done": "BOOLEAN"}, [(0, "Shortlist,Viewing,New,Rejected", True), (1, "Shortlist,Viewing,Rejected", False), (2, "Best,Viewing,Rejected", True), (3, "Shortlist,Viewing,Rejected", False), (4, "Shortlist,Rejected", True), (5, "Shortlist,Viewing,Rejected", False)]))
def saved_list_commands(spark, sf_dir):
    s = state(spark, sf_dir)
    steps = [s.add_list(" New "), s.add_list("Viewing"), s.rename_list("Shortlist", "Best"), s.rename_list("Rejected", "X"), s.delete_list("Viewing"), s.delete_list("Rejected")]
    return spark.createDataFrame([(i, ",".join(x.names()), ok) for i, (x, ok) in enumerate(steps)], "step int, names string, done boolean")


@query(f"WITH {_I} SELECT CASE list WHEN 'Shortlist' THEN 'Best' ELSE list END AS list, id FROM i")
def saved_rename(spark, sf_dir):
    return state(spark, sf_dir).rename_list("Shortlist", "Best")[0].items.select("list", "id")


@query(f"WITH {_I} SELECT list, id FROM i WHERE list <> 'Viewing'")
def saved_delete_list(spark, sf_dir):
    return state(spark, sf_dir).delete_list("Viewing")[0].items.select("list", "id")


@query(literal({"step": "INT", "name": "VARCHAR", "hash": "VARCHAR"}, [(0, "cheap", "maxPrice=2"), (0, "big", "minBeds=5"), (1, "cheap", "maxPrice=1"), (1, "big", "minBeds=5"), (1, "new", "a=b"), (2, "big", "minBeds=5"), (3, "cheap", "maxPrice=1"), (3, "big", "minBeds=5")]))
def saved_searches(spark, sf_dir):
    s = state(spark, sf_dir)
    steps = [s.save_search(" cheap ", "maxPrice=2"), s.save_search("new", "a=b"), s.delete_search("cheap"), s.save_search("  ", "x")]
    out = [x.searches.select(F.lit(i).alias("step"), "name", "hash") for i, x in enumerate(steps)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT 'Viewing' AS list WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = 4)")
def saved_lists_for(spark, sf_dir):
    return state(spark, sf_dir).lists_for("4")


@query(f"WITH {_I}, other AS (SELECT 'Shortlist' AS list, id FROM c WHERE k % 6 < 2 UNION ALL SELECT 'Theirs', id FROM c WHERE k % 50 = 0), a AS (SELECT list, id, 0 AS o, k FROM i UNION ALL SELECT other.list, other.id, 1, c.k FROM other JOIN c USING (id)), f AS (SELECT list, id, min((o, k)) AS first FROM a GROUP BY list, id) SELECT list, id, (row_number() OVER (PARTITION BY list ORDER BY first) - 1)::INT AS pos FROM f")
def saved_merge(spark, sf_dir):
    h = homes(spark, sf_dir)
    theirs = h.where("k % 6 < 2").select(F.lit("Shortlist").alias("list"), "id", F.col("k").cast("int").alias("pos"), saved.snapshot().alias("snap"))
    theirs = theirs.unionByName(h.where("k % 50 = 0").select(F.lit("Theirs").alias("list"), "id", F.col("k").cast("int").alias("pos"), saved.snapshot().alias("snap")))
    other = saved.Saved(spark.createDataFrame([("Shortlist", 0), ("Theirs", 1), ("Rejected", 2)], "list string, pos int"), theirs, spark.createDataFrame([("cheap", "maxPrice=9", 0)], "name string, hash string, pos int"))
    return state(spark, sf_dir).merge(other).items.select("list", "id", "pos")


@query(f"WITH {_I} SELECT i.list, i.id, CASE WHEN shot THEN c.title END AS title, NULL::VARCHAR AS image FROM i JOIN c USING (id)")
def saved_link_round_trip(spark, sf_dir):
    back = saved.decode(spark, state(spark, sf_dir).export())
    return back.items.select("list", "id", "snap.title", "snap.image")


_STATES = [({}, "Shortlist,Viewing,Rejected"), ({"searches": [], "lists": [{"name": "A", "ids": ["1", "1"]}]}, "A,Rejected"), ({"searches": [{"name": "x"}], "lists": [{"ids": []}, {"name": "Rejected", "ids": []}, {"name": "B", "ids": "no"}]}, "Rejected"), (None, "Shortlist,Viewing,Rejected")]


@query(literal({"i": "INT", "names": "VARCHAR", "items": "BIGINT", "searches": "BIGINT"}, [(i, names, 1 if i == 1 else 0, 0) for i, (_, names) in enumerate(_STATES)]))
def saved_states(spark, sf_dir):
    got = [saved.from_state(spark, s) for s, _ in _STATES]
    return spark.createDataFrame([(i, ",".join(s.names()), s.items.count(), s.searches.count()) for i, s in enumerate(got)], "i int, names string, items long, searches long")


#: A user's events are commands on one of forty homes: every seventh takes off, the others put on a list or take off it.
_COMMANDS = "c AS (SELECT user_id AS u, event_id % 40 AS id, row_number() OVER (PARTITION BY user_id, event_id % 40 ORDER BY ts, event_id) AS n, CASE event_type WHEN 'click' THEN 'Shortlist' WHEN 'view' THEN 'Viewing' ELSE 'Rejected' END AS list, event_id % 7 = 0 AS off FROM events)"
_PUT = "CASE WHEN off OR list_contains(lists, list) THEN list_filter(lists, lambda x: x <> list) WHEN list = 'Rejected' THEN ['Rejected'] ELSE list_append(list_filter(lists, lambda x: x <> 'Rejected'), list) END"


@query(f"WITH RECURSIVE {_COMMANDS}, f AS (SELECT u, id, 0::BIGINT AS n, []::VARCHAR[] AS lists FROM c WHERE n = 1 UNION ALL SELECT f.u, f.id, c.n, {_PUT} FROM f JOIN c ON c.u = f.u AND c.id = f.id AND c.n = f.n + 1) SELECT u AS user_id, id, array_to_string(arg_max(lists, n), ',') AS lists FROM f GROUP BY u, id")
def saved_fold(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "click", "Shortlist").when(F.col("event_type") == "view", "Viewing").otherwise("Rejected")
    commands = e.select(F.col("user_id").alias("user"), (F.col("event_id") % 40).alias("id"), name.alias("list"), F.when(F.col("event_id") % 7 == 0, "remove").otherwise("toggle").alias("action"), F.struct("ts", "event_id").alias("ord"))
    return saved.fold(commands).select(F.col("user").alias("user_id"), "id", F.concat_ws(",", "lists").alias("lists"))
