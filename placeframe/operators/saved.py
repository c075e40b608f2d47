"""Saved lists and searches as small tables: lists (list, pos), items (list, id, pos, snap) and searches (name, hash, pos)."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placeframe.operators.search import REJECTED

DEFAULT_LISTS = ("Shortlist", "Viewing", REJECTED)
SNAP = "struct<address:string,title:string,price:int,url:string,image:string>"
_LISTS, _ITEMS, _SEARCHES = "list string, pos int", f"list string, id string, pos int, snap {SNAP}", "name string, hash string, pos int"


@dataclass(frozen=True)
class Saved:
    """A user's state. Commands return a new state; a user's lists are short, so names are checked on the driver."""

    lists: DataFrame
    items: DataFrame
    searches: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.lists.sparkSession

    def names(self) -> list[str]:
        return [r[0] for r in self.lists.orderBy("pos").select("list").collect()]

    def _named(self, names: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(n, i) for i, n in enumerate(names)], _LISTS)

    def ids(self, name: str) -> DataFrame:
        return self.items.where(F.col("list") == name).select("id").distinct()

    def saved_ids(self) -> DataFrame:
        return self.items.where(F.col("list") != REJECTED).select("id").distinct()

    def lists_for(self, home: str) -> DataFrame:
        return self.items.where(F.col("id") == home).join(self.lists.select("list", F.col("pos").alias("__p")), "list").orderBy("__p").select("list")

    def toggle(self, name: str, homes: DataFrame, home: str) -> tuple[Saved, bool]:
        """Put a home on a list or take it off; Rejected excludes all other lists. Also tells whether it is on now."""
        if name not in self.names():
            return self, False
        if self.items.where((F.col("list") == name) & (F.col("id") == home)).limit(1).count():
            return self.remove(name, home), False
        leaves = F.col("list") != name if name == REJECTED else F.col("list") == REJECTED
        rest = self.items.where(~((F.col("id") == home) & leaves))
        new = homes.where(F.col("id") == home).limit(1).select(F.lit(name).alias("list"), F.col("id").cast("string").alias("id"), F.lit(None).cast("int").alias("pos"), snapshot().alias("snap"))
        last = self.items.where(F.col("list") == name).agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("__m"))
        return replace(self, items=rest.unionByName(new.crossJoin(F.broadcast(last)).withColumn("pos", F.col("__m") + 1).drop("__m"))), True

    def remove(self, name: str, home: str) -> Saved:
        return replace(self, items=self.items.where(~((F.col("list") == name) & (F.col("id") == home))))

    def add_list(self, name: str) -> tuple[Saved, bool]:
        """A new list before Rejected, which stays last."""
        names, name = self.names(), name.strip()
        if not name or name in names:
            return self, False
        return replace(self, lists=self._named([*names[:-1], name, names[-1]])), True

    def rename_list(self, old: str, new: str) -> tuple[Saved, bool]:
        names, new = self.names(), new.strip()
        if old not in names or old == REJECTED or not new or new in names:
            return self, False
        renamed = F.when(F.col("list") == old, new).otherwise(F.col("list"))
        return replace(self, lists=self._named([new if n == old else n for n in names]), items=self.items.withColumn("list", renamed)), True

    def delete_list(self, name: str) -> tuple[Saved, bool]:
        names = self.names()
        if name == REJECTED or name not in names:
            return self, False
        return replace(self, lists=self._named([n for n in names if n != name]), items=self.items.where(F.col("list") != name)), True

    def save_search(self, name: str, hash_: str) -> Saved:
        name = name.strip()
        if not name:
            return self
        one = self.spark.createDataFrame([(name, hash_)], "name string, __h string")
        last = self.searches.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("__m"))
        both = self.searches.join(F.broadcast(one), "name", "full_outer").crossJoin(F.broadcast(last))
        return replace(self, searches=both.select("name", F.coalesce("__h", "hash").alias("hash"), F.coalesce(F.col("pos"), F.col("__m") + 1).cast("int").alias("pos")))

    def delete_search(self, name: str) -> Saved:
        return replace(self, searches=self.searches.where(F.col("name") != name))

    def refresh(self, homes: DataFrame) -> Saved:
        """Snapshots of the homes that are still listed, brought up to date."""
        now = homes.select(F.col("id").alias("__id"), snapshot().alias("__snap"))
        out = self.items.join(now, F.col("id") == F.col("__id"), "left")
        return replace(self, items=out.withColumn("snap", F.coalesce("__snap", "snap")).drop("__id", "__snap"))

    def live(self, name: str, homes: DataFrame) -> DataFrame:
        return homes.join(self.ids(name), "id", "left_semi")

    def gone(self, name: str, homes: DataFrame) -> DataFrame:
        """Saved homes that are listed no more, as they were."""
        return self.items.where((F.col("list") == name) & F.col("snap").isNotNull()).join(homes.select("id"), "id", "left_anti").orderBy("pos")

    def merge(self, other: Saved) -> Saved:
        """Add another's lists and searches: its new ids follow ours, its searches of the same name replace ours."""
        names = self.names()
        more = [n for n in other.names() if n and n not in names]
        both = self.items.withColumn("__o", F.lit(0)).unionByName(other.items.withColumn("__o", F.lit(1)))
        first = both.withColumn("__n", F.row_number().over(Window.partitionBy("list", "id").orderBy("__o", "pos"))).where("__n = 1")
        placed = first.withColumn("pos", (F.row_number().over(Window.partitionBy("list").orderBy("__o", "pos")) - 1).cast("int")).drop("__o", "__n")
        # Theirs of a name replace ours where it stands; new ones follow in their order.
        theirs = other.searches.where("name is not null and trim(name) <> '' and hash is not null").select(F.trim("name").alias("name"), F.struct("pos", "hash").alias("s")).groupBy("name").agg(F.max("s").alias("last"), F.min("s.pos").alias("first"))
        joined = self.searches.join(theirs, "name", "full_outer")
        order = Window.orderBy(F.col("pos").isNull(), "pos", "first")  # one user's searches
        searches = joined.select("name", F.coalesce("last.hash", "hash").alias("hash"), (F.row_number().over(order) - 1).cast("int").alias("pos"))
        return replace(self, lists=self._named([*names[:-1], *more, names[-1]]), items=placed, searches=searches)

    def export(self) -> str:
        """All of it as URL-safe base64 of JSON, without images and padding."""
        snap = F.struct("snap.address", "snap.title", "snap.price", "snap.url")
        rows = self.items.orderBy("pos").select("list", "id", F.to_json(snap).alias("s")).collect()
        lists = [{"name": n, "ids": [r["id"] for r in rows if r["list"] == n], "snap": {r["id"]: json.loads(r["s"]) for r in rows if r["list"] == n and r["s"]}} for n in self.names()]
        state = {"searches": [{"name": r["name"], "hash": r["hash"]} for r in self.searches.orderBy("pos").collect()], "lists": lists}
        return base64.urlsafe_b64encode(json.dumps(state, ensure_ascii=False).encode()).decode().rstrip("=")


def fold(commands: DataFrame) -> DataFrame:
    """(user, id, lists): what the commands of all users leave on their lists, in the order in which a home was put on them.

    commands: (user, id, list, action, ord), toggle or remove, in the order of ord. A home on Rejected is on no other list, and is
    taken off it by being put on one. Only the commands of one user on one home hang on each other, so those are folded: an
    aggregation on both and a fold over its sorted list; users with many homes and homes with many users are spread alike.
    """
    steps = commands.groupBy("user", "id").agg(F.array_sort(F.collect_list(F.struct("ord", "list", "action"))).alias("steps"))

    def step(on: Column, c: Column) -> Column:
        off = F.array_remove(on, c["list"])
        put = F.when(c["list"] == REJECTED, F.array(c["list"])).otherwise(F.array_append(F.array_remove(on, REJECTED), c["list"]))
        return F.when((c["action"] == "remove") | F.array_contains(on, c["list"]), off).when(c["action"] == "toggle", put).otherwise(on)

    return steps.select("user", "id", F.aggregate("steps", F.array().cast("array<string>"), step).alias("lists"))


def snapshot():
    return F.struct(F.col("address"), F.col("title"), F.col("price").cast("int").alias("price"), F.col("url"), F.col("image"))


def from_state(spark: SparkSession, state: dict | None) -> Saved:
    """A state from its JSON form; what has no lists of searches and lists gives a fresh one. There is always a Rejected list."""
    if not isinstance(state, dict) or not isinstance(state.get("searches"), list) or not isinstance(state.get("lists"), list):
        state = {"searches": [], "lists": [{"name": n, "ids": []} for n in DEFAULT_LISTS]}
    lists = [x for x in state["lists"] if isinstance(x, dict) and x.get("name") and isinstance(x.get("ids"), list)]
    names = [x["name"] for x in lists]
    if REJECTED not in names:
        names.append(REJECTED)
    keys = ("address", "title", "price", "url", "image")
    shot = lambda s: tuple(s.get(k) for k in keys) if isinstance(s, dict) else None
    items = [(x["name"], i, n, shot((x.get("snap") or {}).get(i))) for x in lists for n, i in enumerate(dict.fromkeys(x["ids"]))]
    searches = [(s["name"], s["hash"], n) for n, s in enumerate(state["searches"]) if isinstance(s, dict) and s.get("name") and isinstance(s.get("hash"), str)]
    return Saved(spark.createDataFrame([(n, i) for i, n in enumerate(names)], _LISTS), spark.createDataFrame(items, _ITEMS), spark.createDataFrame(searches, _SEARCHES))


def decode(spark: SparkSession, param: str) -> Saved | None:
    """The state of a share link, null where it is none."""
    try:
        state = json.loads(base64.urlsafe_b64decode(param + "=" * (-len(param) % 4)))
    except ValueError:
        return None
    whole = isinstance(state, dict) and isinstance(state.get("searches"), list) and isinstance(state.get("lists"), list)
    return from_state(spark, state) if whole else None


def shared_homes(saved: Saved) -> DataFrame:
    """One row: how many homes the lists hold."""
    return saved.items.agg(F.countDistinct("id").alias("homes"))
