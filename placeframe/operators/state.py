"""Daily state: what to read, upserts with price history, lifecycle. Everything takes ``as_of``; nothing reads a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.config import BBOX, RULES
from placeframe.functions.numeric import in_bbox
from placeframe.functions.text import NOT_A_HOME, is_plot, prefilter, rejection

KEPT = "no longer listed"


def _present(c: str, schema) -> Column:
    """A new value counts unless null or an empty text."""
    return F.nullif(F.col(c), F.lit("")) if schema[c].dataType.typeName() == "string" else F.col(c)


def append_price(history: Column, price: Column, day: Column) -> Column:
    """The price series with (day, price) at its end if the price is new and not 0."""
    last = F.try_element_at(history, F.lit(-1))["price"]
    changed = (F.coalesce(price, F.lit(0)) != 0) & ~F.coalesce(last == price, F.lit(False))
    entry = F.array(F.struct(day.cast("date").alias("date"), price.cast("int").alias("price")))
    empty = F.array().cast("array<struct<date:date,price:int>>")
    return F.when(changed, F.concat(F.coalesce(history, empty), entry)).otherwise(F.coalesce(history, empty))


def upsert(state: DataFrame, fresh: DataFrame, as_of: Column, key: str = "id") -> DataFrame:
    """Full outer merge: new values replace old ones unless empty, old ones otherwise stay; price history and dates follow.

    One shuffle of either side on the key (none if both are bucketed by it). ``fresh`` has one row per key.
    """
    day = as_of.cast("date")
    kept = {"price_history", "first_seen", "fetched"}
    columns = list(dict.fromkeys([*state.columns, *fresh.columns]))
    s = state.select([F.col(c).alias(f"s_{c}") for c in state.columns] + [F.lit(True).alias("__s")])
    f = fresh.select([_present(c, fresh.schema).alias(f"f_{c}") for c in fresh.columns] + [F.lit(True).alias("__f")])
    both = s.join(f, F.col(f"s_{key}") == F.col(f"f_{key}"), "full_outer")
    out = []
    for c in columns:
        if c in kept:
            continue
        parts = [F.col(f"{p}_{c}") for p, cols in (("f", fresh.columns), ("s", state.columns)) if c in cols]
        out.append(F.coalesce(*parts).alias(c))
    old = (lambda c, kind: F.col(f"s_{c}") if c in state.columns else F.lit(None).cast(kind))
    is_fresh = F.col("__f").isNotNull()
    history = old("price_history", "array<struct<date:date,price:int>>")
    price = F.col("f_price") if "price" in fresh.columns else F.lit(None).cast("int")
    out += [
        F.when(is_fresh, append_price(history, price, day)).otherwise(history).alias("price_history"),
        F.when(is_fresh, day).otherwise(old("fetched", "date")).alias("fetched"),
        F.coalesce(old("first_seen", "date"), F.when(is_fresh, day)).alias("first_seen"),
    ]
    return both.select(*out)


def needs_fetch(as_of: Column, rules=RULES) -> Column:
    """Whether a found listing's page is to be read: columns known, excluded, plot_parsed, fetched, parser_version."""
    why = F.coalesce(F.col("excluded"), F.lit(""))
    permanent = why.rlike(r"^(flat|rental|district)") | why.rlike(r"^\d+ bedroom$")
    stale = F.coalesce(F.col("fetched") < F.date_sub(as_of.cast("date"), rules.refetch_days), F.lit(True)) | (F.coalesce(F.col("parser_version"), F.lit(1)) < rules.parser_version)
    return F.when(F.col("known").isNull(), True).when(permanent, False).when((why == "bedrooms unknown") & ~F.coalesce(F.col("plot_parsed"), F.lit(False)), True).otherwise(stale)


def todo(found: DataFrame, state: DataFrame, as_of: Column, rules=RULES, cap: int | None = None) -> DataFrame:
    """Found listings (id, url, hint, ord) whose pages are to be read, in order, at most ``cap``."""
    known = state.select(F.col("id").alias("__id"), "excluded", "plot_parsed", "fetched", "parser_version", F.lit(True).alias("known"))
    wanted = found.where(prefilter("url", "hint", rules).isNull()).join(known, F.col("id") == F.col("__id"), "left").where(needs_fetch(as_of, rules))
    return wanted.select(*found.columns).orderBy("ord").limit(cap or rules.max_fetches)


def classify(state: DataFrame, found: DataFrame, complete: bool, unsure: DataFrame | None, as_of: Column, rules=RULES) -> DataFrame:
    """Set kind, active, excluded and last_seen of every row.

    found: (id, url, hint). A row that no search showed is gone, unless it was active and the search that covers its
    district (unsure: (district)), or any (complete false), was cut short.
    """
    seen = found.select(F.col("id").alias("__id"), prefilter("url", "hint", rules).alias("__pre"), F.lit(True).alias("__seen"))
    rows = state.join(seen, F.col("id") == F.col("__id"), "left")
    doubt = F.lit(not complete)
    if complete and unsure is not None:
        rows = rows.join(unsure.select(F.col("district").alias("__u")).distinct(), F.col("district") == F.col("__u"), "left")
        doubt = F.col("__u").isNotNull()
    gone = F.when(~(F.coalesce(F.col("active"), F.lit(False)) & doubt), F.lit(KEPT))
    why = F.coalesce(F.when(F.col("__seen"), F.col("__pre")).otherwise(gone), rejection("title", "property_type", "bedrooms", "district", rules=rules))
    words = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("property_type", F.lit("")))
    out = rows.withColumns({"excluded": why, "kind": F.when(is_plot(words, F.col("bedrooms")), "plot"), "last_seen": F.when(F.col("__seen"), as_of.cast("date")).otherwise(F.col("last_seen"))})
    return out.withColumn("active", F.col("excluded").isNull()).drop("__id", "__pre", *(["__u"] if "__u" in out.columns else []))


def geocode(state: DataFrame, lookup: DataFrame) -> DataFrame:
    """Fill missing coordinates of active rows from (postcode, lat, lng), and mark them approximate."""
    look = lookup.select(F.col("postcode").alias("__pc"), F.col("lat").alias("__lat"), F.col("lng").alias("__lng")).dropDuplicates(["__pc"])
    fill = F.col("lat").isNull() & F.col("__lat").isNotNull() & F.col("active")
    joined = state.join(look, F.col("postcode") == F.col("__pc"), "left")
    flag = F.when(fill, True).otherwise(F.col("approx_location")) if "approx_location" in state.columns else F.when(fill, True)
    return joined.withColumns({"approx_location": flag, "lng": F.when(fill, F.col("__lng")).otherwise(F.col("lng")), "lat": F.when(fill, F.col("__lat")).otherwise(F.col("lat"))}).drop("__pc", "__lat", "__lng")


def outside_map(state: DataFrame, box: dict[str, float] = BBOX) -> DataFrame:
    """Active rows with a position outside the map area become inactive."""
    out = F.col("active") & F.col("lat").isNotNull() & ~in_bbox("lat", "lng", box)
    return state.withColumns({"excluded": F.when(out, "outside map area").otherwise(F.col("excluded")), "active": F.col("active") & ~F.coalesce(out, F.lit(False))})


def collect_garbage(state: DataFrame) -> DataFrame:
    """Without the excluded rows that no search shows any more (sold ones stay); drops the ``__seen`` mark."""
    return state.where(F.col("excluded").isNull() | (F.col("excluded") == KEPT) | F.coalesce(F.col("__seen"), F.lit(False))).drop("__seen")


def lot_reason(as_of: Column, complete: bool, rules=RULES) -> Column:
    """Why an auction lot is not shown; columns seen, auction.date, not_a_home, kind, title, property_type, bedrooms, district."""
    far = (F.coalesce(F.col("district"), F.lit("")) != "") & ~F.col("district").isin(list(rules.districts))
    home = rejection("title", "property_type", "bedrooms", "district", rules=rules)
    return (
        F.when(F.lit(complete) & ~F.coalesce(F.col("seen"), F.lit(False)), KEPT)
        .when(F.col("auction.date") < as_of.cast("date"), "auction passed")
        .when(F.coalesce(F.col("not_a_home"), F.lit(False)) | F.coalesce(F.col("address").rlike(NOT_A_HOME), F.lit(False)), "not a home or plot")
        .when(F.col("kind").eqNullSafe("plot"), F.when(far, F.concat(F.lit("district "), F.col("district"))))
        .otherwise(home)
    )


def lot_lifecycle(lots: DataFrame, as_of: Column, complete: bool, rules=RULES) -> DataFrame:
    """Lots with excluded and active set; those gone or past are deleted."""
    out = lots.withColumn("excluded", lot_reason(as_of, complete, rules))
    return out.where(F.col("excluded").isNull() | ~F.col("excluded").isin(KEPT, "auction passed")).withColumn("active", F.col("excluded").isNull())
