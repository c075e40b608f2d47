"""What JSON texts hold, whatever their shape: values of VARIANT, level by level.

An object's fields come in the order of their names (a VARIANT keeps no other), an array's elements in theirs; outer values come
before inner ones, and each has the places that lead to it as its path. Texts that are no JSON, and nulls, hold nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeframe.functions.numeric import first_number
from placeframe.session import materialise


def values(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, key, value) of everything within each row's JSON; key is null in arrays and for the whole."""
    spark = df.sparkSession
    top = df.select(F.col(id_col).alias("id"), F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(F.col(json_col)).alias("value"))
    level = materialise(top.where("value is not null"), "json")
    out = level
    while True:
        level = materialise(spark.sql("SELECT t.id, array_append(t.path, c.pos) AS path, c.key, c.value FROM {t} t, LATERAL variant_explode(t.value) c", t=level), "json")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def named(found: DataFrame, *keys: str) -> DataFrame:
    """(id, value, number): of the first object that has one, the first non-empty text or number among the keys, whatever their case, and the number in it."""
    place = F.array_position(F.array(*map(F.lit, keys)), F.lower("key"))
    text = F.try_variant_get("value", "$", "string")
    own = found.where((place > 0) & (F.coalesce(text, F.lit("")) != "") & ~F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)"))
    first = own.groupBy("id").agg(F.min(F.struct(F.slice("path", 1, F.size("path") - 1).alias("object"), place.alias("place"), text.alias("value"))).alias("v"))
    return first.select("id", "v.value", first_number(F.col("v.value")).alias("number"))


def in_order(found: DataFrame, key: str) -> DataFrame:
    """(id, values): the texts of a key in all objects, outer ones first along each way."""
    own = found.where(F.lower("key") == key).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("path", F.try_variant_get("value", "$", "string").alias("v")))).alias("vs"))  # of one document
    return own.select("id", F.transform("vs", lambda v: v["v"]).alias("values"))
