"""Search for texts that contain all tokens: lists of trigrams are intersected, and what they share is looked at.

A posting is (trigram, bucket, ids): the ids of one bucket of 4,096, so a list of any length is many bounded rows, and lists are
intersected bucket by bucket. A token of fewer than three characters has no trigram; it is looked for in what the others leave, and
where a search has no other tokens, in all texts. Trigrams are of lower-cased texts, in code points. Null texts contain nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.operators.search import tokens
from placeframe.session import materialise

BUCKET = 4096


def _trigrams(text: Column) -> Column:
    letters = F.split(text, "")
    three = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - 3), lambda i: F.concat(F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)))
    return F.transform(F.array(letters), lambda c: F.when(F.size(c) >= 3, F.array_distinct(three(c))).otherwise(F.array().cast("array<string>")))[0]


def index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(trigram, bucket, ids) of whole-numbered rows, written; it answers any number of searches."""
    each = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(_trigrams(F.lower(text_col))).alias("trigram"))
    lists = each.groupBy("trigram", F.floor(F.col("id") / BUCKET).alias("bucket")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return materialise(lists, "trigrams")


def _parts(q: str) -> set[str]:
    return {t[i : i + 3] for t in tokens(q) for i in range(len(t) - 2)}


def candidates(postings: DataFrame, searches: list[str]) -> DataFrame:
    """(search, id): rows that have all trigrams of a search (its number in the list), for those with a trigram."""
    spark = postings.sparkSession
    rows = [(n, t, len(_parts(q))) for n, q in enumerate(searches) for t in sorted(_parts(q))]
    wanted = spark.createDataFrame(rows, "search int, trigram string, needed int")
    met = postings.join(wanted, "trigram").groupBy("search", "needed", "bucket").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("needed"))  # a search's trigrams
    shared = F.aggregate(F.slice("lists", 2, F.size("lists") - 1), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return met.select("search", F.explode(shared).alias("id"))


def search(df: DataFrame, postings: DataFrame, searches: list[str], id_col: str, text_col: str) -> DataFrame:
    """(search, id): the rows whose text contains all tokens of a search, whatever their case."""
    spark = df.sparkSession
    asked = spark.createDataFrame([(n, tokens(q)) for n, q in enumerate(searches)], "search int, words array<string>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("text"))
    found = candidates(postings, searches).join(rows, "id").join(asked, "search")
    blunt = [n for n, q in enumerate(searches) if not _parts(q)]
    if blunt:  # every text meets the few searches that have no trigram
        words = F.explode(F.array(*[F.struct(F.lit(n).alias("search"), F.array(*map(F.lit, tokens(searches[n]))).cast("array<string>").alias("words")) for n in blunt])).alias("s")
        found = found.unionByName(rows.where("text is not null").select("id", "text", words).select("id", "text", "s.search", "s.words"))
    return found.where(F.forall("words", lambda w: F.contains(F.col("text"), w))).select("search", "id")
