"""Sinks: tables swapped in whole, GeoJSON, one-document JSON, step isolation and run metadata."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def swap_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write beside the table, then put the new one in its place: the old one may be read by ``df`` itself."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    fresh, old = f"{path}.new", f"{path}.old"
    df.write.mode("overwrite").format(fmt).save(fresh)
    for p in (old,):
        fs.delete(_fs(spark, p)[1], True)
    if fs.exists(target):
        fs.rename(target, _fs(spark, old)[1])
    if not fs.rename(_fs(spark, fresh)[1], target):
        raise OSError(f"{fresh} could not be put in place")
    fs.delete(_fs(spark, old)[1], True)


def visible(df: DataFrame) -> DataFrame:
    """Without the columns that begin with an underscore."""
    return df.select([F.col(c) for c in df.columns if not c.startswith("_")])


def feature_collection(df: DataFrame, geometry: str = "polys", by: str | None = None) -> DataFrame:
    """value: a GeoJSON document of the visible columns and the geometry column (polys; or x and y of points).

    One document, or with ``by`` one for each value of that column (a district, a tile), which stays beside it: a document is one
    task's work and is meant for a browser, so a large layer is to be cut. Tables stay Parquet.
    """
    shown = visible(df.drop(by) if by else df)
    keys = [F.col(by)] if by else []
    if geometry == "polys":
        coords = F.transform("polys", lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.array(F.bround(c["x"], 5), F.bround(c["y"], 5)))))
        geom = F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates"))
        props = [c for c in shown.columns if c not in ("polys", "feature_id")]
    elif geometry == "lines":
        coords = F.transform("lines", lambda r: F.transform(r, lambda c: F.array(F.bround(c["x"], 5), F.bround(c["y"], 5))))
        geom = F.struct(F.lit("MultiLineString").alias("type"), coords.alias("coordinates"))
        props = [c for c in shown.columns if c != "lines"]
    else:
        geom = F.struct(F.lit("Point").alias("type"), F.array(F.bround("x", 5), F.bround("y", 5)).alias("coordinates"))
        props = [c for c in shown.columns if c not in ("x", "y")]
    one = visible(df).select(*keys, F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geom.alias("geometry")).alias("f"))
    return one.groupBy(*keys).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("f").alias("features"))).alias("value"))


def write_document(df: DataFrame, path: str) -> None:
    """A one-row text document as a single file under ``path``."""
    df.coalesce(1).write.mode("overwrite").text(path)


def write_documents(df: DataFrame, path: str, by: str) -> None:
    """A text document for each value of ``by``, each a file in a folder of that name; df: by and value."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).text(path)


@dataclass
class Run:
    """Metadata of a run: what each step did, errors and counters."""

    as_of: dt.datetime
    sources: dict = field(default_factory=dict)
    errors: dict = field(default_factory=dict)
    counters: dict = field(default_factory=dict)

    def step(self, name: str, work: Callable[[], object]):
        """Do a step; a failure is noted (500 characters of it) and leaves what the last run wrote. The work must contain
        its actions, as plans fail when they run."""
        try:
            out = work()
        except Exception as e:  # noqa: BLE001
            self.errors[name] = f"{type(e).__name__}: {e}"[:500]
            return None
        self.sources[name] = self.as_of.strftime("%Y-%m-%dT%H:%MZ")
        return out

    def document(self) -> str:
        return json.dumps({"updated": self.as_of.strftime("%Y-%m-%dT%H:%MZ"), "sources": self.sources, "errors": self.errors, **self.counters})

    def stale(self, now: dt.datetime, days: int = 2) -> bool:
        """Whether results are old or a source failed."""
        return bool(self.errors) or now - self.as_of > dt.timedelta(days=days)


def due(last: str | None, as_of: dt.datetime, days: int = 7) -> bool:
    """Whether a step of a weekly rhythm is to be done again; last: when it was, in ISO form."""
    return last is None or as_of - dt.datetime.fromisoformat(last.replace("Z", "+00:00")) >= dt.timedelta(days=days)
