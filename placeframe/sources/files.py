"""File sources: configuration, tolerant JSON, zipped CSV, certificates, timetables, feature layers. Spark opens every path."""

from __future__ import annotations

import csv
import io
import json
import re
import time
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeframe.operators.layers import CERTIFICATE, find_column
from placeframe.session import ship_package


def read_config(spark: SparkSession, path: str, field: str, schema: T.StructType | str) -> DataFrame:
    """The rows of an array within a JSON document, with their position as ord."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([T.StructField(field, T.ArrayType(kind))])
    return spark.read.schema(whole).json(path, multiLine=True).select(F.posexplode(field).alias("ord", "r")).select("ord", "r.*")


def read_json_or(spark: SparkSession, path: str, default):
    """A JSON document as Python value; the default where it is missing or broken."""
    try:
        return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except (AnalysisException, ValueError):
        return default


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """A table; an empty one of its schema where there is none."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def zipped_csv(spark: SparkSession, path: str, member: str, columns: list[str]) -> DataFrame:
    """Rows of a CSV member of zip archives, as texts, by the header's names; without the member, or a column, nothing or null.

    An archive is one task's work, as zip allows; a member is streamed in batches of 50,000 rows. Feeds of many gigabytes
    are better unpacked once and read with ``spark.read.csv``.
    """
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if member not in z.namelist():
                        continue
                    with z.open(member) as f:
                        held: list[list] = [[] for _ in columns]
                        for row in csv.DictReader(io.TextIOWrapper(f, encoding="utf-8-sig", newline="")):
                            for to, c in zip(held, columns, strict=True):
                                to.append(row.get(c))
                            if len(held[0]) >= 50_000:
                                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in held], names=columns)
                                held = [[] for _ in columns]
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in held], names=columns)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


# The tables of a timetable feed and their columns.
TIMETABLE = {
    "stops": ["stop_id", "stop_name", "stop_lat", "stop_lon"],
    "routes": ["route_id", "route_short_name", "route_long_name", "route_type"],
    "trips": ["route_id", "service_id", "trip_id"],
    "calendar": ["service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"],
    "calendar_dates": ["service_id", "date", "exception_type"],
    "stop_times": ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"],
}


def read_timetable(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: zipped_csv(spark, path, f"{name}.txt", columns) for name, columns in TIMETABLE.items()}


def certificate_zip(spark: SparkSession, path: str) -> DataFrame:
    """Raw certificates of every CSV in zip archives under common names; the header is the first row with a postcode cell."""
    ship_package(spark)
    names = list(CERTIFICATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in (m for m in z.namelist() if m.lower().endswith(".csv")):
                        with z.open(member) as f:
                            at, rows = None, []
                            for row in csv.reader(io.TextIOWrapper(f, encoding="utf-8-sig", errors="replace", newline="")):
                                if at is None:
                                    if any(c.strip().upper() == "POSTCODE" for c in row):
                                        at = [row.index(c) if (c := find_column(row, *CERTIFICATE[n])) is not None else None for n in names]
                                    continue
                                rows.append([row[i] if i is not None and i < len(row) else None for i in at])
                            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"{n} string" for n in names))


def certificate_links(html: str) -> list[str]:
    """Zip links of a dataset page that are not of non-domestic certificates."""
    return [u for u in re.findall(r"""href=["']([^"']+\.zip[^"']*)["']""", html, re.I) if not re.search("non[-_ ]?domestic", u, re.I)]


def is_fresh(modified: float, days: float, now: float | None = None) -> bool:
    """Whether a cached download may still be used."""
    return (time.time() if now is None else now) - modified < days * 86_400


_POINT = "array<double>"
_POLYS = "array<array<array<struct<x:double,y:double>>>>"


def read_features(spark: SparkSession, path: str, props: str) -> DataFrame:
    """A GeoJSON feature collection: feature_id, the named properties and polys (of Polygon and MultiPolygon features)."""
    text = spark.read.text(path, wholetext=True)
    kind = f"struct<features:array<struct<properties:struct<{props}>,geometry:struct<type:string,coordinates:string>>>>"
    rows = text.select(F.posexplode(F.from_json("value", kind)["features"]).alias("feature_id", "f"))
    pts = lambda v: F.transform(v, lambda p: F.transform(p, lambda r: F.transform(r, lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))))
    one = F.array(F.from_json("f.geometry.coordinates", f"array<array<{_POINT}>>"))
    many = F.from_json("f.geometry.coordinates", f"array<array<array<{_POINT}>>>")
    polys = F.when(F.col("f.geometry.type") == "Polygon", pts(one)).when(F.col("f.geometry.type") == "MultiPolygon", pts(many))
    return rows.select("feature_id", "f.properties.*", polys.cast(_POLYS).alias("polys"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Map elements (ord, type, tags, members, lat, lon) of a JSON answer."""
    kind = "struct<type:string,tags:map<string,string>,lat:double,lon:double,members:array<struct<type:string,role:string,geometry:array<struct<lat:double,lon:double>>>>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"struct<elements:array<{kind}>>")["elements"]).alias("ord", "e")).select("ord", "e.*")


def synthetic_listings(spark: SparkSession, n: int = 220, seed: int = 42) -> DataFrame:
    """Listings made from a hash of their number: the same for the same seed, on any cluster."""
    r = lambda k, m: F.pmod(F.xxhash64(F.col("id"), F.lit(k), F.lit(seed)), F.lit(m))
    beds = (2 + r(1, 4)).cast("int")
    return spark.range(n).select(
        (36_000_000 + F.col("id")).cast("string").alias("id"), F.concat((1 + r(2, 120)).cast("string"), F.lit(" Sample Street")).alias("address"), F.concat(F.lit("EH"), (1 + r(3, 17)).cast("string")).alias("district"),
        (55.85 + r(4, 15_000) / 100_000).alias("lat"), (-3.40 + r(5, 40_000) / 100_000).alias("lng"), (150_000 + beds * 60_000 + r(6, 100) * 1000).cast("int").alias("price"), beds.alias("bedrooms"), (r(7, 2) == 0).alias("detached"), (r(8, 3) == 0).alias("garage"),
    )
