"""The table of queries, and inputs made of the driver's tables for operators whose own inputs those are not."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def today() -> Column:
    """The day that the queries take for the present."""
    return F.lit("2026-09-01").cast("date")


# A row per part: id, a number n (1 to 50), a price, and texts made of a template that the id chooses. The expected values
# follow from the templates, not from the patterns that are tested.

_BASE = "SELECT p_partkey AS id, p_size AS n, CAST(100000 + (p_partkey * 37) % 900 * 1000 AS INT) AS price FROM part"


def _filled(template: str | None) -> Column:
    if template is None:
        return F.lit(None).cast("string")
    values = {"n": F.col("n").cast("string"), "price": F.col("price").cast("string"), "commas": F.format_number("price", 0), "id": F.col("id").cast("string")}
    parts = [values[x[1:-1]] if re.fullmatch(r"\{\w+\}", x) else F.lit(x) for x in re.split(r"(\{(?:n|price|commas|id)\})", template) if x]
    return F.concat(*parts) if parts else F.lit("")


def cases(spark: SparkSession, sf_dir: str, **columns: list[str | None]) -> DataFrame:
    """id, n, price and a text column for each list of templates; row id uses template id % k."""
    k = len(next(iter(columns.values())))
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("n"), (100_000 + (F.col("p_partkey") * 37) % 900 * 1000).cast("int").alias("price"))
    which = F.pmod("id", F.lit(k))
    for name, templates in columns.items():
        if len(templates) != k:
            raise ValueError(f"{name}: {len(templates)} templates, not {k}")
        text = F.lit(None).cast("string")
        for i, t in enumerate(templates):
            text = F.when(which == i, _filled(t)).otherwise(text)
        base = base.withColumn(name, text)
    return base


def answers(**columns: tuple[str, list]) -> str:
    """SQL of id and the expected columns: name=(type, expressions of id, n and price by id % k)."""
    k = len(next(iter(columns.values()))[1])
    out = []
    for name, (kind, values) in columns.items():
        if len(values) != k:
            raise ValueError(f"{name}: {len(values)} values, not {k}")
        whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
        out.append(f"CAST(CASE id % {k} {whens} END AS {kind}) AS {name}")
    return f"SELECT id, {', '.join(out)} FROM ({_BASE}) b"


def literal(columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL of rows worked out by hand; columns: name to type."""
    def show(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v)
        return str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    values = ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in columns.items())} FROM (VALUES {values}) v({', '.join(columns)})"


def turns(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """A row per customer: k, turn, and the columns of the row of that turn (k % the number of rows)."""
    fixed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"turn int, {schema}")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % len(rows)).cast("int").alias("turn")).join(fixed, "turn")


def turns_sql(columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL: k and the columns of the row of its turn."""
    given = literal({"turn": "INT"} | columns, [(i, *r) for i, r in enumerate(rows)])
    return f"SELECT c_custkey AS k, {', '.join(columns)} FROM customer JOIN ({given}) v ON v.turn = c_custkey % {len(rows)}"
