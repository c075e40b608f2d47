"""Every query of the place analytics against its SQL, over the smallest tables where they are there."""

import datetime as dt
from pathlib import Path

import pytest

from placeframe.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    if not DATA.exists():
        pytest.skip("the tables are not here")
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) >= 190


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    rel = duck.sql(SQL[name])
    assert columns == sorted(rel.columns)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert got == sorted((tuple(map(plain, r)) for r in rel.select(quoted).fetchall()), key=str)


def test_the_entry_is_imported_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) > 190, len(e.oracle_sql()) > 190)"], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert said.stdout.split() == ["True", "True"], said.stderr
