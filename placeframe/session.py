"""Session construction, the shared folder, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import contextlib
import io
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
_SCOPES: list[list[str]] = []
_PACKAGE = Path(__file__).resolve().parent


def build_session(master: str = "local[*]", partitions: int = 8, app: str = "placeframe") -> SparkSession:
    """A session with the settings the library assumes: UTC, ANSI (the default) and adaptive execution."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where that is unset and everything runs in one JVM (tests), a local one, removed at exit; a cluster without it is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="placeframe-shared-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        at = f"file://{_LOCAL[0]}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for scope in _SCOPES:
        scope.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Everything that gets a path within is deleted at the end, but for the paths that are put in the list that it gives."""
    made: list[str] = []
    keep: list[str] = []
    _SCOPES.append(made)
    try:
        yield keep
    finally:
        _SCOPES.remove(made)
        for path in made:
            if path not in keep and "/package-" not in path:
                delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete what :func:`materialise` wrote for these frames; no plan that is still to run may read them."""
    for df in frames:
        if path := getattr(df, "_scratch", None):
            delete(df.sparkSession, path)
            df._scratch = None


def write_file(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file, through Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(data))
    out.close()
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, so no executor needs it installed; it lies in the shared folder."""
    sc = spark.sparkContext
    if getattr(sc, "_placeframe_shipped", False):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(write_file(spark, f"{fresh_path(spark, 'package')}/placeframe_pkg.zip", packed.getvalue()))
    sc._placeframe_shipped = True
