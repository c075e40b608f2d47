"""What the two compression classifiers share: bounded labelled samples, class dictionaries, calibration, scoring.

The sample is the one bounded part: at most ``per_class`` labelled rows of each class, the first by a hash of their id,
each of at most ``MAX_SAMPLE_BYTES``; a dictionary holds ``DICT_BYTES`` at most. Scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeframe.llm.tokens import lean
from placeframe.session import ship_package

#: Labelled rows of each class that may reach the driver.
PER_CLASS = 3000
#: Longer labelled texts are left out of the sample (not cut).
MAX_SAMPLE_BYTES = 32768
DICT_BYTES = 112 * 1024
FOLDS = 5


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out, and so is a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0)).cast("int")


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> list[tuple]:
    """(fold, text, label), and the language if asked for, of a bounded sample of the rows that may be learned from; an id with two labels has the larger."""
    one = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (fold(id_col) != 0)).groupBy(id_col).agg(F.max(label).alias("__y"))
    picked = [one.where(F.col("__y") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for y in (0, 1)]
    keys = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most
    texts = docs.where(F.col(text_col).isNotNull() & (F.octet_length(text_col) <= MAX_SAMPLE_BYTES)).select(id_col, text_col, *([F.col(lang_col).cast("string").alias("__lang")] if lang_col else []))
    rows = texts.join(keys, id_col).orderBy(F.xxhash64(id_col), id_col, text_col).limit(2 * per_class).select(fold(id_col), text_col, "__y", *(["__lang"] if lang_col else [])).collect()
    return [tuple(r) for r in rows]


def pieces(data: bytes, size: int) -> list[bytes]:
    """Windows of about ``size`` bytes that end at a space where there is one near; together they are the whole text."""
    out, i, n = [], 0, len(data)
    while n - i > size:
        j = data.find(b" ", i + size, i + 2 * size)
        j = j if j > 0 else i + size
        out.append(data[i:j])
        i = j
    out.append(data[i:])
    return out


def train_dictionary(texts: list[bytes], sample: int, size: int = DICT_BYTES) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes from samples of ``sample`` bytes each.

    Where there are too few samples to train on, it is the last ``size`` bytes of them as they are.
    """
    parts = [p for t in texts for p in pieces(t, sample) if len(p) >= 8]
    try:
        return zstandard.train_dictionary(size, parts, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:] or b"\n"


@dataclass
class Model:
    """Everything that scoring needs; small and picklable."""

    ordinary: bytes
    special: bytes
    window: int
    raw: bool = False
    thresholds: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    prior: float = 0.0
    knots: tuple[list[float], list[float]] | None = None


def split_folds(rows: list[tuple], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows calibrate (folds 3 and 4) and which train dictionaries; all do both where a side would lack a class."""
    held = np.array([r[0] in (3, 4) for r in rows])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        return np.ones(len(rows), bool), np.ones(len(rows), bool)
    return held, ~held


class Sizes:
    """Compressed sizes of windows under both dictionaries.

    With ``raw`` the dictionaries serve as plain history, searched for matches of four bytes; else as zstandard made them,
    with their entropy tables.
    """

    def __init__(self, model: Model, level: int = 1):
        params = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.both = []
        for d in (model.ordinary, model.special):
            if model.raw:
                found = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=0, strategy=zstandard.STRATEGY_LAZY, **params)
                history = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                history.precompute_compress(compression_params=found)
                self.both.append(zstandard.ZstdCompressor(compression_params=found, dict_data=history))
            else:
                trained = zstandard.ZstdCompressionDict(d)
                trained.precompute_compress(level=level)
                self.both.append(zstandard.ZstdCompressor(level=level, dict_data=trained, **params))

    def __call__(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.fromiter((len(c.compress(p)) for p in parts), np.float64, len(parts)) for c in self.both)
        return a, b


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton's method for a ridge logistic regression; weights (the last is the bias), centre and scale."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - centre) / scale, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w, centre, scale


def isotonic(x: np.ndarray, y: np.ndarray, step: int = 20) -> tuple[list[float], list[float]]:
    """Knots of a rising fit: means of ``step`` rows in order of x, neighbours that fall pooled; half a row of prior."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # x, y and weight
    for i in range(0, len(x), step):
        part = order[i : i + step]
        pools.append([float(x[part].mean()), float(y[part].mean()), float(len(part))])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            (x2, y2, w2), (x1, y1, w1) = pools.pop(), pools.pop()
            pools.append([(x1 * w1 + x2 * w2) / (w1 + w2), (y1 * w1 + y2 * w2) / (w1 + w2), w1 + w2])
    return [p[0] for p in pools], [(p[1] * p[2] + 0.5) / (p[2] + 1) for p in pools]


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    if model.knots:
        return np.interp(x[:, 0], *model.knots)
    if not model.weights:
        return np.full(len(x), model.prior)
    z = np.c_[(x - np.array(model.centre)) / np.array(model.scale), np.ones(len(x))] @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_frame(docs: DataFrame, model: Model, features: Callable[[Model, Sizes, list[bytes]], np.ndarray], cut: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row; texts stream through in Arrow batches and are never shuffled."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col), (fold(id_col) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__t"))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model)
        for batch in batches:
            texts = batch.column(2)
            score = np.empty(len(texts))
            for at in range(0, len(texts), 256):
                block = texts.slice(at, 256).to_pylist()
                score[at : at + len(block)] = probability(model, features(model, sizes, block))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return narrow.mapInArrow(lean(run), schema)
