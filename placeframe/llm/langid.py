"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is the mean of the embeddings of its byte 3- and 4-grams (letters in lower case, every other ASCII byte a blank),
hashed into two tables. Training sees up to six spans of 12 to 400 bytes, anywhere in a text; predictions are of whole
texts. A temperature fitted on a fold of its own calibrates the softmax. Rejection is calibrated on the same fold by two
figures: the confidence that all but a thousandth of its documents reach (one half at most, so that two alike languages do
not reject each other), and the familiarity of a text, the mean log frequency of its grams in training, which is not
relative to the other languages: a text that lies below the fold's median by ``FAR`` times as much as all but a thousandth
of the fold's documents do is in no learned language.

The score is linear in the mean, so scoring folds embeddings and softmax weights into one table of logits for each gram,
with a column for the log frequency.

The ``MAX_LANGUAGES`` commonest languages are learned. Null texts and texts without a letter are ``und`` with score 0 and are rejected. Repeated rows get equal predictions. With
one learned language that language is predicted with score 1; with none, every row is ``und``. Extra columns are ignored by
:func:`predict` and kept by :func:`keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeframe.llm.dictionaries import MAX_SAMPLE_BYTES, fold
from placeframe.llm.tokens import LOWER, chunks, lean
from placeframe.session import ship_package

#: Training documents that may reach the driver: of each language, and in all.
PER_LANGUAGE = 1500
IN_ALL = 6000
#: The commonest values that are learned, a bound of the sample and of the model (256 KB each); a column of more holds other things than languages.
MAX_LANGUAGES = 1000
FAR = 2.5
BITS = 15
DIM = 16
_BLANKED = np.array([LOWER[b] if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # (2 << BITS, languages + 1): rows of 3-grams, then of 4-grams; the last column is the log frequency
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    familiar: float = -np.inf


def grams(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-grams and 4-grams that start at each byte (as far as there are any)."""
    b = _BLANKED[buf].astype(np.uint32)
    if len(b) < 3:
        z = np.zeros(0, np.int32)
        return z, z
    three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    four = three[:-1] | (b[3:] << np.uint32(24))
    shift = np.uint32(32 - BITS)
    return ((three * np.uint32(2654435761)) >> shift).astype(np.int32), (((four * np.uint32(2246822519)) >> shift) + np.uint32(1 << BITS)).astype(np.int32)


def _sums(table: np.ndarray, ids: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the table's rows over the grams within each text, and how many there are."""
    start = offs[:-1]
    n = np.maximum(offs[1:] - order + 1 - start, 0)
    total = np.zeros((len(n), table.shape[1]))
    if len(ids):
        inside = np.zeros(len(ids) + 1, np.int8)
        some = n > 0
        np.add.at(inside, start[some], 1)
        np.add.at(inside, (start + n)[some], -1)
        picked = ids[np.cumsum(inside[:-1]) > 0]
        if some.any():
            total[some] = np.add.reduceat(table[picked], np.r_[0, np.cumsum(n[some])[:-1]], axis=0)
    return total, n


def probabilities(model: Model, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the languages, and familiarity, of every text."""
    three, four = grams(buf)
    a, n = _sums(model.logits, three, offs, 3)
    b, m = _sums(model.logits, four, offs, 4)
    mean = (a + b) / np.maximum(n + m, 1)[:, None]
    z = (mean[:, :-1] + model.bias) / model.temperature
    z = np.exp(z - z.max(1, keepdims=True, initial=-np.inf))
    return z / z.sum(1, keepdims=True), mean[:, -1]


def _of_texts(model: Model, texts: list[bytes], size: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and familiarity of many texts, a few at a time: the driver's memory stays small."""
    out = []
    for i in range(0, len(texts), size):
        part = texts[i : i + size]
        out.append(probabilities(model, np.frombuffer(b"".join(part), np.uint8), np.r_[0, np.cumsum([len(t) for t in part])]))
    return np.concatenate([p for p, _ in out]), np.concatenate([f for _, f in out])


def _snippets(text: bytes, rng: np.random.Generator) -> Iterator[bytes]:
    """Training views of a text: one to six spans of 12 to 400 bytes, anywhere in it."""
    for _ in range(1 + min(5, len(text) // 400)):
        size = int(np.exp(rng.uniform(np.log(12), np.log(400))))
        at = int(rng.integers(0, max(1, len(text) - size)))
        yield text[at : at + size]


def train(rows: list[tuple[str, bytes, int]], epochs: int = 4, rate: float = 1.0, batch: int = 256, seed: int = 11) -> Model:
    """rows: (language, text, fold); fold 4 calibrates."""
    langs = sorted({r[0] for r in rows})
    seen = np.zeros(2 << BITS)
    for _, text, _ in rows:
        np.add.at(seen, np.concatenate(grams(np.frombuffer(text, np.uint8))), 1)
    common = np.log((seen + 0.5) / max(1.0, seen.sum())).astype(np.float32)[:, None]
    if len(langs) < 2:
        return _calibrated(Model(langs, np.hstack([np.zeros((2 << BITS, len(langs)), np.float32), common]), np.zeros(len(langs))), [r[1] for r in rows])
    rng = np.random.default_rng(seed)
    learn = [r for r in rows if r[2] != 4] or rows
    check = [r for r in rows if r[2] == 4] or rows
    views = [(langs.index(lang), np.concatenate(grams(np.frombuffer(s, np.uint8)))) for lang, text, _ in learn for s in _snippets(text, rng)]
    views = [v for v in views if len(v[1])]
    embed = rng.uniform(-1 / DIM, 1 / DIM, (2 << BITS, DIM)).astype(np.float32)
    soft, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    weight = 1 / np.maximum(np.bincount([v[0] for v in views], minlength=len(langs)), 1)
    weight = (weight / weight.mean()).clip(0.2, 5).astype(np.float32)
    steps, done = epochs * -(-len(views) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(views))
        for at in range(0, len(order), batch):
            part = [views[i] for i in order[at : at + batch]]
            y, sizes = np.array([p[0] for p in part]), np.array([len(p[1]) for p in part])
            ids = np.concatenate([p[1] for p in part])
            mean = np.add.reduceat(embed[ids], np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= weight[y][:, None]
            step = rate * (1 - done / steps) / len(y) * 16
            down = (p @ soft.T) / sizes[:, None]
            soft -= step * (mean.T @ p)
            bias -= step * 0.1 * p.sum(0)
            sort = np.argsort(ids, kind="stable")
            rows_at = ids[sort]
            first = np.flatnonzero(np.r_[True, rows_at[1:] != rows_at[:-1]])
            embed[rows_at[first]] -= step * np.add.reduceat(np.repeat(down, sizes, axis=0)[sort], first, axis=0)
            done += 1
    model = Model(langs, np.hstack([(embed @ soft).astype(np.float32), common]), bias.astype(float))
    texts = [(langs.index(lang), s) for lang, text, _ in check for s in (text, *_snippets(text, rng))]
    y = np.array([t[0] for t in texts])
    logp = np.log(_of_texts(model, [s for _, s in texts])[0] + 1e-12)

    def loss(t: float) -> float:
        z = logp / t
        return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) - z.max(1)).mean())

    model.temperature = float(min(np.geomspace(0.1, 4, 40), key=loss))
    return _calibrated(model, [t for _, t, _ in check])


def _calibrated(model: Model, texts: list[bytes]) -> Model:
    """The thresholds of rejection, from whole texts that have letters to go by."""
    usable = [t for t in texts if len(t) >= 3 and (_BLANKED[np.frombuffer(t, np.uint8)] != 32).any()]
    if usable:
        p, f = _of_texts(model, usable)
        model.threshold = float(min(0.5, np.quantile(p.max(1), 0.001)))
        model.familiar = float(np.median(f) - FAR * (np.median(f) - np.quantile(f, 0.001)))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn the languages, MAX_LANGUAGES of them at most, from a bounded sample of the documents that have one and whose fold is not 0.

    A language of few documents gives all of them; one document is the least.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 0) & (F.octet_length(text_col) <= MAX_SAMPLE_BYTES))
    sizes = {r[0]: r[1] for r in usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return Model([], np.zeros((2 << BITS, 1), np.float32), np.zeros(0))
    most = max(1, min(PER_LANGUAGE, IN_ALL // len(sizes)))
    grain = 1_000_000
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(grain, -(-grain * most * 6 // (5 * n)))))])
    picked = usable.where(F.pmod(F.xxhash64(id_col), F.lit(grain)) < share[F.col(lang_col)])
    rows = picked.orderBy(F.xxhash64(id_col), id_col, text_col).limit(2 * IN_ALL + 3 * len(sizes)).select(lang_col, F.col(text_col).cast("binary"), fold(id_col)).collect()
    taken: dict[str, int] = {}
    out = []
    for lang, text, k in rows:
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= most:
            out.append((lang, bytes(text), k))
    return train(out)


def _decide(model: Model, texts: pa.Array, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language index (-1: und), score and rejection of a column of texts."""
    lang, score, known = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
    if model.langs:
        for first, buf, offs in chunks(texts):
            p, f = probabilities(model, buf, offs)
            rows = slice(first, first + len(p))
            lang[rows], score[rows], known[rows] = p.argmax(1), p.max(1), f
    lang[~letter], score[~letter] = -1, 0.0
    return lang, score, (lang < 0) | (score < model.threshold) | (known < model.familiar)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score and rejected of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # two tables of 32768 rows, a column for each language
    narrow = docs.select(F.col(id_col), (fold(id_col) == 0).alias("held_out"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letter"), F.col(text_col).alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for b in batches:
            lang, score, rejected = _decide(m, b.column(3), b.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names[lang], pa.string()), pa.array(score), pa.array(rejected)], names=[id_col, "held_out", "lang_pred", "score", "rejected"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return narrow.mapInArrow(lean(run), schema)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects, all columns as they were."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    marked = docs.select("*", F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            _, _, rejected = _decide(m, b.column(at), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False))
            yield b.select(list(range(b.num_columns - 1))).filter(pa.array(~rejected))

    return marked.mapInArrow(lean(run), docs.schema)
