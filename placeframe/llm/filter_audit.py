"""What each filter of a chain removes, whatever the order: a product of histograms and outcome matrices.

A text is reduced to a mask of the filters it fails, so a part (a language) is a row of 32 counts. Those rows, for all
documents and for those labelled good and toxic, are stacked and multiplied by integer matrices of 32 masks by 600 places
(120 orders of five steps) that say for which masks a document is kept, removed, failed in vain or failed alone.

The conditions: A under 200 words; B fewer than half of the words distinct; C capitals above 3 in 100 code points; D holds
any of ``#$%&*|``; E equal to the text of a smaller doc_id.

Null texts count as empty, null languages as the part of the empty string. A null id comes after all others, has no labels and
is no earlier than another null id; rows that repeat an id are documents of their own, neither before the other. Several
labels of one id: one that marks it is enough. Texts are compared by SHA-256. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeframe.llm import tokens as K
from placeframe.session import ship_package

FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
MASKS = 1 << len(FILTERS)
_CAPITAL, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK[[ord(c) for c in "#$%&*|"]] = True
#: Rows without an id would meet in one task of the join with the labels; they are dealt by their text instead.
NO_ID_SALT = 1 << 20
_OUT = "part string, filter_order string, step int, filter string, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(texts: pa.Array) -> np.ndarray:
    """The mask of A to D for each text; E needs the other texts."""
    out = np.zeros(len(texts), np.int32)
    for first, buf, offs in K.chunks(texts):
        n = len(offs) - 1

        def within(flag: np.ndarray, offs=offs) -> np.ndarray:
            return np.diff(np.r_[0, np.cumsum(flag, dtype=np.int64)][offs])

        ws, we, row = K.words(buf, offs)
        words = K.counts(row, n)
        keys = K.span_hash(K.prefix(K.byte_values(buf)), ws, we) + K.mix(row.astype(K.U))
        distinct = K.counts(row[np.unique(keys, return_index=True)[1]], n)
        points = within((buf & 0xC0) != 0x80)
        fails = (words < 200, 100 * distinct < 50 * words, 100 * within(_CAPITAL[buf]) > 3 * points, within(_MARK[buf]) > 0)
        out[first : first + n] = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
    return out


def outcome_matrices() -> dict[str, np.ndarray]:
    """kept, removed, redundant and unique: masks by places, place 5 * order + step; 1 where that outcome is a document's."""
    out = {name: np.zeros((MASKS, len(ORDERS) * len(FILTERS)), np.int64) for name in ("kept", "removed", "redundant", "unique")}
    mask = np.arange(MASKS)
    for o, order in enumerate(ORDERS):
        before = 0
        for s, f in enumerate(order):
            at, bit = o * len(FILTERS) + s, 1 << f
            fails, gone = (mask & bit) > 0, (mask & before) > 0
            out["kept"][:, at] = ~fails & ~gone
            out["removed"][:, at] = fails & ~gone
            out["redundant"][:, at] = fails & gone
            out["unique"][:, at] = mask == bit
            before |= bit
    return out


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (of all five filters), good, toxic and n: how many documents of a part have that mask and those labels."""
    ship_package(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(failures(b.column(3)))], names=["id", "part", "digest", "bits"])

    judged = narrow.mapInArrow(K.lean(run), narrow.drop("text").schema.add("bits", "integer"))
    judged = judged.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NO_ID_SALT))).otherwise(F.lit(0)))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = judged.join(marks.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")})
    # Copies meet as counts: by id where the join has put them, then by text; what is left of a text is a row a part and label.
    kind = ["digest", "part", "bits", "good", "toxic"]
    ids = marked.groupBy("id", "salt", *kind).agg(F.count(F.lit(1)).alias("n"))
    least = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("n"))
    texts = ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(least).alias("least"))
    first = F.min(F.struct("least.none", "least.id")).over(Window.partitionBy("digest"))
    leads = F.struct("least.none", "least.id").eqNullSafe(F.col("first"))
    split = texts.withColumn("first", first).withColumn("lead", F.when(leads, F.col("least.n")).otherwise(F.lit(0)))
    both = F.explode(F.array(F.struct(F.col("bits").alias("mask"), F.col("lead").alias("n")), F.struct((F.col("bits") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("lead")).alias("n"))))
    rows = split.select("part", "good", "toxic", both.alias("b")).select("part", "b.mask", "good", "toxic", "b.n")
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row for each part, order of the filters and step, with the counts of the outcomes and of the labels lost."""
    # A part has at most 32 masks of four kinds of labels.
    parts = masks(docs, labels, id_col, text_col, part_col).groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("counts"))
    names = ["".join(FILTERS[f] for f in order) for order in ORDERS]
    steps = len(FILTERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = outcome_matrices()
        filters = np.array([f for order in ORDERS for f in order])
        place = np.array(names).repeat(steps), np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names)), np.array(list(FILTERS))[filters]
        for b in batches:
            parts, counts = b.column(0), b.column(1)
            row = np.repeat(np.arange(len(b)), np.diff(counts.offsets.to_numpy()))
            mask, good, toxic, n = (x.to_numpy(zero_copy_only=False) for x in counts.flatten().flatten())
            stacked = np.zeros((3, len(b), MASKS), np.int64)  # all, good, toxic
            np.add.at(stacked[0], (row, mask), n)
            np.add.at(stacked[1], (row, mask), n * good)
            np.add.at(stacked[2], (row, mask), n * toxic)
            everything, of_good, of_toxic = stacked
            removed = everything @ m["removed"]
            by_filter = removed @ (filters[:, None] == np.arange(steps)).astype(np.int64)
            columns = [everything @ m["kept"], removed, everything @ m["redundant"], everything @ m["unique"], of_good @ m["removed"], of_toxic @ m["removed"], by_filter[:, filters]]
            yield pa.RecordBatch.from_arrays(
                [parts.take(pa.array(np.arange(len(b)).repeat(len(filters)))), *[pa.array(np.tile(x, len(b))) for x in place], *[pa.array(x.ravel()) for x in columns]],
                names=["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
            )

    return parts.mapInArrow(run, _OUT)
