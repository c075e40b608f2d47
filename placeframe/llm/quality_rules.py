"""Quality rules with adaptive thresholds.

The measures of every text are taken once and written. Quantile sketches (KLL, mergeable) of each ratio and of what it is
divided by are built for each language and source and merged into sketches of each language and of all rows. Each text is
then joined with the fences of its own group, and kept where it stays within all of them. No fence is a fixed value.

A fence lies SPREAD spreads from the group's median. The spread is the distance of the quartile from the median, or that of
the nearer quantile (0.6, 0.4) in the same units, whichever is smaller: junk in a quarter of a group and more does not move
it. Where most texts have no symbol, no equal line or no repeat at all, the spread is 0, and the grain of the ratio stands
for it: one symbol, line or repeated window in a text as long as the group's median text, or as long as this text if it is
shorter. For word length, whose mean over few words is less exact, the spread grows with the square root of that length over
the text's. Groups of fewer than ``MIN_GROUP`` texts have their language's fences, small languages those of all texts. What
most texts of a group are like is its rule, whatever it is: a source that is junk throughout is left to the base rules.

Null and empty texts have zeros everywhere and fail the base rules. Null languages and sources form groups of their own.
Repeated rows are measured each for itself; long texts are measured whole. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeframe.llm import tokens as K
from placeframe.session import discard, materialise, ship_package

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Ratio, what is counted and by what it is divided, and its grain (None: a mean, whose spread depends on the number of words).
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars", 1),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 1),
    "repeat_ratio": ("n_repeat_words", "n_words", 10),
    "word_length": ("word_chars", "n_words", None),
}
LENGTHS = ("word_chars", "n_lines", "n_words")
#: Spreads from the median to a fence; the quartiles' distance over that of the quantiles 0.4 and 0.6 in a normal distribution.
SPREAD, NEARER, MIN_GROUP = 8.0, 2.662, 200
#: A sketch holds all values of up to so many rows, and is off by some quarter of a hundredth of the ranks beyond.
SKETCH_K = 1024
#: Fences are broadcast up to this many groups (some 100 bytes each), and joined by a shuffle beyond it.
MAX_BROADCAST_GROUPS = 20_000


def measure(texts: pa.Array) -> np.ndarray:
    """(measures, rows): the base counts of each text, see MEASURES."""
    out = np.zeros((len(MEASURES), len(texts)), np.int64)
    for first, buf, offs in K.chunks(texts):
        n = len(offs) - 1
        rows = slice(first, first + n)
        solid = ~K.SPACE[buf]

        def within(flag: np.ndarray, offs=offs) -> np.ndarray:
            return np.diff(np.r_[0, np.cumsum(flag, dtype=np.int64)][offs])

        sums = K.prefix(K.byte_values(buf))
        ws, we, wrow = K.runs(solid, offs)
        out[0, rows] = K.counts(wrow, n)
        out[1, rows] = within(solid & ((buf & 0xC0) != 0x80))
        out[2, rows] = within(_SYMBOL[buf])
        ls, le, lrow = K.runs(buf != 10, offs)
        seen = np.r_[0, np.cumsum(solid, dtype=np.int64)]
        some = seen[le] > seen[ls]
        ls, le, lrow = ls[some], le[some], lrow[some]
        out[3, rows] = K.counts(lrow, n)
        keys = K.span_hash(sums, ls, le) + K.mix(lrow.astype(K.U))
        _, once = np.unique(keys, return_index=True)
        out[4, rows] = out[3, rows] - K.counts(lrow[once], n)
        grams, at = K.ngrams(K.span_hash(sums, ws, we), wrow, 5)
        if len(grams):
            _, inverse, times = np.unique(grams + K.mix(wrow[at].astype(K.U)), return_inverse=True, return_counts=True)
            twice = at[times[inverse] >= 2]
            cover = np.zeros(len(ws) + 1, np.int64)
            np.add.at(cover, twice, 1)
            np.add.at(cover, twice + 5, -1)
            out[5, rows] = K.counts(wrow[np.cumsum(cover[:-1]) > 0], n)
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source and the base counts of every row."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("__t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, measure(b.column(3)))], names=[id_col, "lang", "source", *MEASURES])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *[T.StructField(m, T.LongType()) for m in MEASURES]])
    return narrow.mapInArrow(K.lean(run), schema)


def _ratio(name: str) -> str:
    what, by, _ = RATIOS[name]
    return f"cast({what} / greatest({by}, 1) as double)"


def fences(counted: DataFrame) -> DataFrame:
    """lang, source, the median and spreads of each ratio, and the median lengths, of the group or what stands for it."""
    measured = {r: F.expr(_ratio(r)) for r in RATIOS} | {n: F.col(n).cast("double") for n in LENGTHS}
    sketch = [F.kll_sketch_agg_double(c, F.lit(SKETCH_K)).alias(r) for r, c in measured.items()]
    merge = [F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in measured]
    rows = F.sum("__n").alias("__n")
    own = materialise(counted.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("__n"), *sketch), "quality-sketches")
    lang = own.groupBy("lang").agg(rows, *merge)
    whole = lang.agg(rows, *merge)

    def level(df: DataFrame, keys: list, tag: str) -> DataFrame:
        at = lambda r, q: F.kll_sketch_get_quantile_double(r, F.lit(q))
        out = [*keys, F.col("__n").alias(f"{tag}_n"), *[at(n, 0.5).alias(f"{tag}_{n}") for n in LENGTHS]]
        for r in RATIOS:
            up = F.least(at(r, 0.75) - at(r, 0.5), (at(r, 0.6) - at(r, 0.5)) * NEARER)
            down = F.least(at(r, 0.5) - at(r, 0.25), (at(r, 0.5) - at(r, 0.4)) * NEARER)
            out += [at(r, 0.5).alias(f"{tag}_{r}"), up.alias(f"{tag}_{r}_up"), down.alias(f"{tag}_{r}_down")]
        return df.select(*out)

    a, b, c = level(own, ["lang", "source"], "own"), level(lang, [F.col("lang").alias("__lang")], "lang"), level(whole, [], "all")
    joined = a.join(b, F.col("lang").eqNullSafe(F.col("__lang"))).crossJoin(F.broadcast(c))  # c is one row
    values = [*LENGTHS, *[f"{r}{x}" for r in RATIOS for x in ("", "_up", "_down")]]
    pick = lambda v: F.when(F.col("own_n") >= MIN_GROUP, F.col(f"own_{v}")).when(F.col("lang_n") >= MIN_GROUP, F.col(f"lang_{v}")).otherwise(F.col(f"all_{v}")).alias(f"mid_{v}")
    out = materialise(joined.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *map(pick, values)), "quality-fences")
    discard(own)
    return out


def _limit(r: str, side: str) -> Column:
    """The fence of a ratio above or below for the text at hand, from the columns of :func:`fences`."""
    _, by, grain = RATIOS[r]
    spread = F.col(f"mid_{r}_{side}")
    if grain is None:
        spread = spread * F.greatest(F.lit(1.0), F.sqrt(F.col(f"mid_{by}") / F.greatest(F.col(by), F.lit(1))))
    else:
        spread = F.greatest(spread, F.lit(float(grain)) / F.greatest(F.least(F.col(f"mid_{by}"), F.col(by).cast("double")), F.lit(1.0)))
    return F.col(f"mid_{r}") + (1 if side == "up" else -1) * SPREAD * spread


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Base counts, base_failed, kept and the broken rule (null where kept) of every row."""
    counted = materialise(measures(docs, id_col, text_col, lang_col, source_col), "quality-measures")
    limits = fences(counted)
    if limits.count() <= MAX_BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    joined = counted.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rule = F.when(failed, F.lit("base"))
    for r in RATIOS:
        value = F.expr(_ratio(r))
        broken = value > _limit(r, "up")
        rule = rule.when(broken | (value < _limit(r, "down")) if RATIOS[r][2] is None else broken, F.lit(r))
    return joined.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), rule.isNull().alias("kept"), rule.alias("rule"))
