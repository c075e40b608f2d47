"""Benchmark decontamination by template canonicalisation.

Both sides become sequences of canonical tokens: words without the punctuation around them, in lower case, with numbers,
units after numbers and names (capitalised words within a sentence, a run of them one token) replaced by typed
placeholders. Windows of ``WINDOW`` tokens (a shorter item is one window) are hashed and joined. What the placeholders
stand for must agree: along a matched stretch each slot value of the item must always meet the same value of the document
(two values of the item may meet one of the document). A conflict ends a stretch; the windows of each consistent stretch
count, and windows whose slot values all equal the item's always do. An item whose values all meet themselves is verbatim;
one with other, consistent values is re-parameterised.

Windows of plain words in lower case, without placeholders, are joined for what the templates leave, so that a copy in other
capitals, an item of numbers and a short item are found as they stand; ``MIN_COPIED`` of them, or half of an item's, are a verbatim match. An item of fewer
than ``MIN_ITEM`` words is everyday language: it counts where it makes a whole line of a document. Items without a letter or digit cannot be
sought (:func:`unsearchable` lists them). Template windows with fewer than ``MIN_LITERALS`` plain words are no evidence, so
a re-parameterised item of little else than numbers is not found.

The benchmark is the stated query set, and every document meets all of it, in blocks: a block holds at most
``BLOCK_WINDOWS`` words, so what is broadcast has a fixed bound, and a larger benchmark takes more passes over the
documents, never more memory.

Null and empty texts match nothing; repeated rows and items are matched each for itself; long texts are matched whole; an
empty table on either side gives no rows. Extra columns are ignored. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeframe.llm import tokens as K
from placeframe.session import materialise, ship_package

WINDOW, MIN_ITEM, MIN_LITERALS = 10, 5, 4
#: A pair counts with this many matched windows, or with this share of the item's windows.
MIN_WINDOWS, MIN_COVERAGE = 8, 0.5
#: A pair counts with this many windows of plain words (13 words in a row), or with MIN_COVERAGE of the item's.
MIN_COPIED = 4
BLOCK_WINDOWS = 2_000_000
#: Text bytes that are matched together.
CHUNK = 1 << 19

# Units that may follow a number, and number words.
UNITS = ("km", "m", "cm", "mm", "mi", "miles", "mile", "ft", "feet", "inches", "inch", "kg", "g", "mg", "lb", "lbs", "pounds", "tons", "l", "ml", "litres", "liters", "h", "hours", "hour", "min", "minutes", "minute", "s", "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "percent", "degrees", "dollars", "euros", "cents")
NUMBER_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")

_ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_DIGIT = np.array([48 <= b < 58 for b in range(256)])
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_SMALL = np.array([97 <= b < 123 for b in range(256)])
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n\"("]] = True
NUM, UNIT, NAME, JOINED = (K.U(x) for x in (0x9D5A5F1B3C217E01, 0x5B1F0C9E2A7D4403, 0x71E3A9C4D60B8805, 0x2C94D1E7F83A6607))


def fold_case(buf: np.ndarray) -> np.ndarray:
    """Small letters for ASCII and Latin-1 capitals (whose second UTF-8 byte is 0x80 to 0x9E after 0xC3, but for the times sign)."""
    out = K.LOWER[buf]
    if len(buf) > 1:
        latin = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        out[1:][latin] += 0x20
    return out


def _hashes(words: tuple[str, ...]) -> np.ndarray:
    buf = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words])
    return np.sort(K.span_hash(K.prefix(K.byte_values(buf)), np.r_[0, ends[:-1]], ends))


_UNIT_HASHES, _NUMBER_HASHES = _hashes(UNITS), _hashes(NUMBER_WORDS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return known[at] == h


@dataclass
class Canonical:
    """Tokens of a chunk: template hash, slot type (0: plain), value hash and row; words with their row and line."""

    template: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    row: np.ndarray
    word: np.ndarray
    word_row: np.ndarray
    opens_line: np.ndarray  # one entry more than words: the end opens one too


def canonical(buf: np.ndarray, offs: np.ndarray) -> Canonical:
    ws, we, row = K.words(buf, offs)
    solid = np.flatnonzero(_ALNUM[buf])
    lo, hi = np.searchsorted(solid, ws), np.searchsorted(solid, we) - 1
    real = lo <= hi
    lo, hi, row = lo[real], hi[real], row[real]
    s, e = (solid[lo], solid[hi] + 1) if len(solid) else (lo, lo)
    n = len(s)
    if not n:
        z = np.zeros(0, K.U)
        return Canonical(z, np.zeros(0, np.int8), z, row, z, row, np.ones(1, bool))
    value = K.span_hash(K.prefix(K.byte_values(fold_case(buf))), s, e)

    def having(flag: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(flag[buf], dtype=np.int64)]
        return total[e] - total[s]

    digits, letters = having(_DIGIT), having(_LETTER)
    first = np.r_[True, row[1:] != row[:-1]]
    number = ((digits > 0) & (letters == 0)) | _among(value, _NUMBER_HASHES)
    joined = _DIGIT[buf[s]] & (letters > 0)
    unit = np.r_[False, number[:-1]] & ~first & _among(value, _UNIT_HASHES)
    stops = np.r_[0, np.cumsum(_STOP[buf], dtype=np.int64)]
    opens = first | np.r_[True, stops[s[1:]] > stops[e[:-1]]]
    b0 = buf[s]
    b1 = buf[np.minimum(s + 1, len(buf) - 1)]
    capital = ((b0 >= 65) & (b0 <= 90)) | ((b0 == 0xC3) & (b1 >= 0x80) & (b1 <= 0x9E))
    name = capital & (having(_SMALL) > 0) & ~opens
    slot = np.select([number, joined, unit, name], [1, 2, 3, 4], 0).astype(np.int8)
    template = np.select([slot == 1, slot == 2, slot == 3, slot == 4], [NUM, JOINED, UNIT, NAME], value)
    lines = np.r_[0, np.cumsum(buf == 10)]
    opens_line = np.r_[first | np.r_[True, lines[s[1:]] > lines[e[:-1]]], True]
    word, word_row = value, row
    again = (slot == 4) & np.r_[False, slot[:-1] == 4] & ~first
    if again.any():  # a run of names is one token, valued by all of them
        head = np.flatnonzero(~again)
        value = np.add.reduceat(value, head)
        template, slot, row = template[head], slot[head], row[head]
    return Canonical(template, slot, value, row, word, word_row, opens_line)


def windows(c: Canonical, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` tokens with enough plain words, and where they start."""
    h, at = K.ngrams(c.template, c.row, size)
    plain = np.r_[0, np.cumsum(c.slot == 0)]
    enough = plain[at + size] - plain[at] >= min(MIN_LITERALS, size)
    return h[enough] + K.U(size), at[enough]


@dataclass
class Index:
    """Sorted window hashes of a block with item and position, and the number of windows of each item."""

    sizes: list[int]
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    total: np.ndarray

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of a window of ``h`` and an entry of the same hash."""
        lo = np.searchsorted(self.hashes, h, "left")
        n = np.searchsorted(self.hashes, h, "right") - lo
        return np.repeat(np.arange(len(h)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)


def _index(row: np.ndarray, items: int, shortest: int, windows_of) -> Index:
    """windows_of(size): hashes and starts of the windows of that size."""
    length = np.bincount(row, minlength=items)
    start = np.cumsum(length) - length
    h, at, sizes = [np.zeros(0, K.U)], [np.zeros(0, np.int64)], sorted({min(WINDOW, int(k)) for k in length if k >= shortest})
    for k in sizes:
        x, y = windows_of(k)
        own = (np.minimum(length, WINDOW) == k)[row[y]]
        h.append(x[own])
        at.append(y[own])
    h, at = np.concatenate(h), np.concatenate(at)
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    item = row[at]
    return Index(sizes, h, item, at - start[item], np.bincount(item, minlength=items))


def plain_windows(c: Canonical, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``size`` words, and where they start."""
    h, at = K.ngrams(c.word, c.word_row, size)
    return h + K.U(size), at


@dataclass
class Block:
    """A part of the benchmark: its windows of canonical tokens and of plain words, and the items' tokens."""

    ids: list
    template: Index
    plain: Index
    words: np.ndarray  # of each item
    start: np.ndarray
    slot: np.ndarray
    value: np.ndarray


def block(items: list[tuple]) -> Block:
    """items: (id, text)."""
    data = [(t or "").encode() for _, t in items]
    c = canonical(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64))
    n = len(items)
    template = _index(c.row, n, MIN_ITEM, lambda k: windows(c, k))
    plain = _index(c.word_row, n, 1, lambda k: plain_windows(c, k))
    return Block([i for i, _ in items], template, plain, np.bincount(c.word_row, minlength=n), np.r_[0, np.cumsum(np.bincount(c.row, minlength=n))], c.slot, c.value)


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Block]:
    """The benchmark in blocks of at most BLOCK_WINDOWS words; one block at a time is in memory."""
    part, size = [], 0
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        n = len((r[1] or "").split()) + 1
        if part and size + n > BLOCK_WINDOWS:
            yield block(part)
            part, size = [], 0
        part.append((r[0], r[1]))
        size += n
    if part:
        yield block(part)


def unsearchable(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The items without a letter or digit."""
    return benchmark.where(~F.coalesce(F.col(item_text).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))).select(item_col)


def stretches(qs: set[int], size: int, slots: dict[int, tuple[int, int, int]]) -> Iterator[tuple[set[int], bool, int]]:
    """(windows, verbatim, slots compared) of the verbatim windows of a diagonal and of each of its consistent stretches."""
    of = {q: [slots[p] for p in range(q, q + size) if p in slots] for q in sorted(qs)}
    same = {q for q, values in of.items() if all(mine == theirs for _, mine, theirs in values)}
    if same:
        yield same, True, len({p for q in same for p in range(q, q + size) if p in slots})
    run: set[int] = set()
    meets: dict[tuple[int, int], int] = {}

    def stretch() -> tuple[set[int], bool, int]:
        return run, run <= same, len({p for q in run for p in range(q, q + size) if p in slots})

    for q, values in of.items():
        trial = dict(meets)
        if not all(trial.setdefault((kind, mine), theirs) == theirs for kind, mine, theirs in values):
            if run:
                yield stretch()
            run, trial = set(), {}
            if not all(trial.setdefault((kind, mine), theirs) == theirs for kind, mine, theirs in values):
                meets = {}
                continue
        run, meets = run | {q}, trial
    if run:
        yield stretch()


def _copied(b: Block, c: Canonical) -> dict[tuple[int, int], tuple[int, int, bool, int]]:
    """(row, item): (matched windows, the item's windows, True, 0) of the pairs that count by plain words alone."""
    pairs, n = [np.zeros((3, 0), np.int64)], len(b.ids)
    for k in b.plain.sizes:
        h, at = plain_windows(c, k)
        w, i = b.plain.hits(h)
        p, item = at[w], b.plain.item[i]
        line = c.opens_line[p] & c.opens_line[p + k]
        ok = (np.minimum(b.words[item], WINDOW) == k) & ((b.words[item] >= MIN_ITEM) | line)
        pairs.append(np.stack([c.word_row[p], item, b.plain.at[i]])[:, ok])
    row, item, q = np.concatenate(pairs, axis=1)
    pair = row * n + item
    order = np.lexsort((q, pair))
    pair, q = pair[order], q[order]
    once = np.r_[True, (pair[1:] != pair[:-1]) | (q[1:] != q[:-1])][: len(pair)]
    pair, many = np.unique(pair[once], return_counts=True)
    total = b.plain.total[pair % n]
    good = (many >= MIN_COPIED) | (many >= MIN_COVERAGE * total)
    return {(x // n, x % n): (m, t, True, 0) for x, m, t in zip(pair[good].tolist(), many[good].tolist(), total[good].tolist(), strict=True)}


def match(b: Block, texts: pa.Array) -> Iterator[tuple[int, int, int, int, bool, int]]:
    """(row, item index, matched windows, the item's windows, verbatim, slots) of each pair that counts."""
    for first, buf, offs in K.chunks(texts, CHUNK):
        c = canonical(buf, offs)
        counted: dict[tuple[int, int], tuple[int, int, bool, int]] = {}
        found: dict[tuple[int, int], dict[int, set[int]]] = {}
        for k in b.template.sizes:
            h, at = windows(c, k)
            w, i = b.template.hits(h)
            for p, row, item, q in zip(at[w].tolist(), c.row[at[w]].tolist(), b.template.item[i].tolist(), b.template.at[i].tolist(), strict=True):
                found.setdefault((row, item), {}).setdefault(p - q, set()).add(q)
        for (row, item), diagonals in found.items():
            start, total = int(b.start[item]), int(b.template.total[item])
            size = min(WINDOW, int(b.start[item + 1]) - start)
            meets: dict[tuple[int, int], int] = {}
            whole: tuple[set[int], bool, int] = (set(), True, 0)
            best = whole
            for shift, qs in sorted(diagonals.items(), key=lambda x: (-len(x[1]), x[0])):
                places = [q for q in sorted({q + d for q in qs for d in range(size)}) if b.slot[start + q]]
                slots = {q: (int(b.slot[start + q]), int(b.value[start + q]), int(c.value[shift + q])) for q in places}
                trial = dict(meets)
                if all(trial.setdefault((kind, mine), theirs) == theirs for kind, mine, theirs in slots.values()):
                    meets = trial
                    whole = whole[0] | qs, whole[1] and all(mine == theirs for _, mine, theirs in slots.values()), whole[2] + len(slots)
                else:
                    best = max([best, *stretches(qs, size, slots)], key=lambda x: len(x[0]))
            n, same, slots_met = max(whole, best, key=lambda x: len(x[0]))
            if n and (len(n) >= MIN_WINDOWS or len(n) >= MIN_COVERAGE * total):
                counted[row, item] = len(n), total, same, slots_met
        for pair, told in _copied(b, c).items():
            # Windows without slots are plain words: these count them all, also where a word's capital is a name in one of the two texts.
            if pair not in counted or counted[pair][2:] == (True, 0):
                counted[pair] = told
        for (row, item), (n, total, same, slots_met) in sorted(counted.items()):
            yield first + row, item, n, total, same, slots_met


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per pair: document id, item id, matched windows, the item's windows, coverage, kind and slots compared.

    The windows are of canonical tokens where these decide and compare slots, else of plain words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("n_windows", T.IntegerType()), T.StructField("item_windows", T.IntegerType()), T.StructField("coverage", T.DoubleType()), T.StructField("kind", T.StringType()), T.StructField("n_slots", T.IntegerType())])
    narrow = docs.select(F.col(id_col), F.col(text_col).alias("__t"))
    parts: list[DataFrame] = []
    kept: Block | None = None

    def scan(b: Block) -> DataFrame:
        shared = spark.sparkContext.broadcast(b)  # BLOCK_WINDOWS windows at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            kind = pa.array(own.ids).type
            for batch in batches:
                got = list(match(own, batch.column(1)))
                if got:
                    rows, items, n, total, same, slots = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([own.ids[i] for i in items], kind), pa.array(n, pa.int32()), pa.array(total, pa.int32()), pa.array([a / t for a, t in zip(n, total, strict=True)]), pa.array(["verbatim" if s else "reparameterised" for s in same]), pa.array(slots, pa.int32())], names=schema.names)

        return narrow.mapInArrow(K.lean(run), schema)

    for b in blocks(benchmark, item_col, item_text):
        if kept is not None:
            parts.append(materialise(scan(kept), "decontamination"))
        kept = b
    if kept is None:
        return spark.createDataFrame([], schema)
    out = scan(kept)
    for p in parts:
        out = out.unionByName(p)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; texts are filtered where they are, never shuffled."""
    spark = docs.sparkSession
    ship_package(spark)
    at, schema = docs.columns.index(text_col), docs.schema
    for b in blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast(b)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in match(shared.value, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(K.lean(run), schema)
    return docs
