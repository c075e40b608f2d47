"""Ranked lexical search over all documents: the three-phase uniform threshold algorithm on term-partitioned postings.

A posting is (document, count, length of the document); its impact, the part of a score that hangs on those, counts for
an item times the term's weight. The postings of a term are a list, and lists are cut into segments of some thousand documents,
so the commonest term is many bounded rows. A row of the index is the list of one term in one segment.

1. The heads of all lists give lower bounds of scores: their sums by item and document, of which the k-th best is the item's
   first threshold. Within a segment the documents in the heads are looked up, which can raise it there.
2. Every list gives what is at least the threshold divided by the number of lists. A document that no list gives is below the
   threshold. What others can still get from lists that did not give them is bounded by that share and by the head of the
   list; where their sum with that is less than the k-th best of what was given, they fall.
3. The exact scores of those that are left are looked up in all the item's lists. The best k of each segment are ranked.

No posting of a term of no item is made: a bit table of a fixed 2 MB of the items' term hashes lets terms pass (false ones too,
which meet no item), whatever the number of items; lists and items are joined on the terms themselves. Items go to blocks, and
a task holds one segment and one block of items.

Terms are maximal runs of ASCII letters and digits and of anything beyond ASCII; only A to Z are lower-cased. Null and empty texts
have no terms and are in no count. Items without terms, or whose terms stand in no document, have no rows. Rows that repeat an
id are documents, or items, of their own; equal scores go by id, null ids last. Terms within a segment are told apart by
64-bit hashes. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeframe.llm import tokens as K
from placeframe.session import materialise, ship_package

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bits of a term's hash that choose its place in the bit table.
SLOT_BITS = 24
#: A segment ends after so many postings; items of a block.
SEGMENT_POSTINGS, BLOCK_ITEMS = 1 << 21, 500
_NO_ID = np.iinfo(np.int64).max
_INDEX = "segment long, term string, docs binary, counts binary, sizes binary, ids binary"


def _gather(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings [start, start + size) of the bytes."""
    offs = np.r_[0, np.cumsum(size)]
    at = np.arange(offs[-1]) + np.repeat(start - offs[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(buf[at].tobytes()))


def _terms(texts: pa.Array, passes: np.ndarray | None = None) -> Iterator[tuple]:
    """A chunk: first row, terms with repeats of each row; row, hash, slot and count of each distinct term that passes, and the terms."""
    for first, buf, offs in K.chunks(texts):
        low = K.LOWER[buf]
        s, e, row = K.runs(_TERM[buf], offs)
        h = K.span_hash(K.prefix(K.byte_values(low)), s, e)
        n = K.counts(row, len(offs) - 1)
        slot = (h >> K.U(64 - SLOT_BITS)).astype(np.int64)
        if passes is not None:
            some = np.flatnonzero((passes[slot >> 3] >> (slot & 7)) & 1)
            s, e, row, h, slot = s[some], e[some], row[some], h[some], slot[some]
        order = np.lexsort((h, row))
        edge = np.ones(len(order), bool)
        edge[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        at = np.flatnonzero(edge)
        one = order[at]
        yield first, n, row[one], h[one], slot[one], np.diff(np.r_[at, len(order)]), _gather(low, s[one], (e - s)[one])


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (the row's number), id, term, times and the term's slot in the bit table."""
    ship_package(items.sparkSession)
    narrow = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, _, row, _, slot, times, terms in _terms(b.column(2)):
                at = pa.array(row + first)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), terms, pa.array(times), pa.array(slot)], names=["item", "id", "term", "times", "slot"])

    return narrow.mapInArrow(K.lean(run), "item long, id long, term string, times long, slot long")


def bit_table(terms: DataFrame) -> bytes:
    """The slots of all terms of the items, one bit each: 2 MB whatever their number."""
    bits = terms.groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("bitmap_bit_position(slot + 1)")).alias("bits"))
    out = np.zeros(1 << (SLOT_BITS - 3), np.uint8)
    for bucket, part in bits.collect():  # 512 rows at most
        a = (bucket - 1) * 4096
        out[a : a + 4096] = np.frombuffer(part, np.uint8)
    return out.tobytes()


def index(docs: DataFrame, id_col: str, text_col: str, passes: bytes, segment_postings: int = SEGMENT_POSTINGS) -> DataFrame:
    """The lists of each segment, by term, and a row without a term for its documents: ids and numbers of terms."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(passes)

    def cut(parts: list[tuple], segment: int) -> pa.RecordBatch:
        ids, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        begin = np.r_[0, np.cumsum([len(p[0]) for p in parts])]
        doc = np.concatenate([p[2] + b for p, b in zip(parts, begin, strict=False)])
        h, times = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
        terms = pa.concat_arrays([p[5] for p in parts])
        order = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
        ends = np.r_[heads, len(h)] * 4

        def packed(values: np.ndarray, own: bytes) -> pa.Array:
            """The lists' slices of the values, and one more row."""
            offs = np.r_[ends, ends[-1] + len(own)].astype(np.int32)
            return pa.BinaryArray.from_buffers(pa.binary(), len(heads) + 1, [None, pa.py_buffer(offs), pa.py_buffer(values[order].astype(np.int32).tobytes() + own)])

        every = pa.array(np.full(len(heads) + 1, segment, np.int64))
        named = pa.concat_arrays([terms.take(pa.array(order[heads])), pa.nulls(1, pa.string())])
        own = pa.concat_arrays([pa.nulls(len(heads), pa.binary()), pa.array([ids.tobytes()], pa.binary())])
        return pa.RecordBatch.from_arrays([every, named, packed(doc, b""), packed(times, b""), packed(n[doc], n.astype(np.int32).tobytes()), own], names=["segment", "term", "docs", "counts", "sizes", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)
        parts, held, segment = [], 0, None
        for b in batches:
            ids = b.column(1).fill_null(_NO_ID).to_numpy()
            for first, n, row, h, _, times, terms in _terms(b.column(2), table):
                segment = b.column(0)[first].as_py() if segment is None else segment
                parts.append((ids[first : first + len(n)], n, row, h, times, terms))
                held += len(row) + len(n)
                if held >= segment_postings:
                    yield cut(parts, segment)
                    parts, held, segment = [], 0, None
        if parts:
            yield cut(parts, segment)

    return narrow.mapInArrow(K.lean(run), _INDEX)


def impact(count: np.ndarray, n: np.ndarray, total: int, length: int) -> np.ndarray:
    """What a term's count in a document of n terms is worth, at most a million."""
    count, n = count.astype(np.int64), n.astype(np.int64)
    return (1_000_000_000 * count) // (1000 * count + 12 * (75 + (25 * n * total) // max(length, 1)))


def _ints(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, np.int32)


class Postings:
    """One list of a segment: by document, and in order of impact."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        self.docs, self.impacts = docs, impacts
        self.order = np.argsort(-impacts, kind="stable")
        self.falling = -impacts[self.order]  # rises, for searches

    def head(self, n: int) -> np.ndarray:
        return self.docs[self.order[:n]]

    def at_least(self, least: int) -> np.ndarray:
        """Places of the postings with that impact and more."""
        return self.order[: np.searchsorted(self.falling, -least, "right")]

    def add_to(self, scores: np.ndarray, weight: int, wanted: np.ndarray, place: np.ndarray) -> None:
        """Looks the wanted documents up and adds what they gain; place: of each document among the wanted, or -1."""
        if len(wanted) * len(self.docs).bit_length() < len(self.docs):
            at = np.minimum(np.searchsorted(self.docs, wanted), len(self.docs) - 1)
            hit = self.docs[at] == wanted
            scores[hit] += weight * self.impacts[at[hit]]
        else:
            to = place[self.docs]
            hit = to >= 0
            scores[to[hit]] += weight * self.impacts[hit]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def best_of_segment(lists: list[tuple[Postings, int]], n_docs: int, ids: np.ndarray, threshold: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of a segment, or those of them that reach the threshold, and their exact scores."""
    place = np.full(n_docs, -1, np.int64)

    def look_up(wanted: np.ndarray) -> np.ndarray:
        scores = np.zeros(len(wanted), np.int64)
        place[wanted] = np.arange(len(wanted))
        for postings, w in lists:
            postings.add_to(scores, w, wanted, place)
        place[wanted] = -1
        return scores

    heads = np.unique(np.concatenate([p.head(k) for p, _ in lists]))
    threshold = max(threshold, _kth(look_up(heads), k), 1)
    share = -(-threshold // len(lists))
    got, given, open_ = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool), np.zeros(n_docs, np.int64)
    for p, w in lists:
        places = p.at_least(-(-share // w))
        docs = p.docs[places]
        rest = min(share - 1, w * -int(p.falling[0]))
        got[docs] += w * p.impacts[places]
        open_ += rest
        open_[docs] -= rest
        given[docs] = True
    seen = np.flatnonzero(given)
    stay = seen[got[seen] + open_[seen] >= max(threshold, _kth(got[seen], k))]
    exact = look_up(stay)
    order = np.lexsort((stay, ids[stay], -exact))[:k]
    order = order[exact[order] >= threshold]
    return stay[order], exact[order]


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", segment_postings: int = SEGMENT_POSTINGS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents with the highest scores above 0 for each item."""
    terms = materialise(item_terms(items, item_col, item_text_col), "ranked-items")
    lists = materialise(index(docs, id_col, text_col, bit_table(terms), segment_postings), "ranked-index")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [_ints(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int((x > 0).sum()) for x in n], pa.int64()), pa.array([int(x.sum(dtype=np.int64)) for x in n], pa.int64())], names=["total", "length"])

    counts = lists.where("term is null").select("sizes").mapInArrow(sizes, "total long, length long")
    total, length = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for docs_, times, n in zip(*(b.column(c).to_pylist() for c in ("docs", "counts", "sizes")), strict=True):
                gains = impact(_ints(times), _ints(n), total, length)
                first = np.argpartition(-gains, k)[:k] if len(gains) > k else np.arange(len(gains))
                out.append((_ints(docs_)[first], gains[first], len(gains)))
            times = np.array([len(x) for x, _, _ in out], np.int64)
            df = np.zeros(times.sum(), np.int64)
            df[np.r_[0, np.cumsum(times)[:-1]]] = [n for _, _, n in out]
            at = pa.array(np.arange(len(out)).repeat(times))
            yield pa.RecordBatch.from_arrays([b.column("segment").take(at), b.column("term").take(at), pa.array(np.concatenate([d for d, _, _ in out]).astype(np.int64)), pa.array(np.concatenate([g for _, g, _ in out])), pa.array(df)], names=["segment", "term", "doc", "impact", "df"])

    # Phase 1.
    first_rows = materialise(lists.where("term is not null").mapInArrow(heads, "segment long, term string, doc long, impact long, df long"), "ranked-heads")
    weights = first_rows.groupBy("term").agg(F.sum("df").alias("df")).select("term", F.floor(1000 * F.log(F.lit(2.0 * total + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("w"))
    wanted = materialise(terms.join(weights, "term").select("item", "term", (F.col("w") * F.col("times")).alias("w")).where("w > 0"), "ranked-lists")
    best = _best(first_rows, "term", k, F.desc("impact"), "segment", "doc")
    sums = wanted.join(best, "term").groupBy("item", "segment", "doc").agg(F.sum(F.col("w") * F.col("impact")).alias("sum"))
    first = _best(sums, "item", k, F.desc("sum")).groupBy("item").agg(F.when(F.count(F.lit(1)) == k, F.min("sum")).otherwise(F.lit(0)).alias("threshold"))

    # Phases 2 and 3, by segment and block of items.
    blocks = max(1, -(-terms.select("item").distinct().count() // block_items))
    asked = wanted.join(first, "item").select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "item", "term", "w", "threshold")
    askers = asked.groupBy("block", "term").agg(F.collect_list(F.struct("item", "w", "threshold")).alias("askers"))  # of one block of items
    own = lists.where("term is null").withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")), "askers": F.lit(None).cast(askers.schema["askers"].dataType)})
    cells = lists.where("term is not null").join(askers, "term").unionByName(own)

    def cell(group: pa.Table) -> pa.Table:
        by_item: dict[int, list] = {}
        thresholds, ids, n_docs = {}, np.zeros(0, np.int64), 0
        for docs_, times, n, ids_, asks in zip(*(group.column(c).to_pylist() for c in ("docs", "counts", "sizes", "ids", "askers")), strict=True):
            if asks is None:
                ids = np.frombuffer(ids_, np.int64)
                n_docs = len(ids)
                continue
            postings = Postings(_ints(docs_), impact(_ints(times), _ints(n), total, length))
            for a in asks:
                by_item.setdefault(a["item"], []).append((postings, a["w"]))
                thresholds[a["item"]] = a["threshold"]
        found = [(item, *best_of_segment(of, n_docs, ids, thresholds[item], k)) for item, of in sorted(by_item.items())]
        at = np.concatenate([np.zeros(0, np.int64), *[x for _, x, _ in found]])
        hit = ids[at]
        segment = group.column("segment")[0].as_py()
        return pa.table({"item": np.array([i for i, _, _ in found], np.int64).repeat([len(x) for _, x, _ in found]), "segment": np.full(len(at), segment), "doc": at, "doc_id": pa.array(hit, mask=hit == _NO_ID), "score": np.concatenate([np.zeros(0, np.int64), *[s for _, _, s in found]])})

    met = cells.groupBy("block", "segment").applyInArrow(K.lean_group(cell), "item long, segment long, doc long, doc_id long, score long")
    ranked = _best(met, "item", k, F.desc("score"), F.asc_nulls_last("doc_id"), "segment", "doc")
    names = terms.select("item", F.col("id").alias("item_id")).distinct()
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")


def _best(of: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The k first rows of each key with their rank; Spark cuts every task's rows of a key to k before it shuffles them."""
    return of.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)
