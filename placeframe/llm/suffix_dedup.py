"""Suffix-array deduplication of byte strings across documents, with deep-shallow sorting.

A byte goes if it is covered by a ``LENGTH``-byte string that also starts in a document with a smaller id; strings are
judged on the input. Only suffixes that can take part are sorted; the choice drops none of them:

1. Spool. Texts are written in batches of some megabytes to the shared folder; later steps open a batch by its number.
2. Anchors. Of the ``GRAM``-byte grams in each LENGTH-byte window, the one with the least hash is its anchor; equal windows
   have equal anchors. Anchors that occur in one document only are ruled out; each batch gets a bit for each of its anchors.
3. Contexts. Consecutive windows with the same anchor form one context, a string of less than 2 * LENGTH bytes. Contexts of
   the anchors that are left travel, each once per batch, to buckets by anchor.
4. Sorting. The suffixes of a bucket's distinct contexts, one per window, are sorted to LENGTH bytes: multikey quicksort to
   ``SHALLOW`` bytes, then a blind trie for each group whose members still agree. Equal strings end side by side; the least
   document id of each is known, and every window of a greater id is removed.
5. Hot anchors, which ``HOT_BATCHES`` batches or more hold, skip 3 and 4. Each batch sorts its own windows of them, and sends
   the hash and least id of each distinct one to buckets by hash, packed by batch; those that have a lesser id elsewhere come
   back. A bucket gets an entry for a window and batch, so a line that is everywhere gathers in no task.
6. Cutting. The removed spans return to their batches, where documents are cut.

A batch sends a row to a bucket that holds any of its anchors: rows grow with batches times buckets until each holds one
anchor, and in proportion to the text from there. Anchors, contexts and hot windows are told apart by 64-bit hashes (a
context is wrongly taken for another with odds of n * n / 2^65 for n that meet in a bucket); within a bucket's sort, bytes
are compared.

Ids are whole numbers. A null id counts as greater than all others, and documents with the same id (repeated rows) do not
remove each other's bytes. Null texts count as empty; texts below LENGTH bytes are left alone; long texts are treated in
slabs that overlap. An empty table gives no rows. Records travel as one struct, so no column name can clash.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeframe.llm import tokens as K
from placeframe.session import fresh_path, materialise, ship_package

LENGTH, GRAM, SHALLOW = 50, 20, 24
BATCH_BYTES, BUCKET_BYTES, SLAB = 4 << 20, 8 << 20, 1 << 18
#: An anchor that this many batches hold is hot.
HOT_BATCHES = 1024
#: Tasks of a step that works batch by batch or bucket by bucket.
MAX_TASKS = 20_000
#: Pivots of a partition, and suffixes of a group that is not partitioned further but sorted.
PIVOTS, SMALL = 1024, 1024
_LAST = np.iinfo(np.int64).max


def _open(path: str, write: bool = False):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_output_stream(at, compression=None) if write else fs.open_input_file(at)


def spool(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """Write id, text and the whole row in batches; the manifest (batch, bytes), batch being a file's number, and the folder."""
    folder = fresh_path(docs.sparkSession, "suffix-batches")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(f"`{text_col}`").isNull().alias("no_text")).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            number = uuid.uuid4().int >> 65
            with _open(_file(folder, number), True) as f, pa.ipc.new_file(f, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                for b in held:
                    w.write_batch(b)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64())], names=["batch", "bytes"])

        for b in batches:
            length = np.cumsum(pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
            start = 0
            while start < b.num_rows:
                before = int(length[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(length, before + BATCH_BYTES - size, "right")))
                held.append(b.slice(start, stop - start))
                size += int(length[stop - 1]) - before
                start = stop
                if size >= BATCH_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return materialise(rows.mapInArrow(K.lean(run), "batch long, bytes long"), "suffix-manifest"), folder


def _file(folder: str, number: int) -> str:
    return f"{folder}/{number:016x}.arrow"


def read_batch(folder: str, number: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A batch: its table, the bytes of its texts, their offsets, and the ids as order keys."""
    with _open(_file(folder, number)) as f:
        table = pa.ipc.open_file(f).read_all()
    column = table.column("text").cast(pa.large_binary()).combine_chunks()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    ids = pc.fill_null(table.column("id"), _LAST).to_numpy()
    return table, buf, offs - offs[0], ids


@dataclass
class Runs:
    """Consecutive windows with one anchor: anchor hash, first window, number of windows, document, hash of the context."""

    anchor: np.ndarray
    start: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    context: np.ndarray


def anchored(buf: np.ndarray, offs: np.ndarray) -> Runs:
    n = len(buf)
    some = offs[1:] > offs[:-1]
    leave, end = np.maximum(offs[:-1], offs[1:] - LENGTH + 1)[some], offs[1:][some]  # windows from leave to end leave their document
    low = K.U((1 << 21) - 1)
    parts = []
    for a in range(0, max(0, n - LENGTH + 1), SLAB):
        piece = buf[a : a + SLAB + LENGTH - 1]
        sums = K.prefix(K.byte_values(piece))
        grams = len(piece) - GRAM + 1
        h = K.mix((sums[GRAM:] - sums[:-GRAM]) * K.powers(len(piece))[1][:grams])
        key = (h & ~low) | np.arange(grams, dtype=K.U)
        reach, span = LENGTH - GRAM + 1, 1
        while span * 2 <= reach:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if reach > span:
            key = np.minimum(key[: len(key) - (reach - span)], key[reach - span :])
        place = (key & low).astype(np.int64)
        m = len(place)
        near = (end > a) & (leave < a + m)
        broken = np.zeros(m + 1, np.int32)
        np.add.at(broken, np.clip(leave[near] - a, 0, m), 1)
        np.add.at(broken, np.clip(end[near] - a, 0, m), -1)
        ok = np.cumsum(broken[:-1], dtype=np.int32) == 0
        cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (ok[1:] != ok[:-1])])
        count = np.diff(np.r_[cut, len(place)])
        good = ok[cut]
        cut, count = cut[good], count[good]
        parts.append((h[place[cut]], cut + a, count, K.span_hash(sums, cut, cut + count + LENGTH - 1)))
    if not parts:
        z = np.zeros(0, np.int64)
        return Runs(np.zeros(0, K.U), z, z, z, np.zeros(0, K.U))
    anchor, start, count, context = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Runs(anchor, start, count, np.searchsorted(offs, start, "right") - 1, context)


def distinct_anchors(runs: Runs, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors in bucket order, whether documents of two ids hold them, and the bucket bounds."""
    order = np.argsort(runs.anchor, kind="stable")
    a, d = runs.anchor[order], ids[runs.doc[order]]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(a) else np.zeros(0, bool)
    a = a[first]
    bucket = (a % K.U(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return a[by], many[by], np.searchsorted(bucket[by], np.arange(buckets + 1))


def _six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray((keys >> K.U(16)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0]


def anchor_blobs(manifest: DataFrame, folder: str, buckets: int, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number in b.column(0).to_pylist():
                _, buf, offs, ids = read_batch(folder, number)
                a, many, bounds = distinct_anchors(anchored(buf, offs), ids, buckets)
                some = np.flatnonzero(bounds[1:] > bounds[:-1])
                rows = [(i, number, _six(a[bounds[i] : bounds[i + 1]]), np.packbits(many[bounds[i] : bounds[i + 1]]).tobytes()) for i in some.tolist()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "batch", "keys", "many"])

    return manifest.repartition(parts, "batch").select("batch").mapInArrow(K.lean(run), "bucket long, batch long, keys binary, many binary")


def _shared_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each batch of a bucket, bits of its anchors: in two documents at least but not hot; hot; and whether any is hot."""
    keys = [_unsix(x) for x in pdf["keys"]]
    size = np.array([len(k) for k in keys])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8))[:n] for x, n in zip(pdf["many"], size, strict=True)]).astype(bool)
    _, inverse, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = times >= 2
    shared[inverse[many]] = True
    ends = np.cumsum(size)
    cut = lambda flag: [np.packbits(flag[e - n : e]).tobytes() for e, n in zip(ends, size, strict=True)]
    hot = times >= HOT_BATCHES
    some = [bool(hot[inverse[e - n : e]].any()) for e, n in zip(ends, size, strict=True)]
    return pd.DataFrame({"batch": pdf["batch"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "shared": cut((shared & ~hot)[inverse]), "hot": cut(hot[inverse]), "any_hot": some})


def _window_hash(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(at), K.U)
    up = K.powers(LENGTH)[0]
    for i in range(LENGTH):
        total += K.byte_values(buf[at + i]) * up[i]
    return K.mix(total + K.U(LENGTH))


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - count - start, count)


def _flagged(pdf: pd.DataFrame, folder: str, buckets: int, name: str) -> tuple[np.ndarray, np.ndarray, Runs, np.ndarray]:
    """Bytes, ids and runs of a batch, and whether the anchor of each run has the flag ``name``."""
    _, buf, offs, ids = read_batch(folder, int(pdf["batch"].iat[0]))
    runs = anchored(buf, offs)
    a, _, bounds = distinct_anchors(runs, ids, buckets)
    flag = np.zeros(len(a), bool)
    for bucket, bits in zip(pdf["bucket"], pdf[name], strict=True):
        rows = slice(bounds[bucket], bounds[bucket + 1])
        flag[rows] = np.unpackbits(np.frombuffer(bits, np.uint8))[: rows.stop - rows.start].astype(bool)
    by = np.argsort(a)
    return buf, ids, runs, flag[by[np.searchsorted(a[by], runs.anchor)]] if len(a) else np.zeros(0, bool)


def _contexts(folder: str, buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buf, ids, runs, shared = _flagged(pdf, folder, buckets, "shared")
        own = np.flatnonzero(shared)
        bucket = (runs.anchor[own] % K.U(buckets)).astype(np.int64)
        order = np.lexsort((runs.context[own], bucket))
        own, bucket = own[order], bucket[order]
        start, count, context, doc = runs.start[own], runs.count[own], runs.context[own], ids[runs.doc[own]]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        pack = zstandard.ZstdCompressor(level=1)
        out = []
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)], strict=True) if len(cut) else ():
            first = np.flatnonzero(np.r_[True, context[s + 1 : e] != context[s : e - 1]])
            which = np.repeat(np.arange(len(first)), np.diff(np.r_[first, e - s]))
            text = buf[_ranges(start[s:e][first], count[s:e][first] + LENGTH - 1)]
            out.append((int(bucket[s]), int(pdf["batch"].iat[0]), pack.compress(pickle.dumps((count[s:e][first].astype(np.uint8), text, which.astype(np.uint32), doc[s:e], start[s:e]), 5))))
        return pd.DataFrame(out, columns=["bucket", "batch", "blob"])

    return run


def _hot_windows(folder: str, buckets: int):
    """The distinct windows of a batch's hot anchors: a row (bucket, batch, hashes and least ids) for each bucket of hashes that
    has any, and one without a bucket, which stays with the batch: the same, and where each window is, by contexts and runs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buf, ids, runs, hot = _flagged(pdf, folder, buckets, "hot")
        number = int(pdf["batch"].iat[0])
        own = np.flatnonzero(hot)
        start, count, doc = runs.start[own], runs.count[own], ids[runs.doc[own]]
        _, one, which = np.unique(runs.context[own], return_index=True, return_inverse=True)
        windows = count[one]
        least = np.full(len(one), _LAST)
        np.minimum.at(least, which, doc)
        at = _ranges(start[one], windows)
        order, fresh = deep_shallow_sort(buf, at)
        first = np.flatnonzero(fresh)
        name = _window_hash(buf, at[order[first]])
        low = np.minimum.reduceat(np.repeat(least, windows)[order], first) if len(first) else least
        distinct = np.empty(len(at), np.uint32)
        distinct[order] = np.cumsum(fresh) - 1
        by = np.lexsort((name, bucket := (name % K.U(buckets)).astype(np.int64)))
        cut = np.flatnonzero(np.r_[True, bucket[by][1:] != bucket[by][:-1]][: len(by)])
        pack = zstandard.ZstdCompressor(level=1)
        blob = lambda *x: pack.compress(pickle.dumps(x, 5))
        out = [(int(bucket[by[s]]), number, blob(name[by[s:e]], low[by[s:e]])) for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(by)], strict=True)] if len(cut) else []
        out.append((None, number, blob(name, low, distinct, windows, which, doc, start)))
        return pd.DataFrame(out, columns=["bucket", "batch", "blob"]).astype({"bucket": "Int64"})

    return run


def _hot_least(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each batch of a bucket of hashes, those that have a lesser id in another batch, and the least of all."""
    pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    got = [pickle.loads(unpack.decompress(x)) for x in pdf["blob"]]
    names, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
    low = np.concatenate([g[1] for g in got])
    least = np.full(len(names), _LAST)
    np.minimum.at(least, inverse, low)
    least, ends = least[inverse], np.cumsum([len(g[0]) for g in got])
    out = []
    for batch, (name, own), e in zip(pdf["batch"].tolist(), got, ends.tolist(), strict=True):
        now = least[e - len(name) : e]
        if (less := now < own).any():
            out.append((batch, pack.compress(pickle.dumps((name[less], now[less]), 5))))
    return pd.DataFrame(out, columns=["batch", "blob"])


def _hot_spans(pdf: pd.DataFrame) -> pd.DataFrame:
    """The removed spans of a batch's hot windows, from what stayed with the batch and the lesser ids of others."""
    unpack = zstandard.ZstdDecompressor()
    load = lambda x: pickle.loads(unpack.decompress(x))
    name, low, distinct, windows, which, doc, start = load(pdf["blob"][pdf["own"]].iat[0])
    low, by = low.copy(), np.argsort(name)
    for found, least in map(load, pdf["blob"][~pdf["own"]]):
        low[by[np.searchsorted(name[by], found)]] = least
    begin, end, _ = _removed(low[distinct], windows, which, doc, start)
    if not len(begin):
        return pd.DataFrame([], columns=["batch", "spans"])
    spans = zstandard.ZstdCompressor(level=1).compress(pickle.dumps((begin.astype(np.uint32), (end - begin).astype(np.uint8)), 5))
    return pd.DataFrame([(int(pdf["batch"].iat[0]), spans)], columns=["batch", "spans"])


class BlindTrie:
    """A Patricia trie over strings of one length: nodes keep branching bytes only, and a string is compared with one leaf."""

    def __init__(self):
        self.root: list | None = None  # a leaf is [string, members], an inner node [depth, {byte: node}, None]

    def add(self, s: bytes, member: int) -> None:
        if self.root is None:
            self.root = [s, [member]]
            return
        path, node = [], self.root
        while len(node) == 3:
            path.append(node)
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        known = node[0]
        if known == s:
            node[1].append(member)
            return
        d = next(i for i, (x, y) in enumerate(zip(known, s, strict=True)) if x != y)
        above = None
        for p in path:
            if p[0] >= d:
                break
            above = p
        below = self.root if above is None else above[1].get(s[above[0]])
        leaf = [s, [member]]
        if below is None:
            above[1][s[above[0]]] = leaf
        elif len(below) == 3 and below[0] == d:
            below[1][s[d]] = leaf
        else:
            split = [d, {known[d]: below, s[d]: leaf}, None]
            if above is None:
                self.root = split
            else:
                above[1][s[above[0]]] = split

    def leaves(self) -> Iterator[list[int]]:
        """The members of each distinct string, in order."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if len(node) == 2:
                yield node[1]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def multikey_quicksort(words: np.ndarray, at: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by ``shallow`` bytes, and where one differs from the one before in them.

    Symbols are of eight bytes. A group is split by up to PIVOTS pivot symbols into the parts below, at and between them; the
    parts at a pivot go on to the next symbol, the others stay at this one. Groups of SMALL suffixes and fewer are finished
    together by plain sorts, symbol by symbol, as an insertion sort would be used.
    """
    n = len(at)
    order, fresh = np.arange(n), np.zeros(n, bool)
    fresh[:1] = True
    open_, small = [(0, n, 0)], []
    while open_:
        begin, size, depth = open_.pop()
        if size <= SMALL:
            small.append((np.array([begin]), np.array([size]), np.array([depth])))
            continue
        part = order[begin : begin + size]
        symbol = words[at[part] + depth].astype(K.U)
        pivots = np.unique(symbol[:: max(1, size // PIVOTS)][:PIVOTS])
        side = np.searchsorted(pivots, symbol)
        side = (2 * side + (pivots[np.minimum(side, len(pivots) - 1)] == symbol)).astype(np.uint16)
        order[begin : begin + size] = part[np.argsort(side, kind="stable")]
        count = np.bincount(side, minlength=2 * len(pivots) + 1)
        start = begin + np.cumsum(count) - count
        fresh[start[count > 0]] = True
        deeper = depth + 8 * (np.arange(len(count)) & 1)
        on = (count > 1) & (deeper < shallow)
        few = on & (count <= SMALL)
        small.append((start[few], count[few], deeper[few]))
        open_ += zip(*(x[on & ~few].tolist() for x in (start, count, deeper)), strict=True)
    begin, size, depth = (np.concatenate(x) for x in zip(*small, strict=True)) if small else [np.zeros(0, np.int64)] * 3
    tied = np.zeros(n, bool)  # slots whose group agrees in all symbols before this one
    for d in range(0, shallow, 8):
        now = depth == d
        tied[_ranges(begin[now], size[now])] = True
        slots = np.flatnonzero(tied)
        if not len(slots):
            continue
        group = np.cumsum(fresh[slots])
        w = words[at[order[slots]] + d].astype(K.U)
        by = np.lexsort((w, group))
        order[slots], w = order[slots][by], w[by]
        same = (w[1:] == w[:-1]) & (group[1:] == group[:-1])
        fresh[slots[1:]] |= ~same
        tied[slots] = np.r_[False, same] | np.r_[same, False]
    return order, fresh


def deep_shallow_sort(text: np.ndarray, at: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first ``length`` bytes, and where a suffix differs from the one before."""
    n = len(at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    padded = np.concatenate([text, np.zeros(length + 8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    order, fresh = multikey_quicksort(words, at, shallow)

    def groups() -> tuple[np.ndarray, np.ndarray]:
        """Slots in groups of two or more, and the group of each."""
        starts = np.flatnonzero(fresh)
        size = np.diff(np.r_[starts, n])
        large = np.repeat(size > 1, size)
        return np.flatnonzero(large), np.repeat(starts, size)[large]

    slots, group = groups()
    if len(slots):  # deep: groups that agree throughout are in order; the others go through a blind trie
        here, head = at[order[slots]], at[order[group]]
        same = np.ones(len(slots), bool)
        for depth in (*range(shallow, length - 8, 8), length - 8):
            same &= words[here + depth] == words[head + depth]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        mixed = ~np.logical_and.reduceat(same, starts)
        ends = np.r_[starts[1:], len(slots)]
        data = text.tobytes()
        for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
            lo = int(slots[s])
            members = order[lo : lo + e - s].tolist()
            trie = BlindTrie()
            for m, p in zip(members, here[s:e].tolist(), strict=True):
                trie.add(data[p + shallow : p + length], m)
            slot = lo
            for leaf in trie.leaves():
                order[slot : slot + len(leaf)] = leaf
                fresh[slot] = True
                slot += len(leaf)
    return order, fresh


def _context_hashes(text: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Hashes of contexts that stand one after the other, from their numbers of windows."""
    end = np.cumsum(count.astype(np.int64) + LENGTH - 1)
    return K.span_hash(K.prefix(K.byte_values(text)), end - (count.astype(np.int64) + LENGTH - 1), end)


def _removed(lowest: np.ndarray, windows: np.ndarray, which: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The removed spans (start, end, run) of runs (context, document, start), from the least id of each window of each context."""
    if not len(which):
        return start, start, which
    first = np.cumsum(windows) - windows
    low, high = np.minimum.reduceat(lowest, first), np.maximum.reduceat(lowest, first)
    full = doc > high[which]
    part = np.flatnonzero(~full & (doc > low[which]))
    long = windows[which[part]]
    hit = lowest[_ranges(first[which[part]], long)] < np.repeat(doc[part], long)
    place = _ranges(start[part], long)[hit]
    begin = np.r_[start[full], place]
    end = np.r_[start[full] + windows[which[full]] + LENGTH - 1, place + LENGTH]
    return begin, end, np.r_[np.flatnonzero(full), np.repeat(part, long)[hit]]


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sort the windows of a bucket's contexts; the removed spans (start, end) of each batch."""
    unpack = zstandard.ZstdDecompressor()
    got = [pickle.loads(unpack.decompress(x)) for x in pdf["blob"]]
    context = np.concatenate([_context_hashes(g[1], g[0]) for g in got])
    count = np.concatenate([g[0] for g in got]).astype(np.int64)
    text = np.concatenate([g[1] for g in got])
    before = np.cumsum([0, *[len(g[0]) for g in got]])
    which = np.concatenate([g[2].astype(np.int64) + b for g, b in zip(got, before, strict=False)])
    doc, start = np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got])
    batch = np.repeat(np.arange(len(got)), [len(g[3]) for g in got])
    _, one, inverse = np.unique(context, return_index=True, return_inverse=True)
    began = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    windows = count[one]
    at = _ranges(began[one], windows)
    of = np.repeat(np.arange(len(one)), windows)
    which = inverse[which]
    least = np.full(len(one), _LAST)
    np.minimum.at(least, which, doc)
    order, fresh = deep_shallow_sort(text, at)
    bounds = np.flatnonzero(fresh)
    lowest = np.empty(len(at), np.int64)
    lowest[order] = np.repeat(np.minimum.reduceat(least[of][order], bounds), np.diff(np.r_[bounds, len(order)]))
    begin, end, run = _removed(lowest, windows, which, doc, start)
    home = batch[run]
    by = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[by], np.arange(len(got) + 1))
    pack = zstandard.ZstdCompressor(level=1)
    numbers = pdf["batch"].tolist()
    out = [(numbers[i], pack.compress(pickle.dumps((begin[by[s:e]].astype(np.uint32), (end - begin)[by[s:e]].astype(np.uint8)), 5))) for i, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)) if e > s]
    return pd.DataFrame(out, columns=["batch", "spans"])


STATS = (("n_bytes", pa.int64(), T.LongType()), ("n_removed", pa.int64(), T.LongType()), ("n_spans", pa.int64(), T.LongType()), ("kept_sha256", pa.string(), T.StringType()))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """record (all columns of ``docs``, the text cut), n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A cut within a character drops what is left of it from the text; the digest is of the remaining bytes as they are.
    """
    spark = docs.sparkSession
    ship_package(spark)
    manifest, folder = spool(docs, id_col, text_col)
    n, total = manifest.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    parts = max(1, min(n, MAX_TASKS))  # given outright: the manifest is small, but each of its rows is a batch of work
    buckets = max(64, (total or 0) // BUCKET_BYTES)
    tasks = min(buckets, MAX_TASKS)
    blobs = anchor_blobs(manifest, folder, buckets, parts).repartition(tasks, "bucket")
    shared = materialise(blobs.groupBy("bucket").applyInPandas(K.lean_group(_shared_anchors), "batch long, bucket long, shared binary, hot binary, any_hot boolean"), "suffix-anchors")
    contexts = shared.select("batch", "bucket", "shared").repartition(parts, "batch").groupBy("batch").applyInPandas(K.lean_group(_contexts(folder, buckets)), "bucket long, batch long, blob binary")
    spans = contexts.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(K.lean_group(_settle), "batch long, spans binary")
    hot = shared.where("any_hot").select("batch", "bucket", "hot").repartition(parts, "batch").groupBy("batch").applyInPandas(K.lean_group(_hot_windows(folder, buckets)), "bucket long, batch long, blob binary")
    hot = materialise(hot, "suffix-hot")
    least = hot.where("bucket is not null").repartition(tasks, "bucket").groupBy("bucket").applyInPandas(K.lean_group(_hot_least), "batch long, blob binary")
    known = hot.where("bucket is null").select("batch", "blob", F.lit(True).alias("own")).unionByName(least.withColumn("own", F.lit(False)))
    everywhere = known.repartition(parts, "batch").groupBy("batch").applyInPandas(K.lean_group(_hot_spans), "batch long, spans binary")
    work = spans.unionByName(everywhere).unionByName(manifest.select("batch", F.lit(None).cast("binary").alias("spans"))).repartition(parts, "batch")
    schema = T.StructType([T.StructField("record", docs.schema), *[T.StructField(name, k) for name, _, k in STATS]])
    names, fields = docs.columns, [(f.name, f.nullable) for f in docs.schema.fields]

    def cut(table: pa.Table) -> pa.Table:
        rows, buf, offs, _ = read_batch(folder, table.column("batch")[0].as_py())
        change = np.zeros(len(buf) + 1, np.int32)
        unpack = zstandard.ZstdDecompressor()
        for x in table.column("spans").to_pylist():
            if x is not None:
                begin, length = pickle.loads(unpack.decompress(x))
                np.add.at(change, begin, 1)
                np.add.at(change, begin.astype(np.int64) + length, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        total = np.zeros(len(gone) + 1, np.int64 if len(gone) >> 31 else np.int32)
        np.cumsum(gone, out=total[1:])
        _, _, span_row = K.runs(gone, offs)
        kept = [buf[a:b][~gone[a:b]].tobytes() if total[b] > total[a] else buf[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        record = rows.column("record").combine_chunks()
        record = record.combine_chunks() if isinstance(record, pa.ChunkedArray) else record
        *others, null = record.flatten()
        text = pa.array([None if none else k.decode(errors="ignore") for k, none in zip(kept, null.to_pylist(), strict=True)], pa.string())
        rest = iter(others)
        values = [text if c == text_col else next(rest) for c in names]
        whole = pa.StructArray.from_arrays(values, fields=[pa.field(c, v.type, can_be_null) for (c, can_be_null), v in zip(fields, values, strict=True)])
        stats = [np.diff(offs), (total[offs[1:]] - total[offs[:-1]]).astype(np.int64), K.counts(span_row, len(kept)), [hashlib.sha256(k).hexdigest() for k in kept]]
        return pa.Table.from_arrays([whole, *[pa.array(x, k) for x, (_, k, _) in zip(stats, STATS, strict=True)]], names=["record", *[name for name, _, _ in STATS]])

    return work.groupBy("batch").applyInArrow(K.lean_group(cut), schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    return dedup(docs.select(id_col, text_col), id_col, text_col).select(F.col("record").getField(id_col).alias(id_col), *[name for name, _, _ in STATS])
