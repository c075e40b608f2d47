"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file, once, into arrays that tasks only read:

* the normaliser, whose state is the class of the last character (start of the text, blank, other): it writes the dummy
  prefix, turns blanks to U+2581 and squeezes them where the model says so;
* the pieces, a trie from characters to pieces closed under concatenation, with a fallback arc to the character's bytes for
  every character that is no piece;
* the merge acceptor, whose state is the last piece.

Each input is composed with them: the lattice of an input has its characters' boundaries as states and an arc for every
piece that fits. Weights are of the tropical semiring (a path weighs the sum of its arcs, the least path wins).

* Unigram models: an arc weighs minus its piece's score, and the merge acceptor accepts everything.
* BPE models: the acceptor's arc from piece u to piece t has weight one of the semiring (0) if merging the characters of ut
  ends in u and t again, and zero (infinity) otherwise. A sequence all of whose neighbours agree so is what merging the
  whole input gives, and only one does: were some merge across a boundary the first such, all merges before it lie within
  pieces, and merging that pair of pieces alone would take it too. So each boundary has one last piece of finite weight, the
  path is unique, and it equals the library's own encoding.

A normalised text is cut between any two characters that no piece holds side by side, as no arc can cross there. The
distinct strings between cuts of a chunk of texts are composed and relaxed together, position by position, as arrays.
Nothing is kept from chunk to chunk but a table of arcs of the acceptor, of a fixed number of bytes.

A null text has null ids and null counts. An empty text has no ids. Repeated rows have equal ids; long texts and long runs
without blanks are encoded whole, in time that is linear in their length. Extra columns are ignored. Models with character
maps, user-defined or unused pieces, or without byte fallback are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeframe.llm import tokens as K
from placeframe.session import ship_package

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Text bytes that are encoded together, and characters whose lattice is held at once.
CHUNK, LATTICE = 1 << 19, 1 << 16
#: Entries (nine bytes each) of the table of known arcs of the merge acceptor.
KNOWN_ARCS = 1 << 20
_INF = np.float64(np.inf)


@dataclass
class Vocabulary:
    """What is read from a model file."""

    pieces: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    surface: list[bytes]  # of each id; empty for control pieces
    unigram: bool
    dummy_prefix: bool
    squeeze: bool
    escape: bool


def load(path: str = MODEL_PATH) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    kinds = pb.ModelProto.SentencePiece
    if model.normalizer_spec.precompiled_charsmap or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError("character maps, user-defined and unused pieces are not supported")
    if model.trainer_spec.model_type not in (pb.TrainerSpec.UNIGRAM, pb.TrainerSpec.BPE) or not model.trainer_spec.byte_fallback:
        raise ValueError("a unigram or BPE model with byte fallback is needed")
    pieces, scores, byte_ids, surface = {}, {}, [0] * 256, []
    for i, p in enumerate(model.pieces):
        if p.type == kinds.NORMAL:
            pieces[p.piece], scores[p.piece] = i, p.score
            surface.append(p.piece.replace(BLANK, " ").encode())
        elif p.type == kinds.BYTE:
            byte_ids[int(p.piece[1:-1], 16)] = i
            surface.append(bytes([int(p.piece[1:-1], 16)]))
        else:
            surface.append(" ⁇ ".encode() if p.type == kinds.UNKNOWN else b"")
    n = model.normalizer_spec
    return Vocabulary(pieces, scores, byte_ids, surface, model.trainer_spec.model_type == pb.TrainerSpec.UNIGRAM, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces)


@dataclass
class Normaliser:
    """emit[state, symbol]: what goes before the symbol (0 nothing, 1 a blank), and whether the symbol itself is written.

    States and symbols: 0 the start, 1 a blank, 2 any other character. The state is the class of the symbol before, so a
    whole column of texts is run at once.
    """

    blank: int
    before: np.ndarray
    itself: np.ndarray

    def run(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points and row starts of the normalised texts."""
        if not len(points):
            return points, np.zeros(len(starts), np.int64)
        symbol = np.where(points == 32, 1, 2)
        state = np.r_[0, symbol[:-1]]
        state[starts[:-1][starts[1:] > starts[:-1]]] = 0
        if not self.itself[1, 1]:  # squeezing: blanks at the start of a text leave it in the start state
            solid = np.maximum.accumulate(np.where(symbol == 2, np.arange(len(points)), -1))
            first = np.repeat(starts[:-1], np.diff(starts))
            state[(np.r_[-1, solid[:-1]] < first) & (state == 1)] = 0
        out = 1 * self.before[state, symbol] + self.itself[state, symbol]
        ends = np.cumsum(out)
        result = np.full(int(ends[-1]), self.blank, np.uint32)
        own = self.itself[state, symbol] == 1
        result[ends[own] - 1] = np.where(symbol == 1, self.blank, points)[own]
        return result, np.r_[0, ends][starts]


@dataclass
class Machine:
    """The compiled transducers as arrays. Symbols: the model's ids, then characters without a piece, then ``other``."""

    normaliser: Normaliser
    prefix: bool
    code: np.ndarray  # of each code point; 0 for those no piece holds
    kind: np.ndarray  # of each code: its row in ``joins``
    joins: np.ndarray  # whether some piece holds two characters side by side
    single: np.ndarray  # symbol of each code
    root: np.ndarray  # trie node of each code
    arcs: np.ndarray  # hash table of trie arcs: node * 65536 + code
    target: np.ndarray
    final: np.ndarray  # symbol of each node, or -1
    depth: int
    cost: np.ndarray  # arc weight of each symbol
    merges: tuple[np.ndarray, ...] | None  # of the merge acceptor; None where it accepts everything
    n_ids: int
    byte_ids: np.ndarray
    surface: np.ndarray
    surface_at: np.ndarray


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (K.mix(keys.astype(K.U)) & K.U(size - 1)).astype(np.int64)


def _history(symbols: tuple[str, ...], scores: dict[str, float]) -> tuple[bool, list[tuple[float, str, str]]]:
    """Whether the characters merge into one piece; before each merge, its score and the first and last symbols."""
    parts, steps = list(symbols), []
    while True:
        best, at = -_INF, -1
        for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
            s = scores.get(a + b)
            if s is not None and s > best:
                best, at = s, i
        steps.append((best, parts[0], parts[-1]))
        if at < 0:
            return len(parts) == 1, steps
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


def build(v: Vocabulary) -> Machine:
    """Compile the three machines."""
    chars = sorted({c for p in v.pieces for c in p})
    code_of = {c: i + 1 for i, c in enumerate(chars)}
    code = np.zeros(0x110000, np.uint16)
    code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    long = [p for p in v.pieces if len(p) > 1]
    within = sorted({c for p in long for c in p})
    kind = np.zeros(len(chars) + 1, np.int16)
    kind[[code_of[c] for c in within]] = np.arange(1, len(within) + 1)
    joins = np.zeros((len(within) + 1, len(within) + 1), bool)
    for p in long:
        k = [kind[code_of[c]] for c in p]
        joins[k[:-1], k[1:]] = True
    n = len(v.surface)
    symbol = dict(v.pieces)
    for c in chars:
        symbol.setdefault(c, n + len(symbol) - len(v.pieces))
    other = n + len(symbol) - len(v.pieces)
    single = np.array([other, *[symbol[c] for c in chars]], np.int32)
    stories = None if v.unigram else {p: _history(tuple(p), v.scores) for p in symbol}
    nodes: dict[str, int] = {}
    for p in v.pieces:
        if stories is None or stories[p][0]:  # a piece that merging never gives is on no path
            for i in range(1, len(p) + 1):
                nodes.setdefault(p[:i], len(nodes))
    for c in chars:
        nodes.setdefault(c, len(nodes))
    final = np.full(len(nodes), -1, np.int32)
    for p, k in nodes.items():
        if p in v.pieces and (stories is None or stories[p][0]):
            final[k] = v.pieces[p]
    size = 1 << (2 * len(nodes)).bit_length()
    arcs, target = np.full(size, -1, np.int64), np.zeros(size, np.int32)
    for p, k in nodes.items():
        if len(p) > 1:
            key = nodes[p[:-1]] * 65536 + code_of[p[-1]]
            at = int(_slot(np.array([key]), size)[0])
            while arcs[at] >= 0:
                at = (at + 1) % size
            arcs[at], target[at] = key, k
    cost = np.zeros(other + 1)
    merges = None
    if v.unigram:
        worst = min(v.scores.values(), default=0.0) - 10
        cost[n:] = -worst
        cost[list(v.pieces.values())] = [-v.scores[p] for p in v.pieces]
    else:
        by_id = sorted((k, p) for p, k in symbol.items())
        length, steps = np.zeros(other + 1, np.int64), []
        for k, p in by_id:
            length[k] = len(stories[p][1])
            steps += [(s, symbol[a], symbol[b]) for s, a, b in stories[p][1]]
        pairs = {(symbol[p[:i]], symbol[p[i:]]): v.scores[p] for p in long for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol}
        keys = np.array([a * (other + 1) + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        merges = (np.cumsum(length) - length, *(np.array(x, k) for x, k in zip(zip(*steps, strict=True), (float, np.int32, np.int32), strict=True)), keys[order], np.array(list(pairs.values()), float)[order])
    before, itself = np.zeros((3, 3), np.int64), np.ones((3, 3), np.int64)
    before[0] = int(v.dummy_prefix)
    if v.squeeze:
        itself[:, 1], before[:, 1], before[1, 2] = 0, 0, 1
    ends = np.cumsum([0, *map(len, v.surface)])
    return Machine(
        Normaliser(ord(BLANK) if v.escape else 32, before, itself), v.dummy_prefix, code, kind, joins, single, np.array([0, *[nodes[c] for c in chars]], np.int32),
        arcs, target, final, max(map(len, v.pieces), default=1), cost, merges, n, np.array(v.byte_ids, np.int32), np.frombuffer(b"".join(v.surface), np.uint8), ends,
    )


@lru_cache(maxsize=2)
def machine(path: str = MODEL_PATH) -> Machine:
    return build(load(path))


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every entry, count of each."""
    total = np.cumsum(count)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - count - start, count)


class Encoder:
    """Runs a machine over columns of texts."""

    def __init__(self, m: Machine):
        self.m = m
        self.known = np.full(KNOWN_ARCS if m.merges else 0, -1, np.int64)
        self.crosses = np.zeros(len(self.known), bool)

    def child(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The trie's arcs; -1 where there is none."""
        m, key = self.m, node.astype(np.int64) * 65536 + code
        at = _slot(key, len(m.arcs))
        out = np.full(len(key), -1, np.int32)
        rest = np.arange(len(key))
        while len(rest):
            got = m.arcs[at]
            hit = got == key
            out[rest[hit]] = m.target[at[hit]]
            more = ~hit & (got >= 0)
            rest, key, at = rest[more], key[more], (at[more] + 1) % len(m.arcs)
        return out

    def compose(self, code: np.ndarray, left: np.ndarray) -> list[np.ndarray]:
        """The lattice: for each length, the symbol of the arc that leaves each boundary (-1: none).

        left: characters from here to the end of the string.
        """
        m = self.m
        out = [m.single[code]]
        at, node = np.arange(len(code)), m.root[code]
        for d in range(1, m.depth):
            on = left[at] > d
            at, node = at[on], node[on]
            node = self.child(node, code[at + d])
            on = node >= 0
            at, node = at[on], node[on]
            if not len(at):
                break
            arc = np.full(len(code), -1, np.int32)
            arc[at] = m.final[node]
            out.append(arc)
        return out

    def accepts(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the merge acceptor has an arc of finite weight from u to t, by the table of known arcs where it can."""
        key = u.astype(np.int64) * len(self.m.cost) + t
        at = _slot(key, len(self.known))
        new = self.known[at] != key
        out = ~self.crosses[at]
        if new.any():
            fresh, inverse = np.unique(key[new], return_inverse=True)
            cross = self.merged(fresh // len(self.m.cost), fresh % len(self.m.cost))
            out[new] = ~cross[inverse]
            slot = _slot(fresh, len(self.known))
            self.known[slot], self.crosses[slot] = fresh, cross
            wrong = self.known[slot] != fresh  # two new arcs of one slot: the last stays, with its own value
            if wrong.any():
                last = np.flatnonzero(~wrong)
                self.crosses[slot[last]] = cross[last]
        return out

    def merged(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether merging the characters of ut has a merge across the boundary.

        The merges within u and within t are each known; the one with the better score comes next, unless a merge across
        the boundary is better still (at equal scores the leftmost is first).
        """
        first, score, begins, ends, keys, scores = self.m.merges
        out = np.zeros(len(u), bool)
        i, j, rest = first[u], first[t], np.arange(len(u))
        while len(rest):
            a, b = score[i], score[j]
            key = ends[i].astype(np.int64) * len(self.m.cost) + begins[j]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            across = np.where(keys[at] == key, scores[at], -_INF)
            cross = (across > a) & (across >= b)
            out[rest[cross]] = True
            on = ~cross & ((a > -_INF) | (b > -_INF))
            step = (a >= b)[on]
            rest, i, j = rest[on], i[on] + step, j[on] + ~step
        return out

    def shortest(self, lattice: list[np.ndarray], start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tropical shortest paths of strings that stand one after the other, longest first: last arc's symbol and length at each end.

        Boundaries are relaxed in order, those of all strings at once; the acceptor is asked for arcs that would improve.
        """
        m, n = self.m, int(length.sum())
        weight, symbol, span = np.zeros(n), np.full(n, -1, np.int32), np.zeros(n, np.int32)
        counts = np.searchsorted(-length, -np.arange(1, int(length[0]) + 1), "right")
        for k, active in enumerate(counts.tolist(), 1):
            end = start[:active] + k
            best = np.full(active, _INF)
            for d in range(min(k, len(lattice)), 0, -1):
                arc = lattice[d - 1][end - d]
                before = weight[end - d - 1] if k > d else 0.0
                trial = before + m.cost[arc]
                on = np.flatnonzero((arc >= 0) & (trial < best))
                if k > d and m.merges and len(on):
                    on = on[self.accepts(symbol[end[on] - d - 1], arc[on])]
                if len(on):
                    at = end[on] - 1
                    best[on], symbol[at], span[at] = trial[on], arc[on], d
            if np.isinf(best).any():
                raise AssertionError("a boundary without a path")
            weight[end - 1] = best
        return symbol, span

    def strings(self, points: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of strings that stand one after the other, and how many each has."""
        m = self.m
        order = np.argsort(-length, kind="stable")
        begin = np.cumsum(length) - length
        size = length[order]
        points = points[ranges(begin[order], size)]
        start = np.cumsum(size) - size
        code = m.code[points]
        symbol, span = self.shortest(self.compose(code, np.repeat(start + size, size) - np.arange(len(code))), start, size)
        at, own, ends, which = start + size, np.arange(len(size)), [], []
        while len(at):  # back along the paths
            ends.append(at - 1)
            which.append(own)
            at = at - span[at - 1]
            on = at > start[own]
            at, own = at[on], own[on]
        ends, which = np.concatenate(ends), np.concatenate(which)
        by = np.lexsort((ends, order[which]))
        ends, which = ends[by], order[which[by]]
        ids = symbol[ends]
        bare = np.flatnonzero(ids >= m.n_ids)  # fallback: single characters
        if len(bare):
            p = points[ends[bare]]
            utf8 = np.frombuffer(p.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            width = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
            many = np.ones(len(ids), np.int64)
            many[bare] = width
            out = np.repeat(ids, many)
            out[ranges((np.cumsum(many) - many)[bare], width)] = m.byte_ids[utf8]
            ids, which = out, np.repeat(which, many)
        return ids, np.bincount(which, minlength=len(length))

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a chunk of UTF-8 texts, and their row offsets."""
        m = self.m
        points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
        at = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)][offs]
        points, at = m.normaliser.run(points, at)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        kind = m.kind[m.code[points]]
        cut = np.r_[True, ~m.joins[kind[:-1], kind[1:]]]
        cut[at[:-1][at[1:] > at[:-1]]] = True
        start = np.flatnonzero(cut)
        edge = pa.array(4 * np.r_[start, len(points)])
        found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, edge.buffers()[1], pa.py_buffer(points.astype("<u4").tobytes())]).dictionary_encode()
        which, distinct = found.indices.to_numpy(), found.dictionary
        bounds = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1] // 4
        own = np.frombuffer(distinct.buffers()[2], "<u4")
        ids, counts, a = [], [], 0
        while a < len(distinct):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + LATTICE, "right")) - 1)
            i, c = self.strings(own[bounds[a] : bounds[b]], np.diff(bounds[a : b + 1]))
            ids.append(i)
            counts.append(c)
            a = b
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        first, many = (np.cumsum(counts) - counts)[which], counts[which]
        total = np.r_[0, np.cumsum(many)]
        return ids[ranges(first, many)], total[np.searchsorted(start, at)]

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inverse transducer: surfaces of the ids of all rows, without the dummy prefix; bytes and row offsets."""
        m = self.m
        width = np.diff(m.surface_at)[ids]
        out = m.surface[ranges(m.surface_at[ids], width)]
        ends = np.r_[0, np.cumsum(width)][offs]
        if m.prefix:
            head = ends[:-1][ends[1:] > ends[:-1]]
            head = head[out[head] == 32]
            gone = np.zeros(len(out) + 1, np.int64)
            gone[head + 1] = 1
            out, ends = np.delete(out, head), ends - np.cumsum(gone)[ends]
        return out, ends


def _chunked(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    yield from K.chunks(column, CHUNK)


def encode(docs: DataFrame, path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_byte_tokens, round_trip and ids of every row. round_trip: decoding gives the text back."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(machine(path))  # some megabytes, by the model file and not by the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        is_byte = np.zeros(shared.value.n_ids, bool)
        is_byte[shared.value.byte_ids] = True
        for b in batches:
            for first, buf, offs in _chunked(b.column(1)):
                n = len(offs) - 1
                null = b.column(1).slice(first, n).is_null().to_numpy(zero_copy_only=False)
                ids, at = encoder.encode(buf, offs)
                back, ends = encoder.decode(ids, at)
                same = ~null
                if not np.array_equal(ends, offs) or not np.array_equal(back, buf):
                    same &= [back[a:z].tobytes() == buf[c:d].tobytes() for a, z, c, d in zip(ends[:-1].tolist(), ends[1:].tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                fall = np.diff(np.r_[0, np.cumsum(is_byte[ids])][at])
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), pa.array(np.diff(at).astype(np.int32), mask=null), pa.array(fall.astype(np.int32), mask=null), pa.array(same), lists], names=[id_col, "n_tokens", "n_byte_tokens", "round_trip", "ids"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.IntegerType()), T.StructField("n_byte_tokens", T.IntegerType()), T.StructField("round_trip", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id_col), F.col(text_col).alias("__t")).mapInArrow(K.lean(run), schema)


def decode(encoded: DataFrame, path: str = MODEL_PATH, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; bytes that are no UTF-8 become U+FFFD."""
    spark = encoded.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(machine(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in batches:
            lists = b.column(1)
            null = lists.is_null().to_numpy(zero_copy_only=False)
            at = np.r_[0, np.cumsum(np.where(null, 0, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))].astype(np.int64)
            out, ends = encoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), at)
            texts = [None if gone else out[a:z].tobytes().decode(errors="replace") for a, z, gone in zip(ends[:-1].tolist(), ends[1:].tolist(), null.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    schema = T.StructType([T.StructField(id_col, encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(id_col, ids_col).mapInArrow(K.lean(run), schema)
