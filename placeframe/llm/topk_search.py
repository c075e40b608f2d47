"""Exact top-k search by inner product: elimination with a pivot table.

Components become whole numbers, floor(scale * x). With M the largest norm, each vector gets one more coordinate
sqrt(M^2 - |x|^2), and a query 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so the nearest in that space has the largest inner
product, and distances to pivots bound it: no pivot p allows x to be nearer than | |q - p| - |x - p| |. The distances of
every row to every pivot are the table. Candidates are evaluated in the order of their greatest lower bound, exactly, until
the next bound says that nothing that is left can enter.

Pivots come from a bounded sample (farthest first); which rows they are decides the work and never the result. Each query
begins with the k-th best score within that sample, which any part of the candidates may be held against. Rows are dealt to
blocks of candidates of even size; every query visits every block, in a stream of rows sorted by block, and the best of all
blocks are ranked. Memory is one block and one Arrow batch.

A row takes no part if its vector is null or holds a null or non-finite component; an empty vector has score 0 with all, and
shorter vectors count as filled up with zeros. A query is a row, and its candidates are all other rows, so rows that repeat an
id are queries each and find each other. Rows without an id are no queries; as candidates they come after equal scores with
one. Rows with equal score and id come in any order. Scores must fit 64 bits, components 62 after scaling (else an error). An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeframe.llm import tokens as K
from placeframe.session import materialise, ship_package

#: Rows that pivots are chosen from and that give each query its first threshold; pivots; candidates of a block on average.
SAMPLE, PIVOTS, BLOCK_ROWS = 2048, 32, 4096
#: Candidates evaluated before the bound is looked at again; doubled each time.
FIRST_LOOK = 64
_NO_ID = np.iinfo(np.int64).max
_NO_SCORE = np.iinfo(np.int64).min


def scaled(vectors: pa.Array, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows take part, and floor(scale * x) of those."""
    rows, out = [], []
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offs = vectors.offsets.to_numpy()
    flat = vectors.values
    null = np.asarray(flat.is_null())
    x = np.floor(flat.cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
    bad = np.r_[0, np.cumsum(null | ~np.isfinite(x))]
    there = np.asarray(vectors.is_valid())
    for i in np.flatnonzero(there):
        a, b = offs[i], offs[i + 1]
        if bad[a] == bad[b]:
            if b > a and np.abs(x[a:b]).max() >= 2.0**62:
                raise ValueError("a component is too large for whole numbers of 64 bits")
            rows.append(i)
            out.append(x[a:b].astype(np.int64))
    return np.array(rows, np.int64), out


def stack(packed: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows of a matrix, filled up with zeros."""
    out = np.zeros((len(packed), width), np.int64)
    for k, p in enumerate(packed):
        v = np.frombuffer(p, np.int64)
        out[k, : len(v)] = v
    return out


@dataclass
class Space:
    """What all tasks know: the pivots, the sample, the largest squared norm and the number of components."""

    width: int
    largest: float
    pivots: np.ndarray
    sample: np.ndarray
    sample_rows: np.ndarray
    k: int

    @property
    def exact_in_doubles(self) -> bool:
        """No partial sum of an inner product exceeds the largest squared norm."""
        return self.largest < 2.0**52

    def products(self, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact_in_doubles:
            return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        return v @ q

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.largest - (v.astype(np.float64) ** 2).sum(1), 0.0))

    def distances(self, v: np.ndarray, query: bool) -> np.ndarray:
        """(rows, pivots): distances in the lifted space, of candidates or of queries."""
        f, p = v.astype(np.float64), self.pivots.astype(np.float64)
        inner = f @ p.T
        if query:
            square = (f**2).sum(1)[:, None] + self.largest - 2 * inner
        else:
            square = 2 * (self.largest - inner - self.lift(v)[:, None] * self.lift(self.pivots)[None, :])
        return np.sqrt(np.maximum(square, 0.0)).astype(np.float32)

    @property
    def slack(self) -> float:
        """More than the rounding of two distances as floats can amount to."""
        return 2.0 * np.sqrt(self.largest) * 2.0**-20 + 1e-3

    def radius(self, q_square: float, score: int) -> float:
        """What is farther than this has a smaller score; rounding included."""
        if score == _NO_SCORE:
            return np.inf
        square = q_square + self.largest - 2.0 * score
        return float(np.sqrt(max(square, 0.0) + (q_square + self.largest + 2.0 * abs(score)) * 1e-12) + self.slack)

    def first_score(self, q: np.ndarray, row: int) -> int:
        """The k-th best score among the rows of the sample; there is nothing to hold against a query with fewer."""
        s = self.products(self.sample, q)[self.sample_rows != row]
        return int(np.partition(s, len(s) - self.k)[len(s) - self.k]) if len(s) >= self.k else _NO_SCORE


def farthest_first(sample: np.ndarray, lifted: np.ndarray, n: int) -> np.ndarray:
    """Indices of up to n rows, each as far as possible from those before."""
    x = np.c_[sample.astype(np.float64), lifted]
    picked, away = [], np.full(len(x), np.inf)
    at = 0
    while len(picked) < min(n, len(x)) and away[at] > 0:
        picked.append(at)
        away = np.minimum(away, ((x - x[at]) ** 2).sum(1))
        at = int(away.argmax())
    return np.array(picked, np.int64)


class Block:
    """One block of candidates and its part of the pivot table."""

    def __init__(self, space: Space, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, table: np.ndarray):
        self.space, self.rows, self.ids, self.v = space, rows, ids, v
        self.table = np.ascontiguousarray(table.T)
        self.evaluated = 0

    def search(self, q: np.ndarray, to_pivots: np.ndarray, row: int, first_score: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices and scores of the k best other rows here, or of those that can be among the k best of all rows."""
        space, k = self.space, self.space.k
        q_square = float((q.astype(np.float64) ** 2).sum())
        bound = np.abs(self.table - to_pivots[:, None]).max(0)
        score, limit = first_score, space.radius(q_square, first_score)
        left = np.flatnonzero(bound <= limit)
        left = left[np.argsort(bound[left], kind="stable")]
        best, scores, at, look = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST_LOOK
        while at < len(left) and bound[left[at]] <= limit:
            some = left[at : at + look]
            some = some[self.rows[some] != row]
            self.evaluated += len(some)
            best, scores = np.r_[best, some], np.r_[scores, space.products(self.v[some], q)]
            order = np.lexsort((self.rows[best], self.ids[best], -scores))[:k]
            best, scores = best[order], scores[order]
            if len(best) == k and scores[-1] > score:
                score = int(scores[-1])
                limit = space.radius(q_square, score)
            at, look = at + look, 2 * look
        stays = scores >= first_score
        return best[stays], scores[stays]


def _visits(space: Space, packed_floats: int):
    """Function of Arrow batches sorted by block, candidates before queries: (query row, its id, row, id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for b in batches:
            blocks, kinds = b.column("block").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1]), True]) if len(b) else []
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                if blocks[a] != now:
                    now, parts, block = blocks[a], [], None
                part = b.slice(a, e - a)
                rows = part.column("row").to_numpy()
                ids = part.column("id").fill_null(_NO_ID).to_numpy()
                v = stack(part.column("v").to_pylist(), space.width)
                table = np.frombuffer(b"".join(part.column("distances" if not kinds[a] else "query_distances").to_pylist()), np.float32).reshape(len(part), packed_floats)
                if not kinds[a]:
                    parts.append((rows, ids, v, table))
                    continue
                if block is None:
                    if not parts:
                        continue
                    block = Block(space, *(np.concatenate(x) for x in zip(*parts, strict=True)))
                    parts = []
                firsts = part.column("first_score").to_numpy()
                found = [block.search(v[k], table[k], rows[k], firsts[k]) for k in range(len(part))]
                times = np.array([len(x) for x, _ in found])
                best, scores = np.concatenate([x for x, _ in found]), np.concatenate([s for _, s in found])
                hit = block.ids[best]
                columns = [pa.array(rows.repeat(times)), pa.array(ids.repeat(times)), pa.array(block.rows[best]), pa.array(hit, mask=hit == _NO_ID), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=["query_row", "query_id", "row", "vec_id", "score"])

    return run


def search(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k best other rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship_package(spark)
    narrow = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = scaled(b.column(2), scale)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([len(x) for x in v], pa.int32()), pa.array([float((x.astype(np.float64) ** 2).sum()) for x in v], pa.float64())],
                names=["row", "id", "v", "n", "square"],
            )

    rows = materialise(narrow.mapInArrow(K.lean(whole), "row long, id long, v binary, n int, square double"), "topk-vectors")
    total, width, largest = rows.agg(F.count(F.lit(1)), F.max("n"), F.max("square")).first()
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("row", "v").toArrow()
    v = stack(sample.column("v").to_pylist(), width or 0)
    space = Space(width or 0, largest or 0.0, v[:0], v, sample.column("row").to_numpy(), k)
    space.pivots = v[farthest_first(v, space.lift(v), pivots)]
    n_pivots = len(space.pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = stack(b.column("v").to_pylist(), space.width)
            own = space.distances(x, query=False)
            far, first = [None] * len(b), np.zeros(len(b), np.int64)
            at = np.flatnonzero(np.asarray(b.column("id").is_valid()) & (b.column("id").fill_null(0).to_numpy() % every == 0))
            if len(at):
                d, numbers = space.distances(x[at], query=True), b.column("row").to_numpy()
                for i, j in enumerate(at):
                    far[j], first[j] = d[i].tobytes(), space.first_score(x[j], numbers[j])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), b.column("v"), pa.array([d.tobytes() for d in own], pa.binary()), pa.array(far, pa.binary()), pa.array(first)], names=["row", "id", "v", "distances", "query_distances", "first_score"])

    blocks = max(1, -(-total // block_rows))
    asks = F.col("query_distances").isNotNull()
    visit = lambda block, kind: F.struct(block.cast("long").alias("block"), F.lit(kind).alias("kind"))
    home = F.array(visit(F.pmod(F.xxhash64("row"), F.lit(blocks)), 0))
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda n: visit(n, 1))
    measured = rows.mapInArrow(K.lean(measure), "row long, id long, v binary, distances binary, query_distances binary, first_score long")
    visits = measured.select("*", F.explode(F.when(asks, F.concat(home, everywhere)).otherwise(home)).alias("to"))
    # Only what that kind of visit needs travels.
    visits = visits.select("to.block", "to.kind", "row", "id", "v", F.when(F.col("to.kind") == 0, F.col("distances")).alias("distances"), F.when(F.col("to.kind") == 1, F.col("query_distances")).alias("query_distances"), "first_score")
    met = visits.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(K.lean(_visits(space, n_pivots)), "query_row long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
