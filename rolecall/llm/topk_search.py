"""Exact best inner products by a pivot-distance index.

Vectors are scaled to whole numbers, floor(256 * x). A bounded sample of them serves as
pivots; every vector is keyed by its nearest pivot and its distance to it, and the index
is range-partitioned and sorted by that key, so rows of one pivot form annuli of
growing distance, and a common vector is spread over tasks by its ids.

For a query q and an annulus between distances a and b around pivot p, the triangle
inequality gives |q - x| >= max(|q - p| - b, a - |q - p|, 0) for all x in it, and with
q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 an upper bound of the score; |q| |x| is another.

1. Home: where a query stands in the index, the rows around it give it k candidates, and
   the worst of them a score to beat. This is one pass over the index, without a shuffle.
2. The score to beat and the bounds give, for each query and pivot, the only range of
   distances that can matter. Queries go to the index in blocks of ``block`` rows that
   stand next to each other in it, each a broadcast of fixed size, and a block reads the
   ranges that any of its queries needs; the index's files skip the rest.
3. A task expands each query's annuli from the likeliest on, and the query stops there
   as soon as the next bound is below its score to beat, which grows meanwhile. Equal
   scores are searched, since ties go to the smaller id.

How much this saves is a matter of the vectors. Where they form groups, most pairs are
never scored; where all directions are alike, all vectors are about as far from any
pivot, no bound of this kind can tell them apart, and nearly every pair is scored.

Defined results: vectors that are null, or hold null, NaN or an infinity, take no part,
nor do rows without id; a missing component counts as 0; a row is no candidate for a
query of its own id, and rows that share an id ask one query; scores beyond 64 bits
raise an error; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rolecall.llm.scratch import written

SCALE = 256
ANNULUS = 256  # rows of one annulus
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1
_NONE = -_LONG  # no score
_SLACK = 4e-6  # of a sum of squares: more than rounding can move a bound
INDEX = "pivot long, distance double, id long, square double, vec binary"
FOUND = "query_id long, vec_id long, score long"
RANKED = "query_id long, rank int, vec_id long, score long"


def _usable(vector: Column) -> Column:
    finite = F.forall(
        vector,
        lambda x: x.isNotNull()
        & ~F.isnan(x)
        & (F.abs(x.cast("double")) < F.lit(float("inf"))),
    )
    return vector.isNotNull() & finite


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    """Scaled vectors as rows of whole numbers in doubles; short ones end in zeros."""
    sizes = values.value_lengths().to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = np.floor(SCALE * flat)
    return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products; as Python integers where doubles could round."""
    most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0)
    if most * queries.shape[1] < _EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = [np.array([[int(x) for x in r] for r in m], object) for m in (queries, rows)]
    product = whole[0] @ whole[1].T
    if product.size and not _NONE < product.min() <= product.max() <= _LONG:
        raise OverflowError("scores don't fit in 64 bits")
    return product.astype(np.int64)


class Queries:
    """One block of queries, its distances to the pivots, and scores to be beaten."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, pivots, k: int, to_beat=None):
        self.ids, self.rows, self.k = ids, rows, k
        self.squares = (rows**2).sum(axis=1)
        self.distances = distances(rows, pivots)
        self.to_beat = np.full(len(ids), _NONE) if to_beat is None else to_beat

    def bounds(self, pivot, low, high, most) -> np.ndarray:
        """No score of a query (column) with a row of an annulus (row) is over this.

        An annulus has its distances from ``low`` to ``high`` around ``pivot``, and
        squares of at most ``most``.
        """
        apart = self.distances[:, pivot].T
        gap = np.maximum(np.maximum(apart - high[:, None], low[:, None] - apart), 0)
        squares = self.squares + most[:, None]
        plain = np.sqrt(self.squares * most[:, None])
        bound = np.minimum((squares - gap**2) / 2, plain) + _SLACK * squares + 1
        # Beyond the range of doubles nothing is known.
        return np.where(np.isnan(bound), np.inf, bound)

    def ranges(self, most: np.ndarray) -> list[tuple[int, float, float]]:
        """pivot, least and greatest distance of all rows that some query may need.

        ``most`` is the greatest square of a row under each pivot, -1 if it has none.
        """
        found = []
        for pivot in np.flatnonzero(~(most < 0)).tolist():
            squares = self.squares + most[pivot]
            slack = 2 * _SLACK * squares + 2
            # From (squares - gap^2) / 2 + slack / 2 >= to_beat, and the plain bound.
            room = squares + slack - 2.0 * self.to_beat
            plain = np.sqrt(self.squares * most[pivot]) + slack / 2
            needs = ~(room < 0) & ~(plain < self.to_beat)
            if not needs.any():
                continue
            apart, reach = self.distances[needs, pivot], np.sqrt(room[needs])
            low, high = (apart - reach).min(), (apart + reach).max()
            if np.isnan(low) or np.isnan(high):
                low, high = -np.inf, np.inf
            found.append((pivot, float(low), float(high)))
        return found


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    apart = (rows**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(np.where(np.isnan(apart), np.inf, apart), 0))


def _index(vectors: DataFrame, width: int, pivots: np.ndarray) -> DataFrame:
    """pivot, distance, id, square, vec (doubles as bytes), sorted; written."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                rows = _matrix(part.column(1), width)
                far = distances(rows, pivots)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(far.argmin(axis=1)),
                        pa.array(far.min(axis=1)),
                        part.column(0),
                        pa.array((rows**2).sum(axis=1)),
                        pa.array([row.tobytes() for row in rows], pa.binary()),
                    ],
                    names=["pivot", "distance", "id", "square", "vec"],
                )

    order = ["pivot", "distance", "id"]
    rows = vectors.mapInArrow(key, INDEX)
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order), "index")


class Best:
    """The k best candidates of every query so far, by score, then smaller id.

    ``scored`` counts the pairs of a query and a row whose score was taken.
    """

    def __init__(self, asked: Queries):
        shape = (len(asked.ids), asked.k)
        self.asked, self.to_beat = asked, asked.to_beat.copy()
        self.scores = np.full(shape, _NONE)
        self.ids = np.full(shape, _LONG)
        self.scored = 0

    def search(self, pivot, distance, ids, squares, rows) -> None:
        """All rows of a sorted batch: each query's annuli, the likeliest first."""
        ends = np.flatnonzero(np.diff(pivot)) + 1
        cuts = sorted({0, len(ids), *ends.tolist(), *range(0, len(ids), ANNULUS)})
        cuts = np.array(cuts)
        first, last = cuts[:-1], cuts[1:] - 1
        most = np.maximum.reduceat(squares, first)
        bounds = self.asked.bounds(pivot[first], distance[first], distance[last], most)
        order = np.argsort(-bounds, axis=0, kind="stable")
        bounds = np.take_along_axis(bounds, order, 0)
        done, step = 0, 1
        while done < len(first):
            # Bounds fall, so a query whose next one is too low has stopped for good.
            likely = bounds[done : done + step] >= self.to_beat
            if not likely.any():
                return
            annulus = np.where(likely, order[done : done + step], -1)
            for i in np.unique(annulus[likely]).tolist():
                active = np.flatnonzero((annulus == i).any(axis=0))
                part = slice(cuts[i], cuts[i + 1])
                self._annulus(active, ids[part], rows[part])
            done, step = done + step, 2 * step

    def _annulus(self, active, ids, rows) -> None:
        found = scores(self.asked.rows[active], rows)
        self.scored += found.size
        found[self.asked.ids[active][:, None] == ids] = _NONE
        use = (found >= self.to_beat[active, None]).any(axis=1)
        active, found = active[use], found[use]
        every = np.concatenate([self.scores[active], found], axis=1)
        names = np.concatenate(
            [self.ids[active], np.broadcast_to(ids, found.shape)], axis=1
        )
        first = np.lexsort((names, -every), axis=1)[:, : self.asked.k]
        self.scores[active] = np.take_along_axis(every, first, 1)
        self.ids[active] = np.take_along_axis(names, first, 1)
        self.to_beat[active] = np.maximum(self.to_beat[active], self.scores[active, -1])


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """pivot, distance, id, square and the vectors of a part of the index."""
    raw = b"".join(batch.column(4).to_pylist())
    rows = np.frombuffer(raw).reshape(batch.num_rows, -1)
    return *(batch.column(i).to_numpy() for i in range(4)), rows


def _asking(index: DataFrame, pivots: np.ndarray, query_every: int, k: int) -> DataFrame:
    """id, vec and to_beat of the queries, in the order of the index; written.

    The score to beat is the k-th best among the rows that stand around the query.
    """

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            pivot, distance, ids, squares, rows = _columns(batch)
            at = np.flatnonzero(ids % query_every == 0)
            best = Best(Queries(ids[at], rows[at], pivots, k))
            for near in np.unique(pivot[at]).tolist():
                same, mine = pivot == near, np.flatnonzero(pivot[at] == near)
                best._annulus(mine, ids[same], rows[same])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[at]),
                    batch.column(4).take(pa.array(at)),
                    pa.array(best.to_beat),
                    pa.array(pivot[at]),
                    pa.array(distance[at]),
                ],
                names=["id", "vec", "to_beat", "pivot", "distance"],
            )

    asking = index.mapInArrow(
        home, "id long, vec binary, to_beat long, pivot long, distance double"
    )
    # Of rows that share an id one asks; any of its scores to beat holds for it.
    row = F.min(F.struct("vec", "to_beat", "pivot", "distance")).alias("row")
    asking = asking.groupBy("id").agg(row).select("id", "row.*")
    return written(asking.orderBy("pivot", "distance", "id"), "asking")


def _search(index: DataFrame, asked: Queries, most: np.ndarray) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = Best(asked)
        for batch in batches:
            if batch.num_rows:
                best.search(*_columns(batch))
        at, place = np.nonzero(
            (best.scores > _NONE) & (best.scores >= best.to_beat[:, None])
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(asked.ids[at]),
                pa.array(best.ids[at, place]),
                pa.array(best.scores[at, place]),
            ],
            names=["query_id", "vec_id", "score"],
        )

    needed = F.lit(False)
    for pivot, low, high in asked.ranges(most):
        needed |= (F.col("pivot") == pivot) & F.col("distance").between(low, high)
    return index.where(needed).mapInArrow(search, FOUND)


def exact_top_k(
    vectors: DataFrame,
    k: int = 5,
    query_every: int = 50,
    pivots: int = 64,
    block: int = 2048,
    seed: int = 42,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each id that query_every divides."""
    used = vectors.where(vectors[id_col].isNotNull() & _usable(vectors[vector_col]))
    used = used.select(
        vectors[id_col].cast("long").alias("id"),
        vectors[vector_col].cast("array<double>").alias("v"),
    )
    width = max(1, used.agg(F.max(F.size("v"))).first()[0] or 0)
    draw = F.xxhash64(F.lit(seed), "id")
    sample = used.orderBy(draw, "id", "v").limit(pivots).collect()
    if not sample:
        return vectors.sparkSession.createDataFrame([], RANKED)
    pivot_rows = _matrix(pa.array([r["v"] for r in sample], pa.list_(pa.float64())), width)
    index = _index(used, width, pivot_rows)
    most = np.full(len(pivot_rows), -1.0)
    for row in index.groupBy("pivot").agg(F.max("square").alias("most")).collect():
        most[row["pivot"]] = row["most"]

    asking = _asking(index, pivot_rows, query_every, k).orderBy("pivot", "distance", "id")
    asking = asking.select("id", "vec", "to_beat").toLocalIterator()
    parts = []
    while rows := list(islice(asking, block)):
        ids = np.array([r["id"] for r in rows])
        matrix = np.frombuffer(b"".join(r["vec"] for r in rows)).reshape(len(rows), -1)
        to_beat = np.array([r["to_beat"] for r in rows])
        found = _search(index, Queries(ids, matrix, pivot_rows, k, to_beat), most)
        parts.append(found if len(rows) < block else written(found, "found"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], RANKED)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
