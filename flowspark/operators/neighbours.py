"""Exact k nearest neighbours by a join over cells round pivots.

Pivots are training rows, the root of their number and at most MAX_PIVOTS. Every training row belongs to the
cell of its nearest pivot, which is known by its size and by the least and the largest distance to the
pivot. A query first meets the nearest cells that hold k rows; the k-th distance found there bounds
the answer. The triangle inequality and the hyperplane between two pivots then say which other cells can
still hold a neighbour, and within a cell only rows whose distance to the pivot differs by no more than the bound
are compared. The result is exact whatever the pivots; how much is left to compare depends on the data
(distances that are all alike, as between random vectors in many dimensions, leave nearly everything).

A cell with more than CELL_ROWS rows is cut by hash of the row, and so are the queries of a cell
that more than QUERY_ROWS of them visit: no task holds more than a piece of either.

Where the cells rule out less than half of the pairs, a query would be sent to most cells, whose number grows with the root of
the rows. All pairs are then compared in blocks of rows and of queries; the bounds found at home still hold, so a product in single
precision leaves the few rows whose distance is taken exactly.

Where queries times rows are no more than SMALL_PAIRS, everything is one cell: an index would cost more than it saves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.session import store

MAX_PIVOTS = 2048
SMALL_PAIRS = 1 << 22
CELL_ROWS = 16_384
QUERY_ROWS = 65_536
LEAST_BLOCK = 1024            # queries of a block
CHUNK_ENTRIES = 1 << 22       # distances computed at a time
BLOCK_ROWS = 65_536           # rows of a block at most
DIGITS = 9                    # distances that agree so far are ties, which the smaller id wins
FOUND = "query long, neighbour long, y double, distance double, compared long"


@dataclass
class Cells:
    """What the driver knows of the cells: a row per pivot."""

    pivots: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray
    query_parts: np.ndarray
    piece: int = 0               # rows of a piece of a cell, CELL_ROWS by default

    @property
    def row_parts(self) -> np.ndarray:
        return np.maximum(1, -(-self.rows // (self.piece or CELL_ROWS)))

    @property
    def slack(self) -> float:
        """More than rounding can take from a distance."""
        return 1e-6 * (1.0 + float(np.abs(self.pivots).max(initial=0.0)) + float(self.most.max(initial=0.0)))

    def distances(self, points: np.ndarray) -> np.ndarray:
        return _distances(points, self.pivots)

    def home(self, distance: np.ndarray, k: int) -> np.ndarray:
        """Which cells a query meets first: the nearest ones that hold k rows together."""
        near = np.argsort(distance, axis=1, kind="stable")
        before = np.cumsum(self.rows[near], axis=1) - self.rows[near]
        out = np.zeros(distance.shape, bool)
        np.put_along_axis(out, near, before < k, axis=1)
        return out & (self.rows > 0)

    def reachable(self, distance: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells can hold a row within `bound` of the query."""
        apart = _distances(self.pivots, self.pivots)
        nearest = distance.argmin(1)
        least = np.maximum(distance - self.most, self.least - distance)
        gap = apart[nearest]
        own = distance[np.arange(len(distance)), nearest][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(gap > self.slack, (distance ** 2 - own ** 2) / (2 * gap), 0.0)
        return (np.maximum(least, plane) <= bound[:, None] + self.slack) & (self.rows > 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] - 2.0 * a @ b.T + (b * b).sum(1)[None, :]))


class Shortlist:
    """Rows that can be within a bound of a query, by one product of half the precision; its error is allowed for."""

    def __init__(self, points: np.ndarray):
        self.centre = points.mean(0)
        rows = points - self.centre
        square = (rows * rows).sum(1)
        self.reach = float(np.sqrt(square.max(initial=0.0)))
        self.usable = self.reach < 1e15
        if self.usable:
            self.rows = np.ascontiguousarray(np.hstack([-2.0 * rows, square[:, None]]).astype(np.float32).T)

    def within(self, queries: np.ndarray, bound: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all rows within the bounds that can be among the nearest `take`, and some more."""
        here = queries - self.centre
        square = (here * here).sum(1)
        about = np.hstack([here, np.ones((len(here), 1))]).astype(np.float32) @ self.rows      # distance squared less the query's own square
        error = 5e-7 * (queries.shape[1] + 8) * (np.sqrt(square) + self.reach) ** 2
        limit = bound ** 2 - square + error
        near = about <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]
        take = min(take, about.shape[1])
        if np.count_nonzero(near) > 64 * take * len(here):
            limit = np.minimum(limit, np.partition(about, take - 1, axis=1)[:, take - 1] + 2.0 * error)
            near = about <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]
        return np.divmod(np.flatnonzero(near), about.shape[1])


def _points(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(array), -1) if len(array) else np.empty((0, 0))


def _lists(points: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(points) + 1, dtype=np.int32) * points.shape[1], pa.array(points.ravel()))


def _numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return table.column(table.schema.get_field_index(name)).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[name].to_numpy()


def _chunks(rows: int, columns: int) -> Iterator[slice]:
    step = max(1, CHUNK_ENTRIES // max(1, columns))
    return (slice(at, min(rows, at + step)) for at in range(0, rows, step))


def _pivots(train: DataFrame, size: int) -> np.ndarray:
    """Different training rows by hash order; their number is bounded, and so is what comes to the driver."""
    n = max(1, min(MAX_PIVOTS, math.isqrt(max(0, size - 1)) + 1))
    rows = train.select("v", F.xxhash64("id", F.lit(11)).alias("h")).orderBy("h").limit(n).collect()
    return np.unique(np.array([r["v"] for r in rows], dtype=float), axis=0)


def _placed(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Training rows with their cell and the distance to its pivot."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _points(batch.column(batch.schema.get_field_index("v")))
            cells, r = np.empty(len(points), np.int32), np.empty(len(points))
            for part in _chunks(len(points), len(pivots)):
                cells[part] = _distances(points[part], pivots).argmin(1)
                r[part] = np.sqrt(((points[part] - pivots[cells[part]]) ** 2).sum(1))
            yield batch.append_column("cell", pa.array(cells)).append_column("r", pa.array(r))
    return train.mapInArrow(place, "id long, y double, v array<double>, cell int, r double")


def _visits(queries: DataFrame, cells: Cells, k: int, bounded: bool) -> DataFrame:
    """A row per query and cell it has to meet: in the first round its home cells, in the second all others within its bound."""
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, ids = _points(batch.column(batch.schema.get_field_index("v"))), _numbers(batch, "id")
            for part in _chunks(len(points), 8 * len(cells.pivots)):
                distance = cells.distances(points[part])
                goes = home = cells.home(distance, k)
                bound = np.full(len(distance), np.inf)
                if bounded:
                    bound = _numbers(batch, "bound")[part].astype(float)
                    bound = np.where(np.isnan(bound), np.inf, bound)
                    goes = cells.reachable(distance, bound) & ~home
                at, cell = np.nonzero(goes)
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[part][at]), _lists(points[part][at]), pa.array(cell.astype(np.int32)), pa.array(bound[at]),
                         pa.array(distance[at, cell])], names=["id", "v", "cell", "bound", "d"])
    return queries.mapInArrow(visit, "id long, v array<double>, cell int, bound double, d double")


def _met(visits: DataFrame, placed: DataFrame, cells: Cells, k: int, leave_self_out: bool) -> DataFrame:
    """The best k rows of each cell for each query that visits it."""
    def parts(values: np.ndarray):
        return F.coalesce(F.get(F.array(*[F.lit(int(x)) for x in values]), F.col("cell")), F.lit(1)) if values.max(initial=1) > 1 else F.lit(1)
    q_parts, t_parts = parts(cells.query_parts), parts(cells.row_parts)
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = visits.withColumn("qp", own(q_parts, 1)).withColumn("tp", every(t_parts))
    right = placed.withColumn("tp", own(t_parts, 2)).withColumn("qp", every(q_parts))
    slack = cells.slack

    names = ["query", "neighbour", "y", "distance", "compared"]

    def rows_of(*columns) -> pa.Table:
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return rows_of([], [], [], [], [])
        points, r, ids, y = _points(rows["v"]), _numbers(rows, "r"), _numbers(rows, "id"), _numbers(rows, "y")
        order = np.lexsort((ids, r))
        points, r, ids, y = points[order], r[order], ids[order], y[order]
        by_id = np.argsort(ids, kind="stable")
        sorted_ids = ids[by_id]
        queries, all_bounds, all_d, all_ids = _points(asked["v"]), _numbers(asked, "bound"), _numbers(asked, "d"), _numbers(asked, "id")
        found, compared, shortlist = [], 0, None
        for part in _chunks(len(queries), len(points)):
            here, bound, d, own_id = queries[part], all_bounds[part], all_d[part], all_ids[part]
            low, high = np.searchsorted(r, d - bound - slack), np.searchsorted(r, d + bound + slack, side="right")
            width = high - low
            if width.sum() * 4 > len(here) * len(points):      # most of the cell: one matrix product, then those near enough
                compared += len(here) * len(points)
                own = np.searchsorted(sorted_ids, own_id)
                mine = sorted_ids[np.minimum(own, len(ids) - 1)] == own_id if leave_self_out else np.zeros(len(own), bool)
                itself = np.where(mine, by_id[np.minimum(own, len(ids) - 1)], -1)      # the row that is the query
                if np.isfinite(bound).all() and (shortlist := shortlist or Shortlist(points)).usable and np.isfinite(here).all() and np.abs(here).max(initial=0.0) < 1e15:
                    at, of = shortlist.within(here, bound + slack, k + int(leave_self_out))
                else:
                    about = _distances(here, points)
                    about[np.flatnonzero(mine), itself[mine]] = np.inf
                    take = min(k, len(points))
                    limit = np.minimum(np.partition(about, take - 1, axis=1)[:, take - 1], bound) + slack
                    at, of = np.nonzero(about <= limit[:, None])
                    near = np.isfinite(about[at, of])
                    at, of = at[near], of[near]
                other = of != itself[at]
                at, of = at[other], of[other]
            else:
                compared += int(width.sum())
                at = np.repeat(np.arange(len(here)), width)
                of = np.arange(len(at)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
                if leave_self_out:
                    other = own_id[at] != ids[of]
                    at, of = at[other], of[other]
            exact = np.concatenate([np.sqrt(((here[at[i:i + 65536]] - points[of[i:i + 65536]]) ** 2).sum(1)) for i in range(0, len(at), 65536)] or [np.empty(0)])
            near = exact <= bound[at] + slack
            at, of, exact = at[near], of[near], exact[near]
            order = np.lexsort((ids[of], np.round(exact, DIGITS), at))
            at, of, exact = at[order], of[order], exact[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < k
            found.append(rows_of(own_id[at[keep]], ids[of[keep]], y[of[keep]], exact[keep], np.zeros(int(keep.sum()), np.int64)))
        return pa.concat_tables([*found, rows_of([None], [None], [None], [None], [compared])])
    return left.groupBy("cell", "qp", "tp").cogroup(right.groupBy("cell", "qp", "tp")).applyInArrow(best, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    nearest = Window.partitionBy("query").orderBy(F.round("distance", DIGITS), "neighbour")      # k rows per visited piece of a cell
    return found.where("query IS NOT NULL").withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _candidates(queries: DataFrame, train: DataFrame, vector: str, query_id: str, train_id: str, label: str, k: int,
                leave_self_out: bool, small_pairs: int) -> DataFrame:
    """Rows of both rounds, and a row per task that says how many pairs it compared."""
    wide = lambda d, i, *more: d.where(F.col(vector).isNotNull()).select(
        F.col(i).cast("long").alias("id"), *more, F.col(vector).cast("array<double>").alias("v"))
    t, q = wide(train, train_id, F.col(label).cast("double").alias("y")), wide(queries, query_id)
    size, asking = t.count(), q.count()
    one = np.ones(1, np.int64)
    if size * asking <= small_pairs:
        zero = F.lit(0.0)
        everything = Cells(np.zeros((1, 1)), one * size, np.zeros(1), np.zeros(1), one)
        visits = q.select("id", "v", F.lit(0).alias("cell"), F.lit(float("inf")).alias("bound"), zero.alias("d"))
        return _met(visits, t.select("id", "y", "v", F.lit(0).alias("cell"), zero.alias("r")), everything, k, leave_self_out)
    pivots = _pivots(t, size)
    placed = store(_placed(t, pivots), "knn-cells")
    rows, least, most = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for cell, n, low, high in placed.groupBy("cell").agg(F.count(F.lit(1)), F.min("r"), F.max("r")).collect():     # a row per pivot
        rows[cell], least[cell], most[cell] = n, low, high
    need = k + int(leave_self_out)

    def in_blocks(asked: DataFrame) -> DataFrame:
        """All pairs in blocks: a query travels once per block of rows and not once per cell, a row once per block of queries."""
        wanted = 4 * q.sparkSession.sparkContext.defaultParallelism
        block = min(BLOCK_ROWS, max(CELL_ROWS, -(-size // (math.isqrt(wanted - 1) + 1))))
        piece = min(QUERY_ROWS, max(LEAST_BLOCK, -(-asking // -(-wanted // -(-size // block)))))
        zero = F.lit(0.0)
        everything = Cells(pivots, one * size, least, most, one * -(-asking // piece), block)      # the pivots for their slack
        unbounded = F.coalesce("bound", F.lit(float("inf"))).alias("bound")
        return _met(asked.select("id", "v", F.lit(0).alias("cell"), unbounded, zero.alias("d")),
                    placed.select("id", "y", "v", F.lit(0).alias("cell"), zero.alias("r")), everything, k, leave_self_out)

    def meet(asked: DataFrame, bounded: bool) -> DataFrame | None:
        """None if the cells rule out less than half of the pairs."""
        cells = Cells(pivots, rows, least, most, np.ones(len(pivots), np.int64))
        visits = _visits(asked, cells, need, bounded)
        if bounded or asking > QUERY_ROWS:
            pairs = 0
            for cell, n in visits.groupBy("cell").agg(F.count(F.lit(1))).collect():     # a row per pivot
                cells.query_parts[cell] = max(1, -(-n // QUERY_ROWS))
                pairs += n * int(rows[cell])
            if bounded and 2 * pairs > size * asking:
                return None
        return _met(visits, placed, cells, k, leave_self_out)

    first = store(meet(q, False), "knn-home")
    bounds = _ranked(first, k).groupBy("query").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("bound"))
    asked = store(q.join(bounds, q["id"] == bounds["query"], "left").select("id", "v", "bound"), "knn-bounds")
    second = meet(asked, True)
    # Blocks meet the home cells again, so their answer is the whole one.
    return in_blocks(asked) if second is None else first.unionByName(second)


def nearest_neighbours(queries: DataFrame, train: DataFrame, vector: str, query_id: str, train_id: str, label: str, *,
                       k: int = 15, leave_self_out: bool = False, small_pairs: int = SMALL_PAIRS) -> DataFrame:
    """Exact k nearest training rows of every query: query_id, train_id, neighbour_label, distance, rank.

    Ids are whole numbers that tell rows apart; rows without a vector are left out; all vectors have one length and
    finite entries. `leave_self_out` leaves out the training row with the query's id.
    """
    found = _candidates(queries, train, vector, query_id, train_id, label, k, leave_self_out, small_pairs)
    return _ranked(found, k).select(
        F.col("query").alias(query_id), F.col("neighbour").alias(train_id if train_id != query_id else "neighbour_id"),
        F.col("y").alias("neighbour_label"), "distance", "rank")


def compared_pairs(queries: DataFrame, train: DataFrame, vector: str, query_id: str, train_id: str, label: str, *,
                   k: int = 15, leave_self_out: bool = False, small_pairs: int = SMALL_PAIRS) -> int:
    """How many distances the join computes in cells."""
    found = _candidates(queries, train, vector, query_id, train_id, label, k, leave_self_out, small_pairs)
    return found.agg(F.sum("compared")).first()[0] or 0


def knn_vote(neighbours: DataFrame, query_id: str) -> DataFrame:
    """Score = mean label of the neighbours."""
    return neighbours.groupBy(query_id).agg(F.avg("neighbour_label").alias("score"), F.count(F.lit(1)).alias("neighbours"))
