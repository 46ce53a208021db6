"""Exact k nearest neighbours between two tables of points, by cells around pivots.

Every reference point belongs to the cell of its nearest pivot, and a cell is cut into rings by the distance from
the pivot, of about RING_POINTS points each. The triangle inequality tells which rings can hold a neighbour:
1. a query is answered in the ring it falls into itself, which bounds the distance of its k-th neighbour;
2. it is sent to the other rings that a ball of this size can meet: the pivot's distance has to fit the ring, and the
   plane halfway between two pivots has to be within reach;
3. the best of all rings are merged.
So a query's work follows the number of rings around it, not the number of reference points. Equal points are one
point with a count, so that many copies make no large groups; a ring's queries are dealt in parts of QUERY_ROWS.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.sampling import exact_sample
from flowsieve.session import pinned

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RING_POINTS = 1000
MOST_PIVOTS = 4096
#: Rings of a cell at most.
MOST_RINGS = 256
QUERY_ROWS = 20_000
#: Rings have numbers: the cell times this, and the place in the cell.
_RING = 1 << 20


def distinct_points(df: DataFrame, columns: list[str]) -> DataFrame:
    """(point, x, n): the distinct points of the columns as arrays of doubles, numbered, with their rows; rows with a null are left out."""
    x = F.array(*(F.col(c).cast("double") + F.lit(0.0) for c in columns))
    rows = df.select(x.alias("x")).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    # Numbered in the order of their coordinates, which so decide between equal distances.
    counted = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x")
    return pinned(counted.withColumn("point", F.monotonically_increasing_id()).select("point", "x", "n"))


def _matrix(x: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    flat = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1) if len(x) else np.empty((0, 0))


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distances of rows of a to the rows of b beside them."""
    return np.sqrt(((a - b) ** 2).sum(axis=-1))


def _near_squares(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray, float]]:
    """Squared distances of slices of a to all of b as one product of matrices, and the error that none exceeds.

    They only tell which distances are worth working out.
    """
    middle = b.mean(axis=0)
    b = b - middle
    squares = (b**2).sum(axis=1)
    step = max(1, 2_000_000 // max(len(b), 1))
    for s in range(0, len(a), step):
        part = a[s : s + step] - middle
        own = (part**2).sum(axis=1)
        error = 4e-16 * (a.shape[1] + 8) * (own.max() + squares.max())
        yield slice(s, s + len(part)), part @ (-2.0 * b.T) + own[:, None] + squares, float(error)


def _closest(s: np.ndarray, x: np.ndarray, b: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the nearest row of b for each row of x, the first one of equally near; s: near squares."""
    row, col = np.nonzero(~(s > s.min(axis=1)[:, None] + 2 * error))
    d = _between(x[row], b[col])
    order = np.lexsort((col, d, row))
    first = order[np.searchsorted(row, np.arange(len(x)))]
    return col[first], d[first]


class NeighbourIndex:
    """Reference points in cells and rings; `marks` are the inner ring bounds of each cell, `reach` its largest distance."""

    def __init__(self, points: DataFrame, pivots: np.ndarray, marks: list[np.ndarray], reach: np.ndarray):
        self.points, self.pivots, self.marks, self.reach = points, pivots, marks, reach

    @staticmethod
    def build(points: DataFrame, ring_points: int = RING_POINTS, most_pivots: int = MOST_PIVOTS) -> NeighbourIndex:
        """From (point, x, n). The pivots are a repeatable sample of at most most_pivots points."""
        total = points.count()
        wanted = int(min(most_pivots, max(1, total // ring_points)))
        chosen = exact_sample(points.select("x"), F.col("x").cast("string"), wanted).collect()
        pivots = np.unique(np.array([r.x for r in chosen], np.float64), axis=0) if chosen else np.empty((0, 0))
        sent = points.sparkSession.sparkContext.broadcast(pivots)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, cell, d = _matrix(batch["x"]), np.empty(len(batch), np.int64), np.empty(len(batch))
                for s, squares, error in _near_squares(x, sent.value):
                    cell[s], d[s] = _closest(squares, x[s], sent.value, error)
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("point", "x", "n")), pa.array(cell), pa.array(d)], ["point", "x", "n", "cell", "d"])

        placed = pinned(points.select("point", "x", "n").mapInArrow(assign, "point long, x array<double>, n long, cell long, d double"))
        shares = [k / MOST_RINGS for k in range(1, MOST_RINGS)]
        # One row for each pivot.
        cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("d").alias("reach"), F.percentile_approx("d", F.array(*map(F.lit, shares)), F.lit(4 * MOST_RINGS)).alias("marks")).collect()
        marks, reach = [np.empty(0)] * len(pivots), np.full(len(pivots), -1.0)
        for c in cells:
            rings = min(MOST_RINGS, -(-c["size"] // ring_points))
            picked = [c.marks[round(k * MOST_RINGS / rings) - 1] for k in range(1, rings)]
            marks[c.cell], reach[c.cell] = np.unique(picked), c.reach
        index = NeighbourIndex(placed, pivots, marks, reach)
        index.points = pinned(placed.withColumn("ring", index._ring_of()(F.col("cell"), F.col("d"))))
        return index

    def _ring_of(self):
        marks = self.marks

        @F.pandas_udf("long")
        def ring(cell: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series([c * _RING + int(np.searchsorted(marks[c], x)) for c, x in zip(cell.tolist(), d.tolist(), strict=True)], dtype="int64")

        return ring

    def home(self, queries: DataFrame) -> DataFrame:
        """(query, x, ring): the ring that each query falls into."""
        pivots, marks = self.pivots, self.marks
        sent = queries.sparkSession.sparkContext.broadcast((pivots, marks))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, marks = sent.value
            for batch in batches:
                x, ring = _matrix(batch["x"]), np.empty(len(batch), np.int64)
                for s, squares, error in _near_squares(x, pivots):
                    cell, d = _closest(squares, x[s], pivots, error)
                    ring[s] = [c * _RING + int(np.searchsorted(marks[c], v)) for c, v in zip(cell.tolist(), d.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["query"], batch["x"], pa.array(ring), pa.array(np.full(len(batch), np.inf))], ["query", "x", "ring", "bound"])

        return queries.select("query", "x").mapInArrow(run, "query long, x array<double>, ring long, bound double")

    def visits(self, bounded: DataFrame) -> DataFrame:
        """(query, x, ring, bound): every ring but the own one that can hold a point within the bound of the query."""
        between = np.stack([_between(self.pivots, p) for p in self.pivots]) if len(self.pivots) else np.empty((0, 0))
        sent = bounded.sparkSession.sparkContext.broadcast((self.pivots, self.marks, self.reach, between))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, marks, reach, between = sent.value
            for batch in batches:
                x, bound, own = _matrix(batch["x"]), batch["bound"].to_numpy(zero_copy_only=False), batch["ring"].to_numpy(zero_copy_only=False)
                for s, squares, error in _near_squares(x, pivots):
                    cell, nearest = _closest(squares, x[s], pivots, error)
                    # Cells that may be met by the near squares, then those that are by the distances themselves.
                    farthest = (bound[s][:, None] + reach[None, :]) * (1 + 1e-8) + 1e-8
                    row, c = np.nonzero((reach >= 0)[None, :] & ~(squares - error > farthest**2))
                    far, to = bound[s][row], between[cell[row], c]
                    with np.errstate(invalid="ignore"):
                        may = ~(squares[row, c] - error - nearest[row] ** 2 > 2 * to * (far + 4e-9 * (1 + nearest[row] + to)))
                    row, c, far, to = row[may], c[may], far[may], to[may]
                    dist = _between(x[s][row], pivots[c])
                    slack = 1e-9 * (1 + dist)  # what rounding can take from a bound
                    with np.errstate(invalid="ignore", divide="ignore"):
                        plane = (dist**2 - nearest[row] ** 2) / (2 * to)
                    meets = (dist - far <= reach[c] + slack) & ~(plane > far + slack)
                    row, c, dist, far = row[meets], c[meets], dist[meets], (far + slack)[meets]
                    spans = [np.searchsorted(marks[at], (d - b, d + b)) for at, d, b in zip(c.tolist(), dist.tolist(), far.tolist(), strict=True)]
                    first, last = np.array(spans, np.int64).reshape(-1, 2).T
                    many = last - first + 1
                    row, step = np.repeat(row, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    ring = np.repeat(c * _RING + first, many) + step
                    row, ring = row[ring != own[s][row]], ring[ring != own[s][row]]
                    at = pa.array(s.start + row)
                    yield pa.RecordBatch.from_arrays([batch["query"].take(at), _lists(x[s][row]), pa.array(ring), pa.array(bound[s][row])], ["query", "x", "ring", "bound"])

        return bounded.select("query", "x", "ring", "bound").mapInArrow(run, "query long, x array<double>, ring long, bound double")

    def answers(self, visits: DataFrame, k: int, same: bool) -> DataFrame:
        """(query, near): in each visited ring the nearest points with k rows within the bound, by distance and number.

        same: queries are reference points, of which one row is the query itself.
        """
        visits = pinned(visits)
        parts = visits.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).alias("parts"))
        asked = visits.join(parts, "ring").select(F.col("ring").alias("at"), F.pmod(F.xxhash64("query"), F.col("parts")).alias("turn"), "query", "x", "bound")
        copies = parts.select(F.col("ring").alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        held = self.points.join(copies, F.col("ring") == F.col("of")).select("ring", "part", "point", "x", "n")

        def nearest(x: np.ndarray, bound: np.ndarray, queries: np.ndarray, of: np.ndarray, points: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
            """(row, distance, place, rows) of the neighbours, a slice of queries at a time, in order."""
            for s, squares, error in _near_squares(x, of):
                # Not beyond the bound, and no more than the next k + 1 points.
                limit = np.minimum(bound[s] ** 2 * (1 + 1e-9) + error, np.inf)
                full = np.flatnonzero((squares > limit[:, None]).sum(axis=1) < len(of) - k - 1)
                if len(full):
                    limit[full] = np.minimum(limit[full], np.partition(squares[full], k, axis=1)[:, k] + 2 * error)
                row, at = np.nonzero(~(squares > limit[:, None]))
                d = _between(x[s][row], of[at])
                inside = d <= bound[s][row] * (1 + 1e-12)
                row, at, d = row[inside], at[inside], d[inside]
                order = np.lexsort((at, d, row))
                row, at, d = row[order], at[order], d[order]
                taken = np.arange(len(row)) - np.searchsorted(row, row) <= k
                row, at, d = row[taken], at[taken], d[taken]
                n = counts[at] - (points[at] == queries[s][row] if same else 0)
                row, at, d, n = row[n > 0], at[n > 0], d[n > 0], n[n > 0]
                before = np.cumsum(n) - n
                wanted = before - before[np.searchsorted(row, row)] < k
                yield s.start + row[wanted], d[wanted], at[wanted], n[wanted]

        def run(asked: pa.Table, held: pa.Table) -> pa.Table:
            queries, parts = asked["query"].to_numpy(), []
            if len(held) and len(asked):
                points = held["point"].to_numpy()
                order = points.argsort()
                points, counts = points[order], held["n"].to_numpy()[order]
                parts = list(nearest(_matrix(asked["x"]), asked["bound"].to_numpy(), queries, _matrix(held["x"])[order], points, counts))
            row, d, at, n = (np.concatenate(p) for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 4
            each = pa.StructArray.from_arrays([pa.array(d, pa.float64()), pa.array(points[at] if parts else at, pa.int64()), pa.array(n, pa.int64())], names=["d", "point", "n"])
            ends = pa.array(np.searchsorted(row, np.arange(len(queries) + 1)), pa.int32())
            return pa.table({"query": pa.array(queries, pa.int64()), "near": pa.ListArray.from_arrays(ends, each)})

        schema = "query long, near array<struct<d: double, point: long, n: long>>"
        return asked.groupBy("at", "turn").cogroup(held.groupBy("ring", "part")).applyInArrow(run, schema)


def _taken(near: Column, k: int) -> Column:
    """The first of the sorted neighbours that make up k rows, the last one with the rows that are still wanted."""
    start = F.struct(F.array().cast("array<struct<d: double, point: long, n: long>>").alias("out"), F.lit(0).cast("long").alias("sum"))
    step = lambda a, e: F.when(a["sum"] >= k, a).otherwise(
        F.struct(F.array_append(a["out"], F.struct(e["d"].alias("d"), e["point"].alias("point"), F.least(e["n"], F.lit(k) - a["sum"]).alias("n"))).alias("out"), (a["sum"] + e["n"]).alias("sum"))
    )
    return F.aggregate(near, start, step)["out"]


def k_nearest(index: NeighbourIndex, queries: DataFrame, k: int, same: bool = False) -> DataFrame:
    """(query, near): for each (query, x) its k nearest reference rows as (d, point, n), nearest first; n rows of a point.

    Equal distances go to the smaller point number. Fewer than k reference rows: all of them.
    """
    home = pinned(index.home(queries.select("query", "x")))
    first = pinned(index.answers(home, k, same))
    enough = F.aggregate("near", F.lit(0).cast("long"), lambda a, e: a + e["n"]) >= k
    bounded = home.drop("bound").join(first.select("query", F.when(enough, F.array_max(F.transform("near", lambda e: e["d"]))).otherwise(F.lit(float("inf"))).alias("bound")), "query")
    others = index.answers(index.visits(bounded), k, same)
    every = first.unionByName(others).select("query", F.explode_outer("near").alias("e")).groupBy("query").agg(F.sort_array(F.collect_list("e")).alias("near"))
    return every.select("query", _taken(F.col("near"), k).alias("near"))
