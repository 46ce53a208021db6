"""Local outlier factor over all rows: every row's neighbours are found exactly, none is left out of the reference."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.models.outliers import NEIGHBOURS
from flowsieve.operators.neighbours import NeighbourIndex, distinct_points, k_nearest
from flowsieve.operators.ordered import exact_quantile
from flowsieve.session import pinned

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of the points' values that every task may hold; those of more points are joined.
HERE_BYTES = 128 << 20

def _exploded(near: DataFrame) -> DataFrame:
    return near.select("query", F.explode("near").alias("e")).select("query", F.col("e.d").alias("d"), F.col("e.point").alias("point"), F.col("e.n").alias("n"))


def _mean(near: DataFrame, known: DataFrame, name: str, reaching: bool) -> DataFrame:
    """(query, mean): over a query's neighbours what `known` has of them under the name; reaching: their distance, if that is larger.

    Values of so many points as a task can hold are looked up where the neighbours are: a join deals a row for each neighbour twice.
    """
    if 16 * known.count() > HERE_BYTES:
        value = F.greatest("d", name) if reaching else F.col(name)
        return _exploded(near).join(known, "point").groupBy("query").agg((F.sum(F.col("n") * value) / F.sum("n")).alias("mean"))
    table = known.select("point", F.col(name).cast("double").alias("value")).where("point IS NOT NULL AND value IS NOT NULL").toArrow()
    point, value = table["point"].to_numpy(), table["value"].to_numpy()
    order = np.argsort(point)
    point, value = point[order], value[order]
    del table, order
    sent = near.sparkSession.sparkContext.broadcast((point, value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, value = sent.value
        for batch in batches:
            lists = batch["near"]
            query = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            d, of, n = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            at = np.searchsorted(point, of)
            inside = np.flatnonzero(at < len(point))
            inside = inside[point[at[inside]] == of[inside]]
            query, d, n, v = query[inside], d[inside], n[inside], value[at[inside]]
            total, weight = np.bincount(query, n * (np.maximum(d, v) if reaching else v), len(lists)), np.bincount(query, n, len(lists))
            some = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([batch["query"].take(pa.array(some)), pa.array(total[some] / weight[some])], ["query", "mean"])

    return near.select("query", "near").mapInArrow(run, "query long, mean double")


def _density(near: DataFrame, reach: DataFrame) -> DataFrame:
    """(query, density): the inverse of the mean reachability distance to the neighbours."""
    return _mean(near, reach, "reach", reaching=True).select("query", (1 / (F.col("mean") + 1e-10)).alias("density"))


def _factor(near: DataFrame, own: DataFrame, density: DataFrame) -> DataFrame:
    """(query, factor): the mean density of the neighbours over the query's own."""
    around = _mean(near, density, "density", reaching=False)
    return around.join(own.withColumnRenamed("density", "own"), "query").select("query", (F.col("mean") / F.col("own")).alias("factor"))


@dataclass
class FullOutlierFactor:
    """`points` has (point, x, reach, density, factor) of the distinct training points."""

    columns: list[str]
    index: NeighbourIndex
    points: DataFrame
    neighbours: int
    cut: float

    def with_score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds the factor of new rows among the training rows, about 1 inside a cluster; null where a column has none."""
        queries = distinct_points(df, self.columns).withColumnRenamed("point", "query")
        near = pinned(k_nearest(self.index, queries, self.neighbours))
        own = _density(near, self.points.select("point", "reach"))
        scored = _factor(near, own, self.points.select("point", "density")).join(queries.select("query", "x"), "query")
        return self._joined(df, scored, name)

    def own_factors(self, train: DataFrame, name: str = "factor") -> DataFrame:
        """Adds to the rows of the training table the factors that they had among the others."""
        return self._joined(train, self.points, name)

    def _joined(self, df: DataFrame, scored: DataFrame, name: str) -> DataFrame:
        key = F.array(*(F.col(c).cast("double") + F.lit(0.0) for c in self.columns))
        return df.withColumn("_x", key).join(scored.select(F.col("x").alias("_of"), F.col("factor").alias(name)), F.col("_x") == F.col("_of"), "left").drop("_x", "_of")

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        return self.with_score(df, "_s").withColumn(name, F.coalesce((F.col("_s") > F.lit(self.cut)).cast("int"), F.lit(0))).drop("_s")


def fit_full_outlier_factor(train: DataFrame, columns: list[str], neighbours: int = NEIGHBOURS, contamination: float = 0.01, **rings) -> FullOutlierFactor:
    """Fit on all rows of train; other rows are scored against all of them.

    Equal rows are neighbours of each other. The cut is the quantile of the training rows' own factors.
    Fewer rows than neighbours: all others are neighbours.
    """
    points = distinct_points(train, columns)
    rows = points.agg(F.sum("n")).first()[0] or 0
    k = max(1, min(neighbours, rows - 1))
    index = NeighbourIndex.build(points, **rings)
    near = pinned(k_nearest(index, points.select(F.col("point").alias("query"), "x"), k, same=True))
    reach = near.select(F.col("query").alias("point"), F.coalesce(F.array_max(F.transform("near", lambda e: e["d"])), F.lit(0.0)).alias("reach"))
    own = pinned(_density(near, reach))
    factor = pinned(_factor(near, own, own.withColumnRenamed("query", "point")))
    # A row for each row of train, not for each point.
    copies = factor.join(points.select(F.col("point").alias("query"), "n"), "query").select("factor", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    cut = exact_quantile(copies, "factor", 1 - contamination).first()[0]
    named = lambda df: df.withColumnRenamed("query", "point")
    known = pinned(points.select("point", "x").join(reach, "point").join(named(own), "point").join(named(factor), "point"))
    return FullOutlierFactor(list(columns), index, known, k, float("inf") if cut is None else float(cut))
