"""Outlier detectors with per-row numpy scoring: isolation forest, local outlier factor, one-class boundary.

What is broadcast is fixed in size by the method: trees of bounded depth, a
reference sample of the size the method asks for, or a weight vector.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.evaluation import classification_report
from flowsieve.operators.ordered import exact_quantile
from flowsieve.operators.sampling import exact_sample
from flowsieve.session import kept, pinned

# Executors need not have this package installed: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 100
TREE_ROWS = 256
CONTAMINATIONS = (0.01, 0.015, 0.02, 0.03)
NEIGHBOURS = 20
REFERENCE_ROWS = 45_000


def _score_udf(fn):
    """A vectorised score over several numeric columns."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(fn(np.column_stack([c.to_numpy(dtype=float) for c in columns])))

    return score


def _average_path(n):
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    deep = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, deep))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[list, ...]:
    """One random tree as flat arrays: feature (-1 in a leaf), cut, left, right, path length at a leaf."""
    feature, cut, left, right, length = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(feature)
        for column, empty in ((feature, -1), (cut, 0.0), (left, 0), (right, 0)):
            column.append(empty)
        length.append(depth + float(_average_path(len(rows))))
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        usable = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(usable):
            f = int(rng.choice(usable))
            c = float(rng.uniform(low[f], high[f]))
            goes = rows[:, f] <= c
            feature[at], cut[at] = f, c
            left[at] = node(rows[goes], depth + 1)
            right[at] = node(rows[~goes], depth + 1)
        return at

    node(x, 0)
    return feature, cut, left, right, length


def _mean_path(trees, x: np.ndarray, depth: int) -> np.ndarray:
    total = np.zeros(len(x))
    for feature, cut, left, right, length in trees:
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(depth):
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            value = x[np.arange(len(x)), np.maximum(f, 0)]
            at = np.where(inner, np.where(value <= cut[at], left[at], right[at]), at)
        total += length[at]
    return total / len(trees)


@dataclass
class IsolationForest:
    columns: list[str]
    trees: list
    rows_per_tree: int
    cut: float = 0.5

    def with_score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds the anomaly score in (0, 1); higher is stranger."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        norm = float(_average_path(self.rows_per_tree)) or 1.0
        depth = max(1, math.ceil(math.log2(max(self.rows_per_tree, 2)))) + 1
        score = _score_udf(lambda x: 2.0 ** (-_mean_path(shared.value, x, depth) / norm))
        return df.withColumn(name, score(*[F.col(c).cast("double") for c in self.columns]))

    def set_contamination(self, train: DataFrame, contamination: float) -> IsolationForest:
        return self._cut_at(pinned(self.with_score(train, "_s").select("_s")), contamination)

    def _cut_at(self, scored: DataFrame, contamination: float) -> IsolationForest:
        self.cut = exact_quantile(scored, "_s", 1 - contamination).first()[0]
        return self

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        return self.with_score(df, "_s").withColumn(name, (F.col("_s") > F.lit(self.cut)).cast("int")).drop("_s")

    def predict_signed(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """-1 for outliers, 1 for the rest."""
        return self.predict(df, name).withColumn(name, F.when(F.col(name) == 1, F.lit(-1)).otherwise(F.lit(1)))


def fit_isolation_forest(
    train: DataFrame,
    columns: list[str],
    key: str,
    contamination: float | None = 0.01,
    trees: int = TREES,
    tree_rows: int = TREE_ROWS,
    seed: int = 42,
) -> IsolationForest:
    """Grow the trees in parallel tasks, each on its own draw from a repeatable sample.

    The sample has at most trees x tree_rows rows, whatever the table holds.
    """
    spark = train.sparkSession
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    pool = exact_sample(train.select(key, *numbers), F.col(key), trees * tree_rows, seed)
    points = spark.sparkContext.broadcast(pool.toPandas().sort_values(key)[columns].to_numpy())
    rows = min(tree_rows, len(points.value))
    limit = max(1, math.ceil(math.log2(max(rows, 2))))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for tree in batch["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                draw = points.value[rng.choice(len(points.value), rows, replace=False)]
                out.append((int(tree), *_grow(draw, rng, limit)))
            yield pd.DataFrame(out, columns=["tree", "feature", "cut", "left", "right", "length"])

    schema = "tree long, feature array<int>, cut array<double>, left array<int>, right array<int>, length array<double>"
    jobs = spark.range(0, trees, 1, min(trees, spark.sparkContext.defaultParallelism))
    grown = jobs.mapInPandas(grow, schema).orderBy("tree").collect()
    forest = IsolationForest(
        list(columns),
        [tuple(np.array(getattr(t, n)) for n in ("feature", "cut", "left", "right", "length")) for t in grown],
        rows,
    )
    return forest if contamination is None else forest.set_contamination(train, contamination)


def search_contamination(
    train: DataFrame, test: DataFrame, columns: list[str], key: str, label: str, levels=CONTAMINATIONS, **options
) -> tuple[float, float, IsolationForest]:
    """(level, F1 of class 1, forest): the first level with the strictly best F1 on the test rows."""
    forest = fit_isolation_forest(train, columns, key, None, **options)
    scored = pinned(forest.with_score(train, "_s").select("_s"))
    tested = pinned(forest.with_score(test, "_s").select(label, "_s"))
    best = (levels[0], 0.0)
    for level in levels:
        cut = forest._cut_at(scored, level).cut
        marked = tested.withColumn("predicted", (F.col("_s") > F.lit(cut)).cast("int"))
        report = classification_report(marked, label, "predicted", [0, 1])
        f1 = report.where("name = '1'").first()["f1"]
        if f1 > best[1]:
            best = (level, f1)
    return best[0], best[1], forest._cut_at(scored, best[0])


# --- local outlier factor ---


def _nearest(x: np.ndarray, ref: np.ndarray, k: int, own: np.ndarray | None = None):
    """Indices and distances of the k nearest reference rows, in slices to bound memory."""
    ids, dists = [], []
    norms = (ref**2).sum(axis=1)
    step = max(1, 4_000_000 // max(len(ref), 1))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        d = np.maximum((part**2).sum(axis=1)[:, None] + norms[None, :] - 2.0 * part @ ref.T, 0.0)
        if own is not None:
            d[np.arange(len(part)), own[s : s + step]] = np.inf
        i = np.argpartition(d, k - 1, axis=1)[:, :k]
        exact = np.sqrt(((part[:, None, :] - ref[i]) ** 2).sum(axis=2))
        ids.append(i)
        dists.append(exact)
    return np.concatenate(ids), np.concatenate(dists)


@dataclass
class LocalOutlierFactor:
    columns: list[str]
    reference: np.ndarray
    reach: np.ndarray
    density: np.ndarray
    neighbours: int
    cut: float

    def with_score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds the outlier factor: about 1 inside a cluster, larger outside."""
        shared = df.sparkSession.sparkContext.broadcast((self.reference, self.reach, self.density))
        k = self.neighbours

        def factor(x: np.ndarray) -> np.ndarray:
            ref, reach, density = shared.value
            i, d = _nearest(x, ref, k)
            own = 1.0 / (np.maximum(reach[i], d).mean(axis=1) + 1e-10)
            return density[i].mean(axis=1) / own

        return df.withColumn(name, _score_udf(factor)(*[F.col(c).cast("double") for c in self.columns]))

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        return self.with_score(df, "_s").withColumn(name, (F.col("_s") > F.lit(self.cut)).cast("int")).drop("_s")


def fit_local_outlier_factor(
    train: DataFrame,
    columns: list[str],
    key: str,
    neighbours: int = NEIGHBOURS,
    contamination: float = 0.01,
    reference_rows: int = REFERENCE_ROWS,
) -> LocalOutlierFactor:
    """Fit on a repeatable sample of at most `reference_rows` rows; any number of rows can be scored.

    The sample is what is broadcast. Its own neighbours are searched in parallel tasks.
    """
    spark = train.sparkSession
    numbers = train.select(key, *[F.col(c).cast("double").alias(c) for c in columns])
    local = exact_sample(numbers, F.col(key), reference_rows).toPandas().sort_values(key)
    ref = local[columns].to_numpy()
    k = min(neighbours, len(ref) - 1)
    shared = spark.sparkContext.broadcast(ref)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["id"].to_numpy()
            i, d = _nearest(shared.value[at], shared.value, k, own=at)
            yield pd.DataFrame({"id": at, "near": list(i), "dist": list(d)})

    parts = max(spark.sparkContext.defaultParallelism, len(ref) // 2000)
    found = (
        spark.range(0, len(ref), 1, parts).mapInPandas(search, "id long, near array<long>, dist array<double>").toPandas()
    ).sort_values("id")
    near, dist = np.stack(found["near"].to_numpy()), np.stack(found["dist"].to_numpy())
    reach = dist.max(axis=1)
    density = 1.0 / (np.maximum(reach[near], dist).mean(axis=1) + 1e-10)
    factor = density[near].mean(axis=1) / density
    cut = float(np.percentile(factor, 100 * (1 - contamination)))
    return LocalOutlierFactor(list(columns), ref, reach, density, k, cut)


# --- one-class boundary ---


@dataclass
class OneClassBoundary:
    columns: list[str]
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    offset: float

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return math.sqrt(2.0 / len(self.phases)) * np.cos(x @ self.directions + self.phases)

    def with_score(self, df: DataFrame, name: str = "score") -> DataFrame:
        """Adds the signed distance to the boundary; negative is outside."""
        model = self
        score = _score_udf(lambda x: model._lift(x) @ model.weights - model.offset)
        return df.withColumn(name, score(*[F.col(c).cast("double") for c in self.columns]))

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        return self.with_score(df, "_s").withColumn(name, (F.col("_s") < 0).cast("int")).drop("_s")


def fit_one_class(
    train: DataFrame, columns: list[str], nu: float = 0.01, width: int = 128, steps: int = 30, seed: int = 42
) -> OneClassBoundary:
    """Radial-kernel one-class boundary over random Fourier features (approximate).

    Every step sums the gradient inside the tasks and then by place; one vector reaches the driver.
    The offset is set last, as the nu-quantile of the training scores.
    """
    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    rows = train = kept(train.select(*numbers))
    stats = rows.agg(
        F.count(F.lit(1)), sum((F.avg(c) for c in columns), F.lit(0.0)), sum((F.avg(F.col(c) * F.col(c)) for c in columns), F.lit(0.0))
    ).first()
    p = len(columns)
    variance = max(stats[2] / p - (stats[1] / p) ** 2, 1e-12)
    gamma = 1.0 / (p * variance)
    rng = np.random.default_rng(seed)
    directions = rng.normal(0.0, math.sqrt(2.0 * gamma), (p, width))
    phases = rng.uniform(0.0, 2.0 * math.pi, width)
    model = OneClassBoundary(list(columns), directions, phases, np.zeros(width), 0.0)

    def sums(current: OneClassBoundary | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(width), 0
            for batch in batches:
                z = model._lift(batch.to_numpy())
                inside = np.ones(len(z), dtype=bool) if current is None else z @ current.weights < current.offset
                total += z[inside].sum(axis=0)
                n += int(inside.sum())
            yield pd.DataFrame({"at": np.arange(width + 1), "value": np.append(total, n)})

        parts = rows.mapInPandas(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(width + 1)
        for r in parts:
            out[r["at"]] = r["value"]
        return out[:width], int(out[width])

    count = stats[0]
    start, _ = sums(None)
    model.weights = start / count
    model.offset = float(exact_quantile(model.with_score(train, "_s"), "_s", nu).first()[0])
    for t in range(1, steps + 1):
        pull, outside = sums(model)
        rate = 1.0 / (t + 1)
        model.weights = (1 - rate) * model.weights + rate * pull / (nu * count)
        model.offset -= rate * 0.1 * (outside / (nu * count) - 1.0) * abs(model.offset)
    model.offset = 0.0
    model.offset = float(exact_quantile(model.with_score(train, "_s"), "_s", nu).first()[0])
    return model
