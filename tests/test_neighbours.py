"""Exact neighbours and outlier factors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.models.local_outliers import fit_full_outlier_factor
from flowsieve.operators import neighbours
from flowsieve.session import pinned


def points_of(spark, x):
    return spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, x array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(1200, 3)), rng.normal(size=(700, 3)) * 0.05 + 4, rng.uniform(-9, 9, size=(60, 3))])
    return np.concatenate([x, x[1000:1040], np.repeat(x[5:6], 30, axis=0)])  # some points twice, one 31 times


@pytest.mark.parametrize(("k", "options"), [(5, {"ring_points": 40, "most_pivots": 30}), (20, {"ring_points": 1000}), (3, {"ring_points": 7, "most_pivots": 1})])
def test_neighbours_of_other_points(spark, cloud, k, options):
    points = neighbours.distinct_points(points_of(spark, cloud).select(*(F.col("x")[c].alias(f"c{c}") for c in range(3))), ["c0", "c1", "c2"])
    asked = np.concatenate([cloud[::9] + 0.01, [[40.0, 0, 0]], cloud[:2]])
    index = neighbours.NeighbourIndex.build(points, **options)
    got = {r.query: [(e.d, e.n) for e in r.near] for r in neighbours.k_nearest(index, points_of(spark, asked).withColumnRenamed("id", "query"), k).collect()}
    assert len(got) == len(asked)
    for i, a in enumerate(asked):
        want = np.sort(np.sqrt(((cloud - a) ** 2).sum(axis=1)))[:k]
        assert np.allclose(np.repeat([d for d, _ in got[i]], [n for _, n in got[i]]), want)


def test_few_rings_are_visited(spark, cloud):
    """With four times the points, a query is sent to about as many points as before."""
    sent = []
    for copies in (1, 4):
        rng = np.random.default_rng(3)
        x = rng.uniform(size=(1000 * copies, 2))
        points = neighbours.distinct_points(points_of(spark, x).select(F.col("x")[0].alias("a"), F.col("x")[1].alias("b")), ["a", "b"])
        index = neighbours.NeighbourIndex.build(points, ring_points=30, most_pivots=40 * copies)
        home = pinned(index.home(points_of(spark, rng.uniform(size=(200, 2))).withColumnRenamed("id", "query")))
        first = index.answers(home, 5, False).select("query", F.array_max(F.transform("near", lambda e: e["d"])).alias("bound"))
        sizes = index.points.groupBy("ring").agg(F.count(F.lit(1)).alias("size"))
        sent.append(index.visits(home.drop("bound").join(first, "query")).join(sizes, "ring").agg(F.sum("size")).first()[0] / 200)
    assert sent[1] < 1.5 * sent[0] and sent[1] < 1000


def brute(x, k, asked=None):
    """Factors of x itself, or of other points against x."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    reach = dist.max(1)
    density = 1 / (np.maximum(reach[near], dist).mean(1) + 1e-10)
    if asked is None:
        return density[near].mean(1) / density
    d = np.sqrt(((asked[:, None] - x[None]) ** 2).sum(2))
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    own = 1 / (np.maximum(reach[near], np.take_along_axis(d, near, 1)).mean(1) + 1e-10)
    return density[near].mean(1) / own


def test_outlier_factor_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1900, 3)), rng.uniform(-8, 8, size=(100, 3))])
    asked = rng.normal(size=(150, 3)) * 2
    frame = lambda a: points_of(spark, a).select("id", *(F.col("x")[c].alias(f"c{c}") for c in range(3)))
    columns = ["c0", "c1", "c2"]
    model = fit_full_outlier_factor(frame(x), columns, neighbours=12, ring_points=100)
    own = brute(x, 12)
    assert np.isclose(model.cut, np.percentile(own, 99))
    got = {r.id: r.score for r in model.with_score(frame(asked)).collect()}
    assert np.allclose([got[i] for i in range(150)], brute(x, 12, asked))


def test_copies_nulls_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 50 + [(1.0, 2.0), (9.0, 9.0), (None, 1.0)], "a double, b double")
    model = fit_full_outlier_factor(df, ["a", "b"], neighbours=5)
    rows = {(r.a, r.b): (r.score, r.n) for r in model.with_score(df).groupBy("a", "b", "score").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert rows[1.0, 1.0] == (pytest.approx(1.0), 50) and rows[9.0, 9.0][0] > 1e6 and rows[None, 1.0] == (None, 1)
    small = fit_full_outlier_factor(df.limit(0), ["a", "b"])
    assert small.predict(df.limit(0)).count() == 0


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_few_distances_are_worked_out(monkeypatch, shift):
    """The nearest pivots are those of all distances, ties and far origins included, but hardly more than one distance a row is worked out."""
    rng = np.random.default_rng(6)
    pivots = np.round(rng.uniform(size=(500, 4)), 2) + shift
    x = np.concatenate([rng.uniform(size=(4000, 4)) + shift, pivots[:50], (pivots[:50] + pivots[50:100]) / 2])
    worked, between = [], neighbours._between
    monkeypatch.setattr(neighbours, "_between", lambda a, b: worked.append(len(a)) or between(a, b))
    cell, d = np.empty(len(x), np.int64), np.empty(len(x))
    for s, squares, error in neighbours._near_squares(x, pivots):
        cell[s], d[s] = neighbours._closest(squares, x[s], pivots, error)
    every = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(axis=2))
    assert (cell == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert sum(worked) < 1.1 * len(x)
