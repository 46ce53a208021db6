"""The smallest determinant against a search over all subsets, and outliers that many starts see through."""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from flowsieve.models import robust
from flowsieve.operators.ordered import nth_smallest


def frame(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{k} double" for k in range(x.shape[1]))), [f"c{k}" for k in range(x.shape[1])]


def test_no_subset_is_smaller(spark):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = np.concatenate([rng.normal(size=(9, 2)), rng.normal(size=(4, 2)) * 0.3 + 6])
        df, columns = frame(spark, x)
        _, cov, found = robust.minimum_covariance(df, columns)
        least = min(robust.spread(np.cov(x[list(s)].T, bias=True)) for s in combinations(range(13), 8))
        assert found <= least + 1e-9 and np.isclose(robust.spread(cov), found)


def test_a_third_of_outliers(spark):
    """A tight far group draws a single start from the medians' scale towards it; the bulk is found anyway."""
    rng = np.random.default_rng(7)
    bulk = rng.normal(size=(2000, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.3], [0, 0, 1]])
    x = np.concatenate([bulk, rng.normal(size=(900, 3)) * 0.2 + [6, -6, 6]])
    df, columns = frame(spark, x)
    mean, cov, _ = robust.minimum_covariance(df, columns)
    assert np.abs(mean).max() < 0.2 and np.linalg.cond(cov) < 20
    far = robust._distances(x, mean, cov)
    assert far[2000:].min() > np.quantile(far[:2000], 0.99)


def test_steps_never_enlarge():
    rng = np.random.default_rng(1)
    x = rng.standard_t(2, size=(200, 4))
    mean, cov = x[:5].mean(0), np.cov(x[:6].T, bias=True)
    last = np.inf
    for _ in range(8):
        mean, cov = robust.step(x, mean, cov, 103)
        assert robust.spread(cov) <= last + 1e-9
        last = robust.spread(cov)


def test_nth_smallest(spark):
    df = spark.range(1000).select((F.col("id") % 100).cast("double").alias("v"))
    assert [nth_smallest(df, "v", n) for n in (1, 10, 11, 995, 1000, 1001)] == [0.0, 0.0, 1.0, 99.0, 99.0, None]


def test_constant_column(spark):
    x = np.column_stack([np.random.default_rng(0).normal(size=100), np.ones(100)])
    df, columns = frame(spark, x)
    assert robust.fit_robust_envelope(df, columns).predict(df).agg(F.sum("predicted")).first()[0] <= 1
