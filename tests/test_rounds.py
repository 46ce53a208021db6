"""Shared steps that must not move all rows: what they write, and that results stay exact."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import ordered, sampling
from flowsieve.session import shared_dir


def _bytes(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)


def test_quantile_orders_only_the_rows_around_it(spark):
    values = np.random.default_rng(3).normal(size=200_000)
    df = spark.createDataFrame(values.tolist(), "double").toDF("x").repartition(8)
    df.count()
    before = _bytes(shared_dir(spark))
    for q in (0.0, 0.003, 0.5, 0.99, 1.0):
        assert ordered.exact_quantile(df, "x", q).first()[0] == pytest.approx(float(np.quantile(values, q)), abs=0)
    # One copy of the column each, and few counted values: 13 MB a quantile when all were counted and kept.
    assert _bytes(shared_dir(spark)) - before < 5 * 2.5e6
    order = np.sort(values)
    assert [ordered.nth_smallest(df, "x", n) for n in (1, 777, 200_000, 200_001)] == [order[0], order[776], order[-1], None]


def test_quantile_of_odd_values(spark):
    df = lambda values: spark.createDataFrame([(v,) for v in values], "x double")
    assert ordered.exact_quantile(df([]), "x", 0.5).first()[0] is None
    assert ordered.exact_quantile(df([None, 4.0]), "x", 0.5).first()[0] == 4.0
    assert ordered.exact_quantile(df([1.0] * 3000 + [2.0] * 3000), "x", 0.5).first()[0] == 1.5
    nan = ordered.exact_quantile(df([1.0, 2.0, 3.0, float("nan")]), "x", 1.0).first()[0]
    assert math.isnan(nan) and ordered.exact_quantile(df([1.0, 2.0, 3.0, float("nan")]), "x", 0.5).first()[0] == 2.5
    assert ordered.nth_smallest(df([float("nan")] * 5 + [1.0]), "x", 1) == 1.0


def test_sample_is_the_first_in_hash_order(spark):
    df = spark.range(30_000).withColumn("other", F.col("id") * 2)
    want = {r.id for r in ordered.hash_rank(df, F.col("id"), 42).where("rank <= 500").collect()}
    sample = sampling.exact_sample(df, F.col("id"), 500)
    assert {r.id for r in sample.collect()} == want
    assert sampling.exact_sample(df, F.col("id"), 40_000).count() == 30_000
    assert sampling.exact_sample(df.where("id < 0"), F.col("id"), 5).count() == 0
