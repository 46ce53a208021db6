"""Outlier factors look their neighbours' values up where the neighbours are: a join dealt a row for each of them, twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.models import local_outliers

SCHEMA = "query long, near array<struct<d: double, point: long, n: long>>"


@pytest.fixture
def tables(spark):
    rng = np.random.default_rng(6)
    near = [(q, [(float(d), int(p), int(n)) for d, p, n in zip(np.sort(rng.random(5)), rng.choice(60, 5, replace=False) * 7, rng.integers(1, 4, 5), strict=True)]) for q in range(50)]
    near += [(50, []), (51, None), (52, [(0.5, 3, 2)]), (53, [(0.5, 3, 2), (0.75, 7, 1)])]  # none, and a point that is not known
    reach = [(7 * p, float(rng.random())) for p in range(60)]
    return spark.createDataFrame(near, SCHEMA).repartition(3), spark.createDataFrame(reach, "point long, reach double").repartition(2)


def found(df):
    return {r.query: tuple(r)[1] for r in df.collect()}


def test_values_looked_up_are_those_joined(tables, monkeypatch):
    near, reach = tables
    factors = lambda: (found(local_outliers._density(near, reach)), found(local_outliers._factor(near, local_outliers._density(near, reach), reach.withColumnRenamed("reach", "density"))))
    here = factors()
    monkeypatch.setattr(local_outliers, "HERE_BYTES", 0)
    joined = factors()
    for a, b in zip(here, joined, strict=True):
        assert a.keys() == b.keys() == {*range(50), 53}
        assert np.allclose([a[q] for q in sorted(a)], [b[q] for q in sorted(a)], rtol=1e-13)


def test_no_row_for_each_neighbour_is_dealt(tables):
    near, reach = tables
    plan = local_outliers._density(near.select("query", F.col("near")), reach)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan and "Join" not in plan
