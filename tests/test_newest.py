"""The newest rows for any number of them, against a plain sort."""

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import sampling


@pytest.mark.parametrize("n", [1, 7, 500, 1234, 2500, 2501, 4000])
def test_counted_ranges_match_a_sort(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "ONE_TASK", 0)
    i = F.col("id")
    # Half of the rows share one instant, some have no time, one row comes 20 times.
    at = F.when(i % 50 == 3, F.lit(None)).when(i % 2 == 0, F.timestamp_seconds(F.lit(1_700_000_000))).otherwise(F.timestamp_millis(F.lit(1_699_999_000_000) + (i * 7919) % 1_000_003))
    rows = spark.range(2480).select((i * 31 % 2480).alias("id"), at.alias("timestamp"))
    copies = spark.range(20).select(F.lit(5000).cast("long").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("timestamp"))
    df = rows.unionAll(copies).repartition(5).cache()
    order = lambda r: (r.timestamp is not None and r.timestamp.timestamp(), r.id)
    want = sorted(map(order, df.collect()), reverse=True)[:n]
    assert sorted(map(order, sampling.newest(df, n).collect()), reverse=True) == want


def test_no_single_task_sort(spark, monkeypatch):
    monkeypatch.setattr(sampling, "ONE_TASK", 0)
    df = spark.range(1000).select("id", F.timestamp_seconds("id").alias("timestamp"))
    plan = sampling.newest(df, 500)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and plan.count("GlobalLimit") == 1  # that of the copies
