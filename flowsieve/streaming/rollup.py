"""Streaming forms of the minute rollup and of first-wins predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.rollup import DISTINCT, MEASURES, approximate_distinct, log_columns, rollup_sums


def streaming_minutes(log: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The minute rollup over a stream; distinct counts are approximate there.

    `lateness` is how long a minute stays open for late rows; it is not part of the batch form.
    """
    timed = log_columns(log).where(F.col("time").isNotNull()).withWatermark("time", lateness)
    rolled = timed.groupBy(F.window("time", "1 minute")).agg(*rollup_sums(), *approximate_distinct())
    return rolled.select(F.col("window.start").alias("minute"), *MEASURES)


def streaming_minutes_exact(log: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """The minute rollup over a stream with exact distinct counts: two stateful operators in a chain.

    Every (minute, kind, value) is let through once, by a state that the watermark empties; the rows
    that are let through are counted in the minute's aggregate beside the sums of all rows. A busy
    minute's values are spread by value, and of a minute only its aggregate meets in one place.
    """
    timed = log_columns(log).where(F.col("time").isNotNull()).withWatermark("time", lateness)
    rows = timed.select(F.window("time", "1 minute").alias("window"), "time", "src_ip", "dst_ip", "dst_port", "length", "protocol", "direction")
    kinds = [F.struct(F.lit(name).alias("kind"), F.col(c).cast("string").alias("value")) for name, c in DISTINCT.items()]
    values = rows.select("window", F.explode(F.array(*kinds)).alias("v")).select("window", "v.*").where(F.col("value").isNotNull())
    once = values.dropDuplicates(["window", "kind", "value"]).select("window", "kind")
    both = rows.withColumn("kind", F.lit(None).cast("string")).unionByName(once, allowMissingColumns=True)
    rolled = both.groupBy("window").agg(*rollup_sums(), *(F.count_if(F.col("kind") == name).alias(name) for name in DISTINCT))
    return rolled.select(F.col("window.start").alias("minute"), *MEASURES)


def first_predictions_within(predictions: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """At most one prediction per flow among rows no further apart than the lateness."""
    return predictions.withWatermark("created_at", lateness).dropDuplicatesWithinWatermark(["flow_id"])
