"""Retention, uniqueness and block-list state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.lookups import set_extra
from flowsieve.operators.sampling import newest

# Default retention.
RETENTION_MINUTES = 30
RETENTION_ROWS = 5000


def is_stale(ts: Column, now: Column, minutes: int) -> Column:
    return ts < now - F.make_dt_interval(mins=F.lit(minutes))


def keep_fresh(flows: DataFrame, now: Column, minutes: int = RETENTION_MINUTES) -> DataFrame:
    """Drop flows older than the cutoff; zero or less keeps everything."""
    return flows if minutes <= 0 else flows.where(~is_stale(F.col("timestamp"), now, minutes))


def keep_newest(flows: DataFrame, max_rows: int = RETENTION_ROWS) -> DataFrame:
    """Keep the newest rows; zero or less keeps everything."""
    return flows if max_rows <= 0 else newest(flows, max_rows)


def retained(flows: DataFrame, now: Column, minutes: int = RETENTION_MINUTES, max_rows: int = RETENTION_ROWS) -> DataFrame:
    return keep_newest(keep_fresh(flows, now, minutes), max_rows)


def cascade(predictions: DataFrame, flows: DataFrame) -> DataFrame:
    """Predictions whose flow still exists."""
    kept = flows.select(F.col("id").alias("_kept"))
    return predictions.join(kept, F.col("flow_id") == F.col("_kept"), "left_semi")


def fold_block_events(events: DataFrame) -> DataFrame:
    """Block list from its event log: the last action decides, the last block dates it."""
    blocked_at = F.max(F.when(F.col("action") == "block", F.col("at")))
    # On one instant an unblock comes after a block.
    last = F.max_by(F.col("action"), F.struct(F.col("at"), F.col("action")))
    return (
        events.groupBy("ip")
        .agg((last == "block").alias("active"), blocked_at.alias("created_at"))
        .where(F.col("created_at").isNotNull())
    )


def apply_block_events(block_list: DataFrame, events: DataFrame) -> DataFrame:
    """Merge events into a stored list; unblocking an unknown address does nothing."""
    blocked_at = F.max(F.when(F.col("action") == "block", F.col("at")))
    last = F.max_by(F.col("action"), F.struct(F.col("at"), F.col("action")))
    change = events.groupBy(F.col("ip").alias("_ip")).agg((last == "block").alias("_active"), blocked_at.alias("_at"))
    return (
        block_list.join(change, F.col("ip") == F.col("_ip"), "full")
        .select(
            F.coalesce("ip", "_ip").alias("ip"),
            F.coalesce("_active", "active").alias("active"),
            F.coalesce("_at", "created_at").alias("created_at"),
        )
        .where(F.col("created_at").isNotNull())
    )


def retag(flows: DataFrame, tags: DataFrame) -> DataFrame:
    """Write resolved attack names (flow_id, attack_type) into extra; null clears the field."""
    t = tags.select(F.col("flow_id").alias("_fid"), F.col("attack_type").alias("_attack"))
    value = F.when(F.col("_fid").isNotNull(), F.col("_attack")).otherwise(F.col("extra.attack_type"))
    return (
        flows.join(t, F.col("id") == F.col("_fid"), "left")
        .withColumn("extra", set_extra(flows, attack_type=value))
        .drop("_fid", "_attack")
    )
