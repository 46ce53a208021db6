"""Monitoring queries over recent flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import scores
from flowsieve.operators import sampling
from flowsieve.operators.lookups import served_flows, with_latest_prediction

# Rows shown by default.
RECENT_ROWS = 400
TIMELINE_ROWS = 30


def recent_with_prediction(flows: DataFrame, predictions: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """Newest flows with their latest prediction; predictions are cut to those flows first."""
    recent = sampling.newest(flows, n)
    wanted = recent.select(F.col("id").alias("_want"))
    related = predictions.join(wanted, F.col("flow_id") == F.col("_want"), "left_semi")
    return with_latest_prediction(recent, related)


def recent_flows(flows: DataFrame, predictions: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    return served_flows(recent_with_prediction(flows, predictions, n).orderBy("timestamp", "id"))


def anomalous_only(flows_with_prediction: DataFrame) -> DataFrame:
    return flows_with_prediction.where(scores.is_anomalous(F.col("has_prediction"), F.col("label"), F.col("score")))


def anomalous_flows(flows: DataFrame, predictions: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    return served_flows(anomalous_only(recent_with_prediction(flows, predictions, n)).orderBy("timestamp", "id"))


def anomaly_stats(flows_with_prediction: DataFrame) -> DataFrame:
    """Count above 0.9, highest score and share in percent, rounded and unrounded."""
    score = F.coalesce(F.col("score"), F.lit(0.0))
    stats = flows_with_prediction.agg(
        F.count_if(score > 0.9).alias("count"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("raw_max_score"),
        F.count(F.lit(1)).alias("total"),
    )
    share = F.when(F.col("total") > 0, F.col("count") / F.col("total") * 100.0).otherwise(F.lit(0.0))
    return stats.select(
        "count",
        "raw_max_score",
        share.alias("raw_pct_anomalous"),
        F.round("raw_max_score", 3).alias("max_score"),
        F.round(share, 2).alias("pct_anomalous"),
    )


def anomalous_view(anomalous: DataFrame, recent: DataFrame) -> DataFrame:
    """Rows the anomaly panel shows: of the anomalous flows, or of all recent ones when there are none."""
    label, score = F.col("label"), F.coalesce(F.col("score"), F.lit(0.0))
    shown = (scores.severity(label, score) != "normal") | (score >= 0.6)
    columns = anomalous.columns
    fallback = recent.select(*columns).where(~anomalous.exists())
    return anomalous.unionByName(fallback).where(shown)


def by_source(flows: DataFrame, needle: str) -> DataFrame:
    """Flows whose source contains the text, ignoring case; blank text keeps all."""
    wanted = needle.strip().lower()
    if not wanted:
        return flows
    return flows.where(F.contains(F.lower(F.coalesce("src_ip", F.lit(""))), F.lit(wanted)))


def severity_mix(served: DataFrame) -> DataFrame:
    """Rows per severity, all three always present: one aggregate, then unpivoted."""
    grade = scores.severity(F.col("label"), F.col("score"))
    sums = served.select(grade.alias("g")).agg(*[F.count_if(F.col("g") == s).alias(s) for s in scores.SEVERITIES])
    return sums.unpivot([], list(scores.SEVERITIES), "severity", "n")


def timeline(flows: DataFrame, predictions: DataFrame, n: int = TIMELINE_ROWS) -> DataFrame:
    """Newest rows in time order with clock label, score and severity."""
    rows = recent_with_prediction(flows, predictions, n).orderBy("timestamp", "id")
    label = F.when(F.col("has_prediction"), F.col("label")).otherwise(F.lit("normal"))
    score = F.coalesce(F.col("score"), F.lit(0.0))
    return rows.select(
        "id",
        scores.clock_label(F.col("timestamp")).alias("ts_label"),
        score.alias("score"),
        scores.severity(label, score).alias("severity"),
    )


def chart_rows(flows: DataFrame, predictions: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """Recent flows numbered newest first, with score, severity and label."""
    rows = sampling.with_position(recent_with_prediction(flows, predictions, n))
    label = F.when(F.col("has_prediction"), F.col("label")).otherwise(F.lit("normal"))
    score = F.coalesce(F.col("score"), F.lit(0.0))
    return rows.select(
        "index", score.alias("score"), scores.severity(label, score).alias("severity"), label.alias("label"), "src_ip"
    )

