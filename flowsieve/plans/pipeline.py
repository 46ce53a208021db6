"""From incoming records to stored, scored flows: one batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.models import detector, ensemble
from flowsieve.plans.scoring import score_heuristic, with_attack_type

Scorer = Callable[[DataFrame, DataFrame | None], DataFrame]


def _exists(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def choose_scorer(
    spark: SparkSession, ensemble_path: str | None = None, detector_path: str | None = None, burst_mode: str = "retroactive"
) -> tuple[str, Scorer]:
    """(mode, scorer): the ensemble if saved, else the detector if saved, else the heuristic.

    Decided once per run or micro-batch. A scorer takes flows and, for the burst
    counts of the heuristic, stored flows; it adds score, label and, for the
    ensemble, attack_label.
    """
    if _exists(spark, ensemble_path):
        members = [m for m in ensemble.MEMBERS if _exists(spark, f"{ensemble_path}/{m}")]
        models = {m: ensemble.load_member(spark, ensemble_path, m) for m in members}

        def by_ensemble(flows: DataFrame, history: DataFrame | None = None) -> DataFrame:
            return flows.join(ensemble.score_flows(flows, models), "id")

        return "ensemble", by_ensemble
    if _exists(spark, detector_path):
        loaded = detector.load_detector(spark, detector_path)
        return "detector", lambda flows, history=None: loaded.score_flows(flows)
    return "heuristic", lambda flows, history=None: score_heuristic(flows, burst_mode, history)


def prediction_rows(scored: DataFrame, now: Column) -> DataFrame:
    """Prediction rows of a scored batch, with the resolved attack name alongside."""
    return with_attack_type(scored).select(
        F.col("id"), F.col("id").alias("flow_id"), "score", "label", now.alias("created_at"), "attack_type"
    )
