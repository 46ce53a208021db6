"""Score every flow with the heuristic; resolve attack names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import network, scores
from flowsieve.operators.burst import RETROACTIVE, with_burst


def score_heuristic(flows: DataFrame, mode: str = RETROACTIVE, history: DataFrame | None = None) -> DataFrame:
    """Adds score and label to stored flows (proto already normalised).

    The address tests are separate columns so each is computed once per row.
    """
    ready = with_burst(flows, mode, history=history)
    ready = ready.withColumn("_sp", network.is_private_ip(F.col("src_ip"))).withColumn(
        "_dp", network.is_private_ip(F.col("dst_ip"))
    )
    raw = (
        F.lit(scores.BASE_SCORE)
        + F.lit(scores.BYTES_WEIGHT) * scores.bytes_score(F.col("bytes"))
        + F.lit(scores.BURST_WEIGHT) * F.col("burst_score")
        + scores.direction_bonus(F.col("src_ip"), F.col("dst_ip"), F.col("_sp"), F.col("_dp"))
        + scores.protocol_bonus(F.col("proto"))
        + scores.stable_jitter(F.col("src_ip"), F.col("dst_ip"), F.col("proto"), F.col("timestamp"))
    )
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return (
        ready.withColumn("score", clamped)
        .withColumn(
            "label",
            scores.threshold_label(F.col("score"), scores.HEURISTIC_ANOMALY, scores.HEURISTIC_WATCH),
        )
        .drop("_sp", "_dp")
    )


def with_attack_type(scored: DataFrame) -> DataFrame:
    """Adds attack_type resolved from label, attack_label (optional) and the scan rules."""
    hint = F.col("attack_label") if "attack_label" in scored.columns else F.lit(None).cast("string")
    scanning = scores.infer_scanning(
        F.col("extra.service"), F.col("extra.src_port"), F.col("extra.dst_port"), F.col("bytes")
    )
    return scored.withColumn("attack_type", scores.resolve_attack(F.col("label"), hint, scanning))
