"""Joins of flows with predictions, the block list and the reverse-DNS table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.scores import attack_type
from flowsieve.functions.network import protocol_name


def latest_predictions(predictions: DataFrame) -> DataFrame:
    """One row per flow: the newest prediction, the higher id on equal times.

    An aggregate rather than a window, so copies of one flow combine before the shuffle.
    """
    rest = [c for c in predictions.columns if c != "flow_id"]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "id"))
    return predictions.groupBy("flow_id").agg(newest.alias("p")).select("flow_id", "p.*")


def first_predictions(predictions: DataFrame) -> DataFrame:
    """One row per flow: the prediction stored first (lowest id)."""
    rest = [c for c in predictions.columns if c != "flow_id"]
    oldest = F.min_by(F.struct(*rest), F.col("id"))
    return predictions.groupBy("flow_id").agg(oldest.alias("p")).select("flow_id", "p.*")


def duplicate_flow_ids(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def with_latest_prediction(flows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Adds score and label of the newest prediction and has_prediction."""
    latest = latest_predictions(predictions).select(
        F.col("flow_id").alias("_fid"), F.col("score").alias("score"), F.col("label").alias("label")
    )
    return (
        flows.join(latest, F.col("id") == F.col("_fid"), "left")
        .withColumn("has_prediction", F.col("_fid").isNotNull())
        .drop("_fid")
    )


def served_flows(flows_with_prediction: DataFrame, extra_attack: Column | None = None) -> DataFrame:
    """Flow rows as handed to clients; input carries the latest prediction."""
    label = F.when(F.col("has_prediction"), F.col("label")).otherwise(F.lit("normal"))
    stored = F.col("extra.attack_type") if extra_attack is None else extra_attack
    # ISO time: no fraction when it is zero, microseconds otherwise.
    whole = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format("timestamp", ".SSSSSS")
    iso = F.concat(whole, F.when(fraction == ".000000", F.lit("")).otherwise(fraction), F.lit("+00:00"))
    return flows_with_prediction.select(
        "id",
        iso.alias("ts"),
        "src_ip",
        "dst_ip",
        protocol_name(F.col("proto")).alias("proto"),
        "bytes",
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
        label.alias("label"),
        attack_type(label, stored).alias("attack_type"),
        F.coalesce(F.to_json("extra"), F.lit("{}")).alias("extra"),
    )


def active_blocks(block_list: DataFrame) -> DataFrame:
    return block_list.where("active")


def newest_blocks(block_list: DataFrame) -> DataFrame:
    return active_blocks(block_list).orderBy(F.desc("created_at"), F.desc("ip"))


def without_blocked(flows: DataFrame, block_list: DataFrame) -> DataFrame:
    """Flows with neither endpoint on the active list.

    Two equi anti joins; Spark broadcasts the list only while it is small.
    """
    ips = active_blocks(block_list).select(F.col("ip").alias("_ip")).distinct()
    by_src = flows.join(ips, F.col("src_ip") == F.col("_ip"), "left_anti")
    return by_src.join(ips, F.col("dst_ip") == F.col("_ip"), "left_anti")


def mark_blocked(flows: DataFrame, block_list: DataFrame) -> DataFrame:
    """Adds `blocked` instead of removing rows, for accounting in the same pass."""
    ips = active_blocks(block_list).select("ip").distinct()
    src = ips.select(F.col("ip").alias("_bsrc"))
    dst = ips.select(F.col("ip").alias("_bdst"))
    return (
        flows.join(src, F.col("src_ip") == F.col("_bsrc"), "left")
        .join(dst, F.col("dst_ip") == F.col("_bdst"), "left")
        .withColumn("blocked", F.col("_bsrc").isNotNull() | F.col("_bdst").isNotNull())
        .drop("_bsrc", "_bdst")
    )


def with_reverse_dns(flows: DataFrame, rdns: DataFrame) -> DataFrame:
    """Sets extra.rdns_exists and extra.rdns_hash from the peer address (source, else destination)."""
    names = rdns.groupBy(F.col("ip").alias("_peer_ip")).agg(F.max("resolved").alias("_resolved"))
    peer = F.coalesce(F.nullif(F.col("src_ip"), F.lit("")), F.col("dst_ip"))
    found = F.coalesce(F.col("_resolved"), F.lit(False))
    return (
        flows.withColumn("_peer", peer)
        .join(names, F.col("_peer") == F.col("_peer_ip"), "left")
        .withColumn(
            "extra",
            set_extra(flows, rdns_exists=found, rdns_hash=found.cast("bigint")),
        )
        .drop("_peer", "_peer_ip", "_resolved")
    )


def set_extra(flows: DataFrame, **values: Column) -> Column:
    """The attribute struct with some fields replaced; a null struct becomes one holding only those."""
    kinds = flows.schema["extra"].dataType
    fields = [
        (values[f.name].cast(f.dataType) if f.name in values else F.col(f"extra.{f.name}")).alias(f.name)
        for f in kinds.fields
    ]
    return F.struct(*fields)


def fetch_by_ids(flows: DataFrame, ids: DataFrame | list[int]) -> DataFrame:
    """Flows with the given ids, in id order; a short list becomes a pushed-down filter."""
    if isinstance(ids, DataFrame):
        key = ids.columns[0]
        wanted = ids.select(F.col(key).alias("_wanted"))
        return flows.join(wanted, F.col("id") == F.col("_wanted"), "left_semi").orderBy("id")
    return flows.where(F.col("id").isin([int(i) for i in ids if i])).orderBy("id")


def absent_predictions(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch to insert: the first per flow, and only for flows without a stored row.

    `seq` orders the batch.
    """
    rest = [c for c in batch.columns if c != "flow_id"]
    once = batch.groupBy("flow_id").agg(F.min_by(F.struct(*rest), F.col("seq")).alias("p")).select("flow_id", "p.*")
    known = existing.select(F.col("flow_id").alias("_known")).distinct()
    return once.join(known, F.col("flow_id") == F.col("_known"), "left_anti")
