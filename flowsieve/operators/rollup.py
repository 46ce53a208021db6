"""Per-minute traffic rollup and training-data preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.network import prefix_direction
from flowsieve.functions.text import numeric_or_null, numeric_or_zero


def log_columns(log: DataFrame) -> DataFrame:
    """Packet log with parsed numbers, minute bucket, destination port and direction."""
    seconds = F.col("timestamp")
    micros = F.floor(seconds * 1e6 + 0.5).try_cast("bigint")
    return log.select(
        F.timestamp_micros(micros).alias("time"),
        F.date_trunc("minute", F.timestamp_micros(micros)).alias("minute"),
        "src_ip",
        "dst_ip",
        numeric_or_null(F.col("length")).alias("length"),
        F.col("protocol").alias("protocol"),
        F.coalesce(numeric_or_null(F.col("tcp_dst")), numeric_or_null(F.col("udp_dst"))).alias("dst_port"),
        prefix_direction(F.col("src_ip")).alias("direction"),
    )


# Output names of the distinct counts, and what they count.
DISTINCT = {"n_flows": "src_ip", "n_dest_ports": "dst_port", "n_dest_ip": "dst_ip"}
MEASURES = ("n_flows", "n_packets", "n_bytes", "avg_duration", "n_dest_ports", "n_dest_ip", "tcp_udp_ratio_packets", "dir_ratio_bytes")


def rollup_sums() -> list[Column]:
    sent = lambda way: F.coalesce(F.sum(F.when(F.col("direction") == way, F.col("length"))), F.lit(0.0))
    return [
        F.count("src_ip").alias("n_packets"),
        F.coalesce(F.sum("length"), F.lit(0.0)).alias("n_bytes"),
        ((F.unix_micros(F.max("time")) - F.unix_micros(F.min("time"))) / F.lit(1e6)).alias("avg_duration"),
        (F.count_if(F.col("protocol") == 6) / (F.count_if(F.col("protocol") == 17) + 1)).alias("tcp_udp_ratio_packets"),
        ((sent("out") + 1) / (sent("in") + 1)).alias("dir_ratio_bytes"),
    ]


def approximate_distinct() -> list[Column]:
    return [F.approx_count_distinct(F.col(c)).alias(name) for name, c in DISTINCT.items()]


def minute_rollup(log: DataFrame) -> DataFrame:
    """Traffic measures per minute with packets; rows without a time are left out.

    Each distinct count is a table of its own: (minute, value) pairs are made distinct inside the
    tasks first, so a busy minute is spread by value and no input row is copied per count.
    """
    rows = log_columns(log).where(F.col("minute").isNotNull())
    rolled = rows.groupBy("minute").agg(*rollup_sums())
    for name, c in DISTINCT.items():
        values = rows.select(F.col("minute").alias("_minute"), c).where(F.col(c).isNotNull()).distinct()
        counted = values.groupBy("_minute").agg(F.count(F.lit(1)).alias(name))
        rolled = rolled.join(counted, F.col("minute") == F.col("_minute"), "left").drop("_minute")
        rolled = rolled.withColumn(name, F.coalesce(name, F.lit(0)))
    return rolled.select("minute", *MEASURES)


# Columns dropped from merged training data, and cells that count as missing.
DROPPED_COLUMNS = ("label", "attack_cat", "dataset_source", "type")
MISSING_CELLS = ("-", "?", "")
UNKNOWN_CLASS = "99"
# Attack classes kept for training and their new ids.
TARGET_CLASSES = {0: 0, 2: 1, 3: 2}


def clean_cells(df: DataFrame) -> DataFrame:
    """Missing cells to '0' in every column of an all-text table; known extra columns dropped."""
    if "attack_type" not in df.columns:
        df = df.withColumn("attack_type", F.lit(UNKNOWN_CLASS))
    fill = lambda c: F.when(F.col(c).isNull() | F.col(c).isin(*MISSING_CELLS), F.lit("0")).otherwise(F.col(c))
    return df.select(*[fill(c).alias(c) for c in df.columns if c not in DROPPED_COLUMNS])


def target_classes(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the kept classes with the new class id; every other column numeric, dirt to 0."""
    value = numeric_or_null(F.col("attack_type"))
    new_id = None
    for old, new in TARGET_CLASSES.items():
        new_id = F.when(value == old, F.lit(new)) if new_id is None else new_id.when(value == old, F.lit(new))
    return df.where(value.isin([float(k) for k in TARGET_CLASSES])).select(
        new_id.alias("attack_type"),
        *[F.col(c) if c in keep else numeric_or_zero(F.col(c)).alias(c) for c in df.columns if c != "attack_type"],
    )


def is_attack(class_id: Column) -> Column:
    return (class_id != 0).cast("int")


def ratio_features(df: DataFrame) -> DataFrame:
    """Adds packets per flow, bytes per packet and flows per destination port."""
    ports = F.col("sum_n_dest_ports") if "sum_n_dest_ports" in df.columns else F.lit(1)
    return (
        df.withColumn("packets_per_flow", F.col("n_packets") / (F.col("n_flows") + 1))
        .withColumn("bytes_per_packet", F.col("n_bytes") / (F.col("n_packets") + 1))
        .withColumn("flows_to_ports_ratio", F.col("n_flows") / (ports + 1))
    )


def without_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows with a value in each of the columns (all columns by default)."""
    return df.na.drop(subset=list(columns)) if columns else df.na.drop()


def concat_by_name(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts over the union of their columns."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def concat_complete(parts: list[DataFrame], required: tuple[str, ...]) -> DataFrame | None:
    """The required columns of the parts that have all of them."""
    full = [p.select(*required) for p in parts if set(required) <= set(p.columns)]
    return concat_by_name(full) if full else None


def scaled_columns(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Columns mapped to [0, 1] by their own minimum and maximum, read once here; a constant column becomes 0."""
    bounds = df.agg(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns])
    types, found = {f.name: f.dataType for f in bounds.schema}, bounds.first()
    at = lambda name: F.lit(found[name]).cast(types[name])
    rest = [c for c in df.columns if c not in columns] if keep is None else keep
    value = lambda c: (F.col(c) - at(f"_lo_{c}")) / F.coalesce(F.nullif(at(f"_hi_{c}") - at(f"_lo_{c}"), F.lit(0)), F.lit(1))
    return df.select(*rest, *[value(c).alias(c) for c in columns])
