"""Burst counts: how many other flows a source sent from 90 s before a flow on.

One flooding source can hold a large share of all flows, so no task may see all
rows of a source. Flows are first counted per (source, microsecond), which
combines map-side. A source's time line is then cut into blocks; the window
inside a block and the window over a source's block totals are both bounded by
clock time (distinct microseconds per block, blocks per year), not by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsieve.functions.scores import BURST_WINDOW_SECONDS, burst_score

RETROACTIVE = "retroactive"
TRAILING = "trailing"


def burst_points(
    flows: DataFrame, window_seconds: int = BURST_WINDOW_SECONDS, block_seconds: int = 10
) -> DataFrame:
    """Both burst counts, self included, per distinct (src_ip, ts_us) of non-blank sources.

    Needs src_ip and timestamp; returns src_ip, ts_us, seen_from (no upper time
    bound) and seen_until (up to the flow's own time).
    """
    if window_seconds % block_seconds:
        raise ValueError("block_seconds must divide window_seconds")
    span = window_seconds // block_seconds
    width = block_seconds * 1_000_000
    points = (
        flows.select("src_ip", F.unix_micros("timestamp").alias("ts_us"))
        .where(F.coalesce("src_ip", F.lit("")) != "")
        .groupBy("src_ip", "ts_us")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Every point shows up in its own block and once more, moved on by the window
    # length, in the block of the flows whose window starts inside its block.
    roles = F.array(
        F.struct(F.col("ts_us").alias("pos"), F.col("n").alias("own"), F.lit(0).cast("bigint").alias("past")),
        F.struct(
            (F.col("ts_us") + F.lit(window_seconds * 1_000_000)).alias("pos"),
            F.lit(0).cast("bigint").alias("own"),
            F.col("n").alias("past"),
        ),
    )
    placed = points.select("src_ip", F.explode(roles).alias("r")).select(
        "src_ip", F.floor(F.col("r.pos") / F.lit(width)).cast("bigint").alias("block"), "r.*"
    )
    in_block = Window.partitionBy("src_ip", "block").orderBy("pos")
    cut = placed.select(
        "src_ip",
        "block",
        F.col("pos").alias("ts_us"),
        "own",
        F.sum("past").over(in_block.rangeBetween(Window.currentRow, Window.unboundedFollowing)).alias("tail"),
        F.sum("own").over(in_block.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("head"),
    ).where("own > 0")
    along = Window.partitionBy("src_ip").orderBy("block")
    blocks = (
        points.groupBy("src_ip", F.floor(F.col("ts_us") / F.lit(width)).cast("bigint").alias("block"))
        .agg(F.sum("n").alias("n"))
        .select(
            "src_ip",
            "block",
            F.sum("n").over(along.rangeBetween(-(span - 1), Window.unboundedFollowing)).alias("onward"),
            F.coalesce(F.sum("n").over(along.rangeBetween(-(span - 1), -1)), F.lit(0)).alias("between"),
        )
    )
    return cut.join(blocks, ["src_ip", "block"]).select(
        "src_ip",
        "ts_us",
        (F.col("tail") + F.col("onward")).alias("seen_from"),
        (F.col("tail") + F.col("between") + F.col("head")).alias("seen_until"),
    )


def with_burst(
    flows: DataFrame,
    mode: str = RETROACTIVE,
    window_seconds: int = BURST_WINDOW_SECONDS,
    block_seconds: int = 10,
    history: DataFrame | None = None,
) -> DataFrame:
    """Adds burst_count (the flow itself not counted) and burst_score.

    Stored flows given as `history` are counted but not returned.

    `retroactive` counts all later flows of the source too, as a lookup over the
    stored table does; `trailing` stops at the flow's own time.
    """
    if mode not in (RETROACTIVE, TRAILING):
        raise ValueError(f"unknown burst mode {mode!r}")
    seen = "seen_from" if mode == RETROACTIVE else "seen_until"
    counted = flows.select("src_ip", "timestamp")
    if history is not None:
        counted = counted.unionByName(history.select("src_ip", "timestamp"))
    points = burst_points(counted, window_seconds, block_seconds).select(
        F.col("src_ip").alias("_src"), F.col("ts_us").alias("_us"), F.col(seen).alias("_seen")
    )
    keyed = flows.withColumn("_key_us", F.unix_micros("timestamp"))
    joined = keyed.join(points, (F.col("src_ip") == F.col("_src")) & (F.col("_key_us") == F.col("_us")), "left")
    count: Column = F.coalesce(F.col("_seen") - 1, F.lit(0)).cast("bigint")
    return (
        joined.withColumn("burst_count", count)
        .withColumn("burst_score", burst_score(F.col("burst_count")))
        .drop("_key_us", "_src", "_us", "_seen")
    )
