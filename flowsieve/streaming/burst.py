"""Burst counts kept as stream state, for streams whose flows are not looked up in a store.

The state of a key, a source and a block of its time line, is what the block's flows need: the
flows themselves, how many the source sent in the whole blocks inside the window, and the times of those
in the block that the window starts in. A flow is told to these few blocks when it arrives. A block is
answered and forgotten when the watermark has passed its end, so the state is that of the window, a block
and the lateness, however long the stream runs, and no key holds more than a block of one source.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowsieve.functions.scores import BURST_WINDOW_SECONDS, burst_score

# Executors need not have this package installed: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_SECONDS = 30
#: Parts of a block of flows without a source.
BLANK_PARTS = 64
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# What a row tells a block: a flow of its own, a whole block inside the window, a flow from where the window starts.
OWN, BETWEEN, PAST = 0, 1, 2


def trailing_counts(own: np.ndarray, between: int, past: np.ndarray) -> np.ndarray:
    """For each of a block's times the flows up to it that are in its window, itself left out.

    own: times of the block's flows. between: flows of the blocks that lie whole in every window of this
    one. past: times, moved on by the window, of the flows in the block where the windows start.
    """
    ordered, shifted = np.sort(own), np.sort(past)
    return np.searchsorted(ordered, own, "right") + between + len(shifted) - np.searchsorted(shifted, own, "left") - 1


class BurstBlocks(StatefulProcessor):
    """Answers a block of a source when the watermark has passed it."""

    def __init__(self, block_us: int):
        self.block_us = block_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # A row for each micro-batch: the times and ids as packed longs.
        self.own = handle.getListState("own", "times binary, ids binary")
        self.past = handle.getListState("past", "times binary")
        self.between = handle.getValueState("between", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = pd.concat(list(rows))
        own, past = told[told.role == OWN], told[told.role == PAST]
        longs = lambda c: c.to_numpy(np.int64).tobytes()
        if len(own):
            self.own.appendValue((longs(own.pos), longs(own.id)))
        if len(past):
            self.past.appendValue((longs(past.pos),))
        n = len(told) - len(own) - len(past)
        if n:
            self.between.update((n + (self.between.get()[0] if self.between.exists() else 0),))
        self.handle.registerTimer((int(key[1]) + 1) * self.block_us // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        longs = lambda parts: np.frombuffer(b"".join(parts), np.int64)
        chunks = list(self.own.get()) if self.own.exists() else []
        times, ids = longs(t for t, _ in chunks), longs(i for _, i in chunks)
        past = longs(t for (t,) in self.past.get()) if self.past.exists() else np.empty(0, np.int64)
        between = self.between.get()[0] if self.between.exists() else 0
        counts = trailing_counts(times, between, past) if key[0] else np.zeros(len(times), np.int64)
        for state in (self.own, self.past, self.between):
            state.clear()
        yield pd.DataFrame({"src_ip": pd.Series([key[0]] * len(ids), dtype="object"), "id": ids, "ts_us": times, "burst_count": counts})

    def close(self) -> None:
        pass


def streaming_bursts(flows: DataFrame, lateness: str = "1 minute", window_seconds: int = BURST_WINDOW_SECONDS, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """(id, src_ip, timestamp, burst_count, burst_score) of a stream of flows (id, src_ip, timestamp).

    The trailing counts of with_burst: other flows of the source from the window before a flow up to its
    own time, in whatever order they arrive. `lateness` is how far a flow may be behind the newest one;
    later ones are dropped. A flow delivered again, by its id, within the lateness counts once. Flows without
    a source or a time have no burst; those without a time are dropped. A flow comes out when the
    watermark has passed its block. Start the query inside state_store().
    """
    if window_seconds % block_seconds:
        raise ValueError("block_seconds must divide window_seconds")
    width, span = block_seconds * 1_000_000, window_seconds // block_seconds
    once = flows.select("id", "src_ip", "timestamp").where(F.col("timestamp").isNotNull()).withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["id"])
    blank = F.coalesce("src_ip", F.lit("")) == ""
    us = F.unix_micros("timestamp")
    block = F.floor(us / F.lit(width)).cast("bigint")
    role = lambda kind, at, pos: F.struct(F.lit(kind).alias("role"), at.alias("block"), pos.cast("bigint").alias("pos"))
    told = [role(OWN, block, us), role(PAST, block + span, us + window_seconds * 1_000_000)]
    told += [role(BETWEEN, block + k, F.lit(None)) for k in range(1, span)]
    # Flows without a source tell nothing to other blocks, and their blocks are cut in parts.
    told = F.when(blank, F.array(told[0])).otherwise(F.array(*told))
    part = F.when(blank, F.pmod(F.xxhash64("id"), F.lit(BLANK_PARTS))).otherwise(0)
    rows = once.select("timestamp", "id", "src_ip", part.alias("part"), F.explode(told).alias("r")).select("timestamp", "id", "src_ip", "part", "r.*")
    counted = rows.groupBy("src_ip", "block", "part").transformWithStateInPandas(
        statefulProcessor=BurstBlocks(width), outputStructType="src_ip string, id long, ts_us long, burst_count long", outputMode="Append", timeMode="EventTime"
    )
    return counted.select("id", "src_ip", F.timestamp_micros("ts_us").alias("timestamp"), "burst_count", burst_score(F.col("burst_count")).alias("burst_score"))


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which this state needs; the setting is put back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)
