"""Burst counts as stream state against the stored-history form."""

import json
import random
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

from flowsieve.operators.burst import TRAILING, with_burst
from flowsieve.session import scratch_path
from flowsieve.streaming.burst import BLOCK_SECONDS, state_store, streaming_bursts, trailing_counts

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_counts_of_a_block():
    draw = np.random.default_rng(3)
    for _ in range(50):
        times = draw.integers(0, 400, draw.integers(1, 80))
        block, window, width = 8, 90, 30
        own = times[times // width == block]
        past = times[times // width == block - window // width] + window
        between = int(((times // width > block - window // width) & (times // width < block)).sum())
        want = [int(((times >= t - window) & (times <= t)).sum()) - 1 for t in own]
        assert trailing_counts(own, between, past).tolist() == want


def run(spark, batches, lateness="1 minute"):
    """The counts that came out of a stream of one file a batch, and the last state."""
    root = scratch_path(spark, "bursts")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, src_ip string, timestamp timestamp").coalesce(1).write.parquet(f"{root}/in/{k:03d}")
    reader = spark.readStream.schema("id long, src_ip string, timestamp timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    with state_store(spark):
        out = streaming_bursts(reader.parquet(f"{root}/in"), lateness)
        query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out"), [json.loads(p.json) for p in query.recentProgress]


def test_late_and_repeated_flows(spark):
    draw = random.Random(8)
    flows = [(i, draw.choice(["a", "a", "a", "b", "", None]), START + timedelta(milliseconds=draw.randrange(600_000))) for i in range(1500)]
    flows.sort(key=lambda r: r[2] + timedelta(seconds=draw.randrange(40)))  # up to 40 s behind
    batches = [flows[k : k + 250] for k in range(0, len(flows), 250)]
    batches = [b + (batches[k - 1][-20:] if k else []) for k, b in enumerate(batches)]  # some come again
    got, progress = run(spark, batches)
    closed = max(t for *_, t in flows) - timedelta(minutes=1)
    ended = F.col("timestamp") < F.lit(closed) - F.expr(f"INTERVAL {BLOCK_SECONDS} SECONDS")
    want = with_burst(spark.createDataFrame(flows, "id long, src_ip string, timestamp timestamp"), TRAILING)
    columns = ["id", "src_ip", "timestamp", "burst_count", "burst_score"]
    by_id = lambda df: sorted(map(tuple, df.where(ended).select(*columns).collect()))
    assert len(by_id(want)) > 1000 and by_id(got) == by_id(want)
    assert got.count() == got.select("id").distinct().count()
    assert progress[-1]["stateOperators"]


def test_state_is_that_of_the_window(spark):
    """Twice as long a stream leaves the same state."""
    held = []
    for minutes in (8, 16):
        flows = [(i, "a", START + timedelta(seconds=i)) for i in range(minutes * 60)]
        _, progress = run(spark, [flows[k : k + 120] for k in range(0, len(flows), 120)], "10 seconds")
        held.append([s["numRowsTotal"] for s in progress[-1]["stateOperators"]])
    assert held[0] == held[1] and max(held[0]) < 100
