"""Operators whose groups may be very uneven, against brute force."""

import random
from bisect import bisect_left, bisect_right
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators import lookups, ordered, sampling, upkeep
from flowsieve.operators.burst import RETROACTIVE, TRAILING, with_burst

SPAN = 90_000_000


def skewed_flows(seed=3, n=3000):
    """One source holds over a third of the rows, many of them on one microsecond or one second."""
    rng = random.Random(seed)
    base = 1_700_000_000_000_000
    rows = []
    for i in range(n):
        hot = i % 5 < 2
        src = "10.0.0.1" if hot else rng.choice(["a", "b", "", "c", "192.168.0.9"])
        at = rng.choice([base, base + rng.randrange(1_000_000), base + rng.randrange(400_000_000), base + SPAN, base + SPAN - 1, base + SPAN + 1])
        rows.append((i, src, at if rng.random() < 0.9 else -rng.randrange(300_000_000)))
    return rows


@pytest.mark.parametrize("block", [1, 10, 90])
def test_burst_counts(spark, block):
    rows = skewed_flows()
    times = defaultdict(list)
    for _, src, at in rows:
        times[src].append(at)
    for v in times.values():
        v.sort()
    df = spark.createDataFrame(rows, "id bigint, src_ip string, us bigint").withColumn("timestamp", F.timestamp_micros("us"))
    for mode in (RETROACTIVE, TRAILING):
        got = {r["id"]: r["burst_count"] for r in with_burst(df, mode, block_seconds=block).collect()}
        for i, src, at in rows:
            v = times[src]
            end = len(v) if mode == RETROACTIVE else bisect_right(v, at)
            assert got[i] == (0 if src == "" else end - bisect_left(v, at - SPAN) - 1)


def test_running_totals_and_quantiles(spark):
    rng = random.Random(5)
    values = [1.0] * 4000 + [rng.gauss(0, 1) for _ in range(3000)] + [float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for q in (0.0, 0.25, 0.5, 0.99):
        assert ordered.exact_quantile(df, "x", q).first()[0] == pytest.approx(float(np.quantile(np.array(values), q)))
    counted = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = {r["x"]: (r["cum_n"], r["all_n"]) for r in ordered.running_totals(counted, "x", ["n"], descending=True, ranges=7).collect()}
    arr = np.array(values)
    assert all(got[x] == (int((arr >= x).sum()), len(values)) for x in set(values))


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 50 == 1, "y"))
    got = ordered.hash_rank(df, F.col("id"), 9, ["g"]).collect()
    groups = defaultdict(list)
    for r in got:
        groups[r["g"]].append(r["rank"])
    assert sum(len(v) for v in groups.values()) == 5000
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in groups.values())


def test_samples_and_splits(spark):
    df = spark.range(3000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    first = sorted(r["id"] for r in sampling.exact_sample(df, F.col("id"), 100).collect())
    again = sorted(r["id"] for r in sampling.exact_sample(df.repartition(7), F.col("id"), 100).collect())
    assert len(first) == 100 and first == again
    assert sampling.exact_sample(df, F.col("id"), 9999).count() == 3000
    train, test = sampling.fixed_split(df, F.col("id"), 500, 1000)
    a, b = {r["id"] for r in train.collect()}, {r["id"] for r in test.collect()}
    assert (len(a), len(b), a & b) == (1000, 500, set())
    train, held = sampling.stratified_split(df, "y", F.col("id"))
    assert held.count() == 600 and held.where("y = 1").count() == 60 and train.count() == 2400


def test_latest_and_first_with_a_hot_flow(spark):
    rows = [(i, 1 if i % 3 else i, i / 100, "l%d" % (i % 4), (i * 7) % 500) for i in range(900)]
    df = spark.createDataFrame(rows, "id bigint, flow_id bigint, score double, label string, s bigint").withColumn(
        "created_at", F.timestamp_seconds("s")
    )
    best, oldest = {}, {}
    for r in rows:
        key = (r[4], r[0])
        if r[1] not in best or key > best[r[1]][0]:
            best[r[1]] = (key, r[0])
        oldest[r[1]] = min(oldest.get(r[1], r[0]), r[0])
    assert {r["flow_id"]: r["id"] for r in lookups.latest_predictions(df).collect()} == {k: v[1] for k, v in best.items()}
    assert {r["flow_id"]: r["id"] for r in lookups.first_predictions(df).collect()} == oldest


def test_insert_if_absent_is_idempotent(spark):
    batch = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.2), (2, 2, 0.3)], "flow_id bigint, seq bigint, score double")
    none = batch.where("flow_id > 9")
    once = lookups.absent_predictions(none, batch)
    assert sorted((r["flow_id"], r["score"]) for r in once.collect()) == [(1, 0.1), (2, 0.3)]
    assert lookups.absent_predictions(once, batch).count() == 0


def test_block_list(spark):
    rows = [("a", "block", 1), ("a", "unblock", 5), ("b", "unblock", 2), ("c", "block", 3), ("c", "block", 9), ("d", "block", 4), ("d", "unblock", 4)]
    events = spark.createDataFrame(rows, "ip string, action string, s bigint").select("ip", "action", F.timestamp_seconds("s").alias("at"))
    state = upkeep.fold_block_events(events)
    got = {r["ip"]: (r["active"], r["s"]) for r in state.select("ip", "active", F.unix_seconds("created_at").alias("s")).collect()}
    assert got == {"a": (False, 1), "c": (True, 9), "d": (False, 4)}
    flows = spark.createDataFrame([(1, "c", "x"), (2, "x", "c"), (3, "a", "b")], "id bigint, src_ip string, dst_ip string")
    assert [r["id"] for r in lookups.without_blocked(flows, state).collect()] == [3]
    assert sorted((r["id"], r["blocked"]) for r in lookups.mark_blocked(flows, state).collect()) == [(1, True), (2, True), (3, False)]
    merged = upkeep.apply_block_events(state, events.where("ip = 'b'"))
    assert merged.count() == 3


def test_retention_limits(spark):
    flows = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 60).alias("timestamp"))
    now = F.timestamp_seconds(F.lit(99 * 60))
    assert upkeep.keep_fresh(flows, now).count() == 31
    assert upkeep.keep_fresh(flows, now, 0).count() == 100
    assert sorted(r["id"] for r in upkeep.retained(flows, now, 30, 5).collect()) == [95, 96, 97, 98, 99]
    assert upkeep.keep_newest(flows, 0).count() == 100
