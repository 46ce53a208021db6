"""Retired rows against the rule applied to a list, with late rows, ties and a second delivery."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from flowsieve.session import scratch_path
from flowsieve.sources.store import FlowStore

START = datetime(2024, 1, 1, 23, 30, tzinfo=timezone.utc)


def write(spark, store, batch, rows):
    df = spark.createDataFrame(rows, "id long, timestamp timestamp")
    extra = F.lit(None).cast(store.flows().schema["extra"].dataType).alias("extra")
    store.write_flows(df.select("id", "timestamp", F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"), F.lit("TCP").alias("proto"), F.lit(1).alias("bytes"), extra), batch)


@pytest.mark.parametrize(("minutes", "max_rows"), [(20, 0), (0, 25), (20, 25), (1, 5)])
def test_rows_gone_are_those_of_the_rule(spark, minutes, max_rows):
    draw = random.Random(minutes + max_rows)
    store, table = FlowStore(spark, scratch_path(spark, "store")), []
    batches = []
    for b in range(4):
        now = START + timedelta(minutes=12 * (b + 1))
        # Some minutes are shared by several flows, some flows come late.
        batches.append((now, [(100 * b + i, now - timedelta(minutes=draw.randrange(0, 30 if i % 4 == 0 else 10))) for i in range(15)]))
    seen = []
    for again in (False, True):
        table = []
        for b, (now, rows) in enumerate(batches):
            if not again or b == 2:
                write(spark, store, b, rows)
                assert store.served()[0].where(F.col("batch") == b).count() == 0 or again  # not before its marker
                store.finish(b)
                purged = store.retire(b, now, minutes, max_rows)
            before = len(table) + len(rows)
            table = [r for r in table + rows if minutes <= 0 or r[1] >= now - timedelta(minutes=minutes)]
            table = sorted(table, key=lambda r: (r[1], r[0]))[-max_rows:] if max_rows else table
            if not again:
                assert purged == before - len(table)
                assert sorted(r.id for r in store.served()[0].collect()) == sorted(i for i, _ in table)
                seen.append(purged)
            elif b == 2:
                assert purged == seen[2]
    assert store.line().left == len(table)


def test_no_limit_retires_nothing(spark):
    store = FlowStore(spark, scratch_path(spark, "store"))
    write(spark, store, 0, [(1, START)])
    assert store.retire(0, START + timedelta(days=9), 0, 0) == 0 and store.line() is None
    assert store.served()[0].isEmpty() and store.served()[1].isEmpty()
    store.finish(0)
    assert store.served()[0].count() == 1
