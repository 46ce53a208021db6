"""Streaming ingest of hand-written files: whole-file payloads, rejects, arrival, purging, many copies."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from flowsieve.operators.upkeep import RETENTION_MINUTES
from flowsieve.session import scratch_path
from flowsieve.sources.store import FlowStore
from flowsieve.streaming import ingest

PRETTY = '[\n  {"src_ip": "10.0.0.1",\n   "dst_ip": "8.8.8.8", "bytes": 10},\n  {"src_ip": "10.0.0.2", "dst_ip": "8.8.8.8", "bytes": "many"}\n]\n'


def deliver(spark, root, state, **options):
    store = FlowStore(spark, f"{root}/store")
    ingest.start_ingest(spark, f"{root}/in", store, f"{root}/{state}", available_now=True, **options).awaitTermination()
    return store


def test_whole_file_payloads_and_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(PRETTY)
    (tmp_path / "in" / "b.json").write_text("not json\nat all")
    store = deliver(spark, str(tmp_path), "state", kind="json-files")
    first = store.flows().select("id", "timestamp", "src_ip", "bytes").collect()
    assert [(r.src_ip, r.bytes) for r in first] == [("10.0.0.1", 10)] and first[0].timestamp is not None
    assert sorted((r.reason, r.value[:3]) for r in store.rejects().collect()) == [("bytes", "[\n "), ("payload", "not")]
    counts = spark.read.schema(ingest.ACCOUNTING).json(f"{store.root}/accounting").first()
    assert (counts.ingested, counts.queued, counts.scored, counts.rejected, counts.purged) == (1, 1, 1, 2, 0)
    # Records without a time keep that of the first delivery.
    again = deliver(spark, str(tmp_path), "again", kind="json-files").flows().select("id", "timestamp", "src_ip", "bytes").collect()
    assert again == first


def test_purge_reads_figures_only(spark):
    store = FlowStore(spark, scratch_path(spark, "store"))
    extra = F.lit(None).cast(store.flows().schema["extra"].dataType).alias("extra")
    start = datetime(2024, 1, 1, 23, 50, tzinfo=timezone.utc)
    for batch in range(4):
        at = F.lit(start + timedelta(minutes=10 * batch))
        rows = spark.range(5).select((F.col("id") + 10 * batch).alias("id"), at.alias("timestamp"), F.lit("a").alias("src_ip"), F.lit("b").alias("dst_ip"), F.lit("TCP").alias("proto"), F.lit(1).alias("bytes"), extra)
        store.write_flows(rows, batch)
    assert store.figures().count() == 4
    assert store.flows_since(start + timedelta(minutes=10)).count() == 15  # over the day's end
    assert store.purge(start + timedelta(minutes=RETENTION_MINUTES + 5), max_rows=0) == (1, 5)
    assert store.purge(start, minutes=0, max_rows=6) == (1, 5)  # the two newest batches hold the six newest rows
    assert store.flows().select("batch").distinct().count() == store.figures().count() == 2
    assert store.purge(start, minutes=0, max_rows=0) == (0, 0)


def test_copies_of_one_line(spark):
    lines = spark.range(3 * ingest.COPIES + 7).select(F.lit("f").alias("file"), F.lit("same").alias("value"))
    ids = ingest.numbered_lines(lines, 2).agg(F.count_distinct("id"), F.count("id"), F.min("id")).first()
    assert ids[0] == ids[1] == 3 * ingest.COPIES + 7 and ids[2] == 2 * ingest.BATCH_IDS + 1


PAYLOADS = ['{"src_ip": "10.0.0.1", "bytes": 1}', '[{"src_ip": "10.0.0.2", "bytes": "many"}, null, {"src_ip": "10.0.0.2", "bytes": 2}]', "[]", "17", "null", "", "not json", "[null]"]


def test_payloads_are_parsed_once(spark, tmp_path, monkeypatch):
    """Rejects keep their text without a second parse and without a join; empty lists and lists of nulls are no rejects."""
    parses, from_json = [], F.from_json
    monkeypatch.setattr(ingest.flow_json.F, "from_json", lambda *a, **k: parses.append(a) or from_json(*a, **k))
    lines = spark.createDataFrame([("f", p) for p in PAYLOADS], "file string, value string")
    flows, rejects = ingest.payloads_to_flows(lines, F.timestamp_seconds(F.lit(0)))
    assert len(parses) == 1
    assert sorted((r.src_ip, r.bytes) for r in flows.collect()) == [("10.0.0.1", 1), ("10.0.0.2", 2)]
    want = [("bytes", PAYLOADS[1])] + [("payload", p) for p in PAYLOADS if lines.where(F.col("value") == p).transform(ingest.flow_json.rejected_payloads).count()]
    assert ("payload", "17") in want and ("payload", "[]") not in want
    assert sorted((r.reason, r.value) for r in rejects.collect()) == sorted(want)


def test_batch_is_joined_with_no_copy_of_itself(spark, monkeypatch):
    """The heuristic's flows and predictions come of one pass: the rows stored are read from where they were scored."""
    flows = spark.range(50).select("id", F.timestamp_seconds(F.col("id")).alias("timestamp"), F.lit("10.0.0.1").alias("src_ip"), F.lit("8.8.8.8").alias("dst_ip"), F.lit("TCP").alias("proto"), F.lit(10).alias("bytes"))
    store = FlowStore(spark, scratch_path(spark, "store"))
    flows = flows.withColumn("extra", F.lit(None).cast(store.flows().schema["extra"].dataType))
    plans, write = [], store.write_flows
    monkeypatch.setattr(store, "write_flows", lambda df, batch: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, batch))
    counts = ingest.process_batch(store, flows, 0, now=datetime(2024, 1, 1, tzinfo=timezone.utc), retention_minutes=0, retention_rows=0)
    assert counts["scored"] == store.flows().count() == 50 and "Join" not in plans[0]
