"""Streaming jobs run to the end of files derived from the driver tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from flowsieve import fixtures
from flowsieve.catalog.base import FLOWS, PREDICTIONS, fixed, register, with_ctes
from flowsieve.catalog.prep import _JSON, _PACKETS, _ROLLUP
from flowsieve.catalog.serving import stored_flows
from flowsieve.functions.scores import HEURISTIC_ANOMALY, HEURISTIC_WATCH, threshold_label
from flowsieve.schema import PREDICTIONS as PREDICTION_SCHEMA
from flowsieve.schema import TRAFFIC_LOG
from flowsieve.session import pinned, scratch_path
from flowsieve.sources.store import FlowStore
from flowsieve.streaming.ingest import ACCOUNTING, recent_history, start_ingest
from flowsieve.streaming.burst import state_store, streaming_bursts
from flowsieve.streaming.rollup import first_predictions_within, streaming_minutes, streaming_minutes_exact

#: Files of a batch.
FILES = 4
NOW = datetime(2024, 1, 2, tzinfo=timezone.utc)

# Trailing bursts: the stored rows are all there is once the stream has ended.
_STREAMED = _PACKETS + """,
fl AS (SELECT * FROM pk WHERE src_ip <> '' AND src_ip <> '8.8.4.3'),
bursts AS (SELECT *, count(*) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN 90000000 PRECEDING AND CURRENT ROW) - 1 AS n FROM fl)"""


def _deliver(spark, root, rdns, kind, state, **options):
    """The files below <root>/in, _parts() of them a batch, to the store; a new state folder delivers all of them anew."""
    store = FlowStore(spark, f"{root}/store")
    options = {"now": NOW, "retention_minutes": 0, "retention_rows": 0, **options}
    query = start_ingest(
        spark, f"{root}/in", store, f"{root}/{state}", kind, available_now=True, files_per_trigger=_parts(spark),
        rdns=rdns, **options,
    )
    query.awaitTermination()
    return store


def _parts(spark):
    """Files of a delivery's batch, so that all cores write and read it."""
    return spark.sparkContext.defaultParallelism


def _ingested(spark, sf, kind="packets", batches=2, **options):
    """(store, root, names): all lines delivered in some batches; the reverse-DNS names are found once, for every batch."""
    root = scratch_path(spark, "ingest")
    lines = fixtures.packet_lines(spark, sf) if kind == "packets" else fixtures.json_payloads(spark, sf)
    lines.select("value").repartition(batches * _parts(spark)).write.text(f"{root}/in")
    store = FlowStore(spark, f"{root}/store")
    block = spark.range(1).select(F.lit("8.8.4.3").alias("ip"), F.lit("block").alias("action"), F.lit(NOW).alias("at"))
    store.write_block_events(block, 0)
    rdns = pinned(fixtures.reverse_dns(spark, sf))
    _deliver(spark, root, rdns, kind, "state", **options)
    return store, root, rdns


def _accounting(spark, store):
    return spark.read.schema(ACCOUNTING).json(f"{store.root}/accounting")


@register(
    "l01_l03_packet_stream",
    with_ctes(
        _STREAMED,
        """SELECT src_ip, pproto AS proto, count(*) AS n, CAST(sum(plen) AS BIGINT) AS bytes, count(*) AS scored, count(*) AS graded
           FROM fl GROUP BY 1, 2""",
    ),
)
def packet_stream(spark, sf):
    """Packets in two micro-batches: stored flows, every one with one prediction whose label follows its score."""
    store, *_ = _ingested(spark, sf)
    joined = store.flows().join(store.predictions().select("flow_id", "score", "label"), F.col("id") == F.col("flow_id"), "left")
    graded = F.col("label") == threshold_label(F.col("score"), HEURISTIC_ANOMALY, HEURISTIC_WATCH)
    return joined.groupBy("src_ip", "proto").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.count("flow_id").alias("scored"), F.count_if(graded).alias("graded")
    )


@register(
    "l02_e16_stream_redelivery",
    with_ctes(
        _PACKETS,
        """SELECT delivery, count(*) FILTER (src_ip <> '8.8.4.3') AS ingested, count(*) FILTER (src_ip = '8.8.4.3') AS blocked,
             count(*) FILTER (src_ip <> '8.8.4.3') AS queued, 0::BIGINT AS rejected, 0::BIGINT AS purged,
             count(*) FILTER (src_ip <> '8.8.4.3') AS stored, true AS same
           FROM pk, (VALUES (1), (2)) d(delivery) WHERE src_ip <> '' GROUP BY 1""",
    ),
)
def stream_redelivery(spark, sf):
    """All source files delivered a second time, to the same store: the same counts, flows and predictions."""
    store, root, rdns = _ingested(spark, sf, now=None)
    content = lambda: (
        store.flows().agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "timestamp", "src_ip", "dst_ip", "bytes", F.to_json("extra")) % (1 << 40))).first(),
        store.predictions().agg(F.count(F.lit(1)), F.sum(F.xxhash64("flow_id", "score", "label", "created_at") % (1 << 40))).first(),
    )
    sums = lambda: _accounting(spark, store).agg(*[F.sum(c) for c in ("ingested", "blocked", "queued", "rejected", "purged")]).first()
    before, first = content(), sums()
    _deliver(spark, root, rdns, "packets", "again", now=None)
    after, second = content(), sums()
    rows = [(n, *map(int, s), int(c[0][0]), c == before) for n, s, c in ((1, first, before), (2, second, after))]
    return spark.createDataFrame(rows, "delivery int, ingested long, blocked long, queued long, rejected long, purged long, stored long, same boolean")


@register("l04_burst_with_history", with_ctes(_STREAMED, "SELECT src_ip, count(*) AS n, CAST(sum(n) AS BIGINT) AS bursts FROM bursts WHERE id % 2 = 0 GROUP BY 1"))
def burst_with_history(spark, sf):
    """Half the flows stored, the other half arriving: bursts count both."""
    from flowsieve.operators.burst import TRAILING, with_burst
    from flowsieve.sources import packets

    parsed = packets.ip_packets(packets.packet_fields(pinned(fixtures.packet_lines(spark, sf))))
    f = packets.packet_flows(parsed, F.lit(NOW), keep=("id",)).where("src_ip <> '8.8.4.3'")
    store = FlowStore(spark, scratch_path(spark, "history"))
    store.write_flows(f.where("id % 2 = 1"), 0)
    arriving = f.where("id % 2 = 0")
    counted = with_burst(arriving, TRAILING, history=recent_history(store, arriving, 1))
    return counted.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.sum("burst_count").alias("bursts"))


@register(
    "l04_burst_on_stream",
    with_ctes(
        _STREAMED,
        """SELECT src_ip, count(*) AS n, CAST(sum(n) AS BIGINT) AS bursts, max(n) AS most FROM bursts
           WHERE (ts_us // 30000000 + 1) * 30000000 <= (SELECT max(ts_us) FROM fl) // 1000 * 1000 - 60000000 GROUP BY 1""",
    ),
)
def burst_on_stream(spark, sf):
    """Four batches, the second holding the first's flows again: the state's counts of closed blocks, without a store."""
    from flowsieve.sources import packets

    parsed = packets.ip_packets(packets.packet_fields(pinned(fixtures.packet_lines(spark, sf))))
    f = packets.packet_flows(parsed, F.lit(NOW), keep=("id",)).where("src_ip <> '8.8.4.3'").select("id", "src_ip", "timestamp")
    root = scratch_path(spark, "bursts")
    # Quarters of the time line, each a batch of a few files; flows delivered again are late or counted already.
    quarter = F.least(F.lit(3), F.floor((F.unix_micros("timestamp") - F.lit(fixtures.ORIGIN_US)) / F.lit(6_480_000_000)).cast("int"))
    dealt = pinned(f.withColumn("part", quarter))
    for part in range(4):
        dealt.where(F.col("part").isin(part, 0) if part == 1 else F.col("part") == part).drop("part").repartition(FILES, "id").write.parquet(f"{root}/in/{part}")
    flows = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", FILES).option("recursiveFileLookup", True).parquet(f"{root}/in")
    with state_store(spark):
        counted = streaming_bursts(flows, "1 minute")
        query = counted.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"), F.sum("burst_count").alias("bursts"), F.max("burst_count").alias("most"))


_JSON_COUNTS = _JSON + """,
r AS (SELECT CASE WHEN id % 50 = 49 THEN 1 ELSE 0 END AS payload, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS copies, k % 11 = 0 AS bad, src_ip
  FROM flows)
SELECT CAST(sum(copies) FILTER (payload = 0 AND NOT bad AND src_ip <> '8.8.4.3') AS BIGINT) AS stored,
  CAST(sum(copies) FILTER (payload = 0 AND NOT bad AND src_ip <> '8.8.4.3') AS BIGINT) AS scored,
  CAST(sum(copies) FILTER (payload = 0 AND NOT bad AND src_ip = '8.8.4.3') AS BIGINT) AS blocked,
  CAST(sum(payload) AS BIGINT) AS payloads, CAST(sum(copies) FILTER (payload = 0 AND bad) AS BIGINT) AS records,
  CAST(sum(payload) + sum(copies) FILTER (payload = 0 AND bad) AS BIGINT) AS rejected FROM r"""


@register("l03_json_stream", "WITH " + _JSON_COUNTS)
def json_stream(spark, sf):
    """Payload lines: what is stored, scored, blocked and rejected."""
    store, *_ = _ingested(spark, sf, "json")
    sums = _accounting(spark, store).agg(F.sum("blocked").alias("blocked"), F.sum("rejected").alias("rejected"))
    reasons = store.rejects().agg(F.count_if(F.col("reason") == "payload").alias("payloads"), F.count_if(F.col("reason") != "payload").alias("records"))
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return sums.join(reasons, F.lit(True)).withColumns({"stored": count(store.flows()), "scored": count(store.predictions())})


@register("l03_k01_k03_stream_retention", "SELECT true AS purged, true AS cascaded, true AS fits")
def stream_retention(spark, sf):
    """A late clock purges the whole store; a row limit keeps whole batches that hold the newest rows."""
    late, *_ = _ingested(spark, sf, now=datetime(2030, 1, 1, tzinfo=timezone.utc), retention_minutes=30)
    few, *_ = _ingested(spark, sf, batches=4, retention_rows=100)
    gone = late.flows().isEmpty() and late.predictions().isEmpty()
    orphans = few.predictions().join(few.flows().select(F.col("id").alias("kept")), F.col("flow_id") == F.col("kept"), "left_anti").isEmpty()
    kept = few.flows().select("batch").distinct().count()
    return spark.createDataFrame([(gone, orphans, 1 <= kept < 4)], "purged boolean, cascaded boolean, fits boolean")


_CLOSED = "WHERE minute_s + 60 <= (SELECT max(t) - 60 FROM log)"


def _closed_minutes(spark, sf, rolled):
    root = scratch_path(spark, "minutes")
    fixtures.traffic_log(spark, sf).write.csv(f"{root}/in")
    log = spark.readStream.schema(TRAFFIC_LOG).csv(f"{root}/in")
    query = (
        rolled(log, "1 minute")
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select(
        F.unix_seconds("minute").alias("minute_s"),
        "n_flows",
        "n_packets",
        F.col("n_bytes").cast("bigint").alias("n_bytes"),
        fixed(F.col("avg_duration")).alias("span_fx"),
        "n_dest_ports",
        "n_dest_ip",
        fixed(F.col("tcp_udp_ratio_packets")).alias("packets_fx"),
        fixed(F.col("dir_ratio_bytes")).alias("bytes_fx"),
    )


# Four batches by id; after each the newest rows of all so far that are not older than two hours.
_RETIRED = FLOWS + """,
clock AS (SELECT b, 1704067200000000 + (b + 1) * 6480000000 AS now_us FROM range(4) r(b)),
held AS (SELECT b, count(*) FILTER (id % 4 = b) AS arrived, least(count(*) FILTER (ts_us >= now_us - 7200000000), 300) AS left_rows
  FROM clock JOIN flows ON id % 4 <= b GROUP BY b, now_us)"""


@register(
    "l03_e16_retired_rows",
    with_ctes(_RETIRED, "SELECT b AS batch, left_rows AS \"left\", coalesce(lag(left_rows) OVER (ORDER BY b), 0) + arrived - left_rows AS purged FROM held"),
)
def retired_rows(spark, sf):
    """Rows left and purged after each of four batches, by age and number."""
    store, rows = FlowStore(spark, scratch_path(spark, "retire")), []
    flows = pinned(stored_flows(spark, sf))
    for batch in range(4):
        store.write_flows(flows.where(F.col("id") % 4 == batch), batch)
        store.finish(batch)
        purged = store.retire(batch, fixtures_time(batch + 1), minutes=120, max_rows=300)
        rows.append((batch, store.served()[0].count(), purged))
    return spark.createDataFrame(rows, "batch long, left long, purged long")


def fixtures_time(quarter):
    return datetime.fromtimestamp(fixtures.ORIGIN_US / 1e6 + quarter * 6480, timezone.utc)


@register("l05_streaming_minutes", with_ctes(_ROLLUP, f"SELECT minute_s, n_packets, n_bytes, span_fx, packets_fx, bytes_fx FROM rolled {_CLOSED}"))
def stream_minutes(spark, sf):
    """Minutes closed by the watermark; the last two stay open."""
    return _closed_minutes(spark, sf, streaming_minutes).drop("n_flows", "n_dest_ports", "n_dest_ip")


@register("l05_streaming_minutes_exact", with_ctes(_ROLLUP, f"SELECT minute_s, n_flows, n_packets, n_bytes, span_fx, n_dest_ports, n_dest_ip, packets_fx, bytes_fx FROM rolled {_CLOSED}"))
def stream_minutes_exact(spark, sf):
    """Closed minutes with their exact distinct counts, as the batch rollup has them."""
    return _closed_minutes(spark, sf, streaming_minutes_exact)


@register("l06_first_predictions_stream", with_ctes(PREDICTIONS, "SELECT flow_id, min(id) AS id FROM predictions GROUP BY 1"))
def first_predictions_stream(spark, sf):
    """Later predictions of a flow come in a later file; the first one stays."""
    root = scratch_path(spark, "firsts")
    p = fixtures.predictions(spark, sf)
    for k, part in enumerate((p.where("id < 100000000"), p.where("id >= 100000000"))):
        part.repartition(FILES, "id").write.parquet(f"{root}/in/{k}")
    rows = spark.readStream.schema(PREDICTION_SCHEMA).option("maxFilesPerTrigger", FILES).option("recursiveFileLookup", True).parquet(f"{root}/in")
    query = (
        first_predictions_within(rows)
        .writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("flow_id", "id")
