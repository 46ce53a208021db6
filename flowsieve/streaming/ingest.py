"""Micro-batched ingest: records to stored flows to predictions."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowsieve.functions.scores import BURST_WINDOW_SECONDS
from flowsieve.operators.burst import TRAILING
from flowsieve.operators.lookups import absent_predictions, mark_blocked, set_extra, with_reverse_dns
from flowsieve.operators.ordered import hash_rank
from flowsieve.operators.upkeep import RETENTION_MINUTES, RETENTION_ROWS
from flowsieve.plans.pipeline import choose_scorer, prediction_rows
from flowsieve.plans.scoring import with_attack_type
from flowsieve.session import kept
from flowsieve.sources import flow_json, packets
from flowsieve.sources.store import FlowStore

# Fixed value: longest wait of a micro-batch.
TRIGGER_SECONDS = 2
#: Ids of a batch: its number times this, and the place of the record.
BATCH_IDS = 1 << 36
#: Copies of one line that are unfolded together.
COPIES = 4096
ACCOUNTING = "batch long, ingested long, blocked long, scored long, queued long, rejected long, purged long"


def numbered_lines(lines: DataFrame, batch_id: int = 0) -> DataFrame:
    """Lines (file, value) with an id that a second delivery of the same batch repeats.

    Equal lines of one file are told apart by a running number, made by counting them (which combines
    map-side) and unfolding the count, many copies in parts of their own. The id is the batch and the
    line's place in a repeatable order, so no two records share one.
    """
    counted = lines.groupBy("file", "value").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.select("file", "value", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("part"))
    parts = parts.repartition("file", "value", "part")
    first = F.col("part") * COPIES
    copies = parts.select("file", "value", F.explode(F.sequence(first + 1, F.least(F.col("n"), first + COPIES))).alias("copy"))
    return placed(copies, F.struct("file", "value", "copy"), batch_id).select("id", "value")


def placed(df: DataFrame, key: Column, batch_id: int) -> DataFrame:
    """Adds `id` from the batch and the rank of a unique key."""
    return hash_rank(df, key, 42).withColumn("id", F.lit(batch_id * BATCH_IDS) + F.col("rank")).drop("rank")


def packets_to_flows(lines: DataFrame, arrival: Column, batch_id: int = 0) -> tuple[DataFrame, None]:
    """Flows of capture lines; lines that are no IP packets are part of every capture and not counted."""
    parsed = packets.ip_packets(packets.packet_fields(numbered_lines(lines, batch_id)))
    return packets.packet_flows(parsed, arrival, keep=("id",)), None


def payloads_to_flows(lines: DataFrame, arrival: Column, batch_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """(flows, rejects): records that can be stored, and payloads and records that can't, with the reason.

    Payloads are parsed once; the text goes along only with what is rejected.
    """
    records = flow_json.payload_records(numbered_lines(lines, batch_id).withColumn("payload", F.col("value")), unusable=True)
    read = flow_json.parsed_flows(records, arrival, keep=("id", "pos", "payload"))
    # A payload without records has no place.
    reason = F.when(F.col("pos").isNull(), F.lit("payload")).otherwise(F.col("rejected"))
    parsed = kept(read.withColumn("rejected", reason).withColumn("payload", F.when(F.col("rejected").isNotNull(), F.col("payload"))))
    good = flow_json.usable(parsed).drop("payload").withColumnRenamed("id", "payload")
    flows = placed(good, F.struct("payload", "pos"), batch_id)
    rejects = flow_json.rejected(parsed).select("id", F.col("rejected").alias("reason"), F.col("payload").alias("value"))
    return flows.drop("payload", "pos"), rejects


def recent_history(store: FlowStore, batch: DataFrame, batch_id: int) -> DataFrame:
    """Stored flows of earlier batches that can fall into a burst window of this batch's sources.

    Later ones are left out: when a batch is delivered again, it has to see what it saw at first.
    """
    first = batch.agg(F.min("timestamp")).first()[0]
    if first is None:
        return store.flows().where(F.lit(False))
    stored = store.flows_since(first - timedelta(seconds=BURST_WINDOW_SECONDS)).where(F.col("batch") < batch_id)
    sources = batch.select(F.col("src_ip").alias("_src")).distinct()
    return stored.join(sources, F.col("src_ip") == F.col("_src"), "left_semi")


def process_batch(
    store: FlowStore,
    flows: DataFrame,
    batch_id: int,
    rdns: DataFrame | None = None,
    ensemble_path: str | None = None,
    detector_path: str | None = None,
    burst_mode: str = TRAILING,
    now: datetime | None = None,
    rejects: DataFrame | None = None,
    retention_minutes: int = RETENTION_MINUTES,
    retention_rows: int = RETENTION_ROWS,
) -> dict[str, int]:
    """Block-list filter, store, enrich, score, resolve attacks, store predictions, purge; returns the counts.

    Safe to run again for the same batch: its folders are overwritten with equal content, and without
    a given time the batch keeps that of its first delivery.
    """
    spark = store.spark
    now = now or store.arrival(batch_id)
    marked = mark_blocked(flows, store.block_list())
    marked = kept(marked if rdns is None else with_reverse_dns(marked, rdns))
    counts = marked.agg(F.count_if(~F.col("blocked")).alias("ingested"), F.count_if("blocked").alias("blocked")).first()
    accepted = marked.where(~F.col("blocked")).drop("blocked")
    mode, score = choose_scorer(spark, ensemble_path, detector_path, burst_mode)
    if mode == "heuristic":  # every flow comes back once, with all its columns
        resolved = with_attack_type(score(accepted, recent_history(store, accepted, batch_id)))
        tagged = kept(resolved.select(*accepted.columns, "score", "label", "attack_type"))
        scored = tagged.select("id", F.col("id").alias("flow_id"), "score", "label", F.lit(now).alias("created_at"))
    else:
        predicted = kept(prediction_rows(score(accepted, None), F.lit(now)))
        tagged = accepted.join(predicted.select("flow_id", "attack_type"), F.col("id") == F.col("flow_id"), "left")
        scored = predicted.drop("attack_type")
    store.write_flows(tagged.withColumn("extra", set_extra(tagged, attack_type=F.col("attack_type"))), batch_id)
    # Files whose ids don't reach into the batch's are left out by their statistics.
    ids = scored.agg(F.min("flow_id").alias("a"), F.max("flow_id").alias("b")).first()
    earlier = store.predictions().where(F.col("batch") < batch_id)
    earlier = earlier.where(F.col("flow_id").between(ids.a, ids.b)) if ids.a is not None else earlier.where(F.lit(False))
    store.write_predictions(absent_predictions(earlier, scored.withColumn("seq", F.col("id"))), batch_id)
    if rejects is not None:
        store.write_rejects(rejects, batch_id)
    stored = lambda df: df.where(F.col("batch") == batch_id).count()
    store.finish(batch_id)
    purged = store.retire(batch_id, now, retention_minutes, retention_rows)
    store.drop_stale(now, retention_minutes, retention_rows)
    return {
        "ingested": counts["ingested"],
        "blocked": counts["blocked"],
        "scored": stored(store.predictions()),
        "queued": counts["ingested"],
        "rejected": 0 if rejects is None else stored(store.rejects()),
        "purged": purged,
    }


def start_ingest(
    spark: SparkSession,
    source: str,
    store: FlowStore,
    checkpoint: str,
    kind: str = "packets",
    available_now: bool = False,
    files_per_trigger: int = 1000,
    **options,
) -> StreamingQuery:
    """Run the ingest over a folder that files are added to; counts per batch go to `<root>/accounting`.

    kind: packets, json (a payload on each line) or json-files (each file is one payload, over any
    number of lines).
    """
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.text(source, wholetext=kind == "json-files").select("value", F.col("_metadata.file_path").alias("file"))
    to_flows = packets_to_flows if kind == "packets" else payloads_to_flows

    def run(batch: DataFrame, batch_id: int) -> None:
        arrival = options.get("now") or store.arrival(batch_id)
        flows, rejects = to_flows(batch, F.lit(arrival), batch_id)
        counts = process_batch(store, flows, batch_id, rejects=rejects, **{**options, "now": arrival})
        row = [(batch_id, *(counts[k] for k in ("ingested", "blocked", "scored", "queued", "rejected", "purged")))]
        spark.createDataFrame(row, ACCOUNTING).coalesce(1).write.mode("overwrite").json(f"{store.root}/accounting/run={batch_id}")

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{TRIGGER_SECONDS} seconds")
    return writer.start()
