"""Scoring and monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve import fixtures
from flowsieve.catalog.base import (
    ADDRESSED,
    FLOWS,
    LATEST,
    PREDICTIONS,
    SERVED,
    fixed,
    q_fixed,
    q_severity,
    register,
    with_ctes,
)
from flowsieve.functions import scores
from flowsieve.functions.network import protocol_name
from flowsieve.operators import lookups, sampling, upkeep
from flowsieve.operators.burst import RETROACTIVE, TRAILING, burst_points, with_burst
from flowsieve.plans import scoring, serving


def stored_flows(spark, sf):
    """Flows as stored: protocol already normalised."""
    return fixtures.flows(spark, sf).withColumn("proto", protocol_name(F.col("proto")))


_BURST = """count(*) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN 90000000 PRECEDING AND {end}) - 1"""
_UNBOUNDED = _BURST.format(end="UNBOUNDED FOLLOWING")
_CURRENT = _BURST.format(end="CURRENT ROW")

_HEURISTIC = (
    ADDRESSED
    + f""",
counted AS (SELECT *, CASE WHEN src_ip = '' THEN 0 ELSE {_UNBOUNDED} END AS burst FROM addressed),
scored AS (SELECT *, greatest(0.0, least(1.0, 0.15::DOUBLE
   + 0.45::DOUBLE * CASE WHEN bytes <= 0 THEN 0.0 ELSE least(1.0::DOUBLE, pow(bytes / 20000.0::DOUBLE, 0.6::DOUBLE)) END
   + 0.25::DOUBLE * least(1.0::DOUBLE, burst / 60.0::DOUBLE)
   + CASE WHEN src_ip = '' OR dst_ip = '' THEN 0.0 WHEN sp AND NOT dp THEN 0.07 WHEN NOT sp AND dp THEN 0.05
       WHEN NOT sp AND NOT dp THEN 0.03 ELSE 0.0 END::DOUBLE
   + CASE upper(proto) WHEN 'ICMP' THEN 0.08 WHEN 'UDP' THEN 0.05 WHEN 'SCTP' THEN 0.04 WHEN 'GRE' THEN 0.03 ELSE 0.0 END::DOUBLE
   + CAST(concat('0x', substring(sha1(concat(src_ip, '-', dst_ip, '-', proto, '-', CAST(ts_us // 1000000 AS VARCHAR))), 1, 6)) AS BIGINT)
     / 16777215.0::DOUBLE * 0.05::DOUBLE)) AS hscore FROM counted),
labelled AS (SELECT *, CASE WHEN hscore >= 0.85 THEN 'anomaly' WHEN hscore >= 0.65 THEN 'watch' ELSE 'normal' END AS hlabel FROM scored)"""
)


@register(
    "j06_heuristic_score",
    with_ctes(_HEURISTIC, f"SELECT id, src_ip, dst_ip, proto, bytes, burst AS burst_count, {q_fixed('hscore')} AS score_fx, hlabel AS label FROM labelled"),
)
def heuristic(spark, sf):
    scored = scoring.score_heuristic(stored_flows(spark, sf))
    return scored.select(
        "id", "src_ip", "dst_ip", "proto", "bytes", "burst_count", fixed(F.col("score")).alias("score_fx"), "label"
    )


@register(
    "f01_burst_retroactive",
    with_ctes(FLOWS, f"SELECT id, CASE WHEN src_ip = '' THEN 0 ELSE {_UNBOUNDED} END AS burst_count FROM flows"),
)
def burst_retroactive(spark, sf):
    return with_burst(fixtures.flow_columns(spark, sf), RETROACTIVE).select("id", "burst_count")


@register(
    "f01_burst_trailing",
    with_ctes(FLOWS, f"SELECT id, CASE WHEN src_ip = '' THEN 0 ELSE {_CURRENT} END AS burst_count FROM flows"),
)
def burst_trailing(spark, sf):
    return with_burst(fixtures.flow_columns(spark, sf), TRAILING).select("id", "burst_count")


@register(
    "d07_burst_by_supplier",
    f"""WITH flows AS (SELECT l_orderkey, l_linenumber, concat('s', CAST(l_suppkey AS VARCHAR)) AS src_ip,
            epoch_us(l_shipdate) // 10000 + l_orderkey * 1000 AS ts_us FROM lineitem)
        SELECT l_orderkey, l_linenumber, ts_us, {_CURRENT} AS trailing_count, {_UNBOUNDED} AS later_count FROM flows""",
)
def burst_by_supplier(spark, sf):
    """Burst counts on the largest table, each supplier a source."""
    li = fixtures.table(spark, sf, "lineitem")
    us = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 10000).cast("bigint") + F.col("l_orderkey") * 1000
    f = li.select(
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src_ip"),
        us.alias("ts_us"),
        F.timestamp_micros(us).alias("timestamp"),
    )
    points = burst_points(f).withColumnRenamed("ts_us", "us")
    same = (f["src_ip"] == points["src_ip"]) & (F.col("ts_us") == F.col("us"))
    return f.join(points, same).select(
        "l_orderkey",
        "l_linenumber",
        "ts_us",
        (F.col("seen_until") - 1).alias("trailing_count"),
        (F.col("seen_from") - 1).alias("later_count"),
    )


@register("d02_f02_latest_prediction", with_ctes(LATEST, "SELECT id, has_prediction, score, label FROM joined"))
def latest(spark, sf):
    j = lookups.with_latest_prediction(fixtures.flow_columns(spark, sf), fixtures.predictions(spark, sf))
    return j.select("id", "has_prediction", "score", "label")


@register(
    "a10_flow_projection",
    with_ctes(
        SERVED,
        """SELECT id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S'), CASE WHEN ts_us % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END, '+00:00') AS ts,
          src_ip, dst_ip, upper(proto) AS proto, bytes, sscore AS score, slabel AS label,
          CASE WHEN coalesce(slabel, '') <> '' AND lower(slabel) NOT IN ('normal','watch','anomaly') THEN slabel ELSE stored_attack END AS attack_type
          FROM served""",
    ),
)
def flow_projection(spark, sf):
    j = lookups.with_latest_prediction(stored_flows(spark, sf), fixtures.predictions(spark, sf))
    return lookups.served_flows(j).drop("extra")


_ANOMALOUS = "has_prediction AND ((lower(coalesce(label, '')) NOT IN ('', 'normal')) OR coalesce(score, 0) >= 0.6)"


@register("c01_anomalous_flows", with_ctes(LATEST, f"SELECT id FROM joined WHERE {_ANOMALOUS}"))
def anomalous(spark, sf):
    j = lookups.with_latest_prediction(fixtures.flow_columns(spark, sf), fixtures.predictions(spark, sf))
    return serving.anomalous_only(j).select("id")


_RECENT = SERVED + """,
recent AS (SELECT * FROM served ORDER BY ts_us DESC, id DESC LIMIT 400)"""


@register(
    "c01_recent_anomalous",
    with_ctes(_RECENT, f"SELECT id, sscore AS score, slabel AS label FROM recent WHERE {_ANOMALOUS}"),
)
def recent_anomalous(spark, sf):
    return serving.anomalous_flows(stored_flows(spark, sf), fixtures.predictions(spark, sf)).select("id", "score", "label")


@register(
    "c02_anomaly_panel",
    with_ctes(
        _RECENT,
        f"""SELECT id, sscore AS score, slabel AS label FROM recent
            WHERE {_ANOMALOUS} AND (({q_severity('slabel', 'sscore')}) <> 'normal' OR sscore >= 0.6)""",
    ),
)
def anomaly_panel(spark, sf):
    f, p = stored_flows(spark, sf), fixtures.predictions(spark, sf)
    columns = ("id", "score", "label")
    view = serving.anomalous_view(serving.anomalous_flows(f, p).select(*columns), serving.recent_flows(f, p).select(*columns))
    return view


@register(
    "c02_anomaly_panel_fallback",
    with_ctes(
        SERVED + ", quiet AS (SELECT id, 0.0 AS score, 'normal' AS label FROM served WHERE bytes < 0), "
        "loud AS (SELECT id, least(1.0, bytes / 20000.0::DOUBLE) AS score, NULL::VARCHAR AS label FROM flows)",
        "SELECT id, score, label FROM loud WHERE score >= 0.6",
    ),
)
def anomaly_panel_fallback(spark, sf):
    """No anomalous flow at all: the panel falls back to every recent one."""
    f = fixtures.flow_columns(spark, sf)
    recent = f.select(
        "id", F.least(F.lit(1.0), F.col("bytes") / F.lit(20000.0)).alias("score"), F.lit(None).cast("string").alias("label")
    )
    return serving.anomalous_view(recent.where("score < 0"), recent)


@register("c03_by_source", with_ctes(FLOWS, "SELECT id, src_ip FROM flows WHERE contains(lower(src_ip), 'host-4')"))
def by_source(spark, sf):
    return serving.by_source(fixtures.flow_columns(spark, sf), " HOST-4 ").select("id", "src_ip")


@register("c04_d06_fetch_by_ids", with_ctes(FLOWS, "SELECT id, bytes FROM flows WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)"))
def fetch_by_ids(spark, sf):
    ids = fixtures.table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return lookups.fetch_by_ids(fixtures.flow_columns(spark, sf), ids).select("id", "bytes")


@register(
    "e01_anomaly_stats",
    with_ctes(
        _RECENT,
        f"""SELECT count(*) FILTER (sscore > 0.9) AS "count", {q_fixed('max(sscore)')} AS max_fx,
            {q_fixed('100.0 * count(*) FILTER (sscore > 0.9) / count(*)')} AS pct_fx FROM recent""",
    ),
)
def anomaly_stats(spark, sf):
    recent = serving.recent_with_prediction(stored_flows(spark, sf), fixtures.predictions(spark, sf))
    return serving.anomaly_stats(recent).select(
        "count", fixed(F.col("raw_max_score")).alias("max_fx"), fixed(F.col("raw_pct_anomalous")).alias("pct_fx")
    )


@register(
    "e01_anomaly_stats_all",
    with_ctes(
        SERVED,
        f"""SELECT count(*) FILTER (sscore > 0.9) AS "count", {q_fixed('max(sscore)')} AS max_fx,
            {q_fixed('100.0 * count(*) FILTER (sscore > 0.9) / count(*)')} AS pct_fx FROM served""",
    ),
)
def anomaly_stats_all(spark, sf):
    whole = lookups.with_latest_prediction(stored_flows(spark, sf), fixtures.predictions(spark, sf))
    return serving.anomaly_stats(whole).select(
        "count", fixed(F.col("raw_max_score")).alias("max_fx"), fixed(F.col("raw_pct_anomalous")).alias("pct_fx")
    )


@register(
    "e02_severity_mix",
    with_ctes(
        SERVED,
        f"""SELECT s.severity, count(g) AS n FROM (VALUES ('anomaly'), ('watch'), ('normal')) s(severity)
            LEFT JOIN (SELECT {q_severity('slabel', 'sscore')} AS g FROM served) ON g = s.severity GROUP BY 1""",
    ),
)
def severity_mix(spark, sf):
    j = lookups.with_latest_prediction(stored_flows(spark, sf), fixtures.predictions(spark, sf))
    return serving.severity_mix(lookups.served_flows(j))


@register("g01_recent_flows", with_ctes(_RECENT, "SELECT id, sscore AS score, slabel AS label FROM recent"))
def recent_flows(spark, sf):
    return serving.recent_flows(stored_flows(spark, sf), fixtures.predictions(spark, sf)).select("id", "score", "label")


@register("g02_newest_first", with_ctes(FLOWS, "SELECT id, ts_us FROM flows ORDER BY ts_us DESC, id DESC"))
def newest_first(spark, sf):
    return fixtures.flow_columns(spark, sf).orderBy(F.desc("timestamp"), F.desc("id")).select("id", "ts_us")


@register(
    "g03_timeline",
    with_ctes(
        SERVED + ", t AS (SELECT * FROM served ORDER BY ts_us DESC, id DESC LIMIT 30)",
        f"SELECT id, strftime(ts, '%H:%M:%S') AS ts_label, sscore AS score, {q_severity('slabel', 'sscore')} AS severity FROM t",
    ),
)
def timeline(spark, sf):
    return serving.timeline(stored_flows(spark, sf), fixtures.predictions(spark, sf))


@register(
    "f05_chart_rows",
    with_ctes(
        _RECENT,
        f"""SELECT CAST(row_number() OVER (ORDER BY ts_us DESC, id DESC) - 1 AS INT) AS "index", sscore AS score,
            {q_severity('slabel', 'sscore')} AS severity, slabel AS label, src_ip FROM recent""",
    ),
)
def chart_rows(spark, sf):
    return serving.chart_rows(stored_flows(spark, sf), fixtures.predictions(spark, sf))


# --- attack names ---

_SCAN = """CASE WHEN contains(lower(coalesce(service, '')), 'scan')
      OR (((dst_port <> 0 AND dst_port <= 1024) OR (src_port <> 0 AND src_port <= 1024)) AND bytes <= 20000) THEN 'scanning' END"""


@register("j09_infer_scanning", with_ctes(FLOWS, f"SELECT id, {_SCAN} AS scan FROM flows"))
def infer_scanning(spark, sf):
    f = fixtures.flows(spark, sf)
    x = lambda n: F.col(f"extra.{n}")
    return f.select("id", scores.infer_scanning(x("service"), x("src_port"), x("dst_port"), F.col("bytes")).alias("scan"))


_RESOLVED = LATEST + f""",
hinted AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'dos' WHEN id % 3 = 1 THEN 'normal' END AS hint, {_SCAN} AS scan,
   coalesce(label, '') AS lab FROM joined),
resolved AS (SELECT *, CASE WHEN lab <> '' AND lower(lab) NOT IN ('normal','watch','anomaly') THEN lab
     WHEN hint IS NOT NULL AND lower(lab) NOT IN ('', 'normal') THEN CASE WHEN hint <> 'normal' THEN hint END
     WHEN lower(lab) IN ('normal','watch') THEN scan END AS attack FROM hinted)"""


def _resolved(spark, sf):
    j = lookups.with_latest_prediction(fixtures.flows(spark, sf), fixtures.predictions(spark, sf))
    hint = F.when(F.col("id") % 3 == 0, F.lit("dos")).when(F.col("id") % 3 == 1, F.lit("normal"))
    return scoring.with_attack_type(j.withColumn("attack_label", hint))


@register("j08_attack_resolution", with_ctes(_RESOLVED, "SELECT id, attack AS attack_type FROM resolved"))
def attack_resolution(spark, sf):
    return _resolved(spark, sf).select("id", "attack_type")


@register(
    "k06_retag_flows",
    with_ctes(_RESOLVED, "SELECT id, CASE WHEN id % 2 = 0 THEN attack ELSE stored_attack END AS attack_type, dst_port FROM resolved"),
)
def retag_flows(spark, sf):
    tags = _resolved(spark, sf).where("id % 2 = 0").select(F.col("id").alias("flow_id"), "attack_type")
    return upkeep.retag(fixtures.flows(spark, sf), tags).select("id", F.col("extra.attack_type"), F.col("extra.dst_port"))


# --- block list, reverse DNS, retention ---

_BLOCKS = FLOWS + """,
block_events AS (SELECT src_ip AS ip, CASE WHEN id % 1000 = 0 THEN 'unblock' ELSE 'block' END AS action, ts_us AS at_us
  FROM flows WHERE id % 500 = 0 AND src_ip <> ''),
block_list AS (SELECT ip, max_by(action, at_us * 2 + CASE action WHEN 'unblock' THEN 1 ELSE 0 END) = 'block' AS active,
    max(CASE WHEN action = 'block' THEN at_us END) AS created_us
  FROM block_events GROUP BY ip HAVING max(CASE WHEN action = 'block' THEN at_us END) IS NOT NULL)"""


@register("k04_block_list", with_ctes(_BLOCKS, "SELECT ip, active, created_us FROM block_list"))
def block_list(spark, sf):
    b = upkeep.fold_block_events(fixtures.block_events(spark, sf))
    return b.select("ip", "active", F.unix_micros("created_at").alias("created_us"))


@register("c05_g04_active_blocks", with_ctes(_BLOCKS, "SELECT ip, created_us FROM block_list WHERE active ORDER BY created_us DESC, ip DESC"))
def active_blocks(spark, sf):
    b = upkeep.fold_block_events(fixtures.block_events(spark, sf))
    return lookups.newest_blocks(b).select("ip", F.unix_micros("created_at").alias("created_us"))


@register("h03_block_upsert", with_ctes(_BLOCKS, "SELECT ip, active, created_us FROM block_list"))
def block_upsert(spark, sf):
    """A stored list brought up to date with later events equals the fold of all events."""
    events = fixtures.block_events(spark, sf)
    cut = F.timestamp_micros(F.lit(fixtures.ORIGIN_US + 12_960_000_000))
    stored = upkeep.fold_block_events(events.where(F.col("at") < cut))
    merged = upkeep.apply_block_events(stored, events.where(F.col("at") >= cut))
    return merged.select("ip", "active", F.unix_micros("created_at").alias("created_us"))


@register(
    "d01_without_blocked",
    with_ctes(
        _BLOCKS,
        """SELECT id, src_ip, dst_ip FROM flows WHERE src_ip NOT IN (SELECT ip FROM block_list WHERE active)
           AND dst_ip NOT IN (SELECT ip FROM block_list WHERE active)""",
    ),
)
def without_blocked(spark, sf):
    b = upkeep.fold_block_events(fixtures.block_events(spark, sf))
    return lookups.without_blocked(fixtures.flow_columns(spark, sf), b).select("id", "src_ip", "dst_ip")


@register(
    "e16_ingest_accounting",
    with_ctes(
        _BLOCKS + """, marked AS (SELECT src_ip IN (SELECT ip FROM block_list WHERE active)
              OR dst_ip IN (SELECT ip FROM block_list WHERE active) AS b FROM flows)""",
        "SELECT count(*) FILTER (NOT b) AS ingested, count(*) FILTER (b) AS blocked FROM marked",
    ),
)
def ingest_accounting(spark, sf):
    b = upkeep.fold_block_events(fixtures.block_events(spark, sf))
    marked = lookups.mark_blocked(fixtures.flow_columns(spark, sf), b)
    return marked.agg(F.count_if(~F.col("blocked")).alias("ingested"), F.count_if("blocked").alias("blocked"))


@register(
    "d03_reverse_dns",
    with_ctes(
        FLOWS + ", rdns AS (SELECT DISTINCT src_ip AS ip, length(src_ip) % 2 = 0 AS resolved FROM flows WHERE src_ip <> '')",
        """SELECT f.id, coalesce(r.resolved, false) AS rdns_exists, CAST(coalesce(r.resolved, false) AS BIGINT) AS rdns_hash, dst_port
           FROM flows f LEFT JOIN rdns r ON r.ip = CASE WHEN f.src_ip = '' THEN f.dst_ip ELSE f.src_ip END""",
    ),
)
def reverse_dns(spark, sf):
    f = lookups.with_reverse_dns(fixtures.flows(spark, sf), fixtures.reverse_dns(spark, sf))
    return f.select("id", "extra.rdns_exists", "extra.rdns_hash", "extra.dst_port")


@register(
    "d04_absent_predictions",
    with_ctes(
        PREDICTIONS + ", stored AS (SELECT DISTINCT flow_id FROM predictions WHERE flow_id % 3 = 0)",
        """SELECT flow_id, score, label FROM (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY id) AS rn FROM predictions)
           WHERE rn = 1 AND flow_id NOT IN (SELECT flow_id FROM stored)""",
    ),
)
def absent_predictions(spark, sf):
    p = fixtures.predictions(spark, sf)
    stored = p.where("flow_id % 3 = 0")
    return lookups.absent_predictions(stored, p.withColumn("seq", F.col("id"))).select("flow_id", "score", "label")


@register("e04_duplicate_keys", with_ctes(PREDICTIONS, "SELECT flow_id, count(*) AS n FROM predictions GROUP BY 1 HAVING count(*) > 1"))
def duplicate_keys(spark, sf):
    return lookups.duplicate_flow_ids(fixtures.predictions(spark, sf))


@register(
    "f03_k05_first_prediction",
    with_ctes(PREDICTIONS, "SELECT flow_id, min(id) AS id, arg_min(coalesce(label, '?'), id) AS label FROM predictions GROUP BY 1"),
)
def first_prediction(spark, sf):
    kept = lookups.first_predictions(fixtures.predictions(spark, sf))
    return kept.select("flow_id", "id", F.coalesce("label", F.lit("?")).alias("label"))


def _now(spark, sf):
    return F.timestamp_micros(F.lit(fixtures.ORIGIN_US + 25_000_000_000))


_FRESH = "ts_us >= 1704067200000000 + 25000000000 - 30 * 60000000"


@register("c08_k01_retention_by_age", with_ctes(FLOWS, f"SELECT id FROM flows WHERE {_FRESH}"))
def retention_by_age(spark, sf):
    return upkeep.keep_fresh(fixtures.flow_columns(spark, sf), _now(spark, sf)).select("id")


@register("g05_k02_retention_by_rows", with_ctes(FLOWS, "SELECT id FROM flows ORDER BY ts_us DESC, id DESC LIMIT 5000"))
def retention_by_rows(spark, sf):
    return upkeep.keep_newest(fixtures.flow_columns(spark, sf)).select("id")


@register(
    "d05_k03_retention_cascade",
    with_ctes(
        PREDICTIONS + f", kept AS (SELECT id FROM flows WHERE {_FRESH} ORDER BY ts_us DESC, id DESC LIMIT 500)",
        "SELECT id, flow_id FROM predictions WHERE flow_id IN (SELECT id FROM kept)",
    ),
)
def retention_cascade(spark, sf):
    kept = upkeep.retained(fixtures.flow_columns(spark, sf), _now(spark, sf), max_rows=500)
    return upkeep.cascade(fixtures.predictions(spark, sf), kept).select("id", "flow_id")
