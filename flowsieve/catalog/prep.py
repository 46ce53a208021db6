"""Sources, the traffic rollup and training-data preparation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsieve import fixtures
from flowsieve.catalog.base import FLOWS, fixed, q_fixed, register, with_ctes
from flowsieve.catalog.serving import stored_flows
from flowsieve.operators import ordered, rollup, sampling
from flowsieve.operators.evaluation import threshold_metrics
from flowsieve.schema import HOURLY_FEATURES, SERIES_FEATURES
from flowsieve.session import pinned, scratch_path
from flowsieve.sources import flow_json, packets, series, tables

_LOG = """log AS (
  SELECT CAST(l_orderkey % 7200 AS DOUBLE) + 1704067200 AS t,
    CASE l_suppkey % 3 WHEN 0 THEN concat('192.168.0.', CAST(l_suppkey % 200 AS VARCHAR))
      WHEN 1 THEN concat('10.1.0.', CAST(l_suppkey % 200 AS VARCHAR)) END AS src_ip,
    concat('172.217.0.', CAST(l_partkey % 250 AS VARCHAR)) AS dst_ip,
    CAST(floor(l_quantity * 30) AS BIGINT) AS length,
    CASE l_linenumber % 3 WHEN 0 THEN 17 ELSE 6 END AS protocol,
    CASE WHEN l_linenumber % 3 = 0 THEN 53 ELSE l_partkey % 1024 END AS dst_port,
    l_suppkey % 3 <> 1 AS outgoing
  FROM lineitem)"""

_ROLLUP = (
    _LOG
    + f""", rolled AS (SELECT CAST(floor(t / 60) * 60 AS BIGINT) AS minute_s, count(DISTINCT src_ip) AS n_flows, count(src_ip) AS n_packets,
    CAST(sum(length) AS BIGINT) AS n_bytes, {q_fixed('max(t) - min(t)')} AS span_fx, count(DISTINCT dst_port) AS n_dest_ports,
    count(DISTINCT dst_ip) AS n_dest_ip,
    {q_fixed('count(*) FILTER (protocol = 6) / (count(*) FILTER (protocol = 17) + 1)::DOUBLE')} AS packets_fx,
    {q_fixed('(coalesce(sum(length) FILTER (outgoing), 0) + 1)::DOUBLE / (coalesce(sum(length) FILTER (NOT outgoing), 0) + 1)::DOUBLE')} AS bytes_fx
  FROM log GROUP BY 1)"""
)


def _rolled(log):
    r = rollup.minute_rollup(log)
    return r.select(
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


@register("e03_minute_rollup", with_ctes(_ROLLUP, "SELECT * FROM rolled"))
def minute_rollup(spark, sf):
    return _rolled(fixtures.traffic_log(spark, sf))


@register("a03_traffic_log_csv", with_ctes(_ROLLUP, "SELECT * FROM rolled"))
def traffic_log_csv(spark, sf):
    """The packet log written as header-less CSV, read back and rolled up."""
    path = scratch_path(spark, "traffic-log")
    fixtures.traffic_log(spark, sf).write.csv(path)
    return _rolled(tables.read_traffic_log(spark, path))


@register("a08_write_csv", with_ctes(_ROLLUP, "SELECT minute_s, n_flows, n_packets, n_bytes FROM rolled"))
def write_csv(spark, sf):
    path = scratch_path(spark, "rollup")
    tables.write_csv(_rolled(fixtures.traffic_log(spark, sf)), path)
    back = tables.read_text_csv(spark, path)
    return back.select(*[F.col(c).cast("bigint").alias(c) for c in ("minute_s", "n_flows", "n_packets", "n_bytes")])


@register(
    "a07_flow_table",
    with_ctes(FLOWS, "SELECT id, ts_us, src_ip, proto, bytes, dst_port FROM flows WHERE ts_us >= 1704067200000000 + 5000000000"),
)
def flow_table(spark, sf):
    """Flows written as a day-partitioned table and read back from a time on."""
    path = scratch_path(spark, "flows")
    tables.write_flows(stored_flows(spark, sf), path)
    cutoff = F.timestamp_micros(F.lit(fixtures.ORIGIN_US + 5_000_000_000))
    kept = tables.since(tables.read_flows(spark, path), cutoff)
    return kept.select("id", F.unix_micros("timestamp").alias("ts_us"), "src_ip", "proto", "bytes", "extra.dst_port")


@register(
    "a09_metrics_json",
    f"""WITH s AS (SELECT l_returnflag = 'R' AS y, l_quantity >= 25 AS p FROM lineitem)
        SELECT {q_fixed('count(*) FILTER (y AND p) / count(*) FILTER (p)')} AS precision_fx,
          {q_fixed('count(*) FILTER (y AND p) / count(*) FILTER (y)')} AS recall_fx FROM s""",
)
def metrics_json(spark, sf):
    li = fixtures.table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") / 50).alias("p")
    )
    path = scratch_path(spark, "metrics")
    tables.write_metrics(threshold_metrics(li, "y", "p", 0.5), path)
    back = spark.read.schema("precision double, recall double, f1 double, accuracy double").json(path)
    return back.select(fixed(F.col("precision")).alias("precision_fx"), fixed(F.col("recall")).alias("recall_fx"))


# --- packets ---

_PACKETS = FLOWS + """,
pk AS (SELECT *, id % 3 = 0 AS tcp, id % 3 = 1 AS udp, id % 3 = 1 AND dst_port = 53 AS dns, id % 12 = 0 AS web,
    id % 12 = 6 AS tls, id % 12 = 3 AS answered, id % 3 = 0 AS has_len,
    CASE WHEN id % 3 = 2 THEN NULL WHEN dst_port = 0 THEN NULL ELSE dst_port END AS dport,
    CASE id % 3 WHEN 0 THEN k + 40000 WHEN 1 THEN k + 50000 END AS sport,
    CASE id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMPV6' END AS pproto,
    CASE WHEN k % 13 = 0 THEN 0 ELSE bytes END AS plen
  FROM flows WHERE id % 101 <> 100)"""


@register(
    "a02_b10_b11_packet_flows",
    with_ctes(
        _PACKETS,
        """SELECT id, ts_us, src_ip, dst_ip, pproto AS proto, plen AS bytes, sport AS src_port, dport AS dst_port,
          CASE WHEN web THEN 'http' WHEN tls OR dport IN (443, 8443) THEN 'https' WHEN dns OR dport = 53 THEN 'dns'
            WHEN coalesce(dport, sport) = 22 THEN 'ssh' WHEN coalesce(dport, sport) = 3306 THEN 'mysql'
            WHEN coalesce(dport, sport) = 1433 THEN 'mssql' WHEN coalesce(dport, sport) = 1521 THEN 'oracle'
            ELSE lower(pproto) END AS service,
          CASE WHEN dns THEN concat('h', CAST(k AS VARCHAR), '.example.net') END AS dns_query,
          CASE WHEN dns THEN 28 END::BIGINT AS dns_qtype,
          CASE WHEN web THEN 'agent' END AS http_user_agent,
          CASE WHEN web THEN k * 5 END::BIGINT AS request_len, CASE WHEN answered THEN k * 5 END::BIGINT AS response_len,
          CASE WHEN tls THEN 771 END::BIGINT AS ssl_version, CASE WHEN tls THEN '0xc02f' END AS ssl_cipher
          FROM pk WHERE src_ip <> ''""",
    ),
)
def packet_flows(spark, sf):
    parsed = packets.ip_packets(packets.packet_fields(pinned(fixtures.packet_lines(spark, sf))))
    f = packets.packet_flows(parsed, F.timestamp_micros(F.lit(fixtures.ORIGIN_US)), keep=("id",))
    x = lambda n, name=None: F.col(f"extra.{n}").alias(name or n)
    return f.select(
        "id", F.unix_micros("timestamp").alias("ts_us"), "src_ip", "dst_ip", "proto", "bytes", x("src_port"), x("dst_port"),
        x("service"), x("dns_query"), x("dns_qtype"), x("http_user_agent"), x("http_request_body_len", "request_len"),
        x("http_response_body_len", "response_len"), x("ssl_version"), x("ssl_cipher"),
    )


@register(
    "a02_c06_packet_text_file",
    with_ctes(_PACKETS, "SELECT src_ip, pproto AS proto, count(*) AS n, CAST(sum(plen) AS BIGINT) AS bytes FROM pk WHERE src_ip <> '' GROUP BY 1, 2"),
)
def packet_text_file(spark, sf):
    """The packet lines written as text, read back and counted per source and protocol."""
    path = scratch_path(spark, "packets")
    fixtures.packet_lines(spark, sf).select("value").write.text(path)
    f = packets.packet_flows(packets.ip_packets(packets.read_packets(spark, path)), F.timestamp_micros(F.lit(0)))
    return f.groupBy("src_ip", "proto").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


# --- JSON payloads ---

_JSON = FLOWS + """,
js AS (SELECT *, id % 6 AS kind, CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END AS copies FROM flows WHERE id % 50 <> 49)"""


@register(
    "a01_b08_json_flows",
    with_ctes(
        _JSON,
        """SELECT id, pos, src_ip, dst_ip, proto, bytes,
          CASE kind WHEN 0 THEN ts_us // 1000000 * 1000000 + 500000 WHEN 1 THEN ts_us // 1000000 * 1000000 ELSE 1704067200000000 END AS ts_us,
          CASE kind WHEN 3 THEN dst_port * 10 + 7 WHEN 4 THEN 1 WHEN 5 THEN NULL ELSE dst_port END AS dst_port,
          CASE kind WHEN 2 THEN 1.5 ELSE k + 0.25 END::DOUBLE AS duration,
          CASE kind WHEN 5 THEN NULL ELSE 'http' END AS service, 771::BIGINT AS ssl_version, concat('/p/', CAST(k AS VARCHAR)) AS http_uri
          FROM js, (VALUES (0), (1)) v(pos) WHERE pos < copies AND k % 11 <> 0""",
    ),
)
def json_flows(spark, sf):
    records = flow_json.payload_records(pinned(fixtures.json_payloads(spark, sf)))
    f = flow_json.usable(
        flow_json.parsed_flows(records, F.timestamp_micros(F.lit(fixtures.ORIGIN_US)), keep=("id", "pos"))
    )
    x = lambda n: F.col(f"extra.{n}")
    return f.select(
        "id", "pos", "src_ip", "dst_ip", "proto", "bytes", F.unix_micros("timestamp").alias("ts_us"),
        x("dst_port"), x("duration"), x("service"), x("ssl_version"), x("http_uri"),
    )


@register(
    "a01_json_rejects",
    with_ctes(
        FLOWS,
        """SELECT 'payload' AS reason, count(*) AS n FROM flows WHERE id % 50 = 49 UNION ALL
           SELECT 'bytes', CAST(sum(CASE WHEN id % 2 = 0 THEN 1 ELSE 2 END) AS BIGINT) FROM flows WHERE id % 50 <> 49 AND k % 11 = 0""",
    ),
)
def json_rejects(spark, sf):
    p = pinned(fixtures.json_payloads(spark, sf))
    records = flow_json.rejected(flow_json.parsed_flows(flow_json.payload_records(p), F.timestamp_micros(F.lit(0))))
    bad_records = records.groupBy(F.col("rejected").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return flow_json.rejected_payloads(p).select(F.lit("payload").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    ).unionByName(bad_records)


# --- time series ---

SERIES_SQL = """series AS (
  SELECT l_orderkey AS row_id, count(*)::DOUBLE AS n_flows, sum(floor(l_quantity)::BIGINT)::DOUBLE AS n_packets,
    sum(floor(l_extendedprice)::BIGINT)::DOUBLE AS n_bytes,
    (max(l_linenumber) - min(l_linenumber))::DOUBLE AS avg_duration,
    count(*) FILTER (l_linenumber % 3 <> 0)::DOUBLE / (count(*) FILTER (l_linenumber % 3 = 0) + 1) AS tcp_udp_ratio_packets,
    coalesce(sum(floor(l_extendedprice)::BIGINT) FILTER (l_linenumber % 3 <> 0), 0)::DOUBLE
      / (coalesce(sum(floor(l_extendedprice)::BIGINT) FILTER (l_linenumber % 3 = 0), 0)::DOUBLE + 1) AS tcp_udp_ratio_bytes,
    (count(*) FILTER (l_returnflag = 'R') + 1)::DOUBLE / (count(*) FILTER (l_returnflag <> 'R') + 1)::DOUBLE AS dir_ratio_packets,
    (coalesce(sum(floor(l_extendedprice)::BIGINT) FILTER (l_returnflag = 'R'), 0)::DOUBLE + 1)
      / (coalesce(sum(floor(l_extendedprice)::BIGINT) FILTER (l_returnflag <> 'R'), 0)::DOUBLE + 1) AS dir_ratio_bytes,
    sum(l_partkey % 128)::DOUBLE / count(*) AS avg_ttl, count(DISTINCT l_partkey % 100)::DOUBLE AS n_dest_ports,
    count(DISTINCT l_suppkey)::DOUBLE AS n_dest_ip,
    CASE l_orderkey % 4 WHEN 0 THEN 'institutions' WHEN 1 THEN 'institution_subnets' WHEN 2 THEN 'ip_addresses_full' ELSE 'ip_addresses_sample' END AS folder,
    CASE l_orderkey % 3 WHEN 0 THEN 'agg_10_minutes' WHEN 1 THEN 'agg_1_hour' ELSE 'agg_1_day' END AS agg_level
  FROM lineitem GROUP BY 1)"""


def written_series(spark, sf, whole=False):
    """Series files by folder and level; hourly files carry other columns than the rest. whole: one file for each, in a task of its own."""
    base = scratch_path(spark, "series")
    s = fixtures.series(spark, sf)
    part = ["folder", "agg_level"]
    full = s.where("agg_level <> 'agg_1_hour'").select(*SERIES_FEATURES, *part)
    hourly = s.where("agg_level = 'agg_1_hour'").select(
        *[c for c in SERIES_FEATURES if c in HOURLY_FEATURES],
        F.when(F.col("row_id") % 5 != 0, F.col("n_dest_ports")).alias("sum_n_dest_ports"),
        F.lit("x").alias("note"),
        *part,
    )
    for frame in (full, hourly):
        frame = frame.repartition(*part) if whole else frame
        frame.write.mode("append").option("header", True).partitionBy(*part).csv(base)
    folders = tuple(f"folder={f}" for f in fixtures.SERIES_FOLDERS) + ("folder=absent",)
    return base, folders


@register(
    "a04_h02_series_complete",
    with_ctes(
        SERIES_SQL,
        f"""SELECT folder, agg_level, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS bytes, {q_fixed('max(avg_ttl)')} AS ttl_fx
            FROM series WHERE agg_level <> 'agg_1_hour' GROUP BY 1, 2""",
    ),
)
def series_complete(spark, sf):
    base, folders = written_series(spark, sf)
    files = series.series_files(spark, base, folders, tuple(f"agg_level={v}" for v in fixtures.SERIES_LEVELS))
    rows = series.read_complete(spark, files, SERIES_FEATURES)
    return rows.groupBy("folder", "agg_level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_bytes").cast("bigint").alias("bytes"), fixed(F.max("avg_ttl")).alias("ttl_fx")
    )


@register(
    "h01_c07_series_union",
    with_ctes(
        SERIES_SQL,
        """SELECT folder, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS bytes, CAST(sum(n_dest_ports) AS BIGINT) AS ports
           FROM series WHERE agg_level = 'agg_1_hour' AND row_id % 5 <> 0 GROUP BY 1""",
    ),
)
def series_union(spark, sf):
    """Union of every file's columns, then rows with any null dropped: only full hourly rows stay."""
    base, folders = written_series(spark, sf)
    files = series.series_files(spark, base, folders, tuple(f"agg_level={v}" for v in fixtures.SERIES_LEVELS))
    rows = rollup.without_nulls(series.read_any(spark, files, HOURLY_FEATURES))
    return rows.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("n_bytes").cast("bigint").alias("bytes"),
        F.sum("sum_n_dest_ports").cast("bigint").alias("ports"),
    )


@register(
    "g06_first_files",
    with_ctes(
        SERIES_SQL,
        """SELECT folder, agg_level, count(*) AS n FROM series WHERE folder = 'institutions'
           OR (folder = 'institution_subnets' AND agg_level = 'agg_10_minutes') GROUP BY 1, 2""",
    ),
)
def first_files(spark, sf):
    """The first four files by folder and level, each folder and level being one file."""
    base, folders = written_series(spark, sf, whole=True)
    files = series.series_files(spark, base, folders, tuple(f"agg_level={v}" for v in fixtures.SERIES_LEVELS), max_files=4)
    counted = series.read_any(spark, files, ("n_flows", "n_packets", "n_bytes")).groupBy("folder", "agg_level")
    return counted.agg(F.count(F.lit(1)).alias("n"))


@register(
    "c07_rows_without_nulls",
    with_ctes(_LOG, "SELECT src_ip, count(*) AS n FROM log WHERE src_ip IS NOT NULL GROUP BY 1"),
)
def rows_without_nulls(spark, sf):
    log = rollup.without_nulls(fixtures.traffic_log(spark, sf), ["timestamp", "src_ip"])
    return log.groupBy("src_ip").agg(F.count(F.lit(1)).alias("n"))


@register(
    "b36_ratio_features",
    with_ctes(
        SERIES_SQL,
        f"""SELECT row_id, {q_fixed('n_packets / (n_flows + 1)')} AS ppf_fx, {q_fixed('n_bytes / (n_packets + 1)')} AS bpp_fx,
          {q_fixed('n_flows / 2')} AS without_ports_fx, {q_fixed('n_flows / (n_dest_ports + 1)')} AS with_ports_fx FROM series""",
    ),
)
def ratio_features(spark, sf):
    s = fixtures.series(spark, sf)
    plain = rollup.ratio_features(s).withColumnRenamed("flows_to_ports_ratio", "without_ports")
    both = rollup.ratio_features(plain.withColumn("sum_n_dest_ports", F.col("n_dest_ports")))
    return both.select(
        "row_id",
        fixed(F.col("packets_per_flow")).alias("ppf_fx"),
        fixed(F.col("bytes_per_packet")).alias("bpp_fx"),
        fixed(F.col("without_ports")).alias("without_ports_fx"),
        fixed(F.col("flows_to_ports_ratio")).alias("with_ports_fx"),
    )


@register(
    "e11_quantile_label",
    with_ctes(
        SERIES_SQL + """, cut AS (SELECT quantile_cont(n_flows, 0.99) AS q, quantile_cont(n_bytes, 0.99) AS qb FROM series)""",
        """SELECT row_id, CASE WHEN n_flows > q THEN 1 ELSE 0 END AS anomaly, CASE WHEN n_bytes > qb THEN 1 ELSE 0 END AS heavy
           FROM series, cut""",
    ),
)
def quantile_label(spark, sf):
    s = fixtures.series(spark, sf)
    marked = ordered.mark_above_quantile(ordered.mark_above_quantile(s, "n_flows"), "n_bytes", name="heavy")
    return marked.select("row_id", "anomaly", "heavy")


@register(
    "e11_exact_quantiles",
    "SELECT CAST(floor(quantile_cont(l_extendedprice, 0.99) * 1000 + 0.5) AS BIGINT) AS p99, CAST(floor(quantile_cont(l_extendedprice, 0.5) * 1000 + 0.5) AS BIGINT) AS p50 FROM lineitem",
)
def exact_quantiles(spark, sf):
    li = fixtures.table(spark, sf, "lineitem")
    at = lambda q: F.floor(ordered.exact_quantile(li, "l_extendedprice", q).scalar() * 1000 + 0.5).cast("bigint")
    return spark.range(1).select(at(0.99).alias("p99"), at(0.5).alias("p50"))


@register(
    "e15_minmax_scale",
    with_ctes(
        SERIES_SQL,
        f"""SELECT row_id, {q_fixed('(n_bytes - min(n_bytes) OVER ()) / (max(n_bytes) OVER () - min(n_bytes) OVER ())')} AS bytes_fx,
            {q_fixed('(avg_ttl - min(avg_ttl) OVER ()) / (max(avg_ttl) OVER () - min(avg_ttl) OVER ())')} AS ttl_fx, 0::BIGINT AS flat_fx FROM series""",
    ),
)
def minmax_scale(spark, sf):
    s = fixtures.series(spark, sf).select("row_id", "n_bytes", "avg_ttl", F.lit(4.0).alias("flat"))
    scaled = rollup.scaled_columns(s, ["n_bytes", "avg_ttl", "flat"])
    return scaled.select(
        "row_id", fixed(F.col("n_bytes")).alias("bytes_fx"), fixed(F.col("avg_ttl")).alias("ttl_fx"), fixed(F.col("flat")).alias("flat_fx")
    )


# --- merged training data ---

_MERGED = """merged AS (
  SELECT CAST(o_orderkey % 5 AS VARCHAR) AS attack_type, CAST(o_orderkey AS VARCHAR) AS row_id,
    CASE o_orderkey % 9 WHEN 0 THEN '0' WHEN 1 THEN '0' WHEN 2 THEN '0' WHEN 3 THEN '0' WHEN 4 THEN ' -' END AS f_amount,
    CASE WHEN o_custkey % 4 = 0 THEN '0' ELSE CAST(o_custkey AS VARCHAR) END AS f_cust,
    substring(o_orderpriority, 1, 1) AS f_prio, o_totalprice, o_orderkey FROM orders)"""


@register(
    "b33_clean_cells",
    with_ctes(_MERGED, "SELECT attack_type, row_id, coalesce(f_amount, 'price') AS f_amount, f_cust, f_prio FROM merged"),
)
def clean_cells(spark, sf):
    cleaned = rollup.clean_cells(fixtures.merged_training(spark, sf))
    amount = F.when(F.col("row_id").cast("bigint") % 9 > 4, F.lit("price")).otherwise(F.col("f_amount"))
    return cleaned.withColumn("f_amount", amount)


@register(
    "a06_b34_target_classes",
    with_ctes(
        _MERGED,
        """SELECT CASE attack_type WHEN '0' THEN 0 WHEN '2' THEN 1 ELSE 2 END AS attack_type, CASE attack_type WHEN '0' THEN 0 ELSE 1 END AS attacked,
          CAST(row_id AS BIGINT) AS row_id, CAST(floor(CASE WHEN f_amount IS NULL THEN o_totalprice ELSE 0 END) AS BIGINT) AS amount,
          CAST(f_cust AS BIGINT) AS cust FROM merged WHERE attack_type IN ('0', '2', '3')""",
    ),
)
def target_class_rows(spark, sf):
    """Training CSV with surplus cells on some lines: those lines go, the rest is cleaned and remapped."""
    path = scratch_path(spark, "training")
    rows = rollup.clean_cells(fixtures.merged_training(spark, sf))
    line = F.concat_ws(",", *rows.columns)
    noisy = rows.select(F.explode(F.array(line, F.concat(line, F.lit(",surplus")))).alias("line"))
    noisy.write.text(path)
    back = tables.read_text_csv(spark, path, rows.columns)
    trained = rollup.target_classes(back)
    return trained.select(
        "attack_type",
        rollup.is_attack(F.col("attack_type")).alias("attacked"),
        F.col("row_id").cast("bigint").alias("row_id"),
        F.floor("f_amount").cast("bigint").alias("amount"),
        F.col("f_cust").cast("bigint").alias("cust"),
    )


# --- samples and splits ---


@register(
    "a05_g07_exact_sample",
    "SELECT least(1000, count(*)) AS rows, least(1000, count(*)) AS known, true AS same FROM lineitem",
)
def exact_sample(spark, sf):
    """A sample of the written rows: its size, those that the table has, and whether a second draw is the same."""
    path = scratch_path(spark, "labelled")
    whole = fixtures.labelled_flows(spark, sf)
    tables.write_csv(whole, path)
    sample, again = (pinned(tables.read_labelled_csv(spark, path, sample=1000)) for _ in range(2))
    key = lambda df: df.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("label").cast("string").alias("label"))
    known = key(sample).join(key(whole), ["row_id", "label"], "left_semi")
    count = lambda df: df.agg(F.count(F.lit(1))).scalar()
    sums = sample.agg(F.count(F.lit(1)).alias("rows"))
    return sums.withColumns({"known": count(known), "same": count(sample.exceptAll(again)) == 0})


@register("g07_exact_sample_counts", "SELECT 1000::BIGINT AS small, least(count(*), 150000) AS large, count(*) AS whole FROM lineitem")
def exact_sample_counts(spark, sf):
    f = fixtures.labelled_flows(spark, sf).select("row_id")
    key = F.col("row_id")
    size = lambda n: sampling.exact_sample(f, key, n).agg(F.count(F.lit(1)).alias("n")).scalar()
    return spark.range(1).select(size(1000).alias("small"), size(150_000).alias("large"), size(None).alias("whole"))


@register(
    "j18_fixed_split",
    """WITH t AS (SELECT count(DISTINCT l_orderkey) AS rows FROM lineitem)
       SELECT 'test' AS part, least(500, rows) AS n, 0::BIGINT AS shared FROM t
       UNION ALL SELECT 'train', greatest(0, least(4500, rows - 500)), 0 FROM t""",
)
def fixed_split(spark, sf):
    train, test = sampling.fixed_split(fixtures.series(spark, sf).select("row_id"), F.col("row_id"), 500, 4500)
    both = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    per_row = both.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("row_id")))
    return per_row.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("copies") > 1).alias("shared"))


@register(
    "j19_stratified_split",
    """SELECT CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS label, count(*) AS n, CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS held
       FROM lineitem GROUP BY 1""",
)
def stratified_split(spark, sf):
    marked = sampling.mark_holdout(fixtures.labelled_flows(spark, sf).select("row_id", "label"), "label", F.col("row_id"))
    return marked.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("holdout").alias("held"))


@register(
    "j20_stratified_folds",
    """SELECT label, fold::INT AS fold, (n + CASE fold WHEN 0 THEN 0 ELSE 5 - fold END) // 5 AS n FROM (
         SELECT CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS label, count(*) AS n FROM lineitem GROUP BY 1),
       (VALUES (0), (1), (2), (3), (4)) v(fold)""",
)
def stratified_folds(spark, sf):
    folded = sampling.stratified_folds(fixtures.labelled_flows(spark, sf).select("row_id", "label"), "label", F.col("row_id"))
    return folded.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))
