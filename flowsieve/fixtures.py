"""The driver's tables seen as flows, predictions, logs and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.schema import EXTRA, SERIES_FOLDERS, SERIES_LEVELS
from flowsieve.session import spread

ORIGIN_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key, values, default):
    chain = None
    for k, v in values.items():
        chain = F.when(key == k, v) if chain is None else chain.when(key == k, v)
    return chain.otherwise(default)


def flow_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat flow rows: id, timestamp, ts_us, src_ip, dst_ip, proto (as sent), bytes, dst_port, service, k, user_id.

    Time runs 100 times faster than in the events, so that bursts occur.
    """
    raw = spread(table(spark, sf_dir, "events")).selectExpr(
        "event_id AS id",
        f"{ORIGIN_US} + CAST(floor((unix_micros(CAST(ts AS TIMESTAMP)) - {ORIGIN_US}) / 100) AS BIGINT) AS ts_us",
        "user_id",
        "event_type",
        "value",
        "CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k",
    )
    return raw.selectExpr(
        "id",
        "timestamp_micros(ts_us) AS timestamp",
        "ts_us",
        """CASE user_id % 6
             WHEN 0 THEN concat('192.168.1.', user_id % 10 + 1) WHEN 1 THEN concat('10.0.0.', user_id % 10 + 1)
             WHEN 2 THEN concat('8.8.4.', user_id % 10 + 1) WHEN 3 THEN concat('203.0.113.', user_id % 10 + 1)
             WHEN 4 THEN concat('host-', user_id % 10) ELSE '' END AS src_ip""",
        "CASE id % 4 WHEN 0 THEN '1.1.1.1' WHEN 1 THEN '192.168.1.50' WHEN 2 THEN '172.16.8.4' ELSE '9.9.9.9' END AS dst_ip",
        """CASE event_type WHEN 'click' THEN '6' WHEN 'view' THEN ' tcp ' WHEN 'purchase' THEN '17'
             WHEN 'error' THEN '58' ELSE '99' END AS proto""",
        "CAST(floor(value * 200) AS BIGINT) AS bytes",
        """CAST(CASE k % 10 WHEN 0 THEN 443 WHEN 1 THEN 53 WHEN 2 THEN 22 WHEN 3 THEN 8443 WHEN 4 THEN 3306
             WHEN 5 THEN 0 ELSE 1000 + k * 17 END AS BIGINT) AS dst_port""",
        "CASE k % 7 WHEN 0 THEN 'portscan' WHEN 1 THEN 'http' WHEN 2 THEN 'dns' END AS service",
        "k",
        "user_id",
    )


_GIVEN = {
    "src_port": "k * 31 + 5",
    "dst_port": "dst_port",
    "src_bytes": "CASE WHEN id % 5 = 0 THEN bytes - 50 END",
    "dst_bytes": "CASE WHEN id % 10 = 0 THEN k * 10 END",
    "src_pkts": "CASE WHEN id % 7 = 0 THEN k - 20 END",
    "dst_pkts": "CASE WHEN id % 9 = 0 THEN k END",
    "dns_qclass": "CASE WHEN id % 6 = 1 THEN 1 END",
    "dns_qtype": "CASE WHEN id % 6 = 1 THEN 28 END",
    "dns_rcode": "CASE WHEN id % 12 = 1 THEN 3 END",
    "http_status_code": "CASE WHEN id % 8 = 3 THEN 200 + k END",
    "http_request_body_len": "CASE WHEN id % 8 = 2 THEN k * 3 END",
    "http_response_body_len": "CASE WHEN id % 8 = 3 THEN k * 7 END",
    "duration": "CASE WHEN id % 3 = 0 THEN k / 64D - 0.25D END",
    "dns_query": "CASE WHEN id % 6 = 1 THEN concat('host', k, '.example.com') END",
    "http_method": "CASE WHEN id % 8 = 2 THEN 'get' END",
    "http_uri": "CASE WHEN id % 8 = 2 THEN concat('/item/', k) END",
    "http_referrer": "CASE WHEN id % 16 = 2 THEN 'http://example.org/' END",
    "http_version": "CASE WHEN id % 8 = 2 THEN '1.1' END",
    "http_user_agent": "CASE WHEN id % 8 = 2 THEN concat('agent/', id % 9) END",
    "http_orig_mime_types": "CASE WHEN id % 24 = 2 THEN 'text/plain' END",
    "http_resp_mime_types": "CASE WHEN id % 8 = 3 THEN 'text/html' END",
    "weird_name": "CASE WHEN id % 50 = 0 THEN 'bad_checksum' END",
    "weird_addl": "CASE WHEN id % 50 = 0 THEN 'len' END",
    "weird_notice": "CASE WHEN id % 50 = 0 THEN 'F' END",
    "ssl_cipher": "CASE WHEN id % 11 = 4 THEN 'TLS_AES_128_GCM_SHA256' END",
    "service": "service",
    "ssl_version": "CASE WHEN id % 11 = 4 THEN 771 END",
    "attack_type": "CASE WHEN id % 40 = 7 THEN 'injection' END",
}


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the nested attribute struct filled where the source row suggests a value."""
    fields = ", ".join(
        f"'{x.name}', CAST({_GIVEN.get(x.name, 'NULL')} AS {x.dataType.simpleString()})" for x in EXTRA.fields
    )
    return flow_columns(spark, sf_dir).selectExpr(
        "id", "timestamp", "ts_us", "src_ip", "dst_ip", "proto", "bytes", f"named_struct({fields}) AS extra"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with gaps, null scores and labels, and a second row for some flows."""
    base = flow_columns(spark, sf_dir).where("id % 10 <> 9").selectExpr(
        "id",
        "id AS flow_id",
        "CASE WHEN id % 11 = 0 THEN NULL ELSE least(1D, bytes / 40000D) END AS score",
        """CASE id % 8 WHEN 0 THEN 'normal' WHEN 1 THEN 'watch' WHEN 2 THEN 'anomaly' WHEN 3 THEN 'ddos'
             WHEN 4 THEN 'Scanning' WHEN 5 THEN NULL ELSE 'normal' END AS label""",
        "timestamp AS created_at",
    )
    later = base.where("id % 13 = 0").selectExpr(
        "id + 100000000 AS id", "flow_id", "score / 2 AS score", "'dos' AS label", "created_at + INTERVAL 1 SECOND AS created_at"
    )
    return base.unionByName(later)


def block_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        flow_columns(spark, sf_dir)
        .where("id % 500 = 0 AND src_ip <> ''")
        .select(
            F.col("src_ip").alias("ip"),
            F.when(F.col("id") % 1000 == 0, F.lit("unblock")).otherwise(F.lit("block")).alias("action"),
            F.col("timestamp").alias("at"),
        )
    )


def reverse_dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flow_columns(spark, sf_dir)
    return f.select(F.col("src_ip").alias("ip")).where("ip <> ''").distinct().select("ip", (F.length("ip") % 2 == 0).alias("resolved"))


def traffic_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    src = (
        F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("192.168.0."), (F.col("l_suppkey") % 200).cast("string")))
        .when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit("10.1.0."), (F.col("l_suppkey") % 200).cast("string")))
    )
    udp = F.col("l_linenumber") % 3 == 0
    none = F.lit(None).cast("string")
    return li.select(
        ((F.col("l_orderkey") % 7200).cast("double") + F.lit(1704067200.0)).alias("timestamp"),
        src.alias("src_ip"),
        F.concat(F.lit("172.217.0."), (F.col("l_partkey") % 250).cast("string")).alias("dst_ip"),
        F.floor(F.col("l_quantity") * 30).cast("bigint").cast("string").alias("length"),
        F.when(udp, F.lit(17)).otherwise(F.lit(6)).cast("bigint").alias("protocol"),
        none.alias("tcp_src"),
        F.when(~udp, (F.col("l_partkey") % 1024).cast("string")).alias("tcp_dst"),
        none.alias("udp_src"),
        F.when(udp, F.lit("53")).alias("udp_dst"),
        F.lit("eth:ip").alias("layers"),
    )


def labelled_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of the calibrated detector, with a row key."""
    li = table(spark, sf_dir, "lineitem")
    proto = _pick(F.col("l_linenumber") % 3, {0: F.lit("tcp"), 1: F.lit("udp")}, F.lit("-"))
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"),
        (F.col("l_quantity") * 100).cast("string").alias("sbytes"),
        F.when(F.col("l_orderkey") % 17 == 0, F.lit("n/a")).otherwise(F.col("l_extendedprice").cast("string")).alias("dbytes"),
        F.when(F.col("l_orderkey") % 19 == 0, F.lit(None)).otherwise(proto).alias("proto"),
        F.when(F.col("l_returnflag") == "R", F.lit("1")).otherwise(F.lit("0")).alias("label"),
    )


def merged_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text training rows with dirty cells and columns the cleaning drops."""
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("string")
    dirty = _pick(F.col("o_orderkey") % 9, {0: F.lit("-"), 1: F.lit("?"), 2: F.lit(""), 3: F.lit(None), 4: F.lit(" -")}, price)
    return o.select(
        (F.col("o_orderkey") % 5).cast("string").alias("attack_type"),
        F.col("o_orderkey").cast("string").alias("row_id"),
        dirty.alias("f_amount"),
        _pick(F.col("o_custkey") % 4, {0: F.lit("?")}, F.col("o_custkey").cast("string")).alias("f_cust"),
        F.substring("o_orderpriority", 1, 1).alias("f_prio"),
        F.col("o_orderstatus").alias("label"),
        F.lit("mix").alias("dataset_source"),
        F.lit("x").alias("type"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-series rows with the eleven detector features, one per order, with folder and level."""
    li = table(spark, sf_dir, "lineitem")
    udp = F.col("l_linenumber") % 3 == 0
    back = F.col("l_returnflag") == "R"
    price = F.floor("l_extendedprice").cast("bigint")
    n = lambda cond: F.count_if(cond).cast("double")
    s = lambda cond: F.coalesce(F.sum(F.when(cond, price)), F.lit(0)).cast("double")
    rows = li.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n_flows"),
        F.sum(F.floor("l_quantity").cast("bigint")).cast("double").alias("n_packets"),
        F.sum(price).cast("double").alias("n_bytes"),
        (F.max("l_linenumber") - F.min("l_linenumber")).cast("double").alias("avg_duration"),
        (n(~udp) / (n(udp) + 1)).alias("tcp_udp_ratio_packets"),
        (s(~udp) / (s(udp) + 1)).alias("tcp_udp_ratio_bytes"),
        ((n(back) + 1) / (n(~back) + 1)).alias("dir_ratio_packets"),
        ((s(back) + 1) / (s(~back) + 1)).alias("dir_ratio_bytes"),
        (F.sum(F.col("l_partkey") % 128) / F.count(F.lit(1))).alias("avg_ttl"),
        F.count_distinct(F.col("l_partkey") % 100).cast("double").alias("n_dest_ports"),
        F.count_distinct("l_suppkey").cast("double").alias("n_dest_ip"),
    )
    names = lambda values: F.array(*[F.lit(v) for v in values])
    return rows.select(
        "*",
        F.get(names(SERIES_FOLDERS), (F.col("row_id") % 4).cast("int")).alias("folder"),
        F.get(names(SERIES_LEVELS), (F.col("row_id") % 3).cast("int")).alias("agg_level"),
    )


def packet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated packet text, one line per event, some blank, short or overlong."""
    f = flow_columns(spark, sf_dir)
    text = lambda c: c.cast("string")
    tcp, udp = F.col("id") % 3 == 0, F.col("id") % 3 == 1
    web, tls = F.col("id") % 12 == 0, F.col("id") % 12 == 6
    only = lambda cond, c: F.when(cond, c).otherwise(F.lit(""))
    port = text(F.col("dst_port"))
    whole = F.floor(F.col("ts_us") / 1_000_000).cast("bigint")
    fields = [
        F.concat(text(whole), F.lit("."), F.lpad(text(F.col("ts_us") - whole * 1_000_000), 6, "0")),
        F.col("src_ip"),
        F.col("dst_ip"),
        F.when(tcp, F.lit("6")).when(udp, F.lit("17")).otherwise(F.lit("58")),
        F.when(F.col("k") % 13 == 0, F.lit("big")).otherwise(text(F.col("bytes"))),
        only(tcp, text(F.col("k") + 40000)),
        only(tcp, port),
        only(udp, text(F.col("k") + 50000)),
        only(udp, port),
        only(udp & (F.col("dst_port") == 53), F.concat(F.lit("h"), text(F.col("k")), F.lit(".example.net"))),
        only(udp & (F.col("dst_port") == 53), F.lit("0x1c")),
        only(udp & (F.col("dst_port") == 53), F.lit("1")),
        F.lit(""),
        only(web, F.lit("POST")),
        only(web, F.concat(F.lit("http://s/"), text(F.col("k")))),
        only(web, F.lit(" agent ")),
        only(F.col("id") % 12 == 3, F.lit("200")),
        only((F.col("id") % 3 == 0), text(F.col("k") * 5)),
        only(tls, F.lit("0x0303")),
        only(tls, F.lit("0xc02f")),
    ]
    full = F.concat_ws("\t", *fields)
    line = (
        F.when(F.col("id") % 101 == 100, F.lit(" \t "))
        .when(F.col("id") % 7 == 6, F.concat(full, F.lit("\tmore\tcells")))
        .otherwise(full)
    )
    return f.select("id", line.alias("value"))


def json_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON flow payloads, one per event: objects, lists of two, and unusable scalars."""
    f = flow_columns(spark, sf_dir)
    t = lambda c: c.cast("string")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    kind = F.col("id") % 6
    port = (
        F.when(kind == 0, t(F.col("dst_port")))
        .when(kind == 1, q(t(F.col("dst_port"))))
        .when(kind == 2, F.concat(t(F.col("dst_port")), F.lit(".75")))
        .when(kind == 3, q(F.concat(t(F.col("dst_port")), F.lit(".7"))))
        .when(kind == 4, F.lit("true"))
        .otherwise(F.lit("null"))
    )
    when = (
        F.when(kind == 0, F.concat(t(F.floor(F.col("ts_us") / 1_000_000).cast("bigint")), F.lit(".5")))
        .when(kind == 1, q(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .when(kind == 2, q(F.lit("1700000000")))
        .otherwise(F.lit("null"))
    )
    size = F.when(F.col("k") % 11 == 0, F.lit('"many"')).when(kind == 3, q(t(F.col("bytes")))).otherwise(t(F.col("bytes")))
    record = F.concat(
        F.lit('{"src_ip": '), q(F.col("src_ip")), F.lit(', "dst_ip": '), q(F.col("dst_ip")),
        F.lit(', "proto": '), q(F.col("proto")), F.lit(', "bytes": '), size, F.lit(', "ts": '), when,
        F.lit(', "dst_port": '), port, F.lit(', "duration": '),
        F.when(kind == 2, q(F.lit(" 1.5 "))).otherwise(F.concat(t(F.col("k")), F.lit(".25"))),
        F.lit(', "service": '), F.when(kind == 5, F.lit("null")).otherwise(q(F.lit(" HTTP "))),
        F.lit(', "ssl_version": "0x303", "unknown": [1], "http_uri": '), q(F.concat(F.lit(" /p/"), t(F.col("k")))), F.lit("}"),
    )
    payload = (
        F.when(F.col("id") % 50 == 49, F.lit("17"))
        .when(F.col("id") % 2 == 0, record)
        .otherwise(F.concat(F.lit("["), record, F.lit(", "), record, F.lit("]")))
    )
    return f.select("id", payload.alias("value"))
