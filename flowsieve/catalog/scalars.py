"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve import fixtures
from flowsieve.catalog.base import (
    ADDRESSED,
    FLOWS,
    LATEST,
    fixed,
    q_direction,
    q_fixed,
    q_hash,
    q_ipv4,
    q_private,
    q_severity,
    register,
    with_ctes,
)
from flowsieve.functions import network, scores, text
from flowsieve.operators import rollup
from flowsieve.operators.lookups import with_latest_prediction

_MAP_SERVING = "WHEN '1' THEN 'ICMP' WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' WHEN '41' THEN 'ENCAP' WHEN '47' THEN 'GRE' WHEN '50' THEN 'ESP' WHEN '51' THEN 'AH' WHEN '58' THEN 'ICMPv6' WHEN '132' THEN 'SCTP'"
_MAP_CAPTURE = "WHEN '1' THEN 'ICMP' WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP' WHEN '47' THEN 'GRE' WHEN '50' THEN 'ESP' WHEN '51' THEN 'AH' WHEN '58' THEN 'ICMPV6' WHEN '132' THEN 'SCTP'"


def _proto_sql(mapping: str) -> str:
    t = "trim(v, chr(9) || chr(10) || chr(13) || ' ')"
    return f"""WITH src AS (
      SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN concat(' ', event_type, chr(9))
        WHEN 2 THEN '  ' WHEN 3 THEN concat('0', CAST(event_id % 140 AS VARCHAR))
        ELSE CAST(event_id % 140 AS VARCHAR) END AS v FROM events)
      SELECT id, CASE WHEN v IS NULL OR {t} = '' THEN 'OTHER'
        WHEN regexp_full_match({t}, '[0-9]+') THEN coalesce(CASE {t} {mapping} END, concat('PROTO_', {t}))
        ELSE upper({t}) END AS proto FROM src"""


def _proto_source(spark, sf):
    e = fixtures.table(spark, sf, "events")
    number = (F.col("event_id") % 140).cast("string")
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_id") % 6 == 0, F.lit(None))
        .when(F.col("event_id") % 6 == 1, F.concat(F.lit(" "), "event_type", F.lit("\t")))
        .when(F.col("event_id") % 6 == 2, F.lit("  "))
        .when(F.col("event_id") % 6 == 3, F.concat(F.lit("0"), number))
        .otherwise(number)
        .alias("v"),
    )


@register("b01_protocol_serving", _proto_sql(_MAP_SERVING))
def protocol_serving(spark, sf):
    return _proto_source(spark, sf).select("id", network.protocol_name(F.col("v")).alias("proto"))


@register("b02_protocol_capture", _proto_sql(_MAP_CAPTURE))
def protocol_capture(spark, sf):
    return _proto_source(spark, sf).select("id", network.capture_protocol_name(F.col("v")).alias("proto"))


# Text of many shapes from one row: plain, padded, hex, signed, decimal, listed, empty, words.
_DIRTY_SQL = """WITH src AS (
  SELECT event_id AS id, CAST(event_id AS VARCHAR) AS n, CASE event_id % 9
    WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN concat('  ', CAST(event_id AS VARCHAR), ' ')
    WHEN 2 THEN concat('-', CAST(event_id AS VARCHAR)) WHEN 3 THEN concat(CAST(event_id AS VARCHAR), '.7')
    WHEN 4 THEN concat(CAST(event_id AS VARCHAR), ',', CAST(event_id % 100 AS VARCHAR))
    WHEN 5 THEN '' WHEN 6 THEN event_type WHEN 7 THEN concat('0x', lower(hex(event_id)))
    ELSE NULL END AS v FROM events)
"""


def _dirty(spark, sf):
    e = fixtures.table(spark, sf, "events")
    n = F.col("event_id").cast("string")
    kind = F.col("event_id") % 9
    return e.select(
        F.col("event_id").alias("id"),
        F.when(kind == 0, n)
        .when(kind == 1, F.concat(F.lit("  "), n, F.lit(" ")))
        .when(kind == 2, F.concat(F.lit("-"), n))
        .when(kind == 3, F.concat(n, F.lit(".7")))
        .when(kind == 4, F.concat(n, F.lit(","), (F.col("event_id") % 100).cast("string")))
        .when(kind == 5, F.lit(""))
        .when(kind == 6, F.col("event_type"))
        .when(kind == 7, F.concat(F.lit("0x"), F.lower(F.hex("event_id"))))
        .alias("v"),
    )


@register(
    "b03_int_from_text",
    _DIRTY_SQL
    + """SELECT id, CASE id % 9 WHEN 0 THEN id WHEN 1 THEN id WHEN 2 THEN -id WHEN 7 THEN id
         ELSE TRY_CAST(nullif(regexp_replace(v, '[^0-9]', '', 'g'), '') AS BIGINT) END AS n FROM src""",
)
def int_from_text(spark, sf):
    return _dirty(spark, sf).select("id", text.int_from_text(F.col("v")).alias("n"))


@register(
    "b04_int_from_packet_text",
    _DIRTY_SQL
    + """SELECT id, CASE id % 9 WHEN 0 THEN id WHEN 1 THEN id WHEN 2 THEN -id
         WHEN 7 THEN CASE WHEN id % 2 = 0 THEN id
           ELSE CAST(regexp_replace(v, '[^0-9]', '', 'g') AS BIGINT) END
         ELSE TRY_CAST(nullif(regexp_replace(v, '[^0-9]', '', 'g'), '') AS BIGINT) END AS n FROM src""",
)
def int_from_packet_text(spark, sf):
    # A blank before 0x hides the prefix from this reader.
    v = F.when((F.col("id") % 9 == 7) & (F.col("id") % 2 == 1), F.concat(F.lit(" "), F.col("v"))).otherwise(F.col("v"))
    return _dirty(spark, sf).select("id", text.int_from_packet_text(v).alias("n"))


@register(
    "b05_float_from_text",
    _DIRTY_SQL
    + """SELECT id, CASE id % 9 WHEN 0 THEN CAST(id AS DOUBLE) WHEN 1 THEN CAST(id AS DOUBLE)
         WHEN 2 THEN -CAST(id AS DOUBLE) WHEN 3 THEN id + 0.7::DOUBLE END AS x,
         coalesce(CASE id % 9 WHEN 0 THEN CAST(id AS DOUBLE) WHEN 1 THEN CAST(id AS DOUBLE)
         WHEN 2 THEN -CAST(id AS DOUBLE) WHEN 3 THEN CAST(v AS DOUBLE) END, 0.25) AS x_or FROM src""",
)
def float_from_text(spark, sf):
    v = F.col("v")
    return _dirty(spark, sf).select(
        "id", text.float_from_text(v).alias("x"), text.float_or(v, F.lit(0.25)).alias("x_or")
    )


@register(
    "b06_clean_text",
    """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN event_type
       WHEN 2 THEN concat(event_type, '  x') ELSE NULL END AS cleaned FROM events""",
)
def clean_text(spark, sf):
    e = fixtures.table(spark, sf, "events")
    kind = F.col("event_id") % 4
    v = (
        F.when(kind == 0, F.lit(" \t\r\n "))
        .when(kind == 1, F.concat(F.lit("\t "), "event_type", F.lit("\n")))
        .when(kind == 2, F.concat(F.lit(" "), "event_type", F.lit("  x ")))
    )
    return e.select(F.col("event_id").alias("id"), text.clean_text(v).alias("cleaned"))


@register(
    "b07_parse_time",
    """WITH src AS (SELECT event_id AS id, epoch_us(ts) AS us, epoch_us(date_trunc('second', ts)) AS sec FROM events)
       SELECT id, CASE id % 6 WHEN 0 THEN us WHEN 1 THEN sec WHEN 2 THEN sec - 7200000000
         WHEN 3 THEN sec ELSE 1704067200000000 END AS ts_us FROM src""",
)
def parse_time(spark, sf):
    e = fixtures.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    kind = F.col("id") % 6
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    v = (
        F.when(kind == 1, F.concat(iso, F.lit("Z")))
        .when(kind == 2, F.concat(iso, F.lit("+02:00")))
        .when(kind == 3, F.replace(iso, F.lit("T"), F.lit(" ")))
        .when(kind == 4, F.unix_seconds("ts").cast("string"))
        .when(kind == 5, F.lit("soon"))
    )
    ingest = F.timestamp_micros(F.lit(fixtures.ORIGIN_US))
    number = F.when(kind == 0, F.unix_micros("ts") / F.lit(1e6))
    parsed = F.coalesce(text.epoch_to_time(number), text.time_from_text(v), ingest)
    return e.select("id", F.unix_micros(parsed).alias("ts_us"))


@register(
    "b09_infer_service",
    with_ctes(
        FLOWS,
        """SELECT id, CASE WHEN id % 8 = 2 THEN 'http' WHEN id % 11 = 4 OR dst_port IN (443, 8443) THEN 'https'
          WHEN id % 6 = 1 OR dst_port = 53 THEN 'dns'
          ELSE coalesce(CASE CASE WHEN dst_port <> 0 THEN dst_port ELSE src_port END
            WHEN 20 THEN 'ftp' WHEN 21 THEN 'ftp' WHEN 22 THEN 'ssh' WHEN 23 THEN 'telnet' WHEN 25 THEN 'smtp'
            WHEN 53 THEN 'dns' WHEN 67 THEN 'dhcp' WHEN 68 THEN 'dhcp' WHEN 80 THEN 'http' WHEN 110 THEN 'pop3'
            WHEN 123 THEN 'ntp' WHEN 135 THEN 'rpc' WHEN 143 THEN 'imap' WHEN 161 THEN 'snmp' WHEN 389 THEN 'ldap'
            WHEN 443 THEN 'https' WHEN 445 THEN 'smb' WHEN 465 THEN 'smtps' WHEN 993 THEN 'imaps'
            WHEN 995 THEN 'pop3s' WHEN 1433 THEN 'mssql' WHEN 1521 THEN 'oracle' WHEN 3306 THEN 'mysql'
            WHEN 3389 THEN 'rdp' WHEN 5060 THEN 'sip' END, lower(proto)) END AS service FROM flows""",
    ),
)
def infer_service(spark, sf):
    f = fixtures.flows(spark, sf)
    x = lambda n: F.col(f"extra.{n}")
    return f.select(
        "id",
        network.infer_service(
            network.protocol_name(F.col("proto")), x("src_port"), x("dst_port"), x("dns_query"), x("http_method"), x("ssl_version")
        ).alias("service"),
    )


@register(
    "b12_epoch_seconds",
    f"""SELECT event_id AS id, {q_fixed("CASE WHEN event_id % 7 = 0 THEN 0.0::DOUBLE ELSE (epoch_us(ts) - 1704067200000000) / 1e6 END")} AS sec_fx,
        epoch_us(ts) // 1000000 AS whole FROM events""",
)
def epoch(spark, sf):
    e = fixtures.table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    shifted = F.timestamp_micros(F.unix_micros(ts) - F.lit(fixtures.ORIGIN_US))
    return e.select(
        F.col("event_id").alias("id"),
        fixed(text.epoch_seconds(F.when(F.col("event_id") % 7 != 0, shifted))).alias("sec_fx"),
        F.floor(text.epoch_seconds(ts)).cast("bigint").alias("whole"),
    )


# Addresses that fall in and around every private block.
_IP_SQL = """WITH src AS (
  SELECT event_id AS id, CASE event_id % 14
    WHEN 0 THEN concat('10.', n, '.1.2') WHEN 1 THEN concat('172.', n, '.0.1') WHEN 2 THEN concat('192.168.', n, '.7')
    WHEN 3 THEN concat('192.', n, '.2.1') WHEN 4 THEN concat('198.', n, '.100.9') WHEN 5 THEN concat('203.0.', n, '.5')
    WHEN 6 THEN concat('192.0.0.', n) WHEN 7 THEN concat('169.', n, '.3.4') WHEN 8 THEN concat(n, '.64.0.1')
    WHEN 9 THEN concat('host-', n) WHEN 10 THEN '' WHEN 11 THEN concat('10.0.0.', n, n)
    WHEN 12 THEN concat('198.', n, '.7.7') ELSE concat('0', n, '.1.1.1') END AS ip
  FROM (SELECT event_id, CAST((event_id // 14) % 256 AS VARCHAR) AS n FROM events))
"""


def _addresses(spark, sf):
    e = fixtures.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    n = (F.floor(F.col("id") / 14) % 256).cast("string")
    shapes = [
        ("10.", n, ".1.2"), ("172.", n, ".0.1"), ("192.168.", n, ".7"), ("192.", n, ".2.1"), ("198.", n, ".100.9"),
        ("203.0.", n, ".5"), ("192.0.0.", n), ("169.", n, ".3.4"), (n, ".64.0.1"), ("host-", n), ("",),
        ("10.0.0.", n, n), ("198.", n, ".7.7"), ("0", n, ".1.1.1"),
    ]
    ip = None
    for i, shape in enumerate(shapes):
        made = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in shape])
        ip = F.when(F.col("id") % 14 == i, made) if ip is None else ip.when(F.col("id") % 14 == i, made)
    return e.select("id", ip.alias("ip"))


@register("b13_private_ip", _IP_SQL + f"SELECT id, {q_private('ip')} AS priv FROM src")
def private_ip(spark, sf):
    return _addresses(spark, sf).select("id", network.is_private_ip(F.col("ip")).alias("priv"))


@register(
    "b13_private_ip_v6",
    """SELECT event_id AS id, CASE event_id % 8 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true
         WHEN 3 THEN false WHEN 4 THEN true WHEN 5 THEN true WHEN 6 THEN false ELSE false END AS priv FROM events""",
)
def private_ip_v6(spark, sf):
    e = fixtures.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    group = F.lower(F.hex(F.col("id") % 65536))
    shapes = [
        F.concat(F.lit("2606:4700::"), group),
        F.concat(F.lit("fd00:"), group, F.lit("::1")),
        F.concat(F.lit("2001:db8::"), group),
        F.concat(F.lit("::ffff:8.8.8."), (F.col("id") % 256).cast("string")),
        F.concat(F.lit("::ffff:10.0.0."), (F.col("id") % 256).cast("string")),
        F.concat(F.lit("fe80::"), group, F.lit("%eth0")),
        F.concat(F.lit("2001:20::"), group),
        F.concat(F.lit("1:2:3:4:5:6:7:8:"), group),
    ]
    ip = None
    for i, made in enumerate(shapes):
        ip = F.when(F.col("id") % 8 == i, made) if ip is None else ip.when(F.col("id") % 8 == i, made)
    return e.select("id", network.is_private_ip(ip).alias("priv"))


@register("b14_direction_tag", with_ctes(ADDRESSED, f"SELECT id, {q_direction('sp', 'dp')} AS direction FROM addressed"))
def direction_tag(spark, sf):
    f = fixtures.flow_columns(spark, sf)
    return f.select("id", network.direction_tag(F.col("src_ip"), F.col("dst_ip")).alias("direction"))


@register(
    "b15_prefix_direction",
    """SELECT l_orderkey, l_linenumber, CASE l_suppkey % 3 WHEN 0 THEN 'out' WHEN 1 THEN 'in' ELSE 'out' END AS direction
       FROM lineitem""",
)
def prefix_direction(spark, sf):
    li = fixtures.table(spark, sf, "lineitem")
    third = F.col("l_suppkey") % 3
    ip = F.when(third == 0, F.concat(F.lit("192.168.0."), F.col("l_suppkey").cast("string"))).when(third == 1, F.lit("10.1.0.9"))
    return li.select("l_orderkey", "l_linenumber", network.prefix_direction(ip).alias("direction"))


@register(
    "b16_ip_number",
    _IP_SQL
    + f"""SELECT id, CASE WHEN ip = '' THEN 0 ELSE coalesce({q_ipv4('ip')}, {q_hash('ip', 2**31)}) END AS n FROM src""",
)
def ip_number(spark, sf):
    return _addresses(spark, sf).select("id", network.ip_number(F.col("ip")).cast("bigint").alias("n"))


@register(
    "b17_protocol_code",
    with_ctes(
        FLOWS,
        """SELECT id, CAST(CASE WHEN id % 3 = 0 THEN id % 200 WHEN proto = 'TCP' THEN 6 WHEN proto = 'UDP' THEN 17 ELSE 0 END AS BIGINT) AS code FROM flows""",
    ),
)
def protocol_code(spark, sf):
    f = fixtures.flow_columns(spark, sf)
    name = F.when(F.col("id") % 3 == 0, (F.col("id") % 200).cast("string")).otherwise(
        F.upper(network.protocol_name(F.col("proto")))
    )
    return f.select("id", network.protocol_code(name).cast("bigint").alias("code"))


@register(
    "b18_stable_hash",
    f"""SELECT doc_id, {q_hash('text', 2**31)} AS wide, {q_hash('source', 4099)} AS narrow FROM documents""",
)
def stable_hash(spark, sf):
    d = fixtures.table(spark, sf, "documents")
    return d.select(
        "doc_id",
        network.hashed_category(F.col("text"), 2**31).alias("wide"),
        network.hashed_category(F.col("source"), 4099).alias("narrow"),
    )


@register(
    "b19_b21_traffic_estimates",
    with_ctes(
        ADDRESSED,
        f"""SELECT id, {q_fixed('s')} AS src_fx, {q_fixed('t - s')} AS dst_fx,
          {q_fixed('CASE WHEN s <= 0 THEN 0 ELSE greatest(1.0, s / 450.0::DOUBLE) END')} AS pkts_fx,
          {q_fixed('CASE WHEN s <= 0 THEN 0 ELSE greatest(1.0, s / 64.0::DOUBLE) END')} AS small_pkts_fx,
          {q_fixed('CASE WHEN t <= 0 THEN 0.01::DOUBLE ELSE greatest(0.01::DOUBLE, t / 120000.0::DOUBLE) END')} AS dur_fx
          FROM (SELECT id, t, CASE WHEN sp AND NOT dp THEN t WHEN NOT sp AND dp THEN 0.0 ELSE t / 2.0 END AS s
            FROM (SELECT id, sp, dp, CAST(bytes - 300 AS DOUBLE) AS t FROM addressed))""",
    ),
)
def traffic_estimates(spark, sf):
    f = fixtures.flow_columns(spark, sf).select(
        "id", (F.col("bytes") - 300).cast("double").alias("t"), network.direction_tag(F.col("src_ip"), F.col("dst_ip")).alias("d")
    )
    src, dst = scores.split_bytes(F.col("t"), F.col("d"))
    return f.select("id", "t", src.alias("s"), dst.alias("r")).select(
        "id",
        fixed(F.col("s")).alias("src_fx"),
        fixed(F.col("r")).alias("dst_fx"),
        fixed(scores.estimate_packets(F.col("s"))).alias("pkts_fx"),
        fixed(scores.estimate_packets(F.col("s"), 10)).alias("small_pkts_fx"),
        fixed(scores.estimate_duration(F.col("t"))).alias("dur_fx"),
    )


@register(
    "b22_bytes_score",
    with_ctes(
        FLOWS,
        f"""SELECT id, {q_fixed('CASE WHEN bytes <= 0 THEN 0.0 ELSE least(1.0::DOUBLE, pow(bytes / 20000.0::DOUBLE, 0.6::DOUBLE)) END')} AS fx FROM flows""",
    ),
)
def bytes_score(spark, sf):
    return fixtures.flow_columns(spark, sf).select("id", fixed(scores.bytes_score(F.col("bytes"))).alias("fx"))


@register(
    "b23_direction_bonus",
    with_ctes(
        ADDRESSED,
        """SELECT id, CASE WHEN src_ip = '' OR dst_ip = '' THEN 0.0 WHEN sp AND NOT dp THEN 0.07 WHEN NOT sp AND dp THEN 0.05
             WHEN NOT sp AND NOT dp THEN 0.03 ELSE 0.0 END::DOUBLE AS bonus FROM addressed""",
    ),
)
def direction_bonus(spark, sf):
    s, d = F.col("src_ip"), F.col("dst_ip")
    return fixtures.flow_columns(spark, sf).select(
        "id", scores.direction_bonus(s, d, network.is_private_ip(s), network.is_private_ip(d)).alias("bonus")
    )


@register(
    "b24_protocol_bonus",
    """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 0.08 WHEN 1 THEN 0.05 WHEN 2 THEN 0.04 WHEN 3 THEN 0.03 ELSE 0.0 END::DOUBLE AS bonus FROM events""",
)
def protocol_bonus(spark, sf):
    e = fixtures.table(spark, sf, "events").select(F.col("event_id").alias("id"))
    names = F.array(*[F.lit(n) for n in ("icmp", "UDP", "Sctp", "GRE", "TCP", "")])
    return e.select("id", scores.protocol_bonus(F.get(names, (F.col("id") % 6).cast("int"))).alias("bonus"))


@register(
    "b25_stable_jitter",
    with_ctes(
        FLOWS,
        f"""SELECT id, {q_fixed("CAST(concat('0x', substring(sha1(concat(src_ip, '-', dst_ip, '-', proto, '-', CAST(ts_us // 1000000 AS VARCHAR))), 1, 6)) AS BIGINT) / 16777215.0::DOUBLE * 0.05::DOUBLE")} AS fx FROM flows""",
    ),
)
def stable_jitter(spark, sf):
    f = fixtures.flow_columns(spark, sf)
    proto = network.protocol_name(F.col("proto"))
    return f.select("id", fixed(scores.stable_jitter(F.col("src_ip"), F.col("dst_ip"), proto, F.col("timestamp"))).alias("fx"))


@register(
    "b26_threshold_label",
    with_ctes(
        LATEST,
        """SELECT id, CASE WHEN score >= 0.85 THEN 'anomaly' WHEN score >= 0.65 THEN 'watch' ELSE 'normal' END AS heuristic,
          CASE WHEN score >= 0.402 THEN 'anomaly' WHEN score >= 0.2613 THEN 'watch' ELSE 'normal' END AS model,
          CASE WHEN score >= 0.82 THEN 'anomaly' WHEN score >= 0.6 THEN 'watch' ELSE 'normal' END AS ensemble FROM joined""",
    ),
)
def threshold_label(spark, sf):
    j = with_latest_prediction(fixtures.flow_columns(spark, sf), fixtures.predictions(spark, sf))
    s = F.col("score")
    return j.select(
        "id",
        scores.threshold_label(s, 0.85, 0.65).alias("heuristic"),
        scores.threshold_label(s, 0.402).alias("model"),
        scores.threshold_label(s, 0.82, 0.6).alias("ensemble"),
    )


@register(
    "b27_b29_display_rules",
    with_ctes(
        LATEST,
        f"""SELECT id, {q_severity('label', 'score')} AS severity,
          CASE WHEN coalesce(score, 0) > 0.9 THEN 'high' WHEN coalesce(score, 0) > 0.6 THEN 'elevated' ELSE 'low' END AS band
          FROM joined""",
    ),
)
def display_rules(spark, sf):
    j = with_latest_prediction(fixtures.flow_columns(spark, sf), fixtures.predictions(spark, sf))
    return j.select(
        "id", scores.severity(F.col("label"), F.col("score")).alias("severity"), scores.score_band(F.col("score")).alias("band")
    )


@register(
    "b28_display_label",
    """SELECT event_id AS id, CASE event_id % 4
         WHEN 0 THEN concat(upper(event_type[1]), event_type[2:], ' X', CAST(event_id % 7 AS VARCHAR))
         WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Unknown' ELSE concat('Port ', upper(event_type[1]), event_type[2:]) END AS shown
       FROM events""",
)
def display_label(spark, sf):
    e = fixtures.table(spark, sf, "events")
    kind = F.col("event_id") % 4
    label = (
        F.when(kind == 0, F.concat("event_type", F.lit("_  x"), (F.col("event_id") % 7).cast("string")))
        .when(kind == 1, F.lit(" _ "))
        .when(kind == 3, F.concat(F.lit(" port_"), "event_type"))
    )
    return e.select(F.col("event_id").alias("id"), scores.display_label(label).alias("shown"))


@register("b30_clock_label", with_ctes(FLOWS, "SELECT id, strftime(ts, '%H:%M:%S') AS clock FROM flows"))
def clock_label(spark, sf):
    return fixtures.flow_columns(spark, sf).select("id", scores.clock_label(F.col("timestamp")).alias("clock"))


@register(
    "b31_b35_log_columns",
    """SELECT l_orderkey % 7200 // 60 * 60 + 1704067200 AS minute_s, l_suppkey % 3 = 2 AS no_src,
         CAST(floor(l_quantity * 30) AS BIGINT) AS length,
         CASE WHEN l_linenumber % 3 = 0 THEN 53 ELSE l_partkey % 1024 END AS dst_port FROM lineitem""",
)
def log_columns(spark, sf):
    parsed = rollup.log_columns(fixtures.traffic_log(spark, sf))
    return parsed.select(
        F.unix_seconds("minute").alias("minute_s"),
        F.col("src_ip").isNull().alias("no_src"),
        F.col("length").cast("bigint").alias("length"),
        F.col("dst_port").cast("bigint").alias("dst_port"),
    )


@register(
    "b32_numeric_coerce",
    """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN value END AS x, CASE WHEN event_id % 3 = 0 THEN value ELSE 0.0 END AS x0 FROM events""",
)
def numeric_coerce(spark, sf):
    e = fixtures.table(spark, sf, "events")
    v = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("value").cast("string"))).when(
        F.col("event_id") % 3 == 1, F.lit("n/a")
    )
    return e.select(
        F.col("event_id").alias("id"), text.numeric_or_null(v).alias("x"), text.numeric_or_zero(v).alias("x0")
    )


@register(
    "b37_attack_type",
    with_ctes(
        LATEST,
        """SELECT id, CASE WHEN lab <> '' AND lower(lab) NOT IN ('normal', 'watch', 'anomaly') THEN lab ELSE stored_attack END AS attack_type
           FROM (SELECT *, coalesce(label, '') AS lab FROM joined)""",
    ),
)
def shown_attack(spark, sf):
    j = with_latest_prediction(fixtures.flows(spark, sf), fixtures.predictions(spark, sf))
    return j.select("id", scores.attack_type(F.col("label"), F.col("extra.attack_type")).alias("attack_type"))
