"""Registry of queries and shared pieces of the comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import network

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query; without SQL only its rows can be checked."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def fixed(c: Column) -> Column:
    """Nine decimals as a whole number, so the last bit of a double does not matter."""
    return F.floor(c * F.lit(1e9) + F.lit(0.5)).cast("bigint")


def q_fixed(expr: str) -> str:
    return f"CAST(floor(({expr}) * 1e9 + 0.5) AS BIGINT)"


# --- the driver tables as flows, in SQL ---

_RAW = """raw AS (
  SELECT event_id AS id, epoch_us(ts) AS us, user_id, event_type, value,
         CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)"""

FLOWS = (
    _RAW
    + """,
flows0 AS (
  SELECT id,
    1704067200000000 + CAST(floor((us - 1704067200000000) / 100) AS BIGINT) AS ts_us,
    CASE user_id % 6
      WHEN 0 THEN concat('192.168.1.', CAST(user_id % 10 + 1 AS VARCHAR))
      WHEN 1 THEN concat('10.0.0.',    CAST(user_id % 10 + 1 AS VARCHAR))
      WHEN 2 THEN concat('8.8.4.',     CAST(user_id % 10 + 1 AS VARCHAR))
      WHEN 3 THEN concat('203.0.113.', CAST(user_id % 10 + 1 AS VARCHAR))
      WHEN 4 THEN concat('host-',      CAST(user_id % 10 AS VARCHAR))
      ELSE '' END AS src_ip,
    CASE id % 4 WHEN 0 THEN '1.1.1.1' WHEN 1 THEN '192.168.1.50'
                WHEN 2 THEN '172.16.8.4' ELSE '9.9.9.9' END AS dst_ip,
    CASE event_type WHEN 'click' THEN '6' WHEN 'view' THEN ' tcp '
      WHEN 'purchase' THEN '17' WHEN 'error' THEN '58' ELSE '99' END AS proto_raw,
    CAST(floor(value * 200) AS BIGINT) AS bytes,
    CAST(CASE k % 10 WHEN 0 THEN 443 WHEN 1 THEN 53 WHEN 2 THEN 22 WHEN 3 THEN 8443
      WHEN 4 THEN 3306 WHEN 5 THEN 0 ELSE 1000 + k * 17 END AS BIGINT) AS dst_port,
    CASE k % 7 WHEN 0 THEN 'portscan' WHEN 1 THEN 'http' WHEN 2 THEN 'dns' END AS service,
    k, user_id
  FROM raw),
flows AS (
  SELECT *, make_timestamp(ts_us) AS ts,
    CASE WHEN trim(proto_raw) = '' THEN 'OTHER' WHEN trim(proto_raw) = '6' THEN 'TCP'
         WHEN trim(proto_raw) = '17' THEN 'UDP' WHEN trim(proto_raw) = '58' THEN 'ICMPv6'
         WHEN regexp_full_match(trim(proto_raw), '[0-9]+') THEN concat('PROTO_', trim(proto_raw))
         ELSE upper(trim(proto_raw)) END AS proto,
    k * 31 + 5 AS src_port,
    CASE WHEN id % 40 = 7 THEN 'injection' END AS stored_attack
  FROM flows0)"""
)

PREDICTIONS = (
    FLOWS
    + """,
p0 AS (
  SELECT id, id AS flow_id,
    CASE WHEN id % 11 = 0 THEN NULL ELSE least(1.0::DOUBLE, bytes / 40000.0::DOUBLE) END AS score,
    CASE id % 8 WHEN 0 THEN 'normal' WHEN 1 THEN 'watch' WHEN 2 THEN 'anomaly'
      WHEN 3 THEN 'ddos' WHEN 4 THEN 'Scanning' WHEN 5 THEN NULL
      ELSE 'normal' END AS label,
    ts_us AS created_us FROM flows WHERE id % 10 <> 9),
predictions AS (
  SELECT * FROM p0 UNION ALL
  SELECT id + 100000000, flow_id, score / 2, 'dos', created_us + 1000000
  FROM p0 WHERE id % 13 = 0)"""
)

LATEST = (
    PREDICTIONS
    + """,
latest AS (
  SELECT flow_id, score, label FROM (
    SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY created_us DESC, id DESC) AS rn
    FROM predictions) WHERE rn = 1),
joined AS (
  SELECT f.*, l.score, l.label, l.flow_id IS NOT NULL AS has_prediction
  FROM flows f LEFT JOIN latest l ON f.id = l.flow_id)"""
)

SERVED = (
    LATEST
    + """,
served AS (
  SELECT *, CASE WHEN has_prediction THEN label ELSE 'normal' END AS slabel,
    coalesce(score, 0.0) AS sscore FROM joined)"""
)


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


def q_severity(label: str, score: str) -> str:
    name = f"lower(coalesce({label}, ''))"
    return f"""CASE WHEN {name} = 'normal' THEN 'normal'
      WHEN {name} IN ('scanning','dos','ddos','injection') OR contains({name}, 'attack') THEN 'anomaly'
      WHEN {name} IN ('anomaly','high') THEN 'anomaly' WHEN {name} IN ('watch','medium') THEN 'watch'
      WHEN {name} = 'low' THEN 'normal' WHEN coalesce({score}, 0.0) >= 0.9 THEN 'anomaly'
      WHEN coalesce({score}, 0.0) >= 0.6 THEN 'watch' ELSE 'normal' END"""


def q_ipv4(ip: str) -> str:
    part = lambda i: f"CAST(split_part({ip}, '.', {i}) AS BIGINT)"
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return (
        f"CASE WHEN regexp_full_match({ip}, '{octet}([.]{octet}){{3}}') "
        f"THEN {part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)} END"
    )


def q_private(ip: str) -> str:
    from ipaddress import IPv4Network

    n = f"({q_ipv4(ip)})"

    def hit(blocks):
        nets = [IPv4Network(b) for b in blocks]
        return " OR ".join(f"{n} BETWEEN {int(x.network_address)} AND {int(x.broadcast_address)}" for x in nets)

    return f"coalesce(({hit(network.PRIVATE_V4)}) AND NOT ({hit(network.PUBLIC_V4)}), false)"


def q_direction(src: str, dst: str) -> str:
    return f"""CASE WHEN {src} AND NOT {dst} THEN 'outbound' WHEN NOT {src} AND {dst} THEN 'inbound'
      WHEN {src} AND {dst} THEN 'internal' ELSE 'external' END"""


def q_hash(text: str, modulus: int) -> str:
    return f"(CAST(concat('0x', substring(sha1({text}), 1, 8)) AS BIGINT) % {modulus})"


# Flows with the private tests done once.
ADDRESSED = (
    FLOWS
    + f""",
hosts AS (SELECT ip, {q_private('ip')} AS priv FROM (
  SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows)),
addressed AS (
  SELECT f.*, s.priv AS sp, d.priv AS dp FROM flows f
  JOIN hosts s ON f.src_ip = s.ip JOIN hosts d ON f.dst_ip = d.ip)"""
)
