"""Fixed schemas of the tables the library works on."""

from __future__ import annotations

from pyspark.sql import types as T

# Attribute keys accepted on a flow, by type.
EXTRA_INT_FIELDS = (
    "src_port",
    "dst_port",
    "src_bytes",
    "dst_bytes",
    "src_pkts",
    "dst_pkts",
    "dns_qclass",
    "dns_qtype",
    "dns_rcode",
    "http_status_code",
    "http_request_body_len",
    "http_response_body_len",
)
EXTRA_FLOAT_FIELDS = ("duration",)
EXTRA_TEXT_FIELDS = (
    "dns_query",
    "http_method",
    "http_uri",
    "http_referrer",
    "http_version",
    "http_user_agent",
    "http_orig_mime_types",
    "http_resp_mime_types",
    "weird_name",
    "weird_addl",
    "weird_notice",
    "ssl_cipher",
)

EXTRA = T.StructType(
    [T.StructField(f, T.LongType()) for f in EXTRA_INT_FIELDS]
    + [T.StructField(f, T.DoubleType()) for f in EXTRA_FLOAT_FIELDS]
    + [T.StructField(f, T.StringType()) for f in EXTRA_TEXT_FIELDS]
    + [
        T.StructField("service", T.StringType()),
        T.StructField("ssl_version", T.LongType()),
        T.StructField("attack_type", T.StringType()),
        T.StructField("rdns_exists", T.BooleanType()),
        T.StructField("rdns_hash", T.LongType()),
    ]
)

FLOWS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("src_ip", T.StringType(), False),
        T.StructField("dst_ip", T.StringType(), False),
        T.StructField("proto", T.StringType(), False),
        T.StructField("bytes", T.LongType(), False),
        T.StructField("extra", EXTRA),
    ]
)

PREDICTIONS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("flow_id", T.LongType(), False),
        T.StructField("score", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("created_at", T.TimestampType(), False),
    ]
)

BLOCK_EVENTS = T.StructType(
    [
        T.StructField("ip", T.StringType(), False),
        T.StructField("action", T.StringType(), False),
        T.StructField("at", T.TimestampType(), False),
    ]
)

# Positional packet fields, in capture order.
PACKET_FIELDS = (
    "frame_time_epoch",
    "ip_src",
    "ip_dst",
    "ip_proto",
    "frame_len",
    "tcp_srcport",
    "tcp_dstport",
    "udp_srcport",
    "udp_dstport",
    "dns_qry_name",
    "dns_qry_type",
    "dns_qry_class",
    "dns_flags_rcode",
    "http_request_method",
    "http_request_full_uri",
    "http_user_agent",
    "http_response_code",
    "http_content_length",
    "ssl_handshake_version",
    "ssl_handshake_ciphersuite",
)

TRAFFIC_LOG = T.StructType(
    [
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("length", T.StringType()),
        T.StructField("protocol", T.LongType()),
        T.StructField("tcp_src", T.StringType()),
        T.StructField("tcp_dst", T.StringType()),
        T.StructField("udp_src", T.StringType()),
        T.StructField("udp_dst", T.StringType()),
        T.StructField("layers", T.StringType()),
    ]
)

# Columns every time-series file must carry for the detector comparison.
SERIES_FEATURES = (
    "n_flows",
    "n_packets",
    "n_bytes",
    "avg_duration",
    "tcp_udp_ratio_packets",
    "tcp_udp_ratio_bytes",
    "dir_ratio_packets",
    "dir_ratio_bytes",
    "avg_ttl",
    "n_dest_ports",
    "n_dest_ip",
)
# Columns of the hourly files, of which any subset is read.
HOURLY_FEATURES = (
    "n_flows",
    "n_packets",
    "n_bytes",
    "avg_duration",
    "tcp_udp_ratio_packets",
    "tcp_udp_ratio_bytes",
    "dir_ratio_packets",
    "dir_ratio_bytes",
    "avg_ttl",
    "sum_n_dest_ports",
    "average_n_dest_ports",
    "std_n_dest_ports",
    "sum_n_dest_ip",
    "average_n_dest_ip",
    "std_n_dest_ip",
    "sum_n_dest_asn",
    "average_n_dest_asn",
    "std_n_dest_asn",
)
SERIES_FOLDERS = ("institutions", "institution_subnets", "ip_addresses_full", "ip_addresses_sample")
SERIES_LEVELS = ("agg_10_minutes", "agg_1_hour", "agg_1_day")
