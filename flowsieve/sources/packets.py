"""Tab-separated packet records to flow records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions import network
from flowsieve.functions.scores import MIN_DURATION
from flowsieve.functions.text import clean_text, epoch_to_time, float_or, int_from_packet_text, strip
from flowsieve.schema import EXTRA, PACKET_FIELDS


_NUMERIC = (
    "frame_len",
    "tcp_srcport",
    "tcp_dstport",
    "udp_srcport",
    "udp_dstport",
    "dns_qry_type",
    "dns_qry_class",
    "dns_flags_rcode",
    "http_response_code",
    "http_content_length",
    "ssl_handshake_version",
)


def packet_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """One text column per packet field; blank lines dropped, short rows padded, long rows cut.

    Trimming also takes leading tabs, so an empty first field moves the row left.
    Columns other than the line itself are kept.
    """
    rest = [c for c in lines.columns if c != column]
    trimmed = lines.select(*rest, strip(F.col(column)).alias("_line")).where("_line <> ''")
    cells = trimmed.select(*rest, F.split("_line", "\t").alias("_cells"))
    return cells.select(
        *rest, *[F.coalesce(F.get("_cells", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(PACKET_FIELDS)]
    )


def ip_packets(packets: DataFrame) -> DataFrame:
    return packets.where("ip_src <> ''")


def packet_flows(packets: DataFrame, arrival: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """One flow record per packet: timestamp, endpoints, protocol, bytes and the attribute struct."""
    # One rule over an array of the numeric fields keeps the plan small.
    texts = F.array(*[F.col(name) for name in _NUMERIC])
    numbered = packets.withColumn("_n", F.transform(texts, lambda t: F.when(t != "", int_from_packet_text(t))))
    number = lambda name: F.get("_n", F.lit(_NUMERIC.index(name)))
    words = lambda name: clean_text(F.col(name))
    first = numbered.select(
        *keep,
        float_or(F.col("frame_time_epoch"), F.unix_micros(arrival) / F.lit(1e6)).alias("epoch"),
        F.col("ip_src").alias("src_ip"),
        F.col("ip_dst").alias("dst_ip"),
        network.capture_protocol_name(F.col("ip_proto")).alias("proto"),
        F.greatest(F.lit(0), F.coalesce(number("frame_len"), F.lit(0))).alias("bytes"),
        *[
            F.coalesce(F.nullif(number(f"tcp_{end}"), F.lit(0)), F.nullif(number(f"udp_{end}"), F.lit(0))).alias(name)
            for end, name in (("srcport", "src_port"), ("dstport", "dst_port"))
        ],
        words("dns_qry_name").alias("dns_query"),
        number("dns_qry_type").alias("dns_qtype"),
        number("dns_qry_class").alias("dns_qclass"),
        number("dns_flags_rcode").alias("dns_rcode"),
        words("http_request_method").alias("http_method"),
        words("http_request_full_uri").alias("http_uri"),
        words("http_user_agent").alias("http_user_agent"),
        number("http_response_code").alias("http_status_code"),
        number("http_content_length").alias("_length"),
        number("ssl_handshake_version").alias("ssl_version"),
        words("ssl_handshake_ciphersuite").alias("ssl_cipher"),
    )
    is_request = F.col("http_method").isNotNull()
    made = {
        "service": F.nullif(
            network.infer_service(
                F.col("proto"), F.col("src_port"), F.col("dst_port"), F.col("dns_query"), F.col("http_method"), F.col("ssl_version")
            ),
            F.lit(""),
        ),
        "duration": F.lit(MIN_DURATION),
        "src_bytes": F.col("bytes"),
        "dst_bytes": F.lit(0),
        "src_pkts": F.lit(1),
        "dst_pkts": F.lit(0),
        "http_request_body_len": F.when(is_request, F.col("_length")),
        "http_response_body_len": F.when(~is_request & F.col("http_status_code").isNotNull(), F.col("_length")),
    }
    known = set(first.columns)
    value = lambda name: made.get(name, F.col(name) if name in known else F.lit(None))
    extra = F.struct(*[value(f.name).cast(f.dataType).alias(f.name) for f in EXTRA.fields])
    return first.select(
        *keep, epoch_to_time(F.col("epoch")).alias("timestamp"), "src_ip", "dst_ip", "proto", "bytes", extra.alias("extra")
    )


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return packet_fields(spark.read.text(path))


def stream_packets(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return packet_fields(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))
