"""Score components, labels and display rules as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve.functions.text import strip

# Fixed values of the heuristic score.
BASE_SCORE = 0.15
BYTES_WEIGHT = 0.45
BURST_WEIGHT = 0.25
BYTES_BASELINE = 20000.0
BYTES_EXPONENT = 0.6
BURST_SATURATION = 60.0
BURST_WINDOW_SECONDS = 90
JITTER_SCALE = 0.05
PROTOCOL_BONUS = {"ICMP": 0.08, "UDP": 0.05, "SCTP": 0.04, "GRE": 0.03}
OUTBOUND_BONUS = 0.07
INBOUND_BONUS = 0.05
EXTERNAL_BONUS = 0.03
INTERNAL_BONUS = 0.0
HEURISTIC_ANOMALY = 0.85
HEURISTIC_WATCH = 0.65
# Fixed values of the traffic estimates.
PACKET_BYTES = 450
MIN_PACKET_BYTES = 64
BYTES_PER_SECOND = 120000.0
MIN_DURATION = 0.01
# Class id to label, and labels that are grades rather than attack names.
CLASS_LABELS = {0: "normal", 1: "attack", 2: "scanning", 3: "dos", 4: "injection", 5: "ddos"}
BASE_LABELS = ("normal", "watch", "anomaly")
ATTACK_LABELS = ("scanning", "dos", "ddos", "injection")
SEVERITIES = ("anomaly", "watch", "normal")


def bytes_score(n: Column) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.pow(n / F.lit(BYTES_BASELINE), F.lit(BYTES_EXPONENT)))
    )


def burst_score(count: Column) -> Column:
    return F.least(F.lit(1.0), count / F.lit(BURST_SATURATION))


def direction_bonus(src_ip: Column, dst_ip: Column, src_private: Column, dst_private: Column) -> Column:
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    bonus = F.array(*[F.lit(b) for b in (EXTERNAL_BONUS, INBOUND_BONUS, OUTBOUND_BONUS, INTERNAL_BONUS)])
    return F.when(blank(src_ip) | blank(dst_ip), F.lit(0.0)).otherwise(
        F.get(bonus, src_private.cast("int") * 2 + dst_private.cast("int"))
    )


def protocol_bonus(proto: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in PROTOCOL_BONUS.items()))
    return F.coalesce(F.try_element_at(table, F.upper(proto)), F.lit(0.0))


def stable_jitter(src_ip: Column, dst_ip: Column, proto: Column, ts: Column) -> Column:
    """A small offset that depends only on the endpoints, protocol and whole second."""
    second = (F.unix_micros(ts) / F.lit(1e6)).cast("bigint")
    key = F.concat_ws("-", src_ip, dst_ip, proto, second.cast("string"))
    return F.conv(F.substring(F.sha1(key), 1, 6), 16, 10).cast("double") / F.lit(float(0xFFFFFF)) * F.lit(JITTER_SCALE)


def threshold_label(p: Column, anomaly: float | Column, watch: float | Column | None = None) -> Column:
    """Grade a score; without a watch threshold it follows from the anomaly threshold."""
    if watch is None:
        watch = max(0.2, anomaly * 0.65)
    return F.when(p >= anomaly, F.lit("anomaly")).when(p >= watch, F.lit("watch")).otherwise(F.lit("normal"))


# --- traffic estimates ---


def split_bytes(total: Column, direction: Column) -> tuple[Column, Column]:
    """Attribute a byte total to (source, destination) by direction."""
    half = total / F.lit(2.0)
    src = F.when(direction == "outbound", total).when(direction == "inbound", F.lit(0.0)).otherwise(half)
    dst = F.when(direction == "outbound", F.lit(0.0)).when(direction == "inbound", total).otherwise(half)
    return src, dst


def estimate_packets(n: Column, packet_bytes: int = PACKET_BYTES) -> Column:
    size = float(max(MIN_PACKET_BYTES, packet_bytes))
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(1.0), n / F.lit(size)))


def estimate_duration(n: Column) -> Column:
    return F.when(n <= 0, F.lit(MIN_DURATION)).otherwise(F.greatest(F.lit(MIN_DURATION), n / F.lit(BYTES_PER_SECOND)))


# --- display rules ---


def severity(label: Column, score: Column) -> Column:
    name = F.lower(F.coalesce(label, F.lit("")))
    s = F.coalesce(score, F.lit(0.0))
    return (
        F.when(name == "normal", F.lit("normal"))
        .when(name.isin(*ATTACK_LABELS) | F.contains(name, F.lit("attack")), F.lit("anomaly"))
        .when(name.isin("anomaly", "high"), F.lit("anomaly"))
        .when(name.isin("watch", "medium"), F.lit("watch"))
        .when(name == "low", F.lit("normal"))
        .when(s >= 0.9, F.lit("anomaly"))
        .when(s >= 0.6, F.lit("watch"))
        .otherwise(F.lit("normal"))
    )


def display_label(label: Column) -> Column:
    cleaned = strip(F.replace(label, F.lit("_"), F.lit(" ")))
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))
    titled = F.array_join(F.transform(F.split(cleaned, r"\s+"), word), " ")
    return F.when(label.isNull() | (cleaned == ""), F.lit("Unknown")).otherwise(titled)


def score_band(score: Column) -> Column:
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s > 0.9, F.lit("high")).when(s > 0.6, F.lit("elevated")).otherwise(F.lit("low"))


def clock_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def attack_type(label: Column, stored: Column) -> Column:
    """Attack name to show: the label unless it is only a grade, else the stored one."""
    named = F.coalesce(label, F.lit("")) != ""
    return F.when(named & ~F.lower(label).isin(*BASE_LABELS), label).otherwise(F.nullif(stored, F.lit("")))


def is_anomalous(has_prediction: Column, label: Column, score: Column) -> Column:
    name = F.lower(F.coalesce(label, F.lit("")))
    flagged = ((name != "") & (name != "normal")) | (F.coalesce(score, F.lit(0.0)) >= 0.6)
    return has_prediction & flagged


# --- attack resolution ---


def infer_scanning(service: Column, src_port: Column, dst_port: Column, n_bytes: Column) -> Column:
    low = lambda port: (F.coalesce(port, F.lit(0)) != 0) & (port <= 1024)
    by_name = F.contains(F.lower(F.coalesce(service, F.lit(""))), F.lit("scan"))
    by_port = (low(src_port) | low(dst_port)) & (F.coalesce(n_bytes, F.lit(0)) <= 20000)
    return F.when(F.coalesce(by_name | by_port, F.lit(False)), F.lit("scanning"))


def resolve_attack(label: Column, attack_label: Column, scanning: Column) -> Column:
    """Attack name to keep with a flow after scoring, null to clear it."""
    name = F.lower(F.coalesce(label, F.lit("")))
    has_attack = F.coalesce(attack_label, F.lit("")) != ""
    candidate = (
        F.when((name != "") & ~name.isin(*BASE_LABELS), label)
        .when(has_attack & (name != "") & (name != "normal"), attack_label)
        .when(name.isin("normal", "watch"), scanning)
    )
    return F.when((candidate != "") & ~F.lower(candidate).isin(*BASE_LABELS), candidate)


def class_label(class_id: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in CLASS_LABELS.items()))
    named = F.try_element_at(table, class_id.cast("int"))
    return F.when(class_id.isNotNull(), F.coalesce(named, F.concat(F.lit("class_"), class_id.cast("string"))))
