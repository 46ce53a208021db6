"""Fixed input and output pairs of the scalar rules."""

import datetime as dt
import ipaddress
import math

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import network, scores, text
from flowsieve.operators import evaluation
from flowsieve.plans.scoring import score_heuristic
from flowsieve.sources import flow_json


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_int_from_text(spark):
    cases = {"12.7": 127, " 0x1F ": 31, "0x1F,0x2A": 102, "-5": -5, "-12.7": 127, "": None, "abc": None, "1_0": 10, "0x": 0, "-0x1F": 1}
    cases["0x"] = 0
    got = apply(spark, text.int_from_text, list(cases))
    assert got == list(cases.values())


def test_int_from_packet_text(spark):
    assert apply(spark, text.int_from_packet_text, [" 0x1f", " 5 ", "5,6", "0x1c", "", None]) == [1, 5, 56, 28, None, None]


def test_float_from_text(spark):
    got = apply(spark, text.float_from_text, [" 1.5 ", "nan", "1.0d", "1_0", "-inf", "1e3", ".5", "5.", "x", "", None])
    assert got[0] == 1.5 and math.isnan(got[1]) and got[2] is None and got[3] == 10.0 and got[4] == float("-inf")
    assert got[5:8] == [1000.0, 0.5, 5.0] and got[8:] == [None, None, None]


def test_protocol_names(spark):
    values = [None, "", "  ", "6", " tcp ", "58", "06", "99", "ICMPv6", "41"]
    want = ["OTHER", "OTHER", "OTHER", "TCP", "TCP", "ICMPv6", "PROTO_06", "PROTO_99", "ICMPV6", "ENCAP"]
    assert apply(spark, network.protocol_name, values) == want
    assert apply(spark, network.capture_protocol_name, ["58", "41"]) == ["ICMPV6", "PROTO_41"]


def test_json_values(spark):
    payload = (
        '[{"bytes": 12.7, "dst_port": 12.7, "src_port": "12.7", "src_pkts": true, "dst_pkts": "", "duration": true, "ts": 0,'
        ' "src_ip": "a", "http_method": true, "dns_query": " x "},'
        ' {"bytes": "12.7", "ts": "1700000000"}, {"src_ip": null}, {"ts": "2024-01-01T00:00:00+02:00", "bytes": null, "proto": 6}]'
    )
    lines = spark.createDataFrame([(payload,), ("7",), ("{bad",), ('[{"src_ip": "a"}, 5]',)], "value string")
    now = F.timestamp_micros(F.lit(1_000_000))
    got = flow_json.parsed_flows(flow_json.payload_records(lines), now, keep=("pos",)).orderBy("pos").collect()
    assert [r["rejected"] for r in got] == [None, "bytes", "src_ip", None]
    first = got[0]
    assert first["bytes"] == 12 and first["extra"]["dst_port"] == 12 and first["extra"]["src_port"] == 127
    assert first["extra"]["src_pkts"] == 1 and first["extra"]["dst_pkts"] is None and first["extra"]["duration"] == 1.0
    assert first["extra"]["http_method"] == "True" and first["extra"]["dns_query"] == "x"
    assert first["timestamp"].timestamp() == 0 or first["timestamp"] == dt.datetime(1970, 1, 1)
    assert got[3]["timestamp"] == dt.datetime(2023, 12, 31, 22) and got[3]["bytes"] == 0 and got[3]["extra"] is None
    assert got[3]["proto"] == "TCP" and got[3]["src_ip"] == ""
    # A list with anything but objects in it is refused as a whole.
    assert flow_json.rejected_payloads(lines).count() == 3


def test_time_from_text(spark):
    values = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+02:00", "2024-01-01", "20240101T010203", "2024-01-01T05", "2024", "1700000000", "bad"]
    got = apply(spark, lambda c: F.unix_seconds(text.time_from_text(c)), values)
    base = 1704067200
    assert got == [base, base - 7200, base, base + 3723, base + 18000, None, None, None]


def test_services(spark):
    rows = [
        ("TCP", None, 443, None, "GET", None, "http"),
        ("TCP", None, 8443, None, None, None, "https"),
        ("UDP", None, 53, None, None, None, "dns"),
        ("TCP", 22, 0, None, None, None, "ssh"),
        ("UDP", None, None, None, None, None, "udp"),
        ("TCP", None, 9999, None, None, None, "tcp"),
        ("TCP", None, 80, None, None, 771, "https"),
    ]
    df = spark.createDataFrame(rows, "proto string, s bigint, d bigint, q string, m string, v bigint, want string")
    got = df.select(network.infer_service(*[F.col(c) for c in "proto s d q m v".split()]).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_private_addresses(spark):
    private = ["203.0.113.5", "198.51.100.1", "169.254.1.1", "192.0.0.8", "240.0.0.1", "::1", "2001:db8::1", "fe80::1%eth0"]
    public = ["100.64.0.1", "192.0.0.9", "8.8.8.8", "host-1", "", "2606:4700::1", "01.2.3.4", "::ffff:8.8.8.8"]
    assert apply(spark, network.is_private_ip, private + public) == [True] * len(private) + [False] * len(public)


def test_addresses_against_the_standard_library(spark):
    tails = ["::", "::1", "1::2:3", "2001:20::1", "2001:1::1", "2001:1::3", "64:ff9b:1::1", "::ffff:10.0.0.1", "1:2:3:4:5:6:7:8",
             "1:2:3:4:5:6:7:8:9", "fc00::", "fdff::1", "fe00::", "::1:2:3:4:5:6:7:8", "1:::2", ":", "g::", "ABCD::EF", "172.31.0.1",
             "172.32.0.1", "198.19.255.255", "255.255.255.255", "223.1.1.1"]
    got = apply(spark, lambda c: F.struct(network.is_private_ip(c).alias("p"), network.ipv6_hex(c).alias("h")), tails)
    for ip, r in zip(tails, got):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            assert (r["p"], r["h"]) == (False, None), ip
            continue
        assert r["p"] == a.is_private, ip
        assert r["h"] == (f"{int(a):032x}" if a.version == 6 else None), ip


def test_numbers_and_hashes(spark):
    assert apply(spark, network.ip_number, ["192.168.1.10", "host-1", ""]) == [3232235786.0, 894756392.0, 0.0]
    cases = [("http", 4099, 2811), ("TCP", 997, 632), ("unknown", 997, 685), ("TCP:outbound", 509, 341),
             ("UDP:internal", 509, 99), ("example.com", 20011, 12918), ("GET", 4001, 2450), ("/login", 65521, 65507)]
    for value, modulus, want in cases:
        assert apply(spark, lambda c, m=modulus: network.hashed_category(c, m), [value]) == [want]


def flow_frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, at double, src_ip string, dst_ip string, proto string, bytes bigint").select(
        "id", F.timestamp_micros((F.col("at") * 1e6).cast("bigint")).alias("timestamp"), "src_ip", "dst_ip", "proto", "bytes"
    )


@pytest.mark.parametrize(
    "burst,src,dst,size,want,label",
    [
        (0, "192.168.1.10", "8.8.8.8", 1500, 0.360728932572, "normal"),
        (30, "192.168.1.10", "8.8.8.8", 1500, 0.485728932572, "normal"),
        (60, "10.0.5.33", "203.0.113.55", 20000, 0.891697960597, "anomaly"),
    ],
)
def test_heuristic_score(spark, burst, src, dst, size, want, label):
    rows = [(0, 1700000000.0, src, dst, "TCP", size)]
    rows += [(i + 1, 1700000000.0 - i % 80, src, dst, "TCP", 1) for i in range(burst)]
    got = score_heuristic(flow_frame(spark, rows)).where("id = 0").first()
    assert abs(got["score"] - want) < 1e-9 and got["label"] == label and got["burst_count"] == burst


def test_anomaly_rule(spark):
    rows = [(False, None, None), (True, "normal", 0.7), (True, "normal", 0.5), (True, None, 0.6), (True, "watch", 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h boolean, l string, s double").orderBy("i")
    got = [r[0] for r in df.select(scores.is_anomalous(F.col("h"), F.col("l"), F.col("s"))).collect()]
    assert got == [False, True, False, True, True]


def test_severity_and_labels(spark):
    rows = [("Scanning", 0.0), ("normal", 0.99), ("medium", 0.0), (None, 0.9), (None, 0.6), ("my_attack", 0.0), ("low", 1.0), ("x", 0.1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l string, s double").orderBy("i")
    got = [r[0] for r in df.select(scores.severity(F.col("l"), F.col("s"))).collect()]
    assert got == ["anomaly", "normal", "watch", "anomaly", "watch", "anomaly", "normal", "normal"]
    assert apply(spark, scores.display_label, ["port_scan  x", "dDoS", None, " "]) == ["Port Scan X", "DDoS", "Unknown", "Unknown"]


def test_scan_rule(spark):
    rows = [("portscan", None, None, 99999), (None, None, 22, 500), (None, None, 22, 20001), (None, None, 0, 1), (None, -4, None, 1)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, s bigint, d bigint, b bigint").orderBy("i")
    got = [r[0] for r in df.select(scores.infer_scanning(*[F.col(c) for c in "vsdb"])).collect()]
    assert got == ["scanning", "scanning", None, None, "scanning"]


def test_best_threshold_steps_down(spark):
    rows = [(0, 0.2), (0, 0.2), (0, 0.4), (1, 0.6), (1, 0.6)]
    df = spark.createDataFrame(rows, "y int, p double")
    assert evaluation.best_f1_threshold(evaluation.threshold_curve(df, "y", "p")).first()[0] == pytest.approx(0.4)
    empty = df.where("y > 5")
    assert evaluation.best_f1_threshold(evaluation.threshold_curve(empty, "y", "p")).first()[0] == 0.5
