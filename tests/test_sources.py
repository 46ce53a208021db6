"""Readers on hand-written files."""

from pyspark.sql import functions as F

from flowsieve.schema import HOURLY_FEATURES, SERIES_FEATURES
from flowsieve.session import scratch_path
from flowsieve.sources import flow_json, packets, series, tables


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_packets_file(spark, tmp_path):
    short = "\t".join(["1700000000.5", "10.0.0.1", "8.8.8.8", "6", "60", "1000", "443"])
    http = "\t".join(["1", "10.0.0.1", "8.8.8.8", "6", "x9y", "0", "0", "", "", "", "", "", "", "GET", "/u", "ua", "", "12"]) + "\tz\tz\tz\tz"
    put(tmp_path, "p.txt", f"{short}\n\n  \t \n{http}\n\t10.0.0.1\t8.8.8.8\t6\n1\t\t\t6\t60\n")
    f = packets.packet_flows(packets.ip_packets(packets.read_packets(spark, str(tmp_path))), F.timestamp_seconds(F.lit(77)))
    got = sorted(f.collect(), key=lambda r: r["timestamp"])
    # The line without a first field moves left: its source is the former destination.
    assert len(got) == 3 and got[1]["src_ip"] == "8.8.8.8"
    by_len = {r["bytes"]: r for r in got}
    assert by_len[60]["extra"]["service"] == "https" and by_len[60]["extra"]["src_port"] == 1000 and by_len[60]["extra"]["dst_pkts"] == 0
    assert by_len[9]["extra"]["http_request_body_len"] == 12 and by_len[9]["extra"]["src_port"] is None
    assert by_len[9]["extra"]["service"] == "http"


def test_payload_files(spark, tmp_path):
    put(tmp_path, "a.json", '[\n {"src_ip": "a", "bytes": 1},\n {"src_ip": "b"}\n]')
    put(tmp_path, "b.json", '{"src_ip": "c"}')
    put(tmp_path, "c.json", '"text"')
    lines = flow_json.read_payloads(spark, str(tmp_path))
    flows = flow_json.usable(flow_json.parsed_flows(flow_json.payload_records(lines), F.timestamp_seconds(F.lit(0))))
    assert sorted(r["src_ip"] for r in flows.collect()) == ["a", "b", "c"]


def test_series_folders(spark, tmp_path):
    full = ",".join(SERIES_FEATURES)
    put(tmp_path / "institutions" / "agg_1_day", "b.csv", full + "\n" + ",".join("1" * 11) + "\n" + ",".join(["2"] * 10) + ",\n")
    put(tmp_path / "institutions" / "agg_1_day", "a.csv", ",".join(reversed(SERIES_FEATURES)) + "\n" + ",".join(str(i) for i in range(11)) + "\n")
    put(tmp_path / "institutions" / "agg_1_day", "skip.txt", "x")
    put(tmp_path / "ip_addresses_full" / "agg_1_hour", "h.csv", "n_flows,other\n5,6\n")
    files = series.series_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in files] == ["a.csv", "b.csv", "h.csv"]
    rows = series.read_complete(spark, files, SERIES_FEATURES).orderBy("n_flows").collect()
    assert [(r["n_flows"], r["n_dest_ip"]) for r in rows] == [(1.0, 1.0), (10.0, 0.0)]
    assert {r["folder"] for r in rows} == {"institutions"}
    whole = series.read_any(spark, files, HOURLY_FEATURES)
    assert whole.count() == 4 and "other" not in whole.columns
    assert len(series.series_files(spark, str(tmp_path), max_files=2)) == 2
    assert len(series.tree_files(spark, str(tmp_path))) == 3


def test_csv_lines_with_surplus_cells_are_dropped(spark, tmp_path):
    put(tmp_path, "t.csv", 'a,b,c\n1,2,3\n4,5,6,7\n8,9\n"x,y",1,2\n')
    got = sorted(tuple(r) for r in tables.read_text_csv(spark, str(tmp_path)).fillna("-").collect())
    assert got == [("1", "2", "3"), ("8", "9", "-"), ("x,y", "1", "2")]
    assert sorted(r["b"] for r in tables.read_text_csv(spark, str(tmp_path)).select("b").collect()) == ["1", "2", "9"]


def test_csv_writer_heads_every_file(spark, tmp_path):
    path = scratch_path(spark, "csv")
    tables.write_csv(spark.range(20).repartition(3), path)
    assert tables.read_text_csv(spark, path).count() == 20
