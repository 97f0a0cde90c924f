import json
import struct

import pytest
from pyspark.sql import functions as F

from flowspark.functions.exprs import col
from flowspark.operators.clean import align_schema, label_index
from flowspark.operators.flows import assemble_flows, packet_chunks
from flowspark.schema import FLOW_COLUMNS, FLOW_FILE_HEADER, NUMERIC_FEATURES
from flowspark.sources import captures as cap
from flowspark.sources import sinks, tables

import helpers
from helpers import eth, ip4, ip6, pcap, pcapng, tcp, udp

T0 = 1_700_000_000_000_000


def frames():
    icmp = b"\x08\x00\x00\x00" + b"\0" * 20
    return [
        (T0, eth(ip4("10.0.0.1", "10.0.0.2", 6, tcp(1234, 80, 0x02, 500)))),
        (T0 + 1_500, eth(ip4("10.0.0.2", "10.0.0.1", 6, tcp(80, 1234, 0x12, 600)), vlan=True)),
        (T0 + 2_000, eth(ip4("10.0.0.1", "10.0.0.2", 17, udp(53, 5353, b"x" * 30), options=b"\1" * 4))),
        (T0 + 3_000, eth(ip6("2001:db8::1", "2001:db8::2", 17, udp(1, 2, b"abc")), 0x86DD)),
        (T0 + 4_000, eth(ip6("2001:db8::1", "2001:db8::2", 0, bytes([6, 0, 0, 0, 0, 0, 0, 0]) + tcp(5, 6, 0x10, 7, b"hi")), 0x86DD)),
        (T0 + 5_000, eth(ip4("10.0.0.1", "10.0.0.2", 1, icmp))),
        (T0 + 6_000, eth(b"\0" * 40, 0x0806)),
        (T0 + 7_000, eth(ip4("10.0.0.1", "10.0.0.2", 6, tcp(9, 9, data=b"z" * 9), frag=5))),
    ]


def decoded(spark, tmp_path, files, **kw):
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = cap.decode_captures(cap.list_captures(spark, str(tmp_path)), **kw).collect()
    return sorted(rows, key=lambda r: (r.file, r.packet_index or 0))


@pytest.mark.parametrize("make", [
    lambda f: pcap(f), lambda f: pcap(f, ">"), lambda f: pcap(f, nano=True), lambda f: pcap(f, ">", nano=True),
    lambda f: pcapng(f), lambda f: pcapng(f, ">"), lambda f: pcapng([(t * 1000, d) for t, d in f], tsresol=9)])
def test_decode_fields(spark, tmp_path, make):
    r = decoded(spark, tmp_path, {"a.pcap": make(frames())})
    assert [x.packet_index for x in r] == list(range(8))
    assert [x.ts_us - T0 for x in r] == [0, 1500, 2000, 3000, 4000, 5000, 6000, 7000]
    assert [x.status for x in r] == ["ok"] * 6 + ["dropped", "ok"]
    a, b, u, v, w, i, _, frag = r
    assert (a.src_ip, a.src_port, a.dst_ip, a.dst_port, a.protocol) == ("10.0.0.1", 1234, "10.0.0.2", 80, 6)
    assert (a.total_length, a.header_length, a.payload_length, a.tcp_flags, a.tcp_window, a.has_payload) == (40, 40, 0, 2, 500, False)
    assert (b.src_port, b.tcp_flags, b.tcp_window) == (80, 0x12, 600)
    assert (u.src_port, u.dst_port, u.total_length, u.header_length, u.payload_length, u.has_payload) == (53, 5353, 62, 32, 30, True)
    assert (v.src_ip, v.protocol, v.total_length, v.header_length, v.payload_length) == ("2001:db8::1", 17, 51, 48, 3)
    assert (w.protocol, w.src_port, w.tcp_flags, w.payload_length, w.total_length) == (0, 5, 0x10, 2, 70)
    assert (i.protocol, i.src_port, i.header_length, i.payload_length, i.has_payload) == (1, 0, 28, 20, False)
    assert (frag.src_port, frag.header_length, frag.payload_length) == (0, 20, 29)


def test_truncated_bad_and_empty_files(spark, tmp_path):
    r = decoded(spark, tmp_path, {"cut.pcap": pcap(frames(), cut=10), "bad.pcap": b"not a capture", "none.pcapng": b"",
                                  "ignored.txt": b"x"})
    by = {}
    for x in r:
        by.setdefault(x.file.split("/")[-1], []).append(x)
    assert set(by) == {"cut.pcap", "bad.pcap", "none.pcapng"}
    assert len(by["cut.pcap"]) == 7
    assert by["bad.pcap"][0].status == "error" and by["none.pcapng"][0].status == "error"
    with pytest.raises(FileNotFoundError):
        cap.list_captures(spark, str(tmp_path / "nowhere"))


@pytest.mark.parametrize("make", [pcap, lambda f: pcap(f, ">"), pcapng, lambda f: pcapng(f, ">")])
@pytest.mark.parametrize("split", [700, 4000])
def test_ranges_give_the_same_packets(spark, tmp_path, make, split):
    many = [(T0 + i * 1000, eth(ip4("10.0.0.1", f"10.0.{i % 3}.9", 17, udp(i, 53, b"q" * (i % 50))))) for i in range(300)]
    many[100] = (many[100][0], eth(ip4("10.0.0.1", "10.0.0.9", 17, udp(7, 53, bytes(1300)))))     # larger than a range
    whole = decoded(spark, tmp_path, {"big.pcap": make(many)})
    parts = decoded(spark, tmp_path, {}, split_bytes=split)
    assert len(whole) == 300 and whole == parts
    assert cap.plan_chunks(cap.list_captures(spark, str(tmp_path)), split).count() > 5


def test_misleading_payload_is_walked_from_the_start(spark, tmp_path):
    # Payloads that look like records themselves, so that guesses go wrong.
    fake = pcap([(T0 + i, b"abcd" * 8) for i in range(30)])[24:]
    many = [(T0 + i * 1000, eth(ip4("10.0.0.1", "10.0.0.2", 17, udp(i, 53, fake)))) for i in range(40)]
    whole = decoded(spark, tmp_path, {"big.pcap": pcap(many)})
    assert len(whole) == 40 and whole == decoded(spark, tmp_path, {}, split_bytes=900)


def test_interfaces_that_change_midway(spark, tmp_path):
    one = [(T0 + i, eth(ip4("10.0.0.1", "10.0.0.2", 17, udp(i, 53, b"x" * 20)))) for i in range(60)]
    two = pcapng([(t * 1000, d) for t, d in one], tsresol=9)
    whole = decoded(spark, tmp_path, {"big.pcapng": pcapng(one) + two})
    assert [r.ts_us for r in whole] == [t for t, _ in one] * 2
    assert whole == decoded(spark, tmp_path, {}, split_bytes=800)


def test_file_selection(spark, tmp_path):
    for n in "abcd":
        (tmp_path / f"{n}.pcap").write_bytes(pcap(frames()))
    listing = cap.list_captures(spark, str(tmp_path))
    names = lambda d: [r.path[-6] for r in d.orderBy("path").collect()]
    assert names(cap.select_files(listing, "all")) == list("abcd")
    assert names(cap.select_files(listing, "batch", 1, 2)) == list("bc")
    assert names(cap.select_files(listing, "file", 2)) == ["c"]
    assert names(cap.select_files(listing, "file", 9)) == ["d"]


def test_extraction_round_trip(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.pcap").write_bytes(pcap(frames()))
    (src / "b.pcap").write_bytes(b"junk")
    out = cap.decode_captures(cap.list_captures(spark, str(src)))
    flows = assemble_flows(cap.packets_of(out))
    records = sinks.extraction_records(out, flows, flows_per_record=2)
    counts = sinks.write_extractions(records, str(tmp_path / "jsonl")).first()
    assert (counts.record_count, counts.success_count) == (2, 1)
    back = spark.read.json(str(tmp_path / "jsonl"))
    assert max(len(r.flows) for r in back.collect()) <= 2
    with pytest.raises(Exception, match="extraction failed"):
        tables.read_extractions(spark, str(tmp_path / "jsonl")).collect()
    records.where("success").write.json(str(tmp_path / "good"))
    again = tables.read_extractions(spark, str(tmp_path / "good"))
    assert again.count() == flows.count()
    labelled = sinks.label_precedence(again, 1).select("Label").distinct().collect()
    assert [r.Label for r in labelled] == ["1"]
    given = spark.createDataFrame([(r.file, 1) for r in flows.select("file").distinct().collect()], "file string, label int")
    assert {r.Label for r in sinks.label_flows(flows, given).select("Label").collect()} == {"1"}


def test_flow_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap(frames()))
    flows = assemble_flows(cap.read_packets(spark, str(tmp_path / "a.pcap")))
    sinks.write_flow_csv(flows, str(tmp_path / "csv"))
    back = align_schema(tables.read_csv_files(tables.list_csv(spark, str(tmp_path / "csv"))))
    assert back.columns == FLOW_COLUMNS
    key = lambda d: sorted(map(tuple, d.select(*[col(c) for c in FLOW_COLUMNS]).collect()))
    assert key(back) == key(flows)


def test_csv_encodings_headers_and_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "u.csv").write_bytes("﻿ Flow Duration,名\n1,流量\n".encode("utf-8"))
    (tmp_path / "sub" / "g.csv").write_bytes("Flow Duration, 名 \n2,流量\n".encode("gb18030"))
    (tmp_path / "sub" / "l.csv").write_bytes(b"Flow Duration,x\n3,\xe9\x81\n")
    rows = tables.read_csv_tree(spark, str(tmp_path), infer=False)
    got = sorted((r["Flow Duration"], r["名"]) for r in rows.collect())
    assert got[:2] == [("1", "流量"), ("2", "流量")]
    probe = {r.path[-5:]: r.encoding for r in tables.probe_csv(tables.list_csv(spark, str(tmp_path), True)).collect()}
    assert probe["u.csv"] == "utf-8" and probe["g.csv"] == "gb18030"
    with pytest.raises(KeyError):
        tables.read_csv_files(tables.list_csv(spark, str(tmp_path / "u.csv")), columns=["nope"])


def test_newest_dataset_prefers_telling_names(spark):
    listing = spark.createDataFrame([("/d/other.csv", 1, 300), ("/d/train_old.csv", 1, 100), ("/d/my_Features.csv", 1, 200)],
                                    cap.LISTING_SCHEMA)
    assert tables.newest_dataset(listing).first().path == "/d/my_Features.csv"


def test_repair_misaligned_rows(spark, tmp_path):
    header = FLOW_FILE_HEADER + ["LabelBinary"]
    row = [f"v{i}" for i in range(88)]
    row[3] = '"a,b"'
    p = tmp_path / "bad.csv"
    p.write_text("\n".join([",".join(header), ",".join(row), ",".join(row)]) + "\n")
    fixed = tables.repair_misaligned(spark, str(p)).collect()
    want = [x.strip('"') for x in row[:76] + row[78:]]
    assert [list(r) for r in fixed] == [want, want]
    p.write_text(",".join(header) + "\n" + ",".join(row[:87]) + "\n")
    with pytest.raises(Exception, match="expected 88 values"):
        tables.repair_misaligned(spark, str(p)).collect()
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.repair_misaligned(spark, str(p))


def test_vectorized_dataset_labels(spark, tmp_path):
    p = tmp_path / "vec.csv"
    lines = [",".join(NUMERIC_FEATURES + ["Label"])]
    for i, tail in enumerate(["scan", "dos", "", "scan"]):
        lines.append(",".join(["x" if i == 1 else str(i)] + ["1"] * 79 + [tail]))
    lines.append(",".join(["9"] * 80 + ["dos", "1"]))
    p.write_text("\n".join(lines) + "\n")
    rows = tables.read_vectorized(spark, str(p))
    got = [(r["Source Port"], r.label_text) for r in rows.orderBy("file", "block", "line").collect()]
    assert got == [(0.0, "scan"), (0.0, "dos"), (2.0, None), (3.0, "scan"), (9.0, "1")]
    indexed, mapping = label_index(rows.where("label_text <> '1'"), "label_text", ["line"])
    assert {r.label: r.label_index for r in mapping.collect()} == {"scan": 0, "dos": 1}
    assert indexed.count() == 3
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        tables.read_vectorized(spark, str(p))


def test_dataset_manifest_events_and_chunks(spark, tmp_path):
    rows = spark.createDataFrame([("a.csv", "1.5", "BENIGN"), ("a.csv", "bad", ""), ("b.csv", None, "Scan")], "source_path string, dur string, Label string")
    info = sinks.write_dataset(rows, str(tmp_path / "ds"))
    assert info["rows"] == 3 and info["labeled_rows"] == 3
    listed = {(r.source_path, r.is_total): r.rows for r in spark.read.parquet(str(tmp_path / "ds/manifest")).collect()}
    assert listed == {("a.csv", False): 2, ("b.csv", False): 1, (None, True): 3}
    for i in range(2):
        sinks.append_event(spark, str(tmp_path / "events"), "training", {"n": i})
    events = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "events")).collect()]
    assert sorted(e["data"]["n"] for e in events) == [0, 1] and {e["event"] for e in events} == {"training"}
    (tmp_path / "a.pcap").write_bytes(pcap(frames()))
    packets = cap.read_packets(spark, str(tmp_path / "a.pcap")).withColumn("file", F.lit("a"))
    sinks.write_packet_chunks(packet_chunks(packets, 3), str(tmp_path / "parts"))
    assert {r.part for r in spark.read.parquet(str(tmp_path / "parts")).select("part").collect()} == {1, 2, 3}


def test_small_buckets_of_parts_share_a_directory(spark, tmp_path):
    packets = spark.range(6100).select(F.lit("a").alias("file"), F.col("id").alias("packet_index"))
    path = str(tmp_path / "parts")
    sinks.write_packet_chunks(packet_chunks(packets, 3), path, parts_per_bucket=7)
    assert len(list((tmp_path / "parts").glob("file=a/*"))) == 3
    for part in (1, 7, 1000, 1001, 1002, 2034):
        got = sorted(r.packet_index for r in sinks.read_packet_part(spark, path, "a", part, parts_per_bucket=7).collect())
        assert got == [i for i in range(3 * part - 3, 3 * part) if i < 6100]


def test_repair_splits_a_line_once_and_knows_repeated_headers(spark, tmp_path):
    from flowspark.schema import FLOW_FILE_HEADER
    names = FLOW_FILE_HEADER + ["LabelBinary"]
    row = [str(i) for i in range(88)]
    (tmp_path / "a.csv").write_text("\n".join(["\ufeff" + ",".join(names), ",".join(row), ",".join(f'"{n}"' for n in names), ",".join(names), "",
                                               ",".join(['"0,5"', *row[1:]])]) + "\n", encoding="utf-8")
    fixed = tables.repair_misaligned(spark, str(tmp_path / "a.csv"))
    kept = row[:76] + row[78:]
    assert sorted(map(list, fixed.collect())) == sorted([kept, ["0,5", *kept[1:]]])
    plan = fixed.select(*fixed.columns[:3])._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and all("size(" not in line and "regexp_replace" not in line for line in filters)
    assert sum(line.count("split(value") for line in filters) <= 1       # of lines with quotes


def test_reader_state_beyond_the_first_block(tmp_path):
    """Interface blocks of more than 64 KiB: every interface's clock is known before the first packet."""
    from flowspark.sources.captures import _File, _reader_state
    body = b"".join(helpers._block("<", 1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHBBBB", 9, 1, 9, 0, 0, 0) + struct.pack("<HH", 1, 200) + b"x" * 200
                                   + struct.pack("<HH", 0, 0)) for _ in range(700))
    head = helpers._block("<", 0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1))
    tail = helpers._block("<", 6, struct.pack("<IIIII", 699, 0, 5, 0, 0))
    path = tmp_path / "long.pcapng"
    path.write_bytes(head + body + tail)
    f = _File(str(path))
    state = _reader_state(f)
    f.close()
    assert len(state["ticks"]) == 700 and state["at"] == len(head + body)


def test_encoding_is_tested_over_the_whole_file(spark, tmp_path):
    rows = [f"{i},plain text {i}" for i in range(120_000)] + ["9,\u6076\u610f"]
    path = tmp_path / "late.csv"
    path.write_bytes(("id,label\n" + "\n".join(rows) + "\n").encode("gb18030"))
    assert path.stat().st_size > 1 << 20
    found = tables.probe_csv(tables.list_csv(spark, str(path))).collect()
    assert [r.encoding for r in found] == ["gb18030"]
