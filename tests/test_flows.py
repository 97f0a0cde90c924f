import random
import statistics

import pytest

from flowspark.functions.exprs import col
from flowspark.operators import flows as fl
from flowspark.schema import FLOW_COLUMNS, PACKET_SCHEMA

MB = 1_000_000


def packet(i, us, src, dst, file="f", length=100, flags=0x10, win=10, payload=None, proto=6):
    payload = max(length - 40, 0) if payload is None else payload
    return (file, i, us, src[0], dst[0], src[1], dst[1], proto, length, 40, payload, flags, win, payload > 0, length + 14)


A, B, C = ("10.0.0.1", 1000), ("10.0.0.2", 80), ("10.0.0.9", 99)


def random_packets(n=500, seed=3):
    rnd = random.Random(seed)
    ends, out, t = [A, B, C, ("::1", 5)], [], {"f": 0, "g": 0}
    for i in range(n):
        file = rnd.choice("ffffg")
        t[file] += rnd.choice([0, 10, 500_000, MB - 1, MB, MB + 1, 3 * MB, -20])
        s, d = (A, B) if rnd.random() < 0.4 else (rnd.choice(ends), rnd.choice(ends))
        if rnd.random() < 0.3:
            s, d = d, s
        out.append(packet(i, t[file], s, d, file, rnd.randrange(40, 200), rnd.choice([0, 2, 0x12, 0x18, 0x29]), rnd.randrange(100)))
    return out


def expected(packets):
    """The definition, one packet after another."""
    flows = {}
    for p in sorted(packets, key=lambda p: (p[0], p[1])):
        file, _, us, si, di, sp, dp, proto, length, head, pay, flags, win, has, _ = p
        fwd = (file, si, sp, di, dp, proto)
        rev = (file, di, dp, si, sp, proto)
        key = fwd if fwd in flows or rev not in flows else rev
        flows.setdefault(key, []).append((us, key == fwd, length, head, pay, flags, win, has))
    out = {}
    for key, ps in flows.items():
        f, b = [p for p in ps if p[1]], [p for p in ps if not p[1]]
        gaps = [y[0] - x[0] for x, y in zip(ps, ps[1:])]
        segments, cur = [], [ps[0]]
        for p, g in zip(ps[1:], gaps):
            if g > MB:
                segments.append(cur)
                cur = []
            cur.append(p)
        segments.append(cur)
        iat = lambda q: [y[0] - x[0] for x, y in zip(q, q[1:]) if y[0] > x[0]]
        stat = lambda v: (0, 0, 0, 0) if not v else (statistics.fmean(v), statistics.pstdev(v), max(v), min(v))
        active = [s[-1][0] - s[0][0] for s in segments if s[-1][0] > s[0][0]]
        data = [p[4] for p in f if p[7]]
        count = lambda q, bit: sum(1 for p in q if p[5] & bit)
        row = dict(zip(("Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min"), stat([g for g in gaps if g > 0])))
        for name, q in (("Fwd", f), ("Bwd", b)):
            row.update(zip([f"{name} IAT {s}" for s in ("Mean", "Std", "Max", "Min")], stat(iat(q))))
            row.update(zip([f"{name} Packet Length {s}" for s in ("Mean", "Std", "Max", "Min")], stat([p[2] for p in q])))
            row[f"{name} IAT Total"] = sum(iat(q))
            row[f"{name} PSH Flags"] = count(q, 8)
        row.update(zip([f"Active {s}" for s in ("Mean", "Std", "Max", "Min")], stat(active)))
        row.update(zip([f"Idle {s}" for s in ("Mean", "Std", "Max", "Min")], stat([g for g in gaps if g > MB])))
        row.update({
            "Flow Duration": max(ps[-1][0] - ps[0][0], 0), "Total Fwd Packets": len(f), "Total Backward Packets": len(b),
            "Total Length of Fwd Packets": sum(p[2] for p in f), "Total Length of Bwd Packets": sum(p[2] for p in b),
            "Subflow Fwd Packets": max(sum(p[1] for p in s) for s in segments),
            "Subflow Bwd Bytes": max(sum(p[2] for p in s if not p[1]) for s in segments),
            "Subflow Fwd Bytes": max(sum(p[2] for p in s if p[1]) for s in segments),
            "Init_Win_bytes_forward": f[0][6] if f and f[0][5] else 0, "Init_Win_bytes_backward": b[0][6] if b and b[0][5] else 0,
            "act_data_pkt_fwd": len(data), "min_seg_size_forward": min(data, default=0),
            "SYN Flag Count": count(ps, 2), "URG Flag Count": count(ps, 32),
            "Fwd Header Length": sum(p[3] for p in f),
        })
        out[key] = row
    return out


@pytest.mark.parametrize("forced", [False, True])
def test_flows_follow_the_definition(spark, forced, request):
    if forced:
        request.getfixturevalue("force_hot")
    data = random_packets()
    got = fl.assemble_flows(spark.createDataFrame(data, PACKET_SCHEMA).repartition(4)).collect()
    want = expected(data)
    assert len(got) == len(want)
    for r in got:
        key = (r["file"], r["Source IP"], int(r["Source Port"]), r["Destination IP"], int(r["Destination Port"]), int(r["Protocol"]))
        for name, value in want[key].items():
            assert r[name] == pytest.approx(value, rel=1e-9, abs=1e-6), (key, name)


def test_single_packet_and_schema(spark):
    flows = fl.assemble_flows(spark.createDataFrame([packet(0, 1_700_000_000_000_000, A, B)], PACKET_SCHEMA))
    assert flows.columns == ["file", *FLOW_COLUMNS]
    r = flows.first()
    assert r["Flow ID"] == "10.0.0.1-1000-10.0.0.2-80-6" and r["Timestamp"] == "2023-11-14T22:13:20Z"
    assert r["Flow Duration"] == 0 and r["Flow Packets/s"] == 0 and r["Label"] == "0"
    assert flows.select(*[col(c).isNull().alias(str(i)) for i, c in enumerate(FLOW_COLUMNS)]).first() == tuple([False] * 85)


def test_summary_uses_time_order_and_ipv4_only(spark):
    data = [packet(0, 5 * MB, B, A), packet(1, 3 * MB, A, B, length=50), packet(2, 4 * MB, ("::1", 5), B),
            packet(3, 4 * MB, A, B, proto=1)]
    r = fl.summarize_flows(spark.createDataFrame(data, PACKET_SCHEMA)).collect()
    assert len(r) == 1
    assert (r[0].src_ip, r[0].flow_duration, r[0].total_fwd_pkts, r[0].total_bwd_pkts) == ("10.0.0.2", 2.0, 1, 1)
    assert (r[0].total_len_fwd_pkts, r[0].total_len_bwd_pkts, r[0].flow_pkts_per_s) == (114, 64, 1.0)


@pytest.mark.parametrize("forced", [False, True])
def test_summary_caps(spark, forced, request):
    if forced:
        request.getfixturevalue("force_hot")
    data = [packet(i, i, ("10.0.0.1", 1000 + i % 7), B, "abc"[i // 40]) for i in range(120)]
    df = spark.createDataFrame(data, PACKET_SCHEMA)
    assert fl.summarize_flows(df, max_flows=10).count() == 10
    r = fl.summarize_flows(df, max_flows=10, max_packets=25).collect()
    assert {x.pcap_file for x in r} == {"a"} and sum(x.total_fwd_pkts for x in r) == 25
    assert [x.limited for x in fl.summary_limited(df, 6).collect()] == [True] * 3
    chunks = fl.packet_chunks(df, 15).groupBy("file", "part").count().collect()
    assert sorted(x["count"] for x in chunks if x.file == "a") == [10, 15, 15]


def test_port_list():
    assert fl.parse_ports("80, 443;x;70000;-1; 8080") == [80, 443, 8080]
