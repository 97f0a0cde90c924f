import pytest
from pyspark.sql import functions as F

from flowspark.plans import file_queries as fq
from flowspark.sources import captures as cap


@pytest.fixture
def events_dir(spark, tmp_path):
    """Events of users whose numbers no octet and no port holds."""
    users = [0, 255, 256, 1499, 25_535, 25_536, 65_535, 65_536, 89_999, 1_000_000]
    rows = [(i, 1_700_000_000 + i, users[i % len(users)], ["view", "error", "purchase"][i % 3], i % 300 + 0.5, '{"k": %d}' % (i % 100)) for i in range(200)]
    spark.createDataFrame(rows, "event_id long, at long, user_id long, event_type string, value double, props string").select(
        "event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_users_beyond_an_octet_or_a_port_come_back(spark, events_dir):
    columns = ["ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tcp_flags", "tcp_window", "payload_length", "has_payload"]
    got = sorted(map(tuple, fq.pcap_decode(spark, events_dir).select(*columns).collect()))
    want = sorted(map(tuple, fq.packets_from_events(spark, events_dir).select(*columns).collect()))
    assert got == want and any(r[3] > 65535 for r in got)


def test_watch_takes_their_captures(spark, events_dir):
    assert tuple(fq.online_watch(spark, events_dir).first()) == (200, 0, 0)


def test_captures_follow_the_number_of_packets(spark, events_dir, monkeypatch):
    monkeypatch.setattr(fq, "PACKETS_PER_CAPTURE", 20)
    folder = fq._captures_from_events(spark, events_dir)
    assert cap.list_captures(spark, folder).count() == 10 and cap.read_packets(spark, folder).count() == 200
