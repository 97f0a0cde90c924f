"""Queries over files that Spark writes from the given tables: captures, CSV, JSON lines, streams."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.exprs import col
from flowspark.operators import flows as fl
from flowspark.operators.clean import align_schema
from flowspark.plans.adapters import ACTIVITY_TIMEOUT_SEC, LI_SQL, PACKETS_SQL, packets_from_events
from flowspark.plans.flow_queries import FLOW_SQL
from flowspark.plans.registry import query, table
from flowspark.schema import FLOW_FILE_HEADER
from flowspark.session import scratch_dir
from flowspark.sources import captures as cap
from flowspark.sources import sinks, tables
from flowspark.streaming.watch import file_status, watch_captures

LEAST_CAPTURES, PACKETS_PER_CAPTURE = 4, 1_000_000


def _local(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _address_bytes(text: pd.Series) -> np.ndarray:
    """The four bytes of addresses; an octet over 255 is carried into the one before it."""
    values = np.array([int(x) for x in ".".join(text).split(".")], dtype=np.int64).reshape(-1, 4) @ (256 ** np.arange(3, -1, -1, dtype=np.int64))
    return (values[:, None] >> np.array([24, 16, 8, 0])) & 255


def _records(p: pd.DataFrame) -> bytes:
    """Capture records of Ethernet frames with the packets' addresses, ports (modulo 65536), flags and payload sizes."""
    tcp = p["protocol"].to_numpy() == 6
    payload = p["payload_length"].to_numpy().astype(np.int64)
    size = np.where(tcp, 40, 28) + payload                     # of the IP packet
    at = np.cumsum(size + 30) - (size + 30)
    out = np.zeros(int((size + 30).sum()), dtype=np.uint8)

    def put(place, value, width: int, where=slice(None), little: bool = False) -> None:
        for i in range(width):
            out[(at + place + i)[where]] = ((value >> (8 * (i if little else width - 1 - i))) & 255)[where]

    whole = lambda c: p[c].to_numpy().astype(np.int64)
    full = lambda v: np.full(len(p), v, dtype=np.int64)
    put(0, whole("ts_us") // 1_000_000, 4, little=True)
    put(4, whole("ts_us") % 1_000_000, 4, little=True)
    put(8, size + 14, 4, little=True)
    put(12, size + 14, 4, little=True)
    put(28, full(0x0800), 2)
    put(30, full(0x45), 1)
    put(32, size, 2)
    put(38, full(64), 1)
    put(39, whole("protocol"), 1)
    for place, side in ((42, "src_ip"), (46, "dst_ip")):
        octets = _address_bytes(p[side])
        for i in range(4):
            put(place + i, octets[:, i], 1)
    put(50, whole("src_port"), 2)
    put(52, whole("dst_port"), 2)
    put(62, full(0x50), 1, tcp)
    put(63, whole("tcp_flags"), 1, tcp)
    put(64, whole("tcp_window"), 2, tcp)
    put(54, 8 + payload, 2, ~tcp)
    return out.tobytes()


def _write_part(batches: Iterator[pd.DataFrame], folder: str) -> Iterator[pd.DataFrame]:
    """One capture per task, in time order of its batches, written batch by batch."""
    count = 0
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/part-{TaskContext.get().partitionId():05d}.pcap"
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for batch in batches:
            if len(batch):
                f.write(_records(batch))
                count += len(batch)
    yield pd.DataFrame({"path": [path], "packets": [count]})


def _captures_from_events(spark, sf_dir) -> str:
    """Capture files in a shared folder, one per range of the packets; their number follows that of the packets."""
    folder = _local(scratch_dir(spark, "captures"))
    packets = packets_from_events(spark, sf_dir)
    parts = max(LEAST_CAPTURES, -(-packets.count() // PACKETS_PER_CAPTURE))       # from the files' footers
    packets = packets.repartitionByRange(parts, "packet_index").sortWithinPartitions("packet_index")
    packets.mapInPandas(lambda it: _write_part(it, folder), "path string, packets long").agg(F.sum("packets")).collect()
    return folder


def _as_numbered(packets: DataFrame) -> DataFrame:
    """Decoded packets in the events' notation, 10.0.(user div 256).(user mod 256) and port 40000 + user.

    A capture has 8 bits an octet and 16 a port. `_records` carries what an octet cannot hold into the second one,
    which is 0 in the notation, and keeps the port's low bits: the address read back says what a field had to leave out.
    """
    octet = lambda side, i: F.split_part(F.col(f"{side}_ip"), F.lit("."), F.lit(i)).cast("int")
    out = {}
    for side in ("src", "dst"):
        client = F.col(f"{side}_ip").startswith("10.")
        upper = octet(side, 2) * 256 + octet(side, 3)
        out[f"{side}_ip"] = F.when(client, F.concat(F.lit("10.0."), upper.cast("string"), F.lit("."), octet(side, 4).cast("string"))).otherwise(F.col(f"{side}_ip"))
        lost = F.floor((40000 + upper * 256 + octet(side, 4)) / 65536).cast("int") * 65536
        out[f"{side}_port"] = F.col(f"{side}_port") + F.when(client, lost).otherwise(0)
    return packets.withColumns(out)


@query("pcap_decode", "WITH " + PACKETS_SQL + """ SELECT ts_us, src_ip, dst_ip, CAST(src_port AS INTEGER) AS src_port, CAST(dst_port AS INTEGER) AS dst_port, protocol,
  CASE WHEN tcp_flags IS NULL THEN 0 ELSE tcp_flags END AS tcp_flags, tcp_window, payload_length, CASE WHEN protocol = 6 THEN 40 ELSE 28 END + payload_length AS total_length, has_payload FROM packets""")
def pcap_decode(spark, sf_dir):
    """Packets written to capture files and decoded again."""
    packets = _as_numbered(cap.read_packets(spark, _captures_from_events(spark, sf_dir), split_bytes=200_000))
    return packets.select("ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "tcp_flags", "tcp_window",
                          "payload_length", "total_length", "has_payload")


def _flows(spark, sf_dir) -> DataFrame:
    return fl.assemble_flows(packets_from_events(spark, sf_dir), ACTIVITY_TIMEOUT_SEC)


_COUNTS = """SELECT flow_id, CAST(count(*) FILTER (WHERE fwd) AS DOUBLE) AS fwd_packets,
  CAST(coalesce(sum(total_length) FILTER (WHERE NOT fwd), 0) AS DOUBLE) AS bwd_bytes, CAST(greatest(arg_max(ts_us, packet_index) - arg_min(ts_us, packet_index), 0) AS DOUBLE) AS duration_us
FROM g GROUP BY file, flow_id"""


def _counts(flows: DataFrame) -> DataFrame:
    return flows.select(col("Flow ID").alias("flow_id"), col("Total Fwd Packets").alias("fwd_packets"),
                        col("Total Length of Bwd Packets").alias("bwd_bytes"), col("Flow Duration").alias("duration_us"))


@query("csv_roundtrip", FLOW_SQL + _COUNTS)
def csv_roundtrip(spark, sf_dir):
    """Flows written to CSV, read with encoding probe and aligned to the schema again."""
    path = scratch_dir(spark, "flow-csv")
    sinks.write_flow_csv(_flows(spark, sf_dir), path)
    return _counts(align_schema(tables.read_csv_files(tables.list_csv(spark, path))))


@query("jsonl_roundtrip", FLOW_SQL + _COUNTS)
def jsonl_roundtrip(spark, sf_dir):
    """Extraction records written to JSON lines and exploded to flows again."""
    path = scratch_dir(spark, "extraction")
    packets = packets_from_events(spark, sf_dir)
    decoded = packets.withColumns({"status": F.lit("ok"), "error": F.lit(None).cast("string")})
    sinks.write_extractions(sinks.extraction_records(decoded, fl.assemble_flows(packets, ACTIVITY_TIMEOUT_SEC), 100), path)
    return _counts(tables.read_extractions(spark, path))


@query("csv_repair_88", "WITH " + LI_SQL + """ SELECT CAST(l_orderkey AS VARCHAR) AS first_value, CAST(l_partkey AS VARCHAR) AS last_kept, CAST(l_suppkey AS VARCHAR) AS active_mean, l_returnflag AS label, 86 AS width FROM li""")
def csv_repair_88(spark, sf_dir):
    """Rows of 88 values under 86 headers put right."""
    path = scratch_dir(spark, "misaligned")
    header = ",".join(FLOW_FILE_HEADER + ["LabelBinary"])
    li = table(spark, sf_dir, "lineitem")
    text = lambda c: F.col(c).cast("string")
    values = ([text("l_orderkey")] + [F.lit(str(i)) for i in range(74)] + [text("l_partkey"), F.lit("surplus"), F.lit("surplus"), text("l_suppkey")]
              + [F.lit("0")] * 7 + [F.col("l_returnflag"), F.lit("1")])
    rows = li.select(F.concat_ws(",", *values).alias("value"))

    def with_header(batches):
        yield pd.DataFrame({"value": [header]})
        yield from batches

    rows.mapInPandas(with_header, "value string").write.text(path)
    parts = [r.path for r in cap.list_files(spark, path, (".txt",)).collect()]
    fixed = tables.repair_misaligned(spark, parts)
    names = fixed.columns
    return fixed.select(col(names[0]).alias("first_value"), col(names[75]).alias("last_kept"), col("Active Mean").alias("active_mean"),
                        col("Label").alias("label"), F.lit(len(names)).alias("width"))


@query("dataset_manifest", "WITH " + LI_SQL + """, m AS (SELECT concat('part', CAST(l_suppkey % 5 AS VARCHAR)) AS source_path, count(*) AS rows FROM li GROUP BY 1)
SELECT source_path, rows, rows AS labeled_rows, false AS is_total FROM m UNION ALL SELECT NULL, sum(rows)::BIGINT, sum(rows)::BIGINT, true FROM m""")
def dataset_manifest(spark, sf_dir):
    """Merged training data with its manifest."""
    path = scratch_dir(spark, "dataset")
    rows = table(spark, sf_dir, "lineitem").selectExpr("concat('part', l_suppkey % 5) AS source_path", "l_quantity AS dur", "l_linenumber AS spkts", "l_returnflag AS Label")
    sinks.write_dataset(rows, path)
    return spark.read.parquet(f"{path}/manifest")


@query("online_watch", "SELECT CAST(count(*) AS BIGINT) AS parsed_packets, 0 AS dropped_packets, 0 AS failed_files FROM events")
def online_watch(spark, sf_dir):
    """Every capture of a watched directory treated once by the stream."""
    folder, out = _captures_from_events(spark, sf_dir), scratch_dir(spark, "watch")
    stream = watch_captures(spark, folder, out, scratch_dir(spark, "watch-checkpoint"), max_files=2, once=True)
    stream.awaitTermination()
    return file_status(spark, out).agg(F.sum("parsed_packets").alias("parsed_packets"), F.sum("dropped_packets").alias("dropped_packets"),
                                       F.count("error").alias("failed_files"))
