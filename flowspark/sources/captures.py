"""Capture files to a packet table.

Large captures are cut into byte ranges, so that one big file becomes many
tasks.  Each range looks for its first record by plausibility and hops from
there to the record that crosses its end; the guesses of a file hold if every
range starts exactly where the one before it arrived.  Where they do not, the
file is walked from its start instead.  A range is decoded with array
operations over its bytes; only the hop from record to record is a loop.
"""

from __future__ import annotations

import ipaddress
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.ordered import number_rows
from flowspark.schema import PACKET_SCHEMA

SPLIT_BYTES = 128 * 1024 * 1024
ROWS_PER_BATCH = 100_000
CAPTURE_SUFFIXES = (".pcap", ".pcapng")          # fixed values

# Capture file signatures -> (byte order, ticks per second).
PCAP_SIGNATURES = {
    b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000),
    b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000),
}
PCAPNG_SIGNATURE = b"\x0a\x0d\x0d\x0a"
VLAN_TYPES = (0x8100, 0x88A8, 0x9100)            # fixed values
IPV6_EXTENSIONS = (0, 43, 44, 51, 60)            # fixed values

LISTING_SCHEMA = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("length", T.LongType()),
    T.StructField("modified_ms", T.LongType())])
DECODED_SCHEMA = T.StructType(list(PACKET_SCHEMA) + [
    T.StructField("status", T.StringType()), T.StructField("error", T.StringType())])
RANGE_SCHEMA = "path string, length long, k long, end long, first long, reach long, count long, state string, changed boolean, error string"
CHUNK_SCHEMA = "file string, start long, stop long, first_index long, state string, error string"


# ---------------------------------------------------------------------------
# Listing
# ---------------------------------------------------------------------------
def list_files(spark: SparkSession, source: str, suffixes: tuple[str, ...], recursive: bool = True) -> DataFrame:
    """Files under a directory (or the one file), with length and modification time."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if fs.exists(path):
        entries = fs.listFiles(path, recursive)
        while entries.hasNext():
            e = entries.next()
            if e.getPath().getName().lower().endswith(suffixes):
                found.append((e.getPath().toString(), int(e.getLen()), int(e.getModificationTime())))
    if not found:
        raise FileNotFoundError(f"no {'/'.join(suffixes)} files in {source}")
    return spark.createDataFrame(sorted(found), LISTING_SCHEMA)


def list_captures(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """Captures of a directory, the one file, or those of an explicit list that exist, in its order (`place`)."""
    if isinstance(source, str):
        return list_files(spark, source, CAPTURE_SUFFIXES)
    found = []
    for place, path in enumerate(source):
        try:
            found += [(*r, place) for r in list_files(spark, path, ("",), False).collect()]      # one file
        except FileNotFoundError:
            continue
    if not found:
        raise FileNotFoundError("no pcap/pcapng file of the list exists")
    return spark.createDataFrame(found, T.StructType([*LISTING_SCHEMA, T.StructField("place", T.LongType())]))


def select_files(listing: DataFrame, mode: str = "all", start: int = 0, size: int = 1) -> DataFrame:
    """One file ("file": number `start`, or the last one), `size` files from `start` on ("batch"), or all ("all", "auto").

    Of an explicit list "file" takes the first one and every other mode all.
    """
    if mode not in ("file", "batch", "all", "auto"):
        raise ValueError(f"unknown mode {mode!r}: file, batch, all or auto")
    if mode == "batch" and size <= 0:
        raise ValueError("size must be positive")
    if "place" in listing.columns:
        ordered = listing.orderBy("place")
        return (ordered.limit(1) if mode == "file" else ordered).drop("place")
    if mode in ("all", "auto"):
        return listing.orderBy("path")
    order = F.col("path")
    first = max(0, start)
    if mode == "batch":
        return listing.orderBy(order).offset(first).limit(size)
    numbered = number_rows(listing, [], [order], F.lit(0.0), "__no", limit=first + 1)
    last = numbered.agg(F.max("__no").alias("__last"))
    return numbered.crossJoin(F.broadcast(last)).where(F.col("__no") == F.col("__last")).drop("__no", "__last")


# ---------------------------------------------------------------------------
# Reading records
# ---------------------------------------------------------------------------
class _File:
    """Random access to a local or remote file."""

    def __init__(self, path: str):
        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        if path.startswith("/"):
            self._f = open(path, "rb")
        else:
            from pyarrow.fs import FileSystem
            fs, inner = FileSystem.from_uri(path.replace("s3a://", "s3://"))
            self._f = fs.open_input_file(inner)

    def read(self, at: int, size: int) -> bytes:
        self._f.seek(at)
        return self._f.read(size)

    def close(self) -> None:
        self._f.close()


def _open_state(head: bytes) -> dict:
    """Reader state at the start of a capture."""
    if head[:4] in PCAP_SIGNATURES:
        if len(head) < 24:
            raise ValueError("capture header is cut off")
        order, ticks = PCAP_SIGNATURES[head[:4]]
        return {"kind": "pcap", "order": order, "ticks": ticks, "at": 24}
    if head[:4] == PCAPNG_SIGNATURE:
        return {"kind": "pcapng", "order": "<", "ticks": [], "at": 0}
    raise ValueError("unsupported capture signature; expected pcap or pcapng")


def _tick_rate(options: bytes, order: str) -> int:
    """Ticks per second of an interface from its options."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 0:
            break
        if code == 9 and size:
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10 ** value
        at += 4 + size + (-size % 4)
    return 1_000_000


def _walk(buf: bytes, at: int, stop: int, state: dict, rows: list) -> int:
    """Append (frame offset, captured length, ticks, ticks per second) of whole records; returns where it stopped.

    Offsets are into `buf`; `state` is kept up to date for pcapng sections and interfaces.
    """
    if state["kind"] == "pcap":
        head = struct.Struct(state["order"] + "IIII")
        ticks = state["ticks"]
        while at + 16 <= stop:
            sec, part, size, _ = head.unpack_from(buf, at)
            if at + 16 + size > len(buf):
                break
            rows.append((at + 16, size, sec * ticks + part, ticks))
            at += 16 + size
        return at
    while at + 12 <= stop:
        if buf[at:at + 4] == PCAPNG_SIGNATURE:
            state["order"] = "<" if buf[at + 8:at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            state["ticks"] = []
        order = state["order"]
        kind, size = struct.unpack_from(order + "II", buf, at)
        if size < 12 or at + size > len(buf):
            break
        if kind == 1:
            state["ticks"].append(_tick_rate(buf[at + 16:at + size - 4], order))
        elif kind == 6:
            iface, high, low, cap = struct.unpack_from(order + "IIII", buf, at + 8)
            rate = state["ticks"][iface] if iface < len(state["ticks"]) else 1_000_000
            rows.append((at + 28, min(cap, size - 32), (high << 32) | low, rate))
        elif kind == 3:
            original, = struct.unpack_from(order + "I", buf, at + 8)
            rows.append((at + 12, min(original, size - 16), 0, 1_000_000))
        at += size
    return at


def _hop(buf: bytes, at: int, stop: int, state: dict) -> tuple[int, int, bool]:
    """Where the first record at or after `stop` begins, packets passed, and whether the reader state changed.

    Reads headers only, so the last record may reach beyond `buf`.
    """
    count, changed = 0, False
    if state["kind"] == "pcap":
        length = struct.Struct(state["order"] + "I")
        while at < stop and at + 16 <= len(buf):
            at += 16 + length.unpack_from(buf, at + 8)[0]
            count += 1
        return at, count, changed
    head = struct.Struct(state["order"] + "II")
    while at < stop and at + 8 <= len(buf):
        kind, size = head.unpack_from(buf, at)
        if size < 12:
            break
        changed = changed or kind in (1, 0x0A0D0D0A)
        count += kind in (3, 6)
        at += size
    return at, count, changed


def _plausible(data: np.ndarray, at: np.ndarray, state: dict) -> np.ndarray:
    """Which offsets may be the start of a record."""
    order = state["order"]
    weights = np.array([1, 1 << 8, 1 << 16, 1 << 24] if order == "<" else [1 << 24, 1 << 16, 1 << 8, 1], dtype=np.int64)
    u32 = lambda o: (data[np.minimum(o, len(data) - 4)[:, None] + np.arange(4)].astype(np.int64) * weights).sum(1)
    if state["kind"] == "pcap":
        captured, original = u32(at + 8), u32(at + 12)
        return (captured > 0) & (captured <= 1 << 18) & (captured <= original) & (original <= 1 << 20) & (u32(at + 4) < state["ticks"])
    kind, size = u32(at), u32(at + 4)
    inside = at + size <= len(data)
    closed = ~inside | (u32(at + np.minimum(size, len(data)) - 4) == size)
    return np.isin(kind, (2, 3, 4, 5, 6)) & (size >= 12) & (size % 4 == 0) & (size <= 1 << 20) & closed


def _first_record(buf: bytes, stop: int, state: dict, chain: int = 12) -> int | None:
    """The first offset below `stop` from which a chain of plausible records leads on."""
    data = np.frombuffer(buf + bytes(64), dtype=np.uint8)
    grain = 1 if state["kind"] == "pcap" else 4
    for low in range(0, stop, 1 << 16):
        offsets = np.arange(low, min(low + (1 << 16), stop), grain, dtype=np.int64)
        for start in offsets[_plausible(data, offsets, state)]:
            at = int(start)
            for _ in range(chain):
                if at + 16 > len(buf):
                    return int(start)
                if not _plausible(data, np.array([at]), state)[0]:
                    break
                at = _hop(buf, at, at + 1, state)[0]
            else:
                return int(start)
    return None


def _reader_state(f: _File) -> dict:
    """State after the leading section and interface blocks, however long they are."""
    wanted = 1 << 16
    while True:
        head = f.read(0, wanted)
        state = _open_state(head)
        at, cut = state["at"], False
        while state["kind"] == "pcapng":
            cut = at + 12 > len(head)
            if cut:
                break
            order = "<" if at == 0 and head[8:12] == b"\x4d\x3c\x2b\x1a" else ">" if at == 0 else state["order"]
            kind, size = struct.unpack_from(order + "II", head, at)
            if kind not in (1, 0x0A0D0D0A) or size < 12:
                break
            cut = at + size > len(head)
            if cut:
                break
            _walk(head, at, at + size, state, [])
            at += size
        if not cut or len(head) < wanted:
            return {**state, "at": at}
        wanted *= 4


def _probe_ranges(batches: Iterator[pd.DataFrame], split_bytes: int) -> Iterator[pd.DataFrame]:
    """Per range of a large file: where its records begin, where they lead to, and how many there are."""
    for batch in batches:
        out = []
        for path, length, k in zip(batch["path"], batch["length"], batch["k"]):
            begin, end = k * split_bytes, min((k + 1) * split_bytes, length)
            try:
                f = _File(path)
                try:
                    state = _reader_state(f)
                    base = state["at"] if k == 0 else begin
                    buf = f.read(base, end - base + 16) if end > base else b""
                finally:
                    f.close()
                first = 0 if k == 0 else _first_record(buf, end - base, state)
                if first is None:
                    out.append((path, length, k, end, None, None, 0, json.dumps(state), False, None))
                    continue
                reach, count, changed = _hop(buf, first, end - base, state)
                out.append((path, length, k, end, base + first, base + reach, count, json.dumps(state), changed, None))
            except Exception as e:  # a bad file becomes a row, not a failed task
                out.append((path, length, k, end, None, None, 0, "", False, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in RANGE_SCHEMA.split(", ")])


def _plan_file(path: str, length: int, split_bytes: int) -> list[tuple]:
    """Ranges of one file by walking it from its start; a small file is one range."""
    f = _File(path)
    try:
        state = _open_state(f.read(0, 24))
        if length <= split_bytes:
            return [(path, state["at"], length, 0, json.dumps(state), None)]
        out, at, index = [], state["at"], 0
        while at < length:
            begin, first, before, window = at, index, json.dumps(state), split_bytes
            while True:
                rows: list = []
                buf = f.read(at, window)
                moved = _walk(buf, 0, len(buf), state, rows)
                if moved or at + window >= length:
                    break
                window *= 2         # one record larger than the range
            if not moved:
                break               # cut-off tail
            at += moved
            index += len(rows)
            out.append((path, begin, at, first, before, None))
        return out
    finally:
        f.close()


def _chunks(batches: Iterator[pd.DataFrame], split_bytes: int) -> Iterator[pd.DataFrame]:
    """Chunks of small files, of verified ranges, and of files whose ranges do not fit together."""
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.error:
                if r.k == 0:
                    out.append((r.path, 0, 0, 0, "", r.error))
            elif r.fits:
                if not pd.isna(r.first):
                    out.append((r.path, int(r.first), int(min(r.reach, r.length)), int(r.before), r.state, None))
            elif r.k == 0:
                try:
                    out += _plan_file(r.path, int(r.length), split_bytes)
                except Exception as e:
                    out.append((r.path, 0, 0, 0, "", f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])


def plan_chunks(listing: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Byte ranges to decode: file, start, stop, index of the first frame, reader state."""
    tasks = max(int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    files = listing.select("path", "length")
    large = files.where(F.col("length") > split_bytes).withColumn(
        "k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / split_bytes))))
    probed = large.repartition(tasks, "path", "k").mapInPandas(lambda it: _probe_ranges(it, split_bytes), RANGE_SCHEMA)
    # One row per range of a file; a file of many terabytes has some 100,000 of them.
    along = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    probed = probed.withColumns({"arrived": F.max("reach").over(along), "before": F.coalesce(F.sum("count").over(along), F.lit(0))})
    fits = (F.when(F.col("k") == 0, F.col("first").isNotNull())
            .when(F.col("first").isNull(), F.col("arrived") >= F.col("end")).otherwise(F.col("first") == F.col("arrived")))
    steady = fits & ~F.col("changed")
    whole = Window.partitionBy("path")
    checked = probed.withColumns({"fits": F.bool_and(F.coalesce(steady, F.lit(False))).over(whole), "error": F.max("error").over(whole)})
    small = files.where(F.col("length") <= split_bytes).select(
        "path", "length", F.lit(0).cast("long").alias("k"), *[F.lit(None).cast(t).alias(n) for n, t in (
            ("first", "long"), ("reach", "long"), ("before", "long"), ("state", "string"))],
        F.lit(False).alias("fits"), F.lit(None).cast("string").alias("error"))
    rows = small.repartition(tasks, "path").unionByName(checked.select(*small.columns))
    return rows.mapInPandas(lambda it: _chunks(it, split_bytes), CHUNK_SCHEMA)


# ---------------------------------------------------------------------------
# Decoding
# ---------------------------------------------------------------------------
def _addresses(raw: np.ndarray) -> np.ndarray:
    """Text of 4- or 16-byte addresses; every distinct one is formatted once."""
    packed = np.ascontiguousarray(raw).view(np.dtype((np.void, raw.shape[1]))).ravel()
    distinct, inverse = np.unique(packed, return_inverse=True)
    text = np.array([str(ipaddress.ip_address(bytes(d))) for d in distinct], dtype=object)
    return text[inverse]


def _parse_frames(data: np.ndarray, off: np.ndarray, cap: np.ndarray) -> dict[str, np.ndarray]:
    """Header fields of many Ethernet frames at once; `ok` is false where there is no IP packet."""
    end = off + cap
    u8 = lambda at: data[np.minimum(at, len(data) - 1)].astype(np.int64)
    u16 = lambda at: (u8(at) << 8) | u8(at + 1)

    l3, kind = off + 14, u16(off + 12)
    while (tagged := np.isin(kind, VLAN_TYPES) & (l3 + 4 <= end)).any():
        kind = np.where(tagged, u16(l3 + 2), kind)
        l3 = np.where(tagged, l3 + 4, l3)

    v4 = (kind == 0x0800) & (l3 + 20 <= end) & (u8(l3) >> 4 == 4) & (u8(l3) & 15 >= 5)
    v6 = (kind == 0x86DD) & (l3 + 40 <= end) & (u8(l3) >> 4 == 6)
    ihl = np.where(v4, (u8(l3) & 15) * 4, 40)
    stated = np.where(v4, u16(l3 + 2), u16(l3 + 4) + 40)
    first_proto = np.where(v4, u8(l3 + 9), u8(l3 + 6))
    proto, l4 = first_proto.copy(), l3 + ihl
    limit = np.where(v4 & (stated == 0), end, np.minimum(end, l3 + stated))
    fragment = v4 & ((u16(l3 + 6) & 0x1FFF) != 0)
    while True:
        more = v6 & np.isin(proto, IPV6_EXTENSIONS) & (l4 + 8 <= limit) & ~fragment
        if not more.any():
            break
        fragment = fragment | (more & (proto == 44) & ((u16(l4 + 2) & 0xFFF8) != 0))
        size = np.where(proto == 44, 8, np.where(proto == 51, (u8(l4 + 1) + 2) * 4, (u8(l4 + 1) + 1) * 8))
        proto, l4 = np.where(more, u8(l4), proto), np.where(more, l4 + size, l4)

    room = np.maximum(limit - l4, 0)
    tcp_words = u8(l4 + 12) >> 4
    tcp = ~fragment & (proto == 6) & (room >= 20) & (tcp_words >= 5)
    udp = ~fragment & (proto == 17) & (room >= 8)
    icmp = ~fragment & np.where(v4, proto == 1, proto == 58) & (room >= 4)
    ports = tcp | udp
    head4 = np.where(tcp, tcp_words * 4, np.where(udp | icmp, 8, 0))
    taken = np.where(tcp, tcp_words * 4, np.where(udp, 8, np.where(icmp, 4, 0)))
    payload = np.maximum(room - taken, 0)
    total = np.where(v4 & (stated == 0), ihl + payload, stated)
    return {
        "ok": v4 | v6, "v4": v4, "l3": l3, "protocol": first_proto,
        "src_port": np.where(ports, u16(l4), 0), "dst_port": np.where(ports, u16(l4 + 2), 0),
        "total_length": total, "header_length": ihl + head4, "payload_length": payload,
        "tcp_flags": np.where(tcp, u8(l4 + 13), 0), "tcp_window": np.where(tcp, u16(l4 + 14), 0),
        "has_payload": ports & (payload > 0),
    }


def _decode_range(path: str, buf: bytes, rows: list, first_index: int) -> pd.DataFrame:
    data = np.frombuffer(buf + bytes(64), dtype=np.uint8)
    off = np.array([r[0] for r in rows], dtype=np.int64)
    cap = np.array([r[1] for r in rows], dtype=np.int64)
    p = _parse_frames(data, off, cap)
    out = pd.DataFrame({
        "file": path, "packet_index": first_index + np.arange(len(rows), dtype=np.int64),
        "ts_us": np.array([r[2] * 1_000_000 // r[3] for r in rows], dtype=np.int64)})
    for side, v4_at, v6_at in (("src_ip", 12, 8), ("dst_ip", 16, 24)):
        text = np.full(len(rows), None, dtype=object)
        for mask, at, size in ((p["ok"] & p["v4"], v4_at, 4), (p["ok"] & ~p["v4"], v6_at, 16)):
            if mask.any():
                text[mask] = _addresses(data[(p["l3"][mask] + at)[:, None] + np.arange(size)])
        out[side] = text
    for c in ("src_port", "dst_port", "protocol", "total_length", "header_length", "payload_length", "tcp_flags", "tcp_window"):
        out[c] = p[c].astype(np.int32)
    out["has_payload"], out["frame_length"] = p["has_payload"], cap.astype(np.int32)
    out["status"] = np.where(p["ok"], "ok", "dropped")
    out["error"] = None
    return out[[f.name for f in DECODED_SCHEMA]]


def _error_row(path: str, message: str) -> pd.DataFrame:
    row = {f.name: None for f in DECODED_SCHEMA}
    row.update(file=path, status="error", error=message)
    return pd.DataFrame([row], columns=list(row)).astype(object)


def _decode_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for c in batch.itertuples(index=False):
            if c.error:
                yield _error_row(c.file, c.error)
                continue
            try:
                f = _File(c.file)
                try:
                    buf = f.read(int(c.start), int(c.stop - c.start))
                finally:
                    f.close()
                rows: list = []
                _walk(buf, 0, len(buf), json.loads(c.state), rows)
            except Exception as e:
                yield _error_row(c.file, f"{type(e).__name__}: {e}")
                continue
            for i in range(0, len(rows), ROWS_PER_BATCH):
                yield _decode_range(c.file, buf, rows[i:i + ROWS_PER_BATCH], int(c.first_index) + i)


def decode_captures(listing: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Packets of every listed file with `status` ok, dropped (no IP) or error (one row per bad file).

    Indexes count frames in file order.  A cut-off last record is ignored.
    """
    tasks = max(int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 1)
    chunks = plan_chunks(listing, split_bytes)
    return chunks.repartition(tasks, "file", "start").mapInPandas(_decode_chunks, DECODED_SCHEMA)


def read_packets(spark: SparkSession, source: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The packet table of a capture or a directory of captures."""
    return packets_of(decode_captures(list_captures(spark, source), split_bytes))


def packets_of(decoded: DataFrame) -> DataFrame:
    return decoded.where("status = 'ok'").drop("status", "error")
