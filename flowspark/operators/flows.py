"""Packets to bidirectional flows.

A flow is a five-tuple within one capture file; its forward direction is that
of its first packet in file order.  Everything is computed per *end* of the
flow (the smaller and the larger endpoint) and turned into forward/backward
once the first packet is known, so the direction needs no pass of its own:
packets shuffle once on the flow, are sorted once by file order, and the
windows and the aggregation share that one order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.exprs import iso_utc, ratio
from flowspark.operators.ordered import HotKeys, _same_keys, _renamed, _with_carry, hot_keys, number_rows
from flowspark.schema import FLOW_COLUMNS

ACTIVITY_TIMEOUT_SEC = 1.0     # fixed value: a longer gap ends an active period

# TCP flag bits.
TCP_FLAGS = {"FIN": 0x01, "SYN": 0x02, "RST": 0x04, "PSH": 0x08, "ACK": 0x10, "URG": 0x20, "ECE": 0x40, "CWE": 0x80}

FLOW_KEY = ["file", "lo_ip", "lo_port", "hi_ip", "hi_port", "protocol"]


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Replace the endpoints by the ordered pair (lo, hi) and say which one sent the packet."""
    src = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))
    dst = F.struct(F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"))
    keyed = packets.withColumns({"__lo": F.least(src, dst), "__hi": F.greatest(src, dst), "from_lo": src <= dst})
    return keyed.select(
        "file", F.col("__lo.ip").alias("lo_ip"), F.col("__lo.port").alias("lo_port"),
        F.col("__hi.ip").alias("hi_ip"), F.col("__hi.port").alias("hi_port"), "protocol", "from_lo",
        *[c for c in packets.columns if c not in ("file", "src_ip", "dst_ip", "src_port", "dst_port", "protocol")])


def _ends(name: str, value: Column, agg) -> list[Column]:
    """An aggregate for the packets of each end."""
    return [agg(F.when(F.col("from_lo"), value)).alias(f"lo_{name}"),
            agg(F.when(~F.col("from_lo"), value)).alias(f"hi_{name}")]


def _packet_aggregates() -> list[Column]:
    """Aggregates over a flow's packets; needs ts_us and the gaps to earlier packets."""
    length, flags = F.col("total_length"), F.col("tcp_flags")
    has = lambda bit: flags.bitwiseAND(F.lit(bit)) != 0
    aggs = [
        F.min_by("from_lo", "packet_index").alias("first_from_lo"),
        F.min_by("ts_us", "packet_index").alias("start_us"),
        F.max_by("ts_us", "packet_index").alias("end_us"),
        F.min(length).alias("len_min"), F.max(length).alias("len_max"), F.avg(length).alias("len_mean"),
        F.stddev_pop(length).alias("len_std"), F.var_pop(length).alias("len_var"),
    ]
    aggs += _ends("pkts", F.lit(1), F.count) + _ends("bytes", length, F.sum)
    aggs += _ends("header", F.col("header_length"), F.sum)
    for stat, agg in (("max", F.max), ("min", F.min), ("mean", F.avg), ("std", F.stddev_pop)):
        aggs += _ends(f"len_{stat}", length, agg)
    for prefix, gap in (("iat", "gap"), ("lo_iat", "lo_gap"), ("hi_iat", "hi_gap")):
        positive = F.when(F.col(gap) > 0, F.col(gap))
        aggs += [F.avg(positive).alias(f"{prefix}_mean"), F.stddev_pop(positive).alias(f"{prefix}_std"),
                 F.max(positive).alias(f"{prefix}_max"), F.min(positive).alias(f"{prefix}_min"),
                 F.sum(positive).alias(f"{prefix}_total")]
    idle = F.when(F.col("pause"), F.col("gap"))
    aggs += [F.avg(idle).alias("idle_mean"), F.stddev_pop(idle).alias("idle_std"),
             F.max(idle).alias("idle_max"), F.min(idle).alias("idle_min")]
    aggs += [F.count_if(has(bit)).alias(f"flag_{name}") for name, bit in TCP_FLAGS.items()]
    for name in ("PSH", "URG"):
        aggs += _ends(f"flag_{name}", F.when(has(TCP_FLAGS[name]), 1), F.count)
    window = F.struct("packet_index", F.when(flags != 0, F.col("tcp_window")).otherwise(0).alias("win"))
    aggs += _ends("first", window, F.min)
    aggs += _ends("data_pkts", F.when(F.col("has_payload"), 1), F.count)
    aggs += _ends("min_payload", F.when(F.col("has_payload"), F.col("payload_length")), F.min)
    return aggs


def _segment_aggregates(done: Column, active: Column, counts: dict[str, Column]) -> list[Column]:
    """Active periods (of finished segments, kept if positive) and the largest segment."""
    period = F.when(done & (active > 0), active)
    return [F.avg(period).alias("active_mean"), F.stddev_pop(period).alias("active_std"),
            F.max(period).alias("active_max"), F.min(period).alias("active_min"),
            *[F.max(c).alias(f"sub_{n}") for n, c in counts.items()]]


def _ordinary_flows(rows: DataFrame, timeout_us: int) -> DataFrame:
    """All flows that fit a task: one shuffle, one sort, one aggregation."""
    w = Window.partitionBy(*FLOW_KEY).orderBy("packet_index")
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    ts, lo, length = F.col("ts_us"), F.col("from_lo"), F.col("total_length").cast("long")
    zero = F.lit(0).cast("long")
    running = {
        "n_lo": F.sum(F.when(lo, 1).otherwise(0)).over(upto), "n_hi": F.sum(F.when(lo, 0).otherwise(1)).over(upto),
        "b_lo": F.sum(F.when(lo, length).otherwise(zero)).over(upto),
        "b_hi": F.sum(F.when(lo, zero).otherwise(length)).over(upto),
    }
    rows = rows.withColumns({
        "gap": ts - F.lag("ts_us").over(w),
        "lo_gap": F.when(lo, ts - F.last(F.when(lo, ts), ignorenulls=True).over(before)),
        "hi_gap": F.when(~lo, ts - F.last(F.when(~lo, ts), ignorenulls=True).over(before)),
        **running,
    })
    rows = rows.withColumn("pause", F.coalesce(F.col("gap") > timeout_us, F.lit(False)))
    # What had been counted when the current segment began.
    starts = F.when(F.col("pause") | F.col("gap").isNull(), F.struct(
        ts.alias("ts"),
        *[(F.col(n) - F.when(lo == F.lit(n.endswith("lo")), length if n[0] == "b" else F.lit(1)).otherwise(zero)).alias(n)
          for n in running]))
    rows = rows.withColumns({
        "begin": F.last(starts, ignorenulls=True).over(upto),
        "last_of_segment": F.coalesce(F.lead("pause").over(w), F.lit(True)),
    })
    counts = {n: F.col(n) - F.col(f"begin.{n}") for n in running}
    return rows.groupBy(*FLOW_KEY).agg(
        *_packet_aggregates(), *_segment_aggregates(F.col("last_of_segment"), ts - F.col("begin.ts"), counts))


def _hot_flows(rows: DataFrame, hot: HotKeys, timeout_us: int) -> DataFrame:
    """The few flows too large for one task, in slices of the file order."""
    key = FLOW_KEY + ["__slice"]
    sliced = hot.sliced(rows)
    ts, lo = F.col("ts_us"), F.col("from_lo")
    tails = sliced.groupBy(*key).agg(
        F.max_by("ts_us", "packet_index").alias("t_any"),
        F.max_by(F.when(lo, ts), F.when(lo, F.col("packet_index"))).alias("t_lo"),
        F.max_by(F.when(~lo, ts), F.when(~lo, F.col("packet_index"))).alias("t_hi"))
    earlier = Window.partitionBy(*FLOW_KEY).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*key, *[F.last(c, ignorenulls=True).over(earlier).alias(f"p_{c}") for c in ("t_any", "t_lo", "t_hi")])
    w = Window.partitionBy(*key).orderBy("packet_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    previous = lambda c, p: F.coalesce(F.last(c, ignorenulls=True).over(before), F.col(p))
    gaps = _with_carry(sliced, carry, FLOW_KEY).withColumns({
        "gap": ts - previous(ts, "p_t_any"),
        "lo_gap": F.when(lo, ts - previous(F.when(lo, ts), "p_t_lo")),
        "hi_gap": F.when(~lo, ts - previous(F.when(~lo, ts), "p_t_hi")),
    }).drop("p_t_any", "p_t_lo", "p_t_hi")
    gaps = gaps.withColumn("pause", F.coalesce(F.col("gap") > timeout_us, F.lit(False)))
    packets = gaps.groupBy(*FLOW_KEY).agg(*_packet_aggregates())

    pauses = gaps.groupBy(*key).agg(F.count_if("pause").alias("n"))
    offsets = pauses.select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier_pauses"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    segment = F.sum(F.when(F.col("pause"), 1).otherwise(0)).over(upto) + F.col("earlier_pauses")
    length = F.col("total_length").cast("long")
    zero = F.lit(0).cast("long")
    segments = _with_carry(gaps, offsets, FLOW_KEY).withColumn("segment", segment).groupBy(*FLOW_KEY, "segment").agg(
        (F.max_by("ts_us", "packet_index") - F.min_by("ts_us", "packet_index")).alias("active"),
        F.count_if(lo).alias("n_lo"), F.count_if(~lo).alias("n_hi"),
        F.sum(F.when(lo, length).otherwise(zero)).alias("b_lo"), F.sum(F.when(lo, zero).otherwise(length)).alias("b_hi"))
    counts = {n: F.col(n) for n in ("n_lo", "n_hi", "b_lo", "b_hi")}
    segments = segments.groupBy(*FLOW_KEY).agg(*_segment_aggregates(F.lit(True), F.col("active"), counts))
    side = F.broadcast(_renamed(segments, FLOW_KEY, "__s_"))      # one row per hot flow
    return packets.join(side, _same_keys(packets, FLOW_KEY, "__s_"), "inner").drop(*["__s_" + k for k in FLOW_KEY])


def flow_statistics(packets: DataFrame, activity_timeout: float = ACTIVITY_TIMEOUT_SEC) -> DataFrame:
    """One row of raw statistics per flow (columns per end of the flow)."""
    rows = with_flow_key(packets.drop("frame_length", "payload_bytes"))
    timeout_us = int(round(activity_timeout * 1_000_000))
    hot = hot_keys(rows, FLOW_KEY, F.col("packet_index"))
    if hot is None:
        return _ordinary_flows(rows, timeout_us)
    return _ordinary_flows(hot.others(rows), timeout_us).unionByName(_hot_flows(rows, hot, timeout_us))


def assemble_flows(packets: DataFrame, activity_timeout: float = ACTIVITY_TIMEOUT_SEC) -> DataFrame:
    """The 85 flow columns plus `file` for every flow of every capture; durations are in microseconds."""
    s = flow_statistics(packets, activity_timeout)
    fwd_lo = F.col("first_from_lo")
    s = s.select(
        "*",
        *[F.when(fwd_lo, F.col(f"lo_{n}")).otherwise(F.col(f"hi_{n}")).alias(f"f_{n}") for n in _END_COLUMNS],
        *[F.when(fwd_lo, F.col(f"hi_{n}")).otherwise(F.col(f"lo_{n}")).alias(f"b_{n}") for n in _END_COLUMNS],
        *[F.when(fwd_lo, F.col(f"sub_{n}_lo")).otherwise(F.col(f"sub_{n}_hi")).alias(f"f_sub_{n}") for n in "nb"],
        *[F.when(fwd_lo, F.col(f"sub_{n}_hi")).otherwise(F.col(f"sub_{n}_lo")).alias(f"b_sub_{n}") for n in "nb"],
        F.greatest(F.col("end_us") - F.col("start_us"), F.lit(0)).cast("double").alias("dur"),
    )
    sec = F.col("dur") / 1_000_000.0
    n, b = F.col("f_pkts") + F.col("b_pkts"), F.col("f_all") + F.col("b_all")
    s = s.withColumns({"f_all": F.coalesce("f_bytes", F.lit(0)), "b_all": F.coalesce("b_bytes", F.lit(0))})
    z = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")

    whole = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("int")

    values = {
        "Flow ID": F.concat_ws("-", "f_ip", "f_port", "b_ip", "b_port", "protocol"),
        "Source IP": F.col("f_ip"), "Source Port": whole("f_port"), "Destination IP": F.col("b_ip"),
        "Destination Port": whole("b_port"), "Protocol": whole("protocol"), "Timestamp": iso_utc(F.col("start_us")),
        "Flow Duration": F.col("dur"), "Total Fwd Packets": z("f_pkts"), "Total Backward Packets": z("b_pkts"),
        "Total Length of Fwd Packets": z("f_all"), "Total Length of Bwd Packets": z("b_all"),
        "Flow Bytes/s": ratio(b, sec), "Flow Packets/s": ratio(n, sec),
        "Fwd Packets/s": ratio(F.col("f_pkts"), sec), "Bwd Packets/s": ratio(F.col("b_pkts"), sec),
        "Fwd PSH Flags": z("f_flag_PSH"), "Bwd PSH Flags": z("b_flag_PSH"),
        "Fwd URG Flags": z("f_flag_URG"), "Bwd URG Flags": z("b_flag_URG"),
        "Fwd Header Length": z("f_header"), "Bwd Header Length": z("b_header"), "Fwd Header Length.1": z("f_header"),
        "Min Packet Length": z("len_min"), "Max Packet Length": z("len_max"), "Packet Length Mean": z("len_mean"),
        "Packet Length Std": z("len_std"), "Packet Length Variance": z("len_var"),
        "Down/Up Ratio": ratio(F.col("b_pkts"), F.col("f_pkts")), "Average Packet Size": ratio(b, n),
        "Avg Fwd Segment Size": ratio(F.col("f_all"), F.col("f_pkts")),
        "Avg Bwd Segment Size": ratio(F.col("b_all"), F.col("b_pkts")),
        "Subflow Fwd Packets": z("f_sub_n"), "Subflow Fwd Bytes": z("f_sub_b"),
        "Subflow Bwd Packets": z("b_sub_n"), "Subflow Bwd Bytes": z("b_sub_b"),
        "Init_Win_bytes_forward": z("f_first.win"), "Init_Win_bytes_backward": z("b_first.win"),
        "act_data_pkt_fwd": z("f_data_pkts"), "min_seg_size_forward": z("f_min_payload"),
        "Fwd IAT Total": z("f_iat_total"), "Bwd IAT Total": z("b_iat_total"),
        "Label": F.lit("0"),
    }
    for side, name in (("f", "Fwd"), ("b", "Bwd")):
        for stat in ("Max", "Min", "Mean", "Std"):
            values[f"{name} Packet Length {stat}"] = z(f"{side}_len_{stat.lower()}")
            values[f"{name} IAT {stat}"] = z(f"{side}_iat_{stat.lower()}")
        for bulk in ("Bytes/Bulk", "Packets/Bulk", "Bulk Rate"):
            values[f"{name} Avg {bulk}"] = F.lit(0.0)
    for stat in ("Mean", "Std", "Max", "Min"):
        values[f"Flow IAT {stat}"] = z(f"iat_{stat.lower()}")
        values[f"Active {stat}"] = z(f"active_{stat.lower()}")
        values[f"Idle {stat}"] = z(f"idle_{stat.lower()}")
    for flag in TCP_FLAGS:
        values[f"{flag} Flag Count"] = z(f"flag_{flag}")
    return s.select("file", *[values[c].alias(c) for c in FLOW_COLUMNS])


_END_COLUMNS = ["ip", "port", "pkts", "bytes", "header", "len_max", "len_min", "len_mean", "len_std",
                "iat_mean", "iat_std", "iat_max", "iat_min", "iat_total", "flag_PSH", "flag_URG",
                "first", "data_pkts", "min_payload"]


# ---------------------------------------------------------------------------
# Flow summary
# ---------------------------------------------------------------------------
def parse_ports(text: str) -> list[int]:
    """Ports of a list such as "80, 443; 8080"; anything that is no port is left out."""
    ports = set()
    for part in text.replace(";", ",").split(","):
        part = part.strip()
        if part.lstrip("+-").isdigit() and 0 <= int(part) <= 65535:
            ports.add(int(part))
    return sorted(ports)


def filter_packets(packets: DataFrame, proto: str = "both", whitelist: str = "", blacklist: str = "") -> DataFrame:
    """Keep a packet if either port is whitelisted and neither is blacklisted."""
    keep = {"tcp": F.col("protocol") == 6, "udp": F.col("protocol") == 17}.get(proto.lower(), F.lit(True))
    allowed, denied = parse_ports(whitelist), parse_ports(blacklist)
    if allowed:
        keep = keep & (F.col("src_port").isin(allowed) | F.col("dst_port").isin(allowed))
    if denied:
        keep = keep & ~(F.col("src_port").isin(denied) | F.col("dst_port").isin(denied))
    return packets.where(keep)


def _ipv4_transport(packets: DataFrame) -> DataFrame:
    return packets.where(F.col("protocol").isin(6, 17) & ~F.col("src_ip").contains(":"))


def summarize_flows(packets: DataFrame, proto: str = "both", whitelist: str = "", blacklist: str = "",
                    max_flows: int | None = None, max_packets: int | None = None) -> DataFrame:
    """The 13-column flow summary: IPv4 TCP/UDP, seconds, frame lengths.

    Packets are combined before the shuffle, so a hot flow costs nothing extra.
    `max_flows` keeps the first flows in (file, first packet) order over the
    whole run; `max_packets` ends the run at the file in which that many packets
    of kept flows were read, and ignores the rest of that file.
    """
    rows = with_flow_key(filter_packets(_ipv4_transport(packets), proto, whitelist, blacklist))
    if max_flows or max_packets:
        rows = _capped(rows, max_flows, max_packets)
    length, ts, lo = F.col("frame_length"), F.col("ts_us"), F.col("from_lo")
    s = rows.groupBy(*FLOW_KEY).agg(
        F.min_by("from_lo", "packet_index").alias("fwd_lo"), F.min(ts).alias("t0"), F.max(ts).alias("t1"),
        F.count_if(lo).alias("n_lo"), F.count_if(~lo).alias("n_hi"),
        F.coalesce(F.sum(F.when(lo, length)), F.lit(0)).alias("b_lo"),
        F.coalesce(F.sum(F.when(~lo, length)), F.lit(0)).alias("b_hi"))
    pick = lambda a, b: F.when(F.col("fwd_lo"), F.col(a)).otherwise(F.col(b))
    sec = (F.col("t1") - F.col("t0")) / 1_000_000.0
    return s.select(
        F.element_at(F.split("file", "/"), -1).alias("pcap_file"),
        pick("lo_ip", "hi_ip").alias("src_ip"), pick("hi_ip", "lo_ip").alias("dst_ip"),
        pick("lo_port", "hi_port").alias("src_port"), pick("hi_port", "lo_port").alias("dst_port"),
        F.when(F.col("protocol") == 6, "TCP").otherwise("UDP").alias("protocol"),
        sec.alias("flow_duration"),
        pick("n_lo", "n_hi").alias("total_fwd_pkts"), pick("n_hi", "n_lo").alias("total_bwd_pkts"),
        pick("b_lo", "b_hi").alias("total_len_fwd_pkts"), pick("b_hi", "b_lo").alias("total_len_bwd_pkts"),
        ratio(F.col("b_lo") + F.col("b_hi"), sec).alias("flow_byts_per_s"),
        ratio(F.col("n_lo") + F.col("n_hi"), sec).alias("flow_pkts_per_s"),
    )


def _capped(rows: DataFrame, max_flows: int | None, max_packets: int | None) -> DataFrame:
    if max_flows:
        first = rows.groupBy(*FLOW_KEY).agg(F.min("packet_index").alias("__first"))
        kept = first.orderBy("file", "__first").limit(max_flows).drop("__first")      # a top-k: max_flows rows
        kept = _renamed(kept, FLOW_KEY, "__k_")
        rows = rows.join(kept, _same_keys(rows, FLOW_KEY, "__k_"), "left_semi")
    if max_packets:
        full = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max_packets)
        stop = full.agg(F.min("file").alias("__stop"))                                # one row
        rows = rows.join(F.broadcast(stop), how="cross").where(F.col("__stop").isNull() | (F.col("file") <= F.col("__stop")))
        capped = number_rows(rows.where(F.col("file") == F.col("__stop")), ["file"], [F.col("packet_index")],
                             F.col("packet_index"), "__no", limit=max_packets).drop("__no")
        rows = rows.where(F.col("__stop").isNull() | (F.col("file") < F.col("__stop"))).unionByName(capped).drop("__stop")
    return rows


def summary_limited(packets: DataFrame, max_flows: int, **filters: str) -> DataFrame:
    """Per file: flows present and whether the flow cap cuts any off."""
    rows = with_flow_key(filter_packets(_ipv4_transport(packets), **filters))
    flows = rows.select(*FLOW_KEY).distinct().groupBy("file").agg(F.count(F.lit(1)).alias("flows"))
    return flows.withColumn("limited", F.col("flows") > max_flows)


def packet_chunks(packets: DataFrame, packets_per_part: int = 200) -> DataFrame:
    """Number the parts of N packets each capture splits into, from 1."""
    if packets_per_part <= 0:
        raise ValueError("packets_per_part must be positive")
    rows = number_rows(packets, ["file"], [F.col("packet_index")], F.col("packet_index"), "__no")
    return rows.withColumn("part", (F.floor((F.col("__no") - 1) / packets_per_part) + 1).cast("long")).drop("__no")


def segment_ids(packets: DataFrame, activity_timeout: float = ACTIVITY_TIMEOUT_SEC) -> DataFrame:
    """Packets with their flow key and the number of the active period they fall in (from 0)."""
    rows = with_flow_key(packets)
    timeout_us = int(round(activity_timeout * 1_000_000))
    from flowspark.operators.ordered import previous_value, running_sums
    order, at = [F.col("packet_index")], F.col("packet_index")
    rows = previous_value(rows, FLOW_KEY, order, at, F.col("ts_us"), "prev_ts_us")
    pause = F.when(F.col("ts_us") - F.col("prev_ts_us") > timeout_us, 1).otherwise(0)
    return running_sums(rows, FLOW_KEY, order, at, {"segment_id": pause})


# ---------------------------------------------------------------------------
# Extraction records
# ---------------------------------------------------------------------------
def packet_statistics(decoded: DataFrame) -> DataFrame:
    """Parsed and dropped frames per file from decode output (`status` column)."""
    return decoded.groupBy("file").agg(
        F.count_if(F.col("status") == "ok").alias("parsed_packets"),
        F.count_if(F.col("status") == "dropped").alias("dropped_packets"),
        F.max(F.when(F.col("status") == "error", F.col("error"))).alias("error"))
