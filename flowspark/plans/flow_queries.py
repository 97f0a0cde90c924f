"""Packet-to-flow queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions.exprs import col
from flowspark.operators import flows as fl
from flowspark.operators.rules import rule_settings, score_rules
from flowspark.plans.adapters import ACTIVITY_TIMEOUT_SEC, PACKETS_SQL, packets_from_events
from flowspark.plans.registry import query

TIMEOUT_US = int(ACTIVITY_TIMEOUT_SEC * 1_000_000)

# Flows by the text-book route: direction first, then windows per direction.
FLOW_SQL = "WITH " + PACKETS_SQL + f""",
k AS (SELECT *, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS e1,
             greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS e2 FROM packets),
o AS (SELECT *, first_value(src_ip) OVER w AS f_ip, first_value(src_port) OVER w AS f_port,
             first_value(dst_ip) OVER w AS b_ip, first_value(dst_port) OVER w AS b_port,
             ts_us - lag(ts_us) OVER w AS gap
      FROM k WINDOW w AS (PARTITION BY file, e1, e2, protocol ORDER BY packet_index)),
p AS (SELECT *, src_ip = f_ip AND src_port = f_port AS fwd, coalesce(gap > {TIMEOUT_US}, false) AS pause FROM o),
g AS (SELECT *, concat_ws('-', f_ip, f_port, b_ip, b_port, protocol) AS flow_id,
             ts_us - lag(ts_us) OVER (PARTITION BY file, e1, e2, protocol, fwd ORDER BY packet_index) AS dgap,
             sum(pause::INT) OVER (PARTITION BY file, e1, e2, protocol ORDER BY packet_index) AS segment
      FROM p),
seg AS (SELECT file, flow_id, segment, arg_max(ts_us, packet_index) - arg_min(ts_us, packet_index) AS active,
               count(*) FILTER (WHERE fwd) AS sf, count(*) FILTER (WHERE NOT fwd) AS sb,
               coalesce(sum(total_length) FILTER (WHERE fwd), 0) AS sfb,
               coalesce(sum(total_length) FILTER (WHERE NOT fwd), 0) AS sbb
        FROM g GROUP BY ALL)
"""


def _flows(spark, sf_dir):
    return fl.assemble_flows(packets_from_events(spark, sf_dir), ACTIVITY_TIMEOUT_SEC)


def _out(df, columns: dict[str, str], digits: int = 6, scale: dict[str, float] | None = None):
    """`flow_id` plus renamed feature columns; doubles are rounded for comparison."""
    scale = scale or {}
    return df.select(col("Flow ID").alias("flow_id"), *[
        F.round(col(src) / scale.get(name, 1.0) + OFF_TIE, digits).alias(name) for name, src in columns.items()])


SEC = 1_000_000.0
OFF_TIE = 3.3e-8     # moves values off exact rounding ties, which the two engines break differently


def _stats(name, expr):
    return ", ".join(f"round(coalesce({fn}({expr}), 0) / {SEC} + {OFF_TIE}::DOUBLE, 6) AS {name}_{n}"
                     for n, fn in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"), ("min", "min")))


@query("flow_features", FLOW_SQL + """
SELECT flow_id, arg_min(f_ip, packet_index) AS src_ip, CAST(arg_min(f_port, packet_index) AS INTEGER) AS src_port,
       arg_min(b_ip, packet_index) AS dst_ip, CAST(arg_min(b_port, packet_index) AS INTEGER) AS dst_port,
       strftime(make_timestamp(arg_min(ts_us, packet_index)), '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN arg_min(ts_us, packet_index) % 1000000 = 0 THEN ''
                 ELSE '.' || lpad(CAST(arg_min(ts_us, packet_index) % 1000000 AS VARCHAR), 6, '0') END || 'Z' AS started,
       CAST(greatest(arg_max(ts_us, packet_index) - arg_min(ts_us, packet_index), 0) AS DOUBLE) AS duration_us,
       CAST(count(*) FILTER (WHERE fwd) AS DOUBLE) AS fwd_packets, CAST(count(*) FILTER (WHERE NOT fwd) AS DOUBLE) AS bwd_packets,
       CAST(coalesce(sum(total_length) FILTER (WHERE fwd), 0) AS DOUBLE) AS fwd_bytes,
       CAST(coalesce(sum(total_length) FILTER (WHERE NOT fwd), 0) AS DOUBLE) AS bwd_bytes,
       CAST(coalesce(sum(header_length) FILTER (WHERE fwd), 0) AS DOUBLE) AS fwd_header,
       CAST(coalesce(sum(header_length) FILTER (WHERE NOT fwd), 0) AS DOUBLE) AS bwd_header
FROM g GROUP BY file, flow_id""")
def flow_features(spark, sf_dir):
    """Flow identity, start, duration and totals."""
    return _flows(spark, sf_dir).select(
        col("Flow ID").alias("flow_id"), col("Source IP").alias("src_ip"), col("Source Port").alias("src_port"),
        col("Destination IP").alias("dst_ip"), col("Destination Port").alias("dst_port"),
        col("Timestamp").alias("started"), col("Flow Duration").alias("duration_us"),
        col("Total Fwd Packets").alias("fwd_packets"), col("Total Backward Packets").alias("bwd_packets"),
        col("Total Length of Fwd Packets").alias("fwd_bytes"), col("Total Length of Bwd Packets").alias("bwd_bytes"),
        col("Fwd Header Length.1").alias("fwd_header"), col("Bwd Header Length").alias("bwd_header"))


_LEN = ", ".join(
    f"round(coalesce({fn}(total_length) FILTER (WHERE {cond}), 0) + {OFF_TIE}::DOUBLE, 6) AS {side}_{n}"
    for side, cond in (("all", "true"), ("fwd", "fwd"), ("bwd", "NOT fwd"))
    for n, fn in (("mean", "avg"), ("std", "stddev_pop"), ("max", "max"), ("min", "min")))


@query("flow_packet_lengths", FLOW_SQL + f"""
SELECT flow_id, {_LEN}, round(var_pop(total_length) + {OFF_TIE}::DOUBLE, 6) AS all_var,
       round(count(*) FILTER (WHERE NOT fwd) / greatest(count(*) FILTER (WHERE fwd), 1)::DOUBLE + {OFF_TIE}::DOUBLE, 6) AS down_up,
       round(avg(total_length) + {OFF_TIE}::DOUBLE, 6) AS avg_size
FROM g GROUP BY file, flow_id""")
def flow_packet_lengths(spark, sf_dir):
    """Packet length statistics of the flow and of each direction, and the ratios."""
    cols = {}
    for side, name in (("all", ""), ("fwd", "Fwd "), ("bwd", "Bwd ")):
        for stat in ("Mean", "Std", "Max", "Min"):
            cols[f"{side}_{stat.lower()}"] = f"{name}Packet Length {stat}"
    cols.update(all_max="Max Packet Length", all_min="Min Packet Length", all_var="Packet Length Variance",
                down_up="Down/Up Ratio", avg_size="Average Packet Size")
    return _out(_flows(spark, sf_dir), cols)


@query("flow_rates", FLOW_SQL + """, r AS (
SELECT flow_id, greatest(arg_max(ts_us, packet_index) - arg_min(ts_us, packet_index), 0) / 1e6::DOUBLE AS sec, count(*) AS n,
       sum(total_length) AS b, count(*) FILTER (WHERE fwd) AS nf, count(*) FILTER (WHERE NOT fwd) AS nb
FROM g GROUP BY file, flow_id)
SELECT flow_id, round(CASE WHEN sec > 0 THEN b / sec ELSE 0 END + 3.3e-8::DOUBLE, 6) AS bytes_per_s,
       round(CASE WHEN sec > 0 THEN n / sec ELSE 0 END + 3.3e-8::DOUBLE, 6) AS packets_per_s,
       round(CASE WHEN sec > 0 THEN nf / sec ELSE 0 END + 3.3e-8::DOUBLE, 6) AS fwd_per_s,
       round(CASE WHEN sec > 0 THEN nb / sec ELSE 0 END + 3.3e-8::DOUBLE, 6) AS bwd_per_s FROM r""")
def flow_rates(spark, sf_dir):
    """Bytes and packets per second."""
    return _out(_flows(spark, sf_dir), {"bytes_per_s": "Flow Bytes/s", "packets_per_s": "Flow Packets/s",
                                        "fwd_per_s": "Fwd Packets/s", "bwd_per_s": "Bwd Packets/s"})


@query("flow_iat_stats", FLOW_SQL + f"""
SELECT flow_id, {_stats('flow', 'CASE WHEN gap > 0 THEN gap END')}, {_stats('fwd', 'CASE WHEN fwd AND dgap > 0 THEN dgap END')},
       {_stats('bwd', 'CASE WHEN NOT fwd AND dgap > 0 THEN dgap END')},
       round(coalesce(sum(dgap) FILTER (WHERE fwd AND dgap > 0), 0) / {SEC} + {OFF_TIE}::DOUBLE, 6) AS fwd_total,
       round(coalesce(sum(dgap) FILTER (WHERE NOT fwd AND dgap > 0), 0) / {SEC} + {OFF_TIE}::DOUBLE, 6) AS bwd_total
FROM g GROUP BY file, flow_id""")
def flow_iat_stats(spark, sf_dir):
    """Inter-arrival statistics in seconds: flow, forward, backward."""
    cols = {f"{a}_{s.lower()}": f"{n} IAT {s}" for a, n in (("flow", "Flow"), ("fwd", "Fwd"), ("bwd", "Bwd"))
            for s in ("Mean", "Std", "Max", "Min")}
    cols.update(fwd_total="Fwd IAT Total", bwd_total="Bwd IAT Total")
    return _out(_flows(spark, sf_dir), cols, scale={c: SEC for c in cols})


@query("flow_active_idle", FLOW_SQL + f""",
a AS (SELECT file, flow_id, {_stats('active', 'CASE WHEN active > 0 THEN active END')} FROM seg GROUP BY ALL),
i AS (SELECT file, flow_id, {_stats('idle', 'CASE WHEN pause THEN gap END')} FROM g GROUP BY ALL)
SELECT * EXCLUDE (file) FROM a JOIN i USING (file, flow_id)""")
def flow_active_idle(spark, sf_dir):
    """Active and idle period statistics in seconds."""
    cols = {f"{a}_{s.lower()}": f"{a.capitalize()} {s}" for a in ("active", "idle") for s in ("Mean", "Std", "Max", "Min")}
    return _out(_flows(spark, sf_dir), cols, scale={c: SEC for c in cols})


@query("flow_subflows", FLOW_SQL + """
SELECT flow_id, round(max(sf) + 3.3e-8::DOUBLE, 6) AS fwd_packets, CAST(max(sfb) AS DOUBLE) AS fwd_bytes,
       CAST(max(sb) AS DOUBLE) AS bwd_packets, CAST(max(sbb) AS DOUBLE) AS bwd_bytes
FROM seg GROUP BY file, flow_id""")
def flow_subflows(spark, sf_dir):
    """Largest segment per direction."""
    return _out(_flows(spark, sf_dir), {"fwd_packets": "Subflow Fwd Packets", "fwd_bytes": "Subflow Fwd Bytes",
                                        "bwd_packets": "Subflow Bwd Packets", "bwd_bytes": "Subflow Bwd Bytes"})


_FLAG_SQL = ", ".join(f"CAST(count(*) FILTER (WHERE tcp_flags & {bit} <> 0) AS DOUBLE) AS n_{name.lower()}"
                      for name, bit in fl.TCP_FLAGS.items())


@query("flow_flags", FLOW_SQL + f"""
SELECT flow_id, {_FLAG_SQL},
       CAST(count(*) FILTER (WHERE fwd AND tcp_flags & 8 <> 0) AS DOUBLE) AS fwd_psh,
       CAST(count(*) FILTER (WHERE NOT fwd AND tcp_flags & 8 <> 0) AS DOUBLE) AS bwd_psh,
       CAST(count(*) FILTER (WHERE fwd AND tcp_flags & 32 <> 0) AS DOUBLE) AS fwd_urg,
       CAST(count(*) FILTER (WHERE NOT fwd AND tcp_flags & 32 <> 0) AS DOUBLE) AS bwd_urg
FROM g GROUP BY file, flow_id""")
def flow_flags(spark, sf_dir):
    """TCP flag counts."""
    cols = {f"n_{f.lower()}": f"{f} Flag Count" for f in fl.TCP_FLAGS}
    cols.update(fwd_psh="Fwd PSH Flags", bwd_psh="Bwd PSH Flags", fwd_urg="Fwd URG Flags", bwd_urg="Bwd URG Flags")
    return _out(_flows(spark, sf_dir), cols)


@query("flow_init_window", FLOW_SQL + """
SELECT flow_id,
       CAST(coalesce(arg_min(CASE WHEN tcp_flags <> 0 THEN tcp_window ELSE 0 END, packet_index) FILTER (WHERE fwd), 0) AS DOUBLE) AS win_fwd,
       CAST(coalesce(arg_min(CASE WHEN tcp_flags <> 0 THEN tcp_window ELSE 0 END, packet_index) FILTER (WHERE NOT fwd), 0) AS DOUBLE) AS win_bwd,
       CAST(count(*) FILTER (WHERE fwd AND has_payload) AS DOUBLE) AS data_packets,
       CAST(coalesce(min(payload_length) FILTER (WHERE fwd AND has_payload), 0) AS DOUBLE) AS min_segment
FROM g GROUP BY file, flow_id""")
def flow_init_window(spark, sf_dir):
    """Initial windows, forward data packets and smallest forward segment."""
    return _out(_flows(spark, sf_dir), {"win_fwd": "Init_Win_bytes_forward", "win_bwd": "Init_Win_bytes_backward",
                                        "data_packets": "act_data_pkt_fwd", "min_segment": "min_seg_size_forward"})


SUMMARY_SELECT = """
SELECT file AS pcap_file, f_ip AS src_ip, b_ip AS dst_ip, f_port AS src_port, b_port AS dst_port,
       CASE protocol WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol,
       round((max(ts_us) - min(ts_us)) / 1e6::DOUBLE, 6) AS flow_duration,
       count(*) FILTER (WHERE fwd) AS total_fwd_pkts, count(*) FILTER (WHERE NOT fwd) AS total_bwd_pkts,
       CAST(coalesce(sum(frame_length) FILTER (WHERE fwd), 0) AS BIGINT) AS total_len_fwd_pkts,
       CAST(coalesce(sum(frame_length) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS total_len_bwd_pkts,
       round(CASE WHEN max(ts_us) > min(ts_us) THEN sum(frame_length) / ((max(ts_us) - min(ts_us)) / 1e6::DOUBLE) ELSE 0 END, 8) AS flow_byts_per_s,
       round(CASE WHEN max(ts_us) > min(ts_us) THEN count(*) / ((max(ts_us) - min(ts_us)) / 1e6::DOUBLE) ELSE 0 END, 8) AS flow_pkts_per_s
FROM {src} GROUP BY file, f_ip, b_ip, f_port, b_port, protocol"""


def _round_summary(df):
    return df.withColumns({"flow_duration": F.round("flow_duration", 6), "flow_byts_per_s": F.round("flow_byts_per_s", 8),
                           "flow_pkts_per_s": F.round("flow_pkts_per_s", 8)})


@query("flow_summary", FLOW_SQL + SUMMARY_SELECT.replace("{src}", "g"))
def flow_summary(spark, sf_dir):
    """The 13-column summary of every flow."""
    return _round_summary(fl.summarize_flows(packets_from_events(spark, sf_dir)))


_BY_HOUR = PACKETS_SQL.replace("'events' AS file", "concat('part', lpad(CAST(event_id // 2500 AS VARCHAR), 6, '0')) AS file")


def _several_files(spark, sf_dir):
    part = F.lpad(F.expr("cast(packet_index div 2500 as string)"), 6, "0")
    return packets_from_events(spark, sf_dir).withColumn("file", F.concat(F.lit("part"), part))


@query("flow_summary_capped", FLOW_SQL.replace(PACKETS_SQL, _BY_HOUR) + """,
flows AS (SELECT file, e1, e2, protocol, min(packet_index) AS first FROM g WHERE server_ok GROUP BY ALL),
kept AS (SELECT * FROM flows ORDER BY file, first LIMIT 900),
kp AS (SELECT g.* FROM g JOIN kept USING (file, e1, e2, protocol)),
stop AS (SELECT min(file) AS file FROM (SELECT file FROM kp GROUP BY file HAVING count(*) >= 1900)),
nb AS (SELECT kp.*, row_number() OVER (PARTITION BY kp.file ORDER BY packet_index) AS no, stop.file AS stop FROM kp, stop),
fin AS (SELECT * FROM nb WHERE stop IS NULL OR file < stop OR (file = stop AND no <= 1900))""".replace("WHERE server_ok", "")
       + SUMMARY_SELECT.replace("{src}", "fin"))
def flow_summary_capped(spark, sf_dir):
    """Summary with a flow cap and a packet cap over several capture files."""
    return _round_summary(fl.summarize_flows(_several_files(spark, sf_dir), max_flows=900, max_packets=1900))


@query("flow_summary_limited", "WITH " + _BY_HOUR + """
SELECT file, count(*) AS flows, count(*) > 640 AS limited FROM (
  SELECT DISTINCT file, protocol, least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS a,
         greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) AS b FROM packets) GROUP BY file""")
def flow_summary_limited(spark, sf_dir):
    """Which files hold more flows than the cap."""
    return fl.summary_limited(_several_files(spark, sf_dir), max_flows=640)


@query("port_filter", "WITH " + PACKETS_SQL + """
SELECT packet_index, src_port, dst_port FROM packets
WHERE protocol = 6 AND (src_port IN (80, 443, 22) OR dst_port IN (80, 443, 22)) AND src_port <> 22 AND dst_port <> 22""")
def port_filter(spark, sf_dir):
    """White list, black list and protocol filter on packets."""
    return fl.filter_packets(packets_from_events(spark, sf_dir), "tcp", "80, 443; 22, x", "22").select(
        "packet_index", "src_port", "dst_port")


@query("packet_chunks", "WITH " + PACKETS_SQL + """
SELECT file, packet_index, CAST((row_number() OVER (PARTITION BY file ORDER BY packet_index) - 1) // 200 + 1 AS BIGINT) AS part
FROM packets""")
def packet_chunks(spark, sf_dir):
    """Parts of 200 packets."""
    return fl.packet_chunks(packets_from_events(spark, sf_dir), 200).select("file", "packet_index", "part")


@query("flow_segments", FLOW_SQL + "SELECT packet_index, CAST(segment AS BIGINT) AS segment_id FROM g")
def flow_segments(spark, sf_dir):
    """Running segment number of every packet within its flow."""
    return fl.segment_ids(packets_from_events(spark, sf_dir), ACTIVITY_TIMEOUT_SEC).select(
        "packet_index", F.col("segment_id").cast("long").alias("segment_id"))


# Events a billion times faster, and a third of the UDP clients on ICMP, so that rates and protocols reach the rules.
FAST_FLOW_SQL = FLOW_SQL.replace("packets AS (\n", "slow AS (\n", 1).replace("""
  FROM ev)""", """
  FROM ev),
packets AS (SELECT * REPLACE (ts_us // 1000000000 AS ts_us,
  CASE WHEN protocol = 17 AND greatest(src_port, dst_port) % 3 = 0 THEN 1 ELSE protocol END AS protocol) FROM slow)""", 1)


@query("flow_rules", FAST_FLOW_SQL + """, f AS (
SELECT flow_id, CAST(arg_min(b_port, packet_index) AS INTEGER) AS port, CAST(any_value(protocol) AS INTEGER) AS protocol,
       greatest(arg_max(ts_us, packet_index) - arg_min(ts_us, packet_index), 0) / 1e6::DOUBLE AS sec, count(*) AS n, sum(total_length) AS b
FROM g GROUP BY file, flow_id),
r AS (SELECT *, CASE WHEN sec > 0 THEN b / sec ELSE 0 END AS bps, CASE WHEN sec > 0 THEN 2 * n / sec ELSE 0 END AS pps FROM f)
SELECT flow_id, port, protocol, CAST(port IN (21, 22, 23, 2323, 445, 3389, 5900) AND (bps >= 50000 OR pps >= 150) AS INTEGER) AS risky_port,
       CAST(protocol = 17 AND pps > 3000 AS INTEGER) AS udp_flood, CAST(protocol = 1 AND pps >= 20 AS INTEGER) AS icmp_tunnel FROM r""")
def flow_rules(spark, sf_dir):
    """Packets to flows to rules: port and protocol rules on the engine's own flow table."""
    client = F.greatest("src_port", "dst_port")
    packets = packets_from_events(spark, sf_dir).withColumns({
        "ts_us": F.floor(F.col("ts_us") / F.lit(1_000_000_000)),
        "protocol": F.when((F.col("protocol") == 17) & (client % 3 == 0), F.lit(1)).otherwise(F.col("protocol"))})
    flows = fl.assemble_flows(packets, ACTIVITY_TIMEOUT_SEC)
    scored = score_rules(flows, rule_settings("baseline"), order=["Timestamp", "Flow ID"], scope=["file"],
                         normalize_protocol=True, integral_ports=True, keep_masks=True)
    return scored.select(col("Flow ID").alias("flow_id"), col("Destination Port").alias("port"), F.col("Protocol").alias("protocol"),
                         *[F.col(r).cast("int").alias(n) for r, n in (("R08", "risky_port"), ("R09", "udp_flood"), ("R21", "icmp_tunnel"))])
