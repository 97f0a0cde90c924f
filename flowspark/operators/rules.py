"""Rule scoring: a score of 0-100 and the reasons for every flow."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.exprs import col, float_lit, number
from flowspark.operators.ordered import (
    SliceOn, _attach_totals, exact_quantiles, hot_keys, keyed_join, previous_value, slice_number)

# ---------------------------------------------------------------------------
# Thresholds.
# ---------------------------------------------------------------------------
DEFAULTS = {
    "UDP_PPS_HI": 3000.0,
    "SCAN_TARGETS": 30.0,
    "BEACON_STD_MAX": 0.005,
    "BEACON_MIN_PKTS": 20.0,
    "EXFIL_BPS_RATIO": 0.8,
    "EXFIL_UP_RATIO": 0.8,
    "EXFIL_STRICT_UP_RATIO": 0.9,
    "SYN_HEAVY": 50.0,
    "SYN_HEAVY_RATIO": 3.0,
    "SHORT_FLOW_SEC": 3.0,
    "SMALL_FLOW_BYTES": 800.0,
    "HTTP_BRUTE_MIN": 20.0,
    "SLOWLORIS_MIN_DURATION": 60.0,
    "SLOWLORIS_MAX_PPS": 5.0,
    "HTTP_LONG_FLOW_SEC": 60.0,
    "SLOWLORIS_STRICT_DURATION": 90.0,
    "SLOWLORIS_STRICT_PPS": 1.0,
    "SLOWLORIS_MAX_PKT_MEAN": 200.0,
    "ONEWAY_MIN_PKTS": 50.0,
    "ONEWAY_RATIO": 0.9,
    "DNS_TUNNEL_MIN_DURATION": 30.0,
    "DNS_TUNNEL_MIN_PPS": 50.0,
    "ICMP_TUNNEL_MIN_PPS": 20.0,
    "RATE_SPIKE_ABS": 1000.0,
    "SMALL_PKT_MEAN": 50.0,
    "SMALL_PKT_PPS": 100.0,
    "ICMP_BPS_HI": 50000.0,
    "TLS_DURATION_MAX": 1.0,
    "PORT_SCAN_UNIQUE_PORTS": 10.0,
    "BPS_SIGMA_MULT": 3.0,
    "DDOS_PKT_RATE": 1000.0,
    "DDOS_BYTE_RATE": 1_000_000.0,
    "SLOWLORIS_DURATION": 60.0,
    "SLOWLORIS_BPS_MAX": 100.0,
    "IP_SPOOF_SRC_VARIETY": 10.0,
    "ARP_PPS_HI": 100.0,
    "DNS_REQ_BYTES_MAX": 100.0,
    "DNS_RESP_BYTES_MIN": 1000.0,
    "FTP_LARGE_TRANSFER": 50000.0,
    "UNIQUE_DST_PORTS": 10.0,
    "UNIQUE_DST_IPS": 10.0,
    "TRAFFIC_SPIKE_BPS": 10000.0,
    "TRAFFIC_SPIKE_DURATION": 5.0,
    "UNUSUAL_PROTO_PPS": 100.0,
    "SHORT_SESSION_DURATION": 1.0,
    "LONG_SESSION_DURATION": 3600.0,
    "HIGH_BANDWIDTH_ABS": 100_000.0,
    "HIGH_BANDWIDTH_DURATION": 10.0,
    "HIGH_BANDWIDTH_PERCENTILE": 95.0,
    "FLOW_PPS_THRESHOLD": 200.0,
    "FLOW_BPS_THRESHOLD": 1_000_000.0,
    "FLOW_DURATION_SHORT": 1.0,
    "SPECIAL_DURATION_THRESHOLD": 0.25,
    "UP_RATIO_THRESHOLD": 0.95,
    "MIN_PKT_LEN_THRESHOLD": 40.0,
    "TOTAL_DIRECTIONAL_PKTS": 100.0,
    "RISKY_PORT_BPS": 50_000.0,
    "RISKY_PORT_PPS": 150.0,
}

# Built-in profile thresholds.
PRESET_PARAMS = {
    "baseline": {
        "FLOW_PPS_THRESHOLD": 240.0, "FLOW_BPS_THRESHOLD": 1_200_000.0, "FLOW_DURATION_SHORT": 1.2,
        "SPECIAL_DURATION_THRESHOLD": 0.3, "UP_RATIO_THRESHOLD": 0.96, "MIN_PKT_LEN_THRESHOLD": 45.0,
        "TOTAL_DIRECTIONAL_PKTS": 120.0,
    },
    "aggressive": {
        "FLOW_PPS_THRESHOLD": 90.0, "FLOW_BPS_THRESHOLD": 400_000.0, "FLOW_DURATION_SHORT": 0.5,
        "SPECIAL_DURATION_THRESHOLD": 0.12, "UP_RATIO_THRESHOLD": 0.88, "MIN_PKT_LEN_THRESHOLD": 18.0,
        "TOTAL_DIRECTIONAL_PKTS": 45.0,
    },
}

# Configured profile thresholds that differ from DEFAULTS.
CONFIGURED_PARAMS = {
    "baseline": {"SYN_HEAVY": 15.0},
    "aggressive": {
        "UDP_PPS_HI": 6000.0, "SCAN_TARGETS": 60.0, "BEACON_STD_MAX": 0.01, "BEACON_MIN_PKTS": 30.0,
        "EXFIL_BPS_RATIO": 0.9, "EXFIL_UP_RATIO": 0.85, "EXFIL_STRICT_UP_RATIO": 0.95, "SYN_HEAVY": 20.0,
        "RATE_SPIKE_ABS": 1500.0, "SMALL_PKT_MEAN": 60.0, "SMALL_PKT_PPS": 150.0, "ICMP_BPS_HI": 80000.0,
        "TLS_DURATION_MAX": 0.8, "PORT_SCAN_UNIQUE_PORTS": 15.0, "BPS_SIGMA_MULT": 4.0,
        "DDOS_PKT_RATE": 2000.0, "DDOS_BYTE_RATE": 1_500_000.0, "SLOWLORIS_DURATION": 90.0,
        "SLOWLORIS_BPS_MAX": 150.0, "IP_SPOOF_SRC_VARIETY": 15.0, "ARP_PPS_HI": 120.0,
        "DNS_REQ_BYTES_MAX": 120.0, "DNS_RESP_BYTES_MIN": 1500.0, "FTP_LARGE_TRANSFER": 75000.0,
        "UNIQUE_DST_PORTS": 20.0, "UNIQUE_DST_IPS": 20.0, "TRAFFIC_SPIKE_BPS": 15000.0,
        "UNUSUAL_PROTO_PPS": 120.0, "LONG_SESSION_DURATION": 5400.0,
    },
}

# Decision settings per profile (preset trigger, configured trigger,
# model weight, rule weight, fusion threshold, mode).
PROFILE_DECISION = {
    "baseline": (65.0, 60.0, 0.85, 0.15, 0.75, "conservative"),
    "aggressive": (25.0, 35.0, 0.25, 0.75, 0.3, "aggressive"),
}

# Fixed value: upper bound of the rule trigger when a capture is scored.
CAPTURE_TRIGGER_CAP = 25.0

# Port groups.
HTTP_PORTS = ["80", "443", "8080", "8000", "8443"]
RISKY_PORTS = ["21", "22", "23", "2323", "445", "3389", "5900"]

# Points (baseline, aggressive) and reason (baseline, aggressive) per rule.
RULES = {
    "R01": (20, 30, "High Packets/s – baseline", "High Packets/s – aggressive"),
    "R02": (20, 30, "High Bytes/s – baseline", "High Bytes/s – aggressive"),
    "R03": (15, 20, "Short Flow Duration – baseline", "Short Flow Duration – aggressive"),
    "R04": (10, 15, "Ultra-short Flow Duration – baseline", "Ultra-short Flow Duration – aggressive"),
    "R05": (15, 20, "Upstream-heavy Flow – baseline", "Upstream-heavy Flow – aggressive"),
    "R06": (10, 15, "Min Packet Length Anomaly – baseline", "Min Packet Length Anomaly – aggressive"),
    "R07": (10, 15, "Directional Packet Volume – baseline", "Directional Packet Volume – aggressive"),
    "R08": (12, 28, "High-risk service exposure – baseline",
            "High-risk service exposure / brute-force surface – aggressive"),
    "R09": (40, 40, "高包速UDP", "高包速UDP"),
    "R10": (30, 30, "端口扫描/探测", "端口扫描/探测"),
    "R11": (20, 20, "IP段扫描/探测", "IP段扫描/探测"),
    "R12": (30, 30, "周期心跳(Beacon)", "周期心跳(Beacon)"),
    "R13": (20, 20, "大带宽传输(疑似外泄)", "大带宽传输(疑似外泄)"),
    "R14": (15, 15, "上行占比异常(疑似外泄)", "上行占比异常(疑似外泄)"),
    "R15": (10, 10, "持续高带宽传输", "持续高带宽传输"),
    "R16": (20, 20, "SYN/ACK 比例异常", "SYN/ACK 比例异常"),
    "R17": (25, 25, "HTTP短小高频访问(疑似爆破/批量注入/扫描)", "HTTP短小高频访问(疑似爆破/批量注入/扫描)"),
    "R18": (20, 20, "长时间低包速连接(疑似Slowloris/慢速DoS); 疑似Slowloris攻击",
            "长时间低包速连接(疑似Slowloris/慢速DoS); 疑似Slowloris攻击"),
    "R19": (50, 50, "单向流量占比异常(可能为扫描/单向攻击/隧道)", "单向流量占比异常(可能为扫描/单向攻击/隧道)"),
    "R20": (25, 25, "DNS长时间高包速(疑似DNS隧道)", "DNS长时间高包速(疑似DNS隧道)"),
    "R21": (20, 20, "ICMP高包速(疑似ICMP隧道/探测)", "ICMP高包速(疑似ICMP隧道/探测)"),
    "R22": (20, 20, "流量速率突增", "流量速率突增"),
    "R23": (25, 25, "小包高频(疑似洪泛)", "小包高频(疑似洪泛)"),
    "R24": (30, 30, "异常 ICMP 流量", "异常 ICMP 流量"),
    "R25": (30, 30, "TLS 握手持续时间过短", "TLS 握手持续时间过短"),
    "R26": (35, 35, "端口扫描(统计)", "端口扫描(统计)"),
    "R27": (50, 50, "疑似DDoS攻击(高包速/高带宽)", "疑似DDoS攻击(高包速/高带宽)"),
    "R28": (30, 30, "疑似Slowloris攻击", "疑似Slowloris攻击"),
    "R29": (40, 40, "疑似IP欺骗(来源IP异常多)", "疑似IP欺骗(来源IP异常多)"),
    "R30": (50, 50, "疑似ARP欺骗攻击", "疑似ARP欺骗攻击"),
    "R31": (40, 40, "疑似DNS放大攻击", "疑似DNS放大攻击"),
    "R32": (30, 30, "上行占比极高(强烈外泄信号)", "上行占比极高(强烈外泄信号)"),
    "R33": (60, 60, "FTP大文件传输(疑似外泄)", "FTP大文件传输(疑似外泄)"),
    "R34": (40, 40, "疑似端口扫描(多端口)", "疑似端口扫描(多端口)"),
    "R35": (40, 40, "疑似IP扫描(多目标)", "疑似IP扫描(多目标)"),
    "R36": (50, 50, "短时流量突增", "短时流量突增"),
    "R37": (30, 30, "非常见协议高频通信", "非常见协议高频通信"),
    "R38": (20, 20, "会话持续时间过短", "会话持续时间过短"),
    "R39": (10, 10, "HTTP会话持续时间过长", "HTTP会话持续时间过长"),
    "R40": (10, 10, "会话持续时间过长", "会话持续时间过长"),
}
R39_LOW_RATE_REASON = "HTTP会话持续时间较长(低包速)"   # fixed value


@dataclass(frozen=True)
class RuleSettings:
    profile: str = "baseline"
    params: dict = field(default_factory=lambda: dict(DEFAULTS))
    trigger_threshold: float = 60.0
    model_weight: float = 0.85
    rule_weight: float = 0.15
    fusion_threshold: float = 0.75
    mode: str = "conservative"

    @property
    def aggressive(self) -> bool:
        return self.profile.startswith("agg")

    @property
    def normalized_weights(self) -> tuple[float, float]:
        """(model, rule) weights scaled to sum 1; all weight on the model if they do not add up."""
        total = self.model_weight + self.rule_weight
        if not 0.0 < total < float("inf"):
            return 1.0, 0.0
        return self.model_weight / total, self.rule_weight / total


def rule_settings(profile: str | None = None, source: str = "configured",
                  metadata: dict | None = None, trigger_cap: float | None = None, **params: float) -> RuleSettings:
    """Settings of a profile.

    `source` is "configured" (shipped configuration), "preset" (built-in
    profile) or "defaults" (plain thresholds).  Model metadata may override
    the profile, the trigger, the weights and the fusion threshold; keyword
    arguments override single thresholds.
    """
    metadata = metadata or {}
    name = str(profile or metadata.get("rule_profile") or "baseline").strip().lower()
    if name not in PROFILE_DECISION:
        name = "baseline"
    preset_trigger, configured_trigger, model_w, rule_w, threshold, mode = PROFILE_DECISION[name]
    extra = {"configured": CONFIGURED_PARAMS[name], "preset": PRESET_PARAMS[name], "defaults": {}}[source]
    trigger = configured_trigger if source == "configured" else preset_trigger
    unknown = set(params) - set(DEFAULTS)
    if unknown:
        raise KeyError(f"unknown rule thresholds: {sorted(unknown)}")
    settings = RuleSettings(
        profile=name, params={**DEFAULTS, **extra, **{k: float(v) for k, v in params.items()}},
        trigger_threshold=float(metadata.get("rule_threshold", trigger)),
        model_weight=float(metadata.get("fusion_model_weight", model_w)),
        rule_weight=float(metadata.get("fusion_rule_weight", rule_w)),
        fusion_threshold=float(metadata.get("fusion_threshold", threshold)),
        mode=mode,
    )
    if trigger_cap is not None:
        settings = replace(settings, trigger_threshold=min(settings.trigger_threshold, trigger_cap))
    return settings


# Canonical rule inputs and the spellings that add up to them.
INPUTS = {
    "duration": ["flow_duration", "Flow Duration"],
    "pps": ["pps", "flow_pkts_per_s", "Flow Packets/s", "Fwd Packets/s", "Bwd Packets/s"],
    "bps": ["bps", "flow_byts_per_s", "Flow Bytes/s"],
    "pkt_count": ["pkt_count", "Total Fwd Packets", "Tot Fwd Pkts", "Total Backward Packets", "Tot Bwd Pkts"],
    "inter_std": ["inter_arrival_std", "Flow IAT Std"],
    "flow_bytes": ["flow_bytes"],
    "flow_up_bytes": ["flow_up_bytes"],
    "pkt_mean": ["packet_length_mean", "Packet Length Mean"],
    "min_len": ["min_packet_length", "Min Packet Length"],
    "unique_ports": ["unique_ports_accessed"],
    "unique_dst_ports": ["unique_dst_ports"],
    "unique_dst_ips": ["unique_dst_ips"],
    "unique_src_ips": ["unique_src_ips"],
    "fwd_bytes": ["total_len_fwd_pkts"],
    "bwd_bytes": ["total_len_bwd_pkts"],
    "fwd_volume": ["Total Fwd Packets", "Tot Fwd Pkts", "total_fwd_pkts"],
    "bwd_volume": ["Total Backward Packets", "Tot Bwd Pkts", "total_bwd_pkts"],
    "fwd_pkts": ["Total Fwd Packets", "total_fwd_pkts"],
    "bwd_pkts": ["Total Backward Packets", "total_bwd_pkts"],
    "syn": ["SYN Flag Count", "Syn Flag Count", "syn_flag_count"],
    "ack": ["ACK Flag Count", "Ack Flag Count", "ack_flag_count"],
}
# Identity columns and their accepted spellings, first match wins.
IDENTITY = {
    "protocol": ["protocol", "Protocol", " Protocol"],
    "dst_port": ["dst_port", " Destination Port", "Destination Port"],
    "src_ip": ["src_ip", " Source IP", "Source IP"],
    "dst_ip": ["dst_ip", " Destination IP", "Destination IP"],
}
P = "__rule_"
SOURCELESS_PARTS = 1 << 14      # rows without a source are dealt by HTTP group; it only says how finely


def _total(df: DataFrame, names: list[str]) -> Column:
    terms = [number(df, n, "float") for n in names if n in df.columns]
    return reduce(lambda a, b: a + b, terms) if terms else float_lit(0.0)


def identity_columns(df: DataFrame) -> dict[str, str | None]:
    """The caller's column for protocol, port and addresses."""
    return {k: next((n for n in names if n in df.columns), None) for k, names in IDENTITY.items()}


def _rate(df: DataFrame) -> Column:
    return number(df, "flow_byts_per_s", "float") if "flow_byts_per_s" in df.columns else _total(df, INPUTS["bps"])


def canonical_inputs(df: DataFrame, normalize_protocol: bool = False, integral_ports: bool = True) -> DataFrame:
    """Add the rule inputs (prefix `__rule_`) in one projection; columns not at hand read as 0."""
    found = identity_columns(df)
    new = {P + k: _total(df, names) for k, names in INPUTS.items()}
    new[P + "rate"] = _rate(df)
    new[P + "fpps"] = number(df, "flow_pkts_per_s", "float") if "flow_pkts_per_s" in df.columns else new[P + "pps"]

    proto = F.lit("")
    if found["protocol"]:
        proto = F.coalesce(col(found["protocol"]).cast("string"), F.lit("nan"))
        if normalize_protocol:
            code = proto.try_cast("double").try_cast("int")
            proto = (F.when(code == 6, "TCP").when(code == 17, "UDP")
                     .when(code.isin(1, 58), "ICMP").otherwise(proto))
    new[P + "proto"] = proto
    new[P + "port"] = _port_text(found["dst_port"], integral_ports)
    return df.withColumns(new)


def _port_text(name: str | None, integral: bool) -> Column:
    if not name:
        return F.lit(None).cast("string")
    port = col(name).cast("string")
    return F.coalesce(port.try_cast("double").try_cast("long").cast("string"), port) if integral else port


def _dataset_thresholds(rows: DataFrame, params: dict, scope: list[str], one_rate: bool) -> DataFrame:
    """One row (per scope): duration unit switch, exfiltration and bandwidth thresholds."""
    rate = F.when(F.col(P + "rate") > 0, F.col(P + "rate").cast("double"))
    base = rows.groupBy(*scope).agg(
        F.max(F.abs(F.col(P + "duration"))).alias("__max_duration"),
        F.count(rate).alias("__n"), F.avg(rate).alias("__mean"), F.stddev_pop(rate).alias("__std"))

    def cut(column, wanted):
        """Exact quantiles of the positive values, one column per name."""
        positive = rows.select(*scope, P + column).where(F.col(P + column) > 0)
        found = exact_quantiles(positive, P + column, sorted(set(wanted.values())), by=scope)
        return found.groupBy(*scope).agg(*[
            F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n) for n, p in wanted.items()])

    exfil = params["EXFIL_BPS_RATIO"]
    exfil = exfil if exfil <= 1 else exfil / 100.0
    wide = params["HIGH_BANDWIDTH_PERCENTILE"] / 100.0
    parts = ([cut("rate", {"__exfil": exfil, "__pct": wide})] if one_rate
             else [cut("bps", {"__exfil": exfil}), cut("rate", {"__pct": wide})])
    joined = base
    for part in parts:
        joined = joined.join(part, scope, "left") if scope else joined.join(F.broadcast(part), how="left")
    dynamic = F.when(F.col("__n") > 1, F.col("__mean") + params["BPS_SIGMA_MULT"] * F.col("__std")).otherwise(0.0)
    return joined.select(
        *scope,
        (F.col("__max_duration") > 1_000_000).alias(P + "in_micros"),
        F.col("__exfil").cast("float").alias(P + "exfil_at"),
        F.greatest(F.lit(float(params["HIGH_BANDWIDTH_ABS"])), F.coalesce("__pct", F.lit(0.0)), dynamic)
        .cast("float").alias(P + "bandwidth_at"),
    )


def source_fanout(rows: DataFrame, keys: list[str], port: str | None, ip: str | None, along: list[str] | None = None) -> DataFrame:
    """Distinct targets per source (the last key); nulls do not count as targets. `along` are columns that a source has one value of."""
    count = lambda name: F.countDistinct(col(name)) if name else F.lit(None).cast("long")
    out = rows.where(col(keys[-1]).isNotNull()).groupBy(*[col(k) for k in [*keys, *(along or [])]]).agg(
        count(port).alias(P + "n_ports"), count(ip).alias(P + "n_ips"))
    return out


def _source_context(rows: DataFrame, scope: list[str], found: dict, order: list[Column], slice_on: SliceOn,
                    http: Column) -> DataFrame:
    """Distinct targets, previous rate and HTTP group size of every row's source.

    Sources of ordinary size share one shuffle on (scope, source): the window,
    the join with the per-source counts and the HTTP group count all use it.
    Rows without a source have neither a previous row nor targets, so only their
    HTTP groups stay together (`__rule_part`).
    Rows of a hot source go through slices and broadcast joins instead.
    """
    source = found["src_ip"]
    rate = _rate(rows)
    target = [found["dst_ip"], found["dst_port"]] if found["dst_ip"] and found["dst_port"] else []
    apart = [col(n) for n in target] or order
    rows = rows.withColumn(P + "part", F.when(col(source).isNull(), F.pmod(F.xxhash64(*apart), F.lit(SOURCELESS_PARTS))).otherwise(-1))
    keys = scope + [source, P + "part"]
    fanout = source_fanout(rows, scope + [source], found["dst_port"], found["dst_ip"], [P + "part"])
    group = keys + target if target else None
    hot = hot_keys(rows, keys, slice_on)

    def ordinary(part):
        part = previous_value(part, keys, order, slice_on, rate, P + "prev_rate", hot=None)
        part = part.join(fanout, keys, "left")
        if not group:
            return part.withColumn(P + "http_group", F.lit(None).cast("long"))
        size = F.sum(F.when(http, 1).otherwise(0)).over(Window.partitionBy(*[col(k) for k in group]))
        return part.withColumn(P + "http_group", size)

    out = ordinary(rows if hot is None else hot.others(rows))
    if hot is not None:
        large = hot.rows(rows)
        large = previous_value(large, keys, order, slice_on, rate, P + "prev_rate", hot=hot)
        large = large.join(F.broadcast(hot.rows(fanout)), keys, "left")
        if group:
            text = F.when(http, F.concat_ws("\u0001", *[F.coalesce(col(k).cast("string"), F.lit("\u0002")) for k in group]))
            base = hot.rows(rows).select(text.alias("__group"))
            sizes = base.where(F.col("__group").isNotNull()).groupBy("__group").agg(F.count(F.lit(1)).alias(P + "http_group"))
            large = keyed_join(large.withColumn("__group", text), sizes, ["__group"], hot_keys(base, ["__group"])).drop("__group")
        else:
            large = large.withColumn(P + "http_group", F.lit(None).cast("long"))
        out = out.unionByName(large)
    # A row without a source has no previous row.
    return out.withColumn(P + "prev_rate", F.when(col(source).isNotNull(), F.col(P + "prev_rate"))).drop(P + "part")


def rule_masks(cols: set[str], settings: RuleSettings) -> dict[str, Column]:
    """Predicate of every rule over the canonical inputs; `cols` are the caller's columns."""
    t = {k: float_lit(v) for k, v in settings.params.items()}
    c = {k: F.col(P + k) for k in [*INPUTS, "rate", "fpps", "proto", "port"]}
    has = lambda *names: all(n in cols for n in names)
    never = F.lit(False)

    upper = F.upper(c["proto"])
    http = c["port"].isin(HTTP_PORTS)
    tcp_http = (upper == "TCP") & http
    d = F.when(F.col(P + "in_micros"), (c["duration"] / 1_000_000.0).cast("float")).otherwise(c["duration"])
    positive = d > 0
    total = c["flow_bytes"]
    up = F.when(total > 0, (c["flow_up_bytes"] / total).cast("float"))
    both = has("flow_bytes", "flow_up_bytes")

    length = c["fwd_bytes"] + c["bwd_bytes"]
    volume = F.when(length == 0, c["bps"] * F.greatest(d, float_lit(1.0))).otherwise(length)
    directed = c["fwd_pkts"] + c["bwd_pkts"]
    major = (F.greatest(c["fwd_pkts"], c["bwd_pkts"]) / F.greatest(directed, float_lit(1.0))).cast("float")
    syn_ratio = (c["syn"] / F.greatest(c["ack"], float_lit(1.0))).cast("float")
    strict_for = float_lit(max(settings.params["SLOWLORIS_STRICT_DURATION"], settings.params["HTTP_LONG_FLOW_SEC"]))
    long_http = tcp_http & (d >= t["HTTP_LONG_FLOW_SEC"])

    return {
        "R01": c["fpps"] >= t["FLOW_PPS_THRESHOLD"],
        "R02": c["rate"] >= t["FLOW_BPS_THRESHOLD"],
        "R03": positive & (d <= t["FLOW_DURATION_SHORT"]),
        "R04": positive & (d <= t["SPECIAL_DURATION_THRESHOLD"]),
        "R05": (up >= t["UP_RATIO_THRESHOLD"]) if both else never,
        "R06": (c["min_len"] > 0) & (c["min_len"] <= t["MIN_PKT_LEN_THRESHOLD"]),
        "R07": F.greatest(c["fwd_volume"], c["bwd_volume"]) >= t["TOTAL_DIRECTIONAL_PKTS"],
        "R08": c["port"].isin(RISKY_PORTS) & ((c["rate"] >= t["RISKY_PORT_BPS"]) | (c["fpps"] >= t["RISKY_PORT_PPS"])),
        "R09": c["proto"].isin("17", "udp", "UDP", "Udp") & (c["pps"] > t["UDP_PPS_HI"]),
        "R10": F.col(P + "n_ports").cast("float") >= t["SCAN_TARGETS"],
        "R11": F.col(P + "n_ips").cast("float") >= t["SCAN_TARGETS"],
        "R12": ((c["inter_std"] <= t["BEACON_STD_MAX"]) & (c["pkt_count"] >= t["BEACON_MIN_PKTS"]))
        if has("inter_arrival_std") else never,
        "R13": c["bps"] >= F.col(P + "exfil_at"),
        "R14": (up >= t["EXFIL_UP_RATIO"]) if both else never,
        "R15": (c["rate"] >= F.col(P + "bandwidth_at")) & (d >= t["HIGH_BANDWIDTH_DURATION"]),
        "R16": (c["syn"] >= t["SYN_HEAVY"]) & (syn_ratio >= t["SYN_HEAVY_RATIO"]),
        "R17": http & positive & (d <= t["SHORT_FLOW_SEC"]) & (volume <= t["SMALL_FLOW_BYTES"])
        & (F.col(P + "http_group").cast("float") >= t["HTTP_BRUTE_MIN"]),
        "R18": tcp_http & (d >= strict_for) & (c["pps"] > 0) & (c["pps"] <= t["SLOWLORIS_STRICT_PPS"])
        & (c["pkt_mean"] > 0) & (c["pkt_mean"] <= t["SLOWLORIS_MAX_PKT_MEAN"]),
        "R19": (directed >= t["ONEWAY_MIN_PKTS"]) & (major >= t["ONEWAY_RATIO"]),
        "R20": (c["port"] == "53") & (d >= t["DNS_TUNNEL_MIN_DURATION"]) & (c["pps"] >= t["DNS_TUNNEL_MIN_PPS"]),
        "R21": F.lower(c["proto"]).isin("1", "icmp") & (c["pps"] >= t["ICMP_TUNNEL_MIN_PPS"]),
        "R22": F.abs(c["rate"] - F.coalesce(F.col(P + "prev_rate"), c["rate"])) > t["RATE_SPIKE_ABS"],
        "R23": (c["pkt_mean"] > 0) & (c["pkt_mean"] < t["SMALL_PKT_MEAN"]) & (c["fpps"] > t["SMALL_PKT_PPS"]),
        "R24": (upper == "ICMP") & (c["rate"] > t["ICMP_BPS_HI"]),
        "R25": (upper == "TLS") & positive & (d < t["TLS_DURATION_MAX"]),
        "R26": (c["unique_ports"] >= t["PORT_SCAN_UNIQUE_PORTS"]) if has("unique_ports_accessed") else never,
        "R27": (c["fpps"] >= t["DDOS_PKT_RATE"]) & (c["rate"] >= t["DDOS_BYTE_RATE"]),
        "R28": (d >= t["SLOWLORIS_DURATION"]) & (c["rate"] <= t["SLOWLORIS_BPS_MAX"]),
        "R29": (c["unique_src_ips"] >= t["IP_SPOOF_SRC_VARIETY"]) if has("unique_src_ips") else never,
        "R30": (upper == "ARP") & (c["fpps"] >= t["ARP_PPS_HI"]),
        "R31": (upper == "DNS") & (c["fwd_bytes"] <= t["DNS_REQ_BYTES_MAX"]) & (c["bwd_bytes"] >= t["DNS_RESP_BYTES_MIN"]),
        "R32": (up >= t["EXFIL_STRICT_UP_RATIO"]) if both else never,
        "R33": (upper == "FTP") & (length >= t["FTP_LARGE_TRANSFER"]),
        "R34": (c["unique_dst_ports"] >= t["UNIQUE_DST_PORTS"]) if has("unique_dst_ports") else never,
        "R35": (c["unique_dst_ips"] >= t["UNIQUE_DST_IPS"]) if has("unique_dst_ips") else never,
        "R36": (c["rate"] >= t["TRAFFIC_SPIKE_BPS"]) & positive & (d <= t["TRAFFIC_SPIKE_DURATION"]),
        "R37": ~upper.isin("TCP", "UDP") & (c["fpps"] >= t["UNUSUAL_PROTO_PPS"]),
        "R38": positive & (d < t["SHORT_SESSION_DURATION"]),
        "R39": long_http,
        "R40": ~F.coalesce(long_http, F.lit(False)) & (d >= t["LONG_SESSION_DURATION"]),
    }


def score_rules(df: DataFrame, settings: RuleSettings | None = None, *, order: list[str], slice_on: str | None = None,
                scope: list[str] | None = None, keep_masks: bool = False, normalize_protocol: bool = False,
                integral_ports: bool = True) -> DataFrame:
    """Add `rules_score` (0-100) and `rules_reasons`.

    `order` gives the row order within a source (rule R22); `slice_on` is its
    numeric leading column and defaults to the first one.  `scope` columns bound
    what "the data set" means for the data-dependent rules (one file, say); by
    default it is the whole input.  The input is read several times, so pass a
    stored table rather than a long unsaved plan.
    """
    settings = settings or rule_settings()
    scope = list(scope or [])
    caller = list(df.columns)
    found = identity_columns(df)
    slim = df.select(*scope, _total(df, INPUTS["duration"]).alias(P + "duration"),
                     _total(df, INPUTS["bps"]).alias(P + "bps"), _rate(df).alias(P + "rate"))
    one_rate = [n for n in INPUTS["bps"] if n in caller] == ["flow_byts_per_s"]
    limits = _dataset_thresholds(slim, settings.params, scope, one_rate)

    order_cols = [col(n) for n in order]
    slicing = partial(slice_number, df, slice_on or order[0])
    if found["src_ip"]:
        http = _port_text(found["dst_port"], integral_ports).isin(HTTP_PORTS)
        rows = _source_context(df, scope, found, order_cols, slicing, http)
    else:
        rows = previous_value(df, scope, order_cols, slicing, _rate(df), P + "prev_rate")
        rows = rows.withColumns({P + k: F.lit(None).cast("long") for k in ("n_ports", "n_ips", "http_group")})
    rows = _attach_totals(rows, limits, scope)
    # Added after the shuffle, which so carries the caller's columns only.
    rows = canonical_inputs(rows, normalize_protocol, integral_ports)

    masks = rule_masks(set(caller), settings)
    marked = rows.select(*[col(n) for n in caller], F.col(P + "pps"),
                         *[F.coalesce(m, F.lit(False)).alias(P + r) for r, m in masks.items()])
    side = 1 if settings.aggressive else 0
    points = reduce(lambda a, b: a + b, (
        F.when(F.col(P + r), F.lit(RULES[r][side])).otherwise(F.lit(0)) for r in masks))
    slow = (F.col(P + "pps") > 0) & (F.col(P + "pps") <= float_lit(settings.params["SLOWLORIS_MAX_PPS"]))
    texts = {r: F.lit(RULES[r][2 + side]) for r in masks}
    texts["R39"] = F.when(slow, F.lit(R39_LOW_RATE_REASON)).otherwise(texts["R39"])
    return marked.select(
        *[col(n) for n in caller], *([F.col(P + r).alias(r) for r in masks] if keep_masks else []),
        F.least(F.lit(100), F.greatest(F.lit(0), points)).cast("float").alias("rules_score"),
        F.concat_ws("; ", *[F.when(F.col(P + r), texts[r]) for r in masks]).alias("rules_reasons"),
    )
