"""Rule scoring queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators.rules import HTTP_PORTS, RISKY_PORTS, R39_LOW_RATE_REASON, RULES, rule_settings, score_rules
from flowspark.plans.adapters import FLOWS_SQL, flows_from_lineitem
from flowspark.plans.registry import query

ORDER = ["ts_us", "row_id"]


def _ports(ports):
    return "(" + ", ".join(f"'{p}'" for p in ports) + ")"


def _inputs_sql(p: dict) -> str:
    """Canonical inputs, per-source context and data-set thresholds over `flows`."""
    exfil = p["EXFIL_BPS_RATIO"]
    return FLOWS_SQL + f""",
base AS (
  SELECT *, flow_duration::FLOAT AS dur0, flow_pkts_per_s::FLOAT AS pps, flow_byts_per_s::FLOAT AS rate,
         pkt_count::FLOAT AS pkts, inter_arrival_std::FLOAT AS istd, packet_length_mean::FLOAT AS pmean,
         min_packet_length::FLOAT AS mlen, total_fwd_pkts::FLOAT AS fp, total_bwd_pkts::FLOAT AS bp,
         total_len_fwd_pkts::FLOAT AS fb, total_len_bwd_pkts::FLOAT AS bb,
         CASE WHEN flow_bytes > 0 THEN flow_up_bytes::FLOAT / flow_bytes::FLOAT END AS up,
         CAST(dst_port AS VARCHAR) AS port, coalesce(protocol, 'nan') AS proto
  FROM flows),
lim AS (
  SELECT max(abs(dur0)) > 1000000 AS micros,
         (quantile_cont(rate::DOUBLE, {exfil}::DOUBLE) FILTER (WHERE rate > 0))::FLOAT AS exfil_at,
         greatest({p['HIGH_BANDWIDTH_ABS']}::DOUBLE,
           coalesce(quantile_cont(rate::DOUBLE, {p['HIGH_BANDWIDTH_PERCENTILE'] / 100}::DOUBLE) FILTER (WHERE rate > 0), 0),
           CASE WHEN count(*) FILTER (WHERE rate > 0) > 1
                THEN avg(rate::DOUBLE) FILTER (WHERE rate > 0)
                     + {p['BPS_SIGMA_MULT']}::DOUBLE * stddev_pop(rate::DOUBLE) FILTER (WHERE rate > 0) ELSE 0 END)::FLOAT AS bw_at
  FROM base),
fan AS (SELECT src_ip AS fan_src, count(DISTINCT port) AS n_ports, count(DISTINCT dst_ip) AS n_ips
        FROM base WHERE src_ip IS NOT NULL GROUP BY src_ip),
x AS (
  SELECT b.*, CASE WHEN micros THEN dur0 / 1000000::FLOAT ELSE dur0 END AS dur, upper(proto) AS up_proto,
         port IN {_ports(HTTP_PORTS)} AS http, exfil_at, bw_at, n_ports, n_ips,
         CASE WHEN src_ip IS NULL THEN rate
              ELSE coalesce(lag(rate) OVER (PARTITION BY src_ip ORDER BY ts_us, row_id), rate) END AS prev_rate,
         sum(CASE WHEN port IN {_ports(HTTP_PORTS)} THEN 1 ELSE 0 END)
             OVER (PARTITION BY src_ip, dst_ip, port) AS http_group
  FROM base b CROSS JOIN lim LEFT JOIN fan ON b.src_ip = fan.fan_src)"""


def _masks_sql(p: dict) -> dict[str, str]:
    t = {k: f"{v}::FLOAT" for k, v in p.items()}
    long_http = f"(up_proto = 'TCP' AND http AND dur >= {t['HTTP_LONG_FLOW_SEC']})"
    strict = f"{max(p['SLOWLORIS_STRICT_DURATION'], p['HTTP_LONG_FLOW_SEC'])}::FLOAT"
    return {
        "R01": f"pps >= {t['FLOW_PPS_THRESHOLD']}",
        "R02": f"rate >= {t['FLOW_BPS_THRESHOLD']}",
        "R03": f"dur > 0 AND dur <= {t['FLOW_DURATION_SHORT']}",
        "R04": f"dur > 0 AND dur <= {t['SPECIAL_DURATION_THRESHOLD']}",
        "R05": f"up >= {t['UP_RATIO_THRESHOLD']}",
        "R06": f"mlen > 0 AND mlen <= {t['MIN_PKT_LEN_THRESHOLD']}",
        "R07": f"greatest(fp, bp) >= {t['TOTAL_DIRECTIONAL_PKTS']}",
        "R08": f"port IN {_ports(RISKY_PORTS)} AND (rate >= {t['RISKY_PORT_BPS']} OR pps >= {t['RISKY_PORT_PPS']})",
        "R09": f"proto IN ('17', 'udp', 'UDP', 'Udp') AND pps > {t['UDP_PPS_HI']}",
        "R10": f"n_ports >= {t['SCAN_TARGETS']}",
        "R11": f"n_ips >= {t['SCAN_TARGETS']}",
        "R12": f"istd <= {t['BEACON_STD_MAX']} AND pkts >= {t['BEACON_MIN_PKTS']}",
        "R13": "rate >= exfil_at",
        "R14": f"up >= {t['EXFIL_UP_RATIO']}",
        "R15": f"rate >= bw_at AND dur >= {t['HIGH_BANDWIDTH_DURATION']}",
        "R16": f"syn_flag_count >= {t['SYN_HEAVY']} AND "
               f"syn_flag_count::FLOAT / greatest(ack_flag_count::FLOAT, 1::FLOAT) >= {t['SYN_HEAVY_RATIO']}",
        "R17": f"http AND dur > 0 AND dur <= {t['SHORT_FLOW_SEC']} AND http_group >= {t['HTTP_BRUTE_MIN']} AND "
               f"CASE WHEN fb + bb = 0 THEN rate * greatest(dur, 1::FLOAT) ELSE fb + bb END <= {t['SMALL_FLOW_BYTES']}",
        "R18": f"up_proto = 'TCP' AND http AND dur >= {strict} AND pps > 0 AND pps <= {t['SLOWLORIS_STRICT_PPS']} "
               f"AND pmean > 0 AND pmean <= {t['SLOWLORIS_MAX_PKT_MEAN']}",
        "R19": f"fp + bp >= {t['ONEWAY_MIN_PKTS']} AND greatest(fp, bp) / greatest(fp + bp, 1::FLOAT) >= {t['ONEWAY_RATIO']}",
        "R20": f"port = '53' AND dur >= {t['DNS_TUNNEL_MIN_DURATION']} AND pps >= {t['DNS_TUNNEL_MIN_PPS']}",
        "R21": f"lower(proto) IN ('1', 'icmp') AND pps >= {t['ICMP_TUNNEL_MIN_PPS']}",
        "R22": f"abs(rate - prev_rate) > {t['RATE_SPIKE_ABS']}",
        "R23": f"pmean > 0 AND pmean < {t['SMALL_PKT_MEAN']} AND pps > {t['SMALL_PKT_PPS']}",
        "R24": f"up_proto = 'ICMP' AND rate > {t['ICMP_BPS_HI']}",
        "R25": f"up_proto = 'TLS' AND dur > 0 AND dur < {t['TLS_DURATION_MAX']}",
        "R26": f"unique_ports_accessed >= {t['PORT_SCAN_UNIQUE_PORTS']}",
        "R27": f"pps >= {t['DDOS_PKT_RATE']} AND rate >= {t['DDOS_BYTE_RATE']}",
        "R28": f"dur >= {t['SLOWLORIS_DURATION']} AND rate <= {t['SLOWLORIS_BPS_MAX']}",
        "R29": f"unique_src_ips >= {t['IP_SPOOF_SRC_VARIETY']}",
        "R30": f"up_proto = 'ARP' AND pps >= {t['ARP_PPS_HI']}",
        "R31": f"up_proto = 'DNS' AND fb <= {t['DNS_REQ_BYTES_MAX']} AND bb >= {t['DNS_RESP_BYTES_MIN']}",
        "R32": f"up >= {t['EXFIL_STRICT_UP_RATIO']}",
        "R33": f"up_proto = 'FTP' AND fb + bb >= {t['FTP_LARGE_TRANSFER']}",
        "R34": f"unique_dst_ports >= {t['UNIQUE_DST_PORTS']}",
        "R35": f"unique_dst_ips >= {t['UNIQUE_DST_IPS']}",
        "R36": f"rate >= {t['TRAFFIC_SPIKE_BPS']} AND dur > 0 AND dur <= {t['TRAFFIC_SPIKE_DURATION']}",
        "R37": f"up_proto NOT IN ('TCP', 'UDP') AND pps >= {t['UNUSUAL_PROTO_PPS']}",
        "R38": f"dur > 0 AND dur < {t['SHORT_SESSION_DURATION']}",
        "R39": long_http,
        "R40": f"NOT {long_http} AND dur >= {t['LONG_SESSION_DURATION']}",
    }


def scored_sql(settings, rules=None) -> str:
    """CTEs ending in `scored`: flows with rules_score and rules_reasons."""
    side = 1 if settings.aggressive else 0
    masks = {k: v for k, v in _masks_sql(settings.params).items() if rules is None or k in rules}
    points = " + ".join(f"CASE WHEN {m} THEN {RULES[r][side]} ELSE 0 END" for r, m in masks.items())
    texts = []
    for r, m in masks.items():
        text = f"'{RULES[r][2 + side]}'"
        if r == "R39":
            text = (f"CASE WHEN pps > 0 AND pps <= {settings.params['SLOWLORIS_MAX_PPS']}::FLOAT "
                    f"THEN '{R39_LOW_RATE_REASON}' ELSE {text} END")
        texts.append(f"CASE WHEN {m} THEN {text} END")
    return _inputs_sql(settings.params) + f""",
scored AS (
  SELECT *, CAST(least(100, greatest(0, {points})) AS DOUBLE) AS rules_score,
         concat_ws('; ', {', '.join(texts)}) AS rules_reasons
  FROM x)"""


def _full(profile: str, source: str = "configured"):
    settings = rule_settings(profile, source)

    def run(spark, sf_dir):
        scored = score_rules(flows_from_lineitem(spark, sf_dir), settings, order=ORDER)
        return scored.select("row_id", F.col("rules_score").cast("double").alias("rules_score"), "rules_reasons")

    sql = "WITH " + scored_sql(settings) + " SELECT row_id, rules_score, rules_reasons FROM scored"
    return run, sql


for _name, _args in {
    "rules_full_baseline": ("baseline",),
    "rules_full_aggressive": ("aggressive",),
    "rules_preset_baseline": ("baseline", "preset"),
    "rules_preset_aggressive": ("aggressive", "preset"),
    "rules_defaults": ("baseline", "defaults"),
}.items():
    _run, _sql = _full(*_args)
    query(_name, _sql)(_run)


_BASE = rule_settings()
_HIT_SQL = "WITH " + _inputs_sql(_BASE.params) + " SELECT " + ", ".join(
    f"CAST(count(*) FILTER (WHERE {m}) AS BIGINT) AS {r.lower()}_hits" for r, m in _masks_sql(_BASE.params).items()) + " FROM x"


@query("rule_hit_counts", _HIT_SQL)
def rule_hit_counts(spark, sf_dir):
    """How many flows each of the 40 rules marks."""
    scored = score_rules(flows_from_lineitem(spark, sf_dir), _BASE, order=ORDER, keep_masks=True)
    return scored.agg(*[F.count_if(F.col(r)).alias(r.lower() + "_hits") for r in RULES])


@query("rules_by_source_scope", "WITH " + FLOWS_SQL + f""",
s AS (SELECT *, dst_port AS scope_port, flow_byts_per_s::FLOAT AS rate FROM flows),
lim AS (SELECT scope_port, (quantile_cont(rate::DOUBLE, 0.8::DOUBLE) FILTER (WHERE rate > 0))::FLOAT AS exfil_at
        FROM s GROUP BY scope_port),
fan AS (SELECT scope_port, src_ip, count(DISTINCT dst_ip) AS n_ips FROM s WHERE src_ip IS NOT NULL GROUP BY ALL)
SELECT s.scope_port, CAST(count(*) FILTER (WHERE rate >= exfil_at) AS BIGINT) AS exfil_hits,
       CAST(count(*) FILTER (WHERE n_ips >= 30) AS BIGINT) AS sweep_hits
FROM s JOIN lim USING (scope_port) LEFT JOIN fan ON s.scope_port = fan.scope_port AND s.src_ip = fan.src_ip
GROUP BY s.scope_port""")
def rules_by_source_scope(spark, sf_dir):
    """Data-dependent rules bounded by a scope column (here the service port)."""
    flows = flows_from_lineitem(spark, sf_dir).withColumn("scope_port", F.col("dst_port"))
    scored = score_rules(flows, _BASE, order=ORDER, scope=["scope_port"], keep_masks=True)
    return scored.groupBy("scope_port").agg(
        F.count_if("R13").alias("exfil_hits"), F.count_if("R11").alias("sweep_hits"))


@query("rules_top20", "WITH " + scored_sql(_BASE) + """
SELECT row_id, rules_score, rules_reasons FROM scored ORDER BY rules_score DESC, row_id LIMIT 20""")
def rules_top20(spark, sf_dir):
    """Which flows look most dangerous, and why."""
    run, _ = _full("baseline")
    return run(spark, sf_dir).orderBy(F.col("rules_score").desc(), "row_id").limit(20)


_FIRST = [f"R0{i}" for i in range(1, 10)]


@query("rules_basic", "WITH " + scored_sql(_BASE, _FIRST) + " SELECT row_id, rules_score FROM scored")
def rules_basic(spark, sf_dir):
    """Points of the threshold rules R01 to R09 alone."""
    scored = score_rules(flows_from_lineitem(spark, sf_dir), _BASE, order=ORDER, keep_masks=True)
    points = sum((F.when(F.col(r), RULES[r][0]).otherwise(0) for r in _FIRST), F.lit(0))
    return scored.select("row_id", F.least(F.lit(100), points).cast("double").alias("rules_score"))


def _one(name, rule, columns):
    """A query per data-dependent rule: the rows it marks."""
    sql = "WITH " + _inputs_sql(_BASE.params) + f" SELECT {', '.join(columns)} FROM x WHERE {_masks_sql(_BASE.params)[rule]}"

    @query(name, sql)
    def run(spark, sf_dir):
        scored = score_rules(flows_from_lineitem(spark, sf_dir), _BASE, order=ORDER, keep_masks=True)
        return scored.where(F.col(rule)).select(*columns)
    run.__doc__ = f"Rows marked by rule {rule}."


_one("scan_port_fanout", "R10", ["row_id", "src_ip"])
_one("scan_ip_fanout", "R11", ["row_id", "src_ip"])
_one("exfil_percentile", "R13", ["row_id", "flow_byts_per_s"])
_one("high_bandwidth_dynamic", "R15", ["row_id", "flow_byts_per_s"])
_one("http_brute_groups", "R17", ["row_id", "src_ip", "dst_ip", "dst_port"])
_one("oneway_flows", "R19", ["row_id", "total_fwd_pkts", "total_bwd_pkts"])
_one("rate_spike_lag", "R22", ["row_id", "src_ip", "flow_byts_per_s"])
