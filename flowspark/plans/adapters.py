"""The driver's tables read as flows, packets and scored results.

Plain arithmetic only, so that the same definition can be written in SQL; each
adapter has its SQL twin next to it (a CTE body without the leading WITH).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.plans.registry import table

ACTIVITY_TIMEOUT_SEC = 86_400.0     # the events are minutes apart, so a day stands for the 1 s gap


def epoch_us(ntz: Column) -> Column:
    """Epoch microseconds of a zone-less timestamp read as UTC."""
    zone = SparkSession.getActiveSession().conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT"):
        ntz = F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz)
    return F.unix_micros(ntz.cast("timestamp"))


def _li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumns({
        "d": F.round(F.col("l_discount") * 100).cast("int"),
        "t": F.round(F.col("l_tax") * 100).cast("int"),
        "q": F.col("l_quantity").cast("int"),
        "row_id": F.concat_ws("-", *[F.col(c).cast("string") for c in
                                     ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                              F.date_format("l_shipdate", "yyyyMMdd")),
        "ts_us": epoch_us(F.col("l_shipdate")),
    })


LI_SQL = """li AS (
  SELECT *, CAST(round(l_discount * 100) AS INTEGER) AS d, CAST(round(l_tax * 100) AS INTEGER) AS t,
         CAST(l_quantity AS INTEGER) AS q,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS row_id,
         epoch_us(l_shipdate) AS ts_us
  FROM lineitem)"""

FLOW_EXPRS = """
  row_id, ts_us,
  CASE WHEN l_suppkey % 50 = 7 THEN NULL
       ELSE concat('10.', CAST({div}(l_suppkey, 65536) % 256 AS STRING), '.',
                   CAST({div}(l_suppkey, 256) % 256 AS STRING), '.', CAST(l_suppkey % 256 AS STRING)) END AS src_ip,
  CASE WHEN l_suppkey % 6 = 3 THEN '172.16.9.9'
       WHEN l_suppkey % 4 = 1 THEN concat('172.16.0.', CAST(l_partkey % 200 AS STRING))
       ELSE concat('172.16.1.', CAST(l_partkey % 20 AS STRING)) END AS dst_ip,
  CAST(CASE WHEN l_suppkey % 10 = 0 THEN 1000 + l_partkey % 100
       ELSE CASE {div}(l_partkey, 4) % 8 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 8080 WHEN 3 THEN 22
            WHEN 4 THEN 53 WHEN 5 THEN 21 WHEN 6 THEN 3389 ELSE 5000 END END AS INT) AS dst_port,
  CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'TCP' WHEN 'AO' THEN 'UDP' WHEN 'NF' THEN '6'
       WHEN 'RF' THEN 'TCP' WHEN 'RO' THEN 'udp'
       ELSE CASE l_linenumber WHEN 1 THEN 'ICMP' WHEN 2 THEN 'TLS' WHEN 3 THEN 'ARP' WHEN 4 THEN 'DNS'
            WHEN 5 THEN 'FTP' WHEN 6 THEN '1' ELSE NULL END END AS protocol,
  CASE l_partkey % 4 WHEN 0 THEN l_quantity / 100 WHEN 1 THEN l_quantity * 10 WHEN 2 THEN l_quantity * 100
       ELSE l_quantity END AS flow_duration,
  CASE WHEN q <= 5 THEN (l_orderkey % 8) / CAST(2 AS DOUBLE) ELSE CAST(l_orderkey % 4000 AS DOUBLE) END AS flow_pkts_per_s,
  CASE l_suppkey % 5 WHEN 0 THEN l_extendedprice * 20 WHEN 2 THEN l_extendedprice / 1000
       ELSE l_extendedprice END AS flow_byts_per_s,
  CAST(4 * q + l_linenumber * d AS BIGINT) AS pkt_count,
  CAST(4 * q AS BIGINT) AS total_fwd_pkts,
  CAST(l_linenumber * d AS BIGINT) AS total_bwd_pkts,
  CAST(10 * q * (l_partkey % 3) AS BIGINT) AS total_len_fwd_pkts,
  CAST(1000 * t * t AS BIGINT) AS total_len_bwd_pkts,
  CAST(10 * q * (l_partkey % 3) + 1000 * t * t AS BIGINT) AS flow_bytes,
  CAST(10 * q * (l_partkey % 3) AS BIGINT) AS flow_up_bytes,
  CAST(20 + 40 * t AS DOUBLE) AS packet_length_mean,
  CAST(6 * d AS DOUBLE) AS min_packet_length,
  CAST(d AS DOUBLE) * CAST(0.0011 AS DOUBLE) AS inter_arrival_std,
  CAST(q AS BIGINT) AS syn_flag_count,
  CAST(d AS BIGINT) AS ack_flag_count,
  CAST(l_partkey % 13 AS BIGINT) AS unique_ports_accessed,
  CAST(l_partkey % 23 AS BIGINT) AS unique_dst_ports,
  CAST(l_partkey % 21 AS BIGINT) AS unique_dst_ips,
  CAST(t + l_partkey % 9 AS BIGINT) AS unique_src_ips,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
"""


def _select_list(text: str) -> list[str]:
    """Split a SQL select list at its top-level commas."""
    items, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return items + [cur.strip()]


def flows_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = FLOW_EXPRS.replace("{div}(l_suppkey, 65536)", "(l_suppkey div 65536)") \
        .replace("{div}(l_suppkey, 256)", "(l_suppkey div 256)").replace("{div}(l_partkey, 4)", "(l_partkey div 4)")
    return _li(spark, sf_dir).selectExpr(*_select_list(exprs))


FLOWS_SQL = LI_SQL + ",\nflows AS (SELECT " + FLOW_EXPRS.replace("{div}(l_suppkey, 65536)", "(l_suppkey // 65536)") \
    .replace("{div}(l_suppkey, 256)", "(l_suppkey // 256)").replace("{div}(l_partkey, 4)", "(l_partkey // 4)") \
    .replace("AS STRING", "AS VARCHAR").replace("AS INT)", "AS INTEGER)") + " FROM li)"


def results_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored flows: a coarse score with many ties, a fine one, rule score, file and truth."""
    return _li(spark, sf_dir).selectExpr(*_select_list(RESULT_EXPRS))


RESULT_EXPRS = """
  row_id, ts_us,
  CASE WHEN l_suppkey % 25 = 3 THEN NULL ELSE concat('capture_', CAST(l_suppkey % 40 AS STRING), '.pcap') END AS pcap_file,
  row_id AS flow_id,
  d / CAST(10 AS DOUBLE) AS malicious_score,
  CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100000 AS DOUBLE) / 100000 AS fine_score,
  CAST(2 * q AS DOUBLE) AS rules_score,
  CASE WHEN d >= 5 THEN 1 ELSE 0 END AS prediction_status,
  CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'A' AND d > 6) THEN 1 ELSE 0 END AS label,
  CASE WHEN l_returnflag = 'R' THEN 'DDoS' WHEN l_returnflag = 'A' AND d > 6 THEN 'PortScan'
       ELSE 'BENIGN' END AS label_text,
  l_quantity, l_extendedprice, CAST(t AS DOUBLE) AS tax_points, CAST(l_linenumber AS DOUBLE) AS line_number
"""

RESULTS_SQL = LI_SQL + ",\nresults AS (SELECT " + RESULT_EXPRS.replace("AS STRING", "AS VARCHAR") + " FROM li)"


def packets_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets of one capture; odd event ids are replies."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    client = F.concat(F.lit("10.0."), F.expr("cast(user_id div 256 as string)"), F.lit("."), (user % 256).cast("string"))
    server_port = (F.when(F.col("event_type") == "view", 80).when(F.col("event_type") == "click", 443)
                   .when(F.col("event_type") == "purchase", 8080).when(F.col("event_type") == "signup", 22)
                   .otherwise(53))
    client_port = (40000 + user).cast("int")
    reply = F.col("event_id") % 2 == 1
    tcp = F.col("event_type") != "error"
    payload = F.floor(F.col("value")).cast("int")
    server = F.lit("192.168.0.1")
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("file"), F.col("event_id").alias("packet_index"), epoch_us(F.col("ts")).alias("ts_us"),
        F.when(reply, server).otherwise(client).alias("src_ip"),
        F.when(reply, client).otherwise(server).alias("dst_ip"),
        F.when(reply, server_port).otherwise(client_port).cast("int").alias("src_port"),
        F.when(reply, client_port).otherwise(server_port).cast("int").alias("dst_port"),
        F.when(tcp, 6).otherwise(17).alias("protocol"),
        (40 + payload).alias("total_length"),
        F.when(tcp, 40).otherwise(28).alias("header_length"),
        payload.alias("payload_length"),
        F.when(tcp, k % 64).otherwise(0).alias("tcp_flags"),
        F.when(tcp, k * 100).otherwise(0).alias("tcp_window"),
        (payload > 0).alias("has_payload"),
        (54 + payload).alias("frame_length"),
    )


PACKETS_SQL = """ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 2 = 1 AS reply,
         event_type <> 'error' AS tcp, CAST(floor(value) AS INTEGER) AS payload,
         concat('10.0.', CAST(user_id // 256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) AS client,
         CAST(40000 + user_id AS INTEGER) AS client_port,
         CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'purchase' THEN 8080
              WHEN 'signup' THEN 22 ELSE 53 END AS server_port
  FROM events),
packets AS (
  SELECT 'events' AS file, event_id AS packet_index, epoch_us(ts) AS ts_us,
         CASE WHEN reply THEN '192.168.0.1' ELSE client END AS src_ip,
         CASE WHEN reply THEN client ELSE '192.168.0.1' END AS dst_ip,
         CASE WHEN reply THEN server_port ELSE client_port END AS src_port,
         CASE WHEN reply THEN client_port ELSE server_port END AS dst_port,
         CASE WHEN tcp THEN 6 ELSE 17 END AS protocol, 40 + payload AS total_length,
         CASE WHEN tcp THEN 40 ELSE 28 END AS header_length, payload AS payload_length,
         CASE WHEN tcp THEN k % 64 ELSE 0 END AS tcp_flags, CASE WHEN tcp THEN k * 100 ELSE 0 END AS tcp_window,
         payload > 0 AS has_payload, 54 + payload AS frame_length
  FROM ev)"""
