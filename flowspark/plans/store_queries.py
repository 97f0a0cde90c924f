"""Queries over what the engine stores and reads again: pages, annotation log, CSV files, registries, captures by size."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.exprs import col
from flowspark.operators import analyze as an
from flowspark.operators import clean as cl
from flowspark.operators import flows as fl
from flowspark.operators import fusion as fu
from flowspark.operators import model as mo
from flowspark.operators import pages, upsert
from flowspark.operators.plugins import apply_features, register_feature
from flowspark.operators.rules import rule_settings
from flowspark.plans.adapters import FLOWS_SQL, LI_SQL, PACKETS_SQL, RESULTS_SQL, flows_from_lineitem, packets_from_events, results_from_lineitem
from flowspark.plans.analyze_queries import _ANN_SQL, _annotations
from flowspark.plans.registry import query, table
from flowspark.schema import LABEL, NUMERIC_FEATURES
from flowspark.session import scratch_dir, store
from flowspark.sources import captures as cap
from flowspark.sources import sinks, tables

ORDER = ["ts_us", "row_id"]
W = "WITH " + RESULTS_SQL
LATE_PAGE, PAGE_ROWS = 400, 100


def _write_lines(rows: DataFrame, header: str, path: str) -> list[str]:
    """Text files of the column `value`, each with the header; returns their paths."""
    def with_header(batches):
        yield pd.DataFrame({"value": [header]})
        yield from batches

    rows.select("value").mapInPandas(with_header, "value string").write.text(path)
    return [r.path for r in cap.list_files(rows.sparkSession, path, (".txt",)).collect()]


# ---- pages and annotations -----------------------------------------------------------------------------------------

@query("page_late_rows", W + f"""SELECT row_id, fine_score FROM (
  SELECT *, row_number() OVER (ORDER BY ts_us, row_id) AS no, count(*) OVER () AS n FROM results)
WHERE (no - 1) // {PAGE_ROWS} = least({LATE_PAGE}, (n + {PAGE_ROWS - 1}) // {PAGE_ROWS}) - 1""".replace("SELECT row_id", " SELECT row_id", 1))
def page_late_rows(spark, sf_dir):
    """A late page (or the last one) through the stored index, without sorting again."""
    path = scratch_dir(spark, "pages")
    pages.store_pages(results_from_lineitem(spark, sf_dir).select("row_id", "ts_us", "fine_score"), path, ORDER, PAGE_ROWS)
    return pages.read_page(spark, path, LATE_PAGE, PAGE_ROWS).select("row_id", "fine_score")


@query("annotation_upsert", "WITH x AS (SELECT 1)" + _ANN_SQL + """ SELECT flow_key, label, annotator, timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY seq % 3 DESC, timestamp DESC, seq DESC) AS place FROM a) WHERE place = 1""")
def annotation_upsert(spark, sf_dir):
    """Three batches of labels, the second one followed by a compaction: later batches replace earlier records."""
    path = scratch_dir(spark, "annotations")
    rows = _annotations(spark, sf_dir)
    for batch in range(3):
        upsert.upsert(spark, path, rows.where(F.col("seq") % 3 == batch).orderBy("timestamp", "seq"))
        if batch == 1:
            upsert.compact(spark, path)
    return upsert.read_annotations(spark, path).select("flow_key", "label", "annotator", "timestamp")


# ---- CSV -----------------------------------------------------------------------------------------------------------

@query("csv_encodings", """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN '异常流量 ' WHEN 1 THEN 'né ü ' ELSE '€ ✓ ' END || c_custkey || ' x' AS name,
  CASE c_custkey % 3 WHEN 0 THEN 'gb18030' WHEN 1 THEN 'latin1' ELSE 'utf-8' END AS encoding FROM customer""")
def csv_encodings(spark, sf_dir):
    """Files in three encodings, tested in small byte ranges and read by their own."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(
        F.when(F.col("c_custkey") % 3 == 0, "异常流量 ").when(F.col("c_custkey") % 3 == 1, "né ü ").otherwise("€ ✓ "), "c_custkey", F.lit(" x")).alias("name"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = scratch_dir(spark, "encodings")
    for rest, charset in ((0, "GB18030"), (1, "ISO-8859-1"), (2, "UTF-8")):
        rows.where(F.col("id") % 3 == rest).write.option("header", True).option("encoding", charset).csv(f"{path}/{rest}")
    listing = tables.list_csv(spark, path, recursive=True)
    probed = store(tables.probe_csv(listing, range_bytes=2048), "probed")
    read = tables.read_csv_files(listing, file_column="file", probed=probed)
    return read.join(F.broadcast(probed.select(F.col("path").alias("file"), "encoding")), "file").select(F.col("id").cast("long").alias("id"), "name", "encoding")      # a row per file


@query("csv_tree", "SELECT l_linenumber, count(*) AS rows, round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY l_linenumber")
def csv_tree(spark, sf_dir):
    """Every CSV below a folder, types inferred."""
    path = scratch_dir(spark, "tree")
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", "l_returnflag")
    rows.write.partitionBy("l_returnflag").option("header", True).csv(path)
    return tables.read_csv_tree(spark, path).groupBy(F.col("l_linenumber").cast("int").alias("l_linenumber")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("newest_dataset", """SELECT path FROM (SELECT concat('/data/', CASE WHEN p_partkey % 7 = 0 THEN 'Train_' ELSE 'x_' END, p_partkey, '.csv') AS path, p_size FROM part)
ORDER BY contains(path, 'Train_') DESC, p_size DESC, path LIMIT 1""")
def newest_dataset(spark, sf_dir):
    """The newest file, those with a telling name first."""
    name = F.concat(F.lit("/data/"), F.when(F.col("p_partkey") % 7 == 0, "Train_").otherwise("x_"), "p_partkey", F.lit(".csv"))
    return tables.newest_dataset(table(spark, sf_dir, "part").select(name.alias("path"), F.col("p_size").alias("modified_ms"))).select("path")


@query("vectorized_roundtrip", "WITH " + LI_SQL + """ SELECT row_id, l_quantity AS duration, l_extendedprice AS fwd_packets, 0.0::DOUBLE AS idle_min,
  CASE l_linenumber % 3 WHEN 1 THEN 'DDoS' WHEN 2 THEN '1' END AS label FROM li""")
def vectorized_roundtrip(spark, sf_dir):
    """A vectorised data set written and loaded: labels from the column, from a surplus last value, or none."""
    path = scratch_dir(spark, "vectorized")
    li = results_from_lineitem(spark, sf_dir)
    index = {c: i for i, c in enumerate(NUMERIC_FEATURES)}
    values = [F.lit("0")] * len(NUMERIC_FEATURES)
    values[index["Flow Duration"]], values[index["Total Fwd Packets"]] = F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string")
    # The row's own name travels as a number of the file: its key is hidden in two features.
    part = F.split("row_id", "-")
    for at, feature in enumerate(("Active Mean", "Active Std", "Active Max", "Idle Mean", "Idle Std")):
        values[index[feature]] = part[at]
    line = F.col("line_number").cast("int")
    given = F.when(line % 3 == 1, "DDoS").otherwise("")
    value = F.concat_ws(",", *values, given, F.when(line % 3 == 2, "1"))
    paths = _write_lines(li.select(value.alias("value")), ",".join([*[c.removesuffix(".1") for c in NUMERIC_FEATURES], LABEL]), path)
    rows = tables.read_vectorized(spark, paths)
    whole = [F.col(c).cast("long").cast("string") for c in ("Active Mean", "Active Std", "Active Max", "Idle Mean", "Idle Std")]
    return rows.select(F.concat_ws("-", *whole).alias("row_id"), col("Flow Duration").alias("duration"), col("Total Fwd Packets").alias("fwd_packets"),
                       col("Idle Min").alias("idle_min"), F.col("label_text").alias("label"))


@query("inferred_features", """SELECT feature, round(sum(value), 4) AS total FROM (
  UNPIVOT (SELECT l_orderkey::DOUBLE AS l_orderkey, l_partkey::DOUBLE AS l_partkey, l_suppkey::DOUBLE AS l_suppkey, l_quantity::DOUBLE AS l_quantity,
    l_extendedprice::DOUBLE AS l_extendedprice, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem)
  ON COLUMNS(*) INTO NAME feature VALUE value) GROUP BY feature""")
def inferred_features(spark, sf_dir):
    """Columns that serve as features when nothing is said: numeric, no label; with their totals."""
    rows = table(spark, sf_dir, "lineitem")
    names = cl.infer_features(rows, "l_linenumber")
    return rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names]))).groupBy(
        "feature").agg(F.round(F.sum("value"), 4).alias("total"))


# ---- captures and flows --------------------------------------------------------------------------------------------

@query("extraction_files", W + """, f AS (SELECT pcap_file AS file, count(*) AS rows FROM results WHERE pcap_file IS NOT NULL GROUP BY 1)
SELECT file, rows, true AS fits FROM f""")
def extraction_files(spark, sf_dir):
    """Flows per capture: rows read back, and whether the number of files follows the capture's size."""
    path, per_file = scratch_dir(spark, "captures"), 500
    rows = results_from_lineitem(spark, sf_dir).where("pcap_file IS NOT NULL")
    flows = rows.select(F.col("pcap_file").alias("file"), F.col("row_id").alias("Flow ID"), F.col("ts_us").cast("string").alias("Timestamp"), "fine_score")
    sinks.write_flows_per_capture(flows, path, rows_per_file=per_file)
    # With a schema Spark need not list every file once more to look for a header.
    back = spark.read.schema("`Flow ID` string, Timestamp string, fine_score string, file string").option("header", True).csv(path).withColumn("__from", F.col("_metadata.file_path"))
    counted = back.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("__from").alias("files"))
    return counted.select("file", "rows", F.col("files").between(F.lit(1), F.ceil(F.col("rows") / per_file)).alias("fits"))


@query("packet_part", "WITH " + PACKETS_SQL + """, n AS (SELECT packet_index, ts_us, (row_number() OVER (PARTITION BY file ORDER BY packet_index) - 1) // 50 + 1 AS part FROM packets)
SELECT packet_index, ts_us FROM n WHERE part = 7""")
def packet_part(spark, sf_dir):
    """One part of a capture, read from its bucket."""
    path = scratch_dir(spark, "parts")
    sinks.write_packet_chunks(fl.packet_chunks(packets_from_events(spark, sf_dir), 50), path, parts_per_bucket=5)
    return sinks.read_packet_part(spark, path, "events", 7, parts_per_bucket=5).select("packet_index", "ts_us")


@query("record_label_precedence", W + """ SELECT row_id, CASE WHEN l_quantity > 40 THEN '1' ELSE label_text END AS own, '0' AS forced FROM results""")
def record_label_precedence(spark, sf_dir):
    """Labels of extraction records: a given one, else the record's, else the flow's."""
    rows = results_from_lineitem(spark, sf_dir).select("row_id", F.col("label_text").alias(LABEL), F.when(F.col("l_quantity") > 40, 1).alias("record_label"))
    own = sinks.label_precedence(rows).select("row_id", F.col(LABEL).alias("own"))
    return own.join(sinks.label_precedence(rows, 0).select("row_id", F.col(LABEL).alias("forced")), "row_id")


@dataclass
class _Formula:
    """A model given as a column expression."""

    features: list[str]
    expression: Column

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("malicious_score", self.expression)


_MODEL_FEATURES = ["Flow Duration", "dur", "total_fwd_pkts", "spkts", "flow_byts_per_s", "never there", "nor there"]


@query("capture_scoring", "WITH " + FLOWS_SQL + """, s AS (SELECT 'capture_' || (pkt_count % 7) AS file, flow_duration AS d, least(1, greatest(0, (flow_duration + total_fwd_pkts) / 400)) AS score FROM flows)
SELECT file, count(*) AS flows, 4 AS shared_features, round(4 / 7.0::DOUBLE, 9) AS coverage, 'spkts,never there,nor there' AS missing_columns, 0 AS warnings,
  CAST(count(*) FILTER (WHERE score > 0.5) AS BIGINT) AS anomalies, round(avg(score), 6) AS mean_score FROM s GROUP BY file""")
def capture_scoring(spark, sf_dir):
    """Model scores of extracted flows: features under their aliases, missing ones as 0, coverage per capture."""
    flows = flows_from_lineitem(spark, sf_dir).withColumn("file", F.concat(F.lit("capture_"), F.col("pkt_count") % 7))
    model = _Formula(_MODEL_FEATURES, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (
        col("Flow Duration") / 2 + F.col("dur") / 2 + F.col("total_fwd_pkts") + col("never there")) / 400)))
    scored, report = mo.score_captures(flows, model)
    found = scored.groupBy("file").agg(F.count_if(F.col("malicious_score") > 0.5).alias("anomalies"), F.round(F.avg("malicious_score"), 6).alias("mean_score"))
    return report.join(found, "file").select("file", "flows", "shared_features", F.round("coverage", 9).alias("coverage"), F.array_join("missing_columns", ",").alias("missing_columns"),
                                             F.size("warnings").alias("warnings"), "anomalies", "mean_score")


# ---- registries, logs, settings ------------------------------------------------------------------------------------

@query("registry_roundtrip", """SELECT s_suppkey AS model_id, s_acctbal AS samples FROM supplier ORDER BY s_nationkey DESC, s_suppkey DESC LIMIT 1""")
def registry_roundtrip(spark, sf_dir):
    """Registry rows appended in two runs; the newest model."""
    path = scratch_dir(spark, "registry")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model_id"), F.col("s_nationkey").alias("trained_at"), F.col("s_acctbal").alias("samples"))
    for rest in (0, 1):
        sinks.append_registry(rows.where(F.col("model_id") % 2 == rest), path)
    return mo.latest_model(spark.read.parquet(path)).select("model_id", "samples")


@query("event_log_roundtrip", "SELECT 'training' AS event, r_name AS name, CAST(r_regionkey AS BIGINT) AS key FROM region")
def event_log_roundtrip(spark, sf_dir):
    """Model events, one line each."""
    path = scratch_dir(spark, "events")
    for r in table(spark, sf_dir, "region").select("r_name", "r_regionkey").collect():      # one call per event
        sinks.append_event(spark, path, "training", {"name": r["r_name"], "key": r["r_regionkey"]})
    log = spark.read.schema("timestamp timestamp, event string, data struct<name: string, key: bigint>").json(path)
    return log.where("timestamp IS NOT NULL").select("event", "data.name", "data.key")


@query("report_tables_roundtrip", W + """ SELECT 'totals' AS name, count(*) AS rows FROM (SELECT 1) UNION ALL SELECT 'by_file', count(DISTINCT coalesce(pcap_file, '')) FROM results
UNION ALL SELECT 'histogram', 50 FROM (SELECT 1)""")
def report_tables_roundtrip(spark, sf_dir):
    """Report tables written, one folder each, and read again."""
    path = scratch_dir(spark, "report")
    rows = results_from_lineitem(spark, sf_dir)
    sinks.write_tables({"totals": an.totals(rows, "pcap_file", "label"), "by_file": an.file_summary(rows, "pcap_file", "fine_score"),
                        "histogram": an.histogram(rows, "fine_score")}, path)
    out = None
    for name in ("totals", "by_file", "histogram"):
        part = spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("predictions_roundtrip", W + " SELECT row_id, fine_score, prediction_status FROM results")
def predictions_roundtrip(spark, sf_dir):
    """Predictions written as CSV and read again."""
    path = scratch_dir(spark, "predictions")
    sinks.write_predictions(results_from_lineitem(spark, sf_dir).select("row_id", "fine_score", "prediction_status"), path, "csv")
    return spark.read.option("header", True).schema("row_id string, fine_score double, prediction_status int").csv(path)


_META = {"rule_profile": "aggressive", "rule_threshold": 30.0, "fusion_model_weight": 0.5, "fusion_rule_weight": 0.25, "fusion_threshold": 0.55}


@query("rule_settings_metadata", W + """ SELECT row_id, round(0.5::DOUBLE * malicious_score + 0.25::DOUBLE * (rules_score / 100), 9) AS fusion_score,
  CAST(0.5::DOUBLE * malicious_score + 0.25::DOUBLE * (rules_score / 100) >= 0.55::DOUBLE OR rules_score >= 30 AS INTEGER) AS fusion_decision, rules_score >= 30 AS rules_triggered FROM results""")
def rule_settings_metadata(spark, sf_dir):
    """What a model's metadata says wins over the profile: trigger, weights, threshold."""
    out = fu.fuse_votes(results_from_lineitem(spark, sf_dir), rule_settings(metadata=_META), confidence=None)
    return out.select("row_id", F.round("fusion_score", 9).alias("fusion_score"), "fusion_decision", "rules_triggered")


@register_feature("price_per_unit")
def price_per_unit(df: DataFrame) -> DataFrame:
    return df.withColumn("price_per_unit", F.col("l_extendedprice") / F.col("l_quantity"))


@register_feature("price_rank")
def price_rank(df: DataFrame) -> DataFrame:
    return df.withColumn("expensive", F.col("price_per_unit") > 1500)


@query("plugin_features", W + """ SELECT row_id, CAST(floor(l_extendedprice / l_quantity) AS BIGINT) AS price_per_unit, l_extendedprice / l_quantity > 1500 AS expensive FROM results""")
def plugin_features(spark, sf_dir):
    """Registered feature functions applied in order."""
    rows = apply_features(results_from_lineitem(spark, sf_dir), ["price_per_unit", "price_rank"])
    return rows.select("row_id", F.floor("price_per_unit").alias("price_per_unit"), "expensive")
