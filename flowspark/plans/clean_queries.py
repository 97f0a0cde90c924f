"""Schema, label and row-status queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.functions import exprs as ex
from flowspark.operators import clean as cl
from flowspark.plans.adapters import FLOWS_SQL, LI_SQL, RESULTS_SQL, flows_from_lineitem, results_from_lineitem
from flowspark.plans.registry import query, table

W = "WITH " + RESULTS_SQL


def _words(tokens):
    return "(" + ", ".join(f"'{t}'" for t in tokens) + ")"


def _unsw(spark, sf_dir):
    """Line items under the short column names of another capture tool."""
    return flows_from_lineitem(spark, sf_dir).select(
        "row_id", F.col("src_ip").alias(" srcip "), F.col("dst_ip").alias("Dst_IP"), F.col("dst_port").alias("dsport"),
        F.col("protocol").alias("proto"), F.col("flow_duration").cast("string").alias("dur"),
        F.when(F.col("total_fwd_pkts") > 150, "n/a").otherwise(F.col("total_fwd_pkts").cast("string")).alias("spkts"),
        F.col("total_bwd_pkts").alias("dpkts"), F.col("total_len_fwd_pkts").alias("sbytes"), F.col("total_len_bwd_pkts").alias("dbytes"))


_NUM = "CASE WHEN total_fwd_pkts > 150 THEN 0 ELSE total_fwd_pkts END"


@query("align_schema", "WITH " + FLOWS_SQL + f""" SELECT coalesce(src_ip, '') AS src, dst_ip AS dst, CAST(dst_port AS DOUBLE) AS port,
  CAST(coalesce(TRY_CAST(protocol AS DOUBLE), 0) AS DOUBLE) AS proto, flow_duration AS duration, CAST({_NUM} AS DOUBLE) AS fwd, CAST(total_bwd_pkts AS DOUBLE) AS bwd,
  CAST(total_len_fwd_pkts AS DOUBLE) AS fwd_bytes, 0.0::DOUBLE AS missing, '' AS label, 85 AS n_columns FROM flows""")
def align_schema(spark, sf_dir):
    """Aliased headers mapped, numbers coerced and missing columns filled into the 85-column schema."""
    out = cl.align_schema(_unsw(spark, sf_dir))
    c = ex.col
    return out.select(c("Source IP").alias("src"), c("Destination IP").alias("dst"), c("Destination Port").alias("port"), c("Protocol").alias("proto"),
                      c("Flow Duration").alias("duration"), c("Total Fwd Packets").alias("fwd"), c("Total Backward Packets").alias("bwd"),
                      c("Total Length of Fwd Packets").alias("fwd_bytes"), c("Fwd Header Length.1").alias("missing"), c("Label").alias("label"),
                      F.lit(len(out.columns)).alias("n_columns"))


@query("coerce_numeric", """WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' 12.5 ' WHEN 1 THEN 'abc' WHEN 2 THEN NULL WHEN 3 THEN 'nan' WHEN 4 THEN '1e3' ELSE source END AS raw FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 12.5 WHEN 4 THEN 1000 ELSE 0 END::DOUBLE AS value FROM t""")
def coerce_numeric(spark, sf_dir):
    """Text to number: unparseable, missing and NaN as 0."""
    k = F.col("doc_id") % 6
    raw = (F.when(k == 0, " 12.5 ").when(k == 1, "abc").when(k == 2, F.lit(None)).when(k == 3, "nan").when(k == 4, "1e3").otherwise(F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", ex.clean_double(raw).alias("value"))


@query("alias_copy", "WITH " + FLOWS_SQL + """ SELECT row_id, flow_duration AS dur, CAST(total_fwd_pkts AS DOUBLE) AS spkts, CAST(total_len_bwd_pkts AS DOUBLE) AS dbytes, dst_ip AS daddr FROM flows""")
def alias_copy(spark, sf_dir):
    """Canonical columns copied under alias names."""
    flows = flows_from_lineitem(spark, sf_dir).select(
        "row_id", F.col("flow_duration").alias("Flow Duration"), F.col("total_fwd_pkts").cast("double").alias("Total Fwd Packets"),
        F.col("total_len_bwd_pkts").cast("double").alias("Total Length of Bwd Packets"), F.col("dst_ip").alias("Destination IP"))
    return cl.add_alias_copies(flows, ["dur"]).select("row_id", "dur", "spkts", "dbytes", "daddr")


@query("label_binary", W + """ SELECT row_id, CAST(NOT contains(upper(label_text), 'BENIGN') AS INTEGER) AS label_binary FROM results""")
def label_binary(spark, sf_dir):
    """0 for benign labels, 1 for the rest."""
    return results_from_lineitem(spark, sf_dir).select("row_id", cl.label_binary(F.col("label_text")).alias("label_binary"))


@query("clean_training", W + """ SELECT l_quantity AS duration, 0.0::DOUBLE AS missing, label_text AS label, CAST(label_text <> 'BENIGN' AS INTEGER) AS label_binary FROM results""")
def clean_training(spark, sf_dir):
    """Training table: numeric features, label and binary label."""
    raw = results_from_lineitem(spark, sf_dir).select(F.col("l_quantity").cast("string").alias(" Flow Duration"), F.col("label_text").alias("Label"))
    out = cl.clean_training(raw)
    return out.select(ex.col("Flow Duration").alias("duration"), ex.col("Idle Min").alias("missing"), F.col("Label").alias("label"), F.col("LabelBinary").alias("label_binary"))


@query("binarize_truth", W + f""", w AS (SELECT row_id, CASE WHEN label_text = 'BENIGN' THEN '  Normal ' WHEN l_quantity > 48 THEN NULL ELSE label_text END AS words, CASE WHEN CAST(l_quantity AS INTEGER) % 5 = 0 THEN 'nan' ELSE label_text END AS odd, CAST(label * 3 AS VARCHAR) AS num FROM results)
SELECT row_id, CAST(coalesce(trim(words), '') <> '' AND lower(trim(coalesce(words, ''))) NOT IN {_words(cl.TRUTH_BENIGN)} AS INTEGER) AS by_words, CAST(TRY_CAST(num AS DOUBLE) > 0 AS INTEGER) AS by_number,
  CAST(trim(odd) <> '' AND lower(trim(odd)) NOT IN {_words(cl.TRUTH_BENIGN)} AS INTEGER) AS with_nan FROM w""")
def binarize_truth(spark, sf_dir):
    """Truth from words, or from numbers if the column holds any."""
    rows = results_from_lineitem(spark, sf_dir).select(
        "row_id", F.when(F.col("label_text") == "BENIGN", "  Normal ").when(F.col("l_quantity") > 48, F.lit(None)).otherwise(F.col("label_text")).alias("words"),
        F.when(F.col("l_quantity").cast("int") % 5 == 0, "nan").otherwise(F.col("label_text")).alias("odd"), (F.col("label") * 3).cast("string").alias("num"))
    rows = cl.binarize_truth(cl.binarize_truth(rows, "words", "by_words"), "num", "by_number")
    return cl.binarize_truth(rows, "odd", "with_nan").select("row_id", "by_words", "by_number", "with_nan")


@query("binarize_pred", W + f""", w AS (SELECT row_id, CASE WHEN label_text = 'DDoS' THEN 'ddos-attack' WHEN label_text = 'BENIGN' THEN 'Benign flow' WHEN l_quantity > 40 THEN '' ELSE 'maybe' END AS t FROM results)
SELECT row_id, CAST(t = 'ddos-attack' OR t = 'maybe' AS INTEGER) AS predicted FROM w""")
def binarize_pred(spark, sf_dir):
    """Predictions from words and parts of words."""
    t = (F.when(F.col("label_text") == "DDoS", "ddos-attack").when(F.col("label_text") == "BENIGN", "Benign flow").when(F.col("l_quantity") > 40, "").otherwise("maybe"))
    return cl.binarize_prediction(results_from_lineitem(spark, sf_dir).select("row_id", t.alias("t")), "t").select("row_id", "predicted")


@query("document_label_tokens", f"""SELECT doc_id, lower(trim(source)) AS word, CAST(lower(trim(lang)) NOT IN {_words(cl.EVALUATION_BENIGN)} AND NOT contains(lower(lang), 'normal') AND trim(lang) <> '' AS INTEGER) AS truth,
  contains(lower(text), 'attack') OR contains(lower(text), 'malicious') OR contains(lower(text), 'anomal') OR contains(lower(text), 'intrus') AS mentions FROM documents""")
def document_label_tokens(spark, sf_dir):
    """Token tests on whole texts."""
    docs = table(spark, sf_dir, "documents")
    rows = cl.binarize_truth(docs, "lang", "truth", cl.EVALUATION_BENIGN, ["normal"])
    low = F.lower("text")
    hit = low.contains("attack") | low.contains("malicious") | low.contains("anomal") | low.contains("intrus")
    return rows.select("doc_id", ex.lower_text(F.col("source")).alias("word"), "truth", hit.alias("mentions"))


@query("text_normalisation", r"""SELECT doc_id, md5(regexp_replace(lower(text), '[\x{FEFF}\s]+', '', 'g')) AS squashed, regexp_replace(lower(trim(source)), '[^\p{L}\p{N}]', '', 'g') AS header,
  regexp_replace(concat(source, '/', lang, '.pcap'), '[^\p{L}\p{N}_\-]', '_', 'g') AS file_name FROM documents""")
def text_normalisation(spark, sf_dir):
    """Header, file-name and white-space normalisation of whole texts."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(ex.squashed(F.col("text"))).alias("squashed"), ex.alnum_key(F.col("source")).alias("header"),
        ex.safe_file_name(F.concat("source", F.lit("/"), "lang", F.lit(".pcap"))).alias("file_name"))


@query("label_index_first_seen", W + """, f AS (SELECT label_text AS l, row_number() OVER (ORDER BY min(ts_us || '/' || row_id)) - 1 AS label_index FROM (SELECT label_text, lpad(CAST(ts_us AS VARCHAR), 20, '0') AS ts_us, row_id FROM results) GROUP BY 1)
SELECT row_id, label_text, label_index FROM results JOIN f ON label_text = l""")
def label_index_first_seen(spark, sf_dir):
    """Class index in order of first appearance."""
    rows, _ = cl.label_index(results_from_lineitem(spark, sf_dir), "label_text", ["ts_us", "row_id"])
    return rows.select("row_id", "label_text", "label_index")


@query("label_statistics", W + """ SELECT count(*) AS total_rows, count(*) FILTER (WHERE l_quantity <= 40) AS labeled_rows, count(*) FILTER (WHERE l_quantity > 40) AS dropped_rows FROM results""")
def label_statistics(spark, sf_dir):
    """Total, labelled and dropped rows."""
    rows = results_from_lineitem(spark, sf_dir).withColumn("l", F.when(F.col("l_quantity") <= 40, F.col("label_text")).otherwise("  "))
    return cl.label_statistics(rows, "l")


@query("feature_coverage", "WITH " + FLOWS_SQL + f""", c AS (SELECT 2 + CAST(total_fwd_pkts <= 150 AS INTEGER) AS a FROM flows)
SELECT count(*) AS rows, 5 AS feature_count, round(avg(a / 5.0::DOUBLE), 9) AS coverage, avg(a / 5.0::DOUBLE) < 0.2::DOUBLE AS low_coverage FROM c""")
def feature_coverage(spark, sf_dir):
    """How many model features the rows hold."""
    out = cl.coverage_summary(_unsw(spark, sf_dir), ["dur", "spkts", "dpkts", "rate", "sload"])
    return out.withColumn("coverage", F.round("coverage", 9))


@query("align_to_model", "WITH " + FLOWS_SQL + f""" SELECT CAST(flow_duration::FLOAT AS DOUBLE) AS dur, CAST({_NUM} AS DOUBLE) AS spkts, 7.0::DOUBLE AS rate, 1 AS missing_count FROM flows""")
def align_to_model(spark, sf_dir):
    """Exactly the model's columns, missing ones filled."""
    flows = cl.rename_headers(_unsw(spark, sf_dir))
    out, info = cl.align_to_model(flows, ["dur", "spkts", "rate"], fill_values={"rate": 7.0})
    return out.select(*[F.col(c).cast("double").alias(c) for c in out.columns], F.lit(info["missing_count"]).alias("missing_count"))


@query("unsw_rule_inputs", "WITH " + FLOWS_SQL + f""", r AS (SELECT row_id, coalesce(protocol, '?') AS protocol, flow_duration AS d, {_NUM} + total_bwd_pkts AS n, total_len_fwd_pkts + total_len_bwd_pkts AS b FROM flows)
SELECT row_id, protocol, CAST(d::FLOAT AS DOUBLE) AS flow_duration, CAST((n / d)::FLOAT AS DOUBLE) AS flow_pkts_per_s, CAST((b / d)::FLOAT AS DOUBLE) AS flow_byts_per_s FROM r""")
def unsw_rule_inputs(spark, sf_dir):
    """Rule inputs derived from short-named columns."""
    out = cl.unsw_rule_inputs(_unsw(spark, sf_dir))
    return out.select("row_id", F.coalesce("protocol", F.lit("?")).alias("protocol"),
                      *[F.col(c).cast("double").alias(c) for c in ("flow_duration", "flow_pkts_per_s", "flow_byts_per_s")])


@query("simple_predict", W + """, s AS (SELECT row_id, malicious_score, CASE WHEN l_quantity > 45 THEN 'Benign' WHEN l_quantity > 40 THEN '-1' WHEN l_quantity > 38 THEN '02' WHEN l_quantity > 35 THEN '2' WHEN l_quantity > 30 THEN ' bad ' ELSE '' END AS label FROM results)
SELECT row_id, CASE WHEN label = 'Benign' THEN '正常' WHEN label = '-1' THEN '异常' WHEN label = '02' THEN 'worm' WHEN label = ' bad ' THEN '异常' WHEN malicious_score >= 0.65::DOUBLE THEN '异常' ELSE '正常' END AS prediction,
  printf('%.6f', malicious_score) AS malicious_score FROM s""")
def simple_predict(spark, sf_dir):
    """Threshold predictor with label override and mapping."""
    label = (F.when(F.col("l_quantity") > 45, "Benign").when(F.col("l_quantity") > 40, "-1").when(F.col("l_quantity") > 38, "02").when(F.col("l_quantity") > 35, "2")
             .when(F.col("l_quantity") > 30, " bad ").otherwise(""))
    rows = results_from_lineitem(spark, sf_dir).select("row_id", "malicious_score", label.alias("label"))
    out = cl.simple_predict(rows, {"threshold": 0.65, "positive_label": "bad", "label_mapping": {"2": "worm"}})
    return out.select("row_id", "prediction", "malicious_score")


@query("prediction_status_counts", W + """ SELECT count(*) FILTER (WHERE l_quantity > 10) AS anomaly_count, count(*) FILTER (WHERE l_quantity <= 5) AS normal_count, count(*) AS rows, '异常' AS status_text FROM results""")
def prediction_status_counts(spark, sf_dir):
    """Anomalous and normal predictions by name and by code."""
    rows = results_from_lineitem(spark, sf_dir).select(F.when(F.col("l_quantity") > 30, 1).when(F.col("l_quantity") > 10, 3).when(F.col("l_quantity") > 5, 4).otherwise(0).alias("p"))
    return cl.prediction_status_counts(rows, "p", {3: "Malicious", 4: "unknown"})


@query("status_summary", W + """ SELECT CASE WHEN l_quantity > 30 THEN '异常' WHEN l_quantity > 10 THEN '正常' WHEN l_quantity > 5 THEN 'odd' ELSE '正常' END AS normalized_label, count(*) AS rows FROM results GROUP BY 1""")
def status_summary(spark, sf_dir):
    """Normalised labels of text predictions."""
    text = F.when(F.col("l_quantity") > 30, " Attack ").when(F.col("l_quantity") > 10, "legit").when(F.col("l_quantity") > 5, "odd").otherwise("0")
    rows = results_from_lineitem(spark, sf_dir).select(text.alias("p"))
    return cl.interpret_prediction(rows, "p").groupBy("normalized_label").agg(F.count(F.lit(1)).alias("rows"))


@query("abnormal_export", W + " SELECT row_id FROM results WHERE prediction_status = 1")
def abnormal_export(spark, sf_dir):
    """Abnormal rows by the best flag column."""
    return cl.abnormal_rows(results_from_lineitem(spark, sf_dir)).select("row_id")


@query("abnormal_export_by_score", W + " SELECT row_id FROM results WHERE malicious_score >= 0.5::DOUBLE")
def abnormal_export_by_score(spark, sf_dir):
    """Abnormal rows by score where no flag column is at hand."""
    return cl.abnormal_rows(results_from_lineitem(spark, sf_dir).drop("prediction_status"), 0.5).select("row_id")


@query("drop_predictions", W + """ SELECT row_id, label, 12 AS columns_left FROM results""")
def drop_predictions(spark, sf_dir):
    """Columns of an earlier prediction removed before scoring again."""
    left = cl.drop_predictions(results_from_lineitem(spark, sf_dir))
    return left.select("row_id", "label", F.lit(len(left.columns)).alias("columns_left"))


@query("row_status", W + """ SELECT row_id, CASE WHEN label_text = 'DDoS' THEN '异常' WHEN label_text = 'BENIGN' THEN '正常' WHEN d >= 8 THEN '异常' ELSE '正常' END AS row_status
FROM (SELECT r.*, CAST(round(malicious_score * 10) AS INTEGER) AS d FROM results r)""")
def row_status(spark, sf_dir):
    """Row status from hints in the label, positive labels and class codes."""
    rows = results_from_lineitem(spark, sf_dir).withColumns({
        "prediction_label": F.when(F.col("label_text") == "BENIGN", "benign traffic").when(F.col("label_text") == "DDoS", "ddos").otherwise("scan"),
        "prediction": F.round(F.col("malicious_score") * 10).cast("int")})
    return cl.row_status(rows, positive_tokens=["DDoS"], positive_classes=[8, 9, 10]).select("row_id", "row_status")


@query("row_messages", W + """ SELECT row_id, concat('[', CASE WHEN prediction_status = 1 THEN '异常' ELSE '正常' END, '] flow_id=', flow_id, ' -> 预测=', label_text, ' 分数=', printf('%.4f', malicious_score),
  CASE WHEN rules_score >= 60 THEN concat(' [规则命中] 规则分=', printf('%.1f', rules_score)) ELSE '' END) AS message FROM results""")
def row_messages(spark, sf_dir):
    """One readable line per row."""
    rows = results_from_lineitem(spark, sf_dir).withColumns({"prediction_label": F.col("label_text"), "rules_triggered": F.col("rules_score") >= 60})
    return cl.row_messages(rows).select("row_id", "message")


@query("train_test_alignment", "WITH " + LI_SQL + """ SELECT CAST(q AS DOUBLE) AS a, 0.0::DOUBLE AS b, CASE WHEN q > 40 THEN 0 ELSE l_extendedprice END AS c FROM li""")
def train_test_alignment(spark, sf_dir):
    """Test table with the train table's columns; infinite values as 0."""
    li = table(spark, sf_dir, "lineitem")
    train = li.select(F.col("l_quantity").cast("int").alias("a"), F.col("l_tax").alias("b"))
    price = F.when(F.col("l_quantity") > 40, F.lit(float("inf"))).otherwise(F.col("l_extendedprice"))
    test = li.select(F.col("l_quantity").cast("int").alias("a"), price.alias("c"))
    return cl.align_train_test(train, test)[1]
