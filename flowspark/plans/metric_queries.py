"""Fusion and evaluation queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import fusion as fu
from flowspark.operators import metrics as me
from flowspark.operators.rules import rule_settings
from flowspark.plans.adapters import RESULTS_SQL, results_from_lineitem
from flowspark.plans.registry import query, table

BASE, AGG = rule_settings("baseline"), rule_settings("aggressive")
ORDER = ["ts_us", "row_id"]
W = "WITH " + RESULTS_SQL


def _fused_sql(profile: str) -> str:
    s = {"baseline": BASE, "aggressive": AGG}[profile]
    hi, lo = fu.CONFIDENCE_SPLIT[profile]["high"], fu.CONFIDENCE_SPLIT[profile]["low"]
    total = s.model_weight + s.rule_weight
    w = lambda p: f"{total * p[0]!r}::DOUBLE * malicious_score + {total * p[1]!r}::DOUBLE * (rules_score / 100)"
    decide = f"fusion_score >= {s.fusion_threshold}::DOUBLE" + (
        f" OR rules_score >= {s.trigger_threshold}" if profile == "aggressive" else "")
    return f"""f0_{profile} AS (SELECT *, CASE WHEN greatest(malicious_score, 1 - malicious_score) >= 0.8::DOUBLE
                THEN {w(hi)} ELSE {w(lo)} END AS fusion_score FROM results),
{profile} AS (SELECT *, CAST(({decide}) AS INTEGER) AS fusion_decision, rules_score >= {s.trigger_threshold} AS rules_triggered FROM f0_{profile})"""


def _fused(spark, sf_dir, settings):
    return fu.fuse_votes(results_from_lineitem(spark, sf_dir), settings)


@query("fusion_plain", W + """ SELECT row_id, round(0.85::DOUBLE * malicious_score + 0.15::DOUBLE * (rules_score / 100), 9) AS fusion_score,
  CAST(0.85::DOUBLE * malicious_score + 0.15::DOUBLE * (rules_score / 100) >= 0.75::DOUBLE AS INTEGER) AS fusion_decision,
  rules_score >= 60 AS rules_triggered FROM results""")
def fusion_plain(spark, sf_dir):
    """Fusion with the configured weights and no confidence."""
    out = fu.fuse_votes(results_from_lineitem(spark, sf_dir), BASE, confidence=None)
    return out.select("row_id", F.round("fusion_score", 9).alias("fusion_score"), "fusion_decision", "rules_triggered")


for _p, _s in (("baseline", BASE), ("aggressive", AGG)):
    @query("fusion_confidence" if _p == "baseline" else "fusion_aggressive_or",
           W + ", " + _fused_sql(_p) + f" SELECT row_id, round(fusion_score, 9) AS fusion_score, fusion_decision, rules_triggered FROM {_p}")
    def _fusion(spark, sf_dir, _settings=_s):
        """Confidence-dependent weights; the aggressive profile also decides by rule trigger."""
        return _fused(spark, sf_dir, _settings).select(
            "row_id", F.round("fusion_score", 9).alias("fusion_score"), "fusion_decision", "rules_triggered")


@query("final_decision", W + ", " + _fused_sql("aggressive") + """
SELECT row_id, CAST(fusion_score >= 0.3::DOUBLE OR rules_score >= 80 OR rules_triggered AS INTEGER) AS prediction_status,
       CASE WHEN fusion_score >= 0.3::DOUBLE OR rules_score >= 80 OR rules_triggered THEN '异常' ELSE '正常' END AS fusion_status,
       CAST(rules_triggered AS INTEGER) AS rules_flag FROM aggressive""")
def final_decision(spark, sf_dir):
    """Final flow decision of batch prediction."""
    return fu.final_decision(_fused(spark, sf_dir, AGG), AGG).select("row_id", "prediction_status", "fusion_status", "rules_flag")


@query("fusion_capture_trigger", W + """ SELECT row_id, rules_score >= 25 AS rules_triggered FROM results""")
def fusion_capture_trigger(spark, sf_dir):
    """Capture scoring bounds the rule trigger at 25."""
    return fu.fuse_votes(results_from_lineitem(spark, sf_dir), rule_settings("baseline", trigger_cap=25.0)).select("row_id", "rules_triggered")


@query("vote_risk", W + """, l AS (SELECT quantile_cont(fine_score, 0.05::DOUBLE) AS cut, avg(malicious_score) AS v, stddev_pop(fine_score) AS sd FROM results)
SELECT row_id, round(least(1, greatest(0, 0.6::DOUBLE / (1 + exp(-((cut - fine_score) / (sd + 1e-6::DOUBLE))))
   + 0.4::DOUBLE * least(1, greatest(0, (malicious_score - v) / greatest(1e-6::DOUBLE, 1 - v))))), 9) AS risk_score FROM results, l""")
def vote_risk(spark, sf_dir):
    """Risk from an anomaly score and a vote ratio with thresholds taken from the data."""
    out = fu.vote_risk(results_from_lineitem(spark, sf_dir), "fine_score", "malicious_score")
    return out.select("row_id", F.round("risk_score", 9).alias("risk_score"))


@query("weight_sweep", W + """, w(model_weight, rule_weight) AS (VALUES (0.8::DOUBLE, 0.2::DOUBLE), (0.6::DOUBLE, 0.4::DOUBLE), (0.5::DOUBLE, 0.5::DOUBLE)),
x AS (SELECT *, CAST(model_weight * fine_score + rule_weight * (rules_score / 100) >= 0.5::DOUBLE AS INTEGER) AS flag FROM results, w),
c AS (SELECT model_weight, rule_weight, count(*) FILTER (WHERE label = 1 AND flag = 1) AS tp, count(*) FILTER (WHERE label = 0 AND flag = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND flag = 0) AS fn, count(*) FILTER (WHERE label = 0 AND flag = 0) AS tn,
  count(*) FILTER (WHERE rules_score >= 60) AS rules_triggered FROM x GROUP BY ALL)
SELECT model_weight, rule_weight, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 9) AS accuracy, round(tp / (tp + fp)::DOUBLE, 9) AS "precision",
  round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1,
  round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 9) AS auc, rules_triggered, tp + fp AS fused_positive FROM c""")
def weight_sweep(spark, sf_dir):
    """Metrics for three weight pairs."""
    out = me.weight_sweep(results_from_lineitem(spark, sf_dir), "label", "fine_score", "rules_score",
                          [(0.8, 0.2), (0.6, 0.4), (0.5, 0.5)])
    return _round(out, "accuracy", "precision", "recall", "f1", "auc")


def _round(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


_RATES = """round((tp + tn) / n::DOUBLE, 9) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 9) AS "precision",
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 9) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 9) AS f1,
  round(fp / (fp + tn + 1e-12::DOUBLE), 9) AS fpr"""


def _counts(y, p, by=""):
    return (f"SELECT {by} count(*) AS n, count(*) FILTER (WHERE {y} = 1 AND {p} = 1) AS tp, count(*) FILTER (WHERE {y} = 0 AND {p} = 1) AS fp, "
            f"count(*) FILTER (WHERE {y} = 1 AND {p} = 0) AS fn, count(*) FILTER (WHERE {y} = 0 AND {p} = 0) AS tn")


def auc_sql(src, score, label, by=""):
    """Rank-sum AUC and step-wise average precision of `src`, per group."""
    part = f"PARTITION BY {by}" if by else ""
    sel = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {sel} CAST(sum({label}) AS BIGINT) AS positives, CAST(sum(1 - {label}) AS BIGINT) AS negatives,
  (sum(CASE WHEN {label} = 1 THEN rk END) - sum({label}) * (sum({label}) + 1) / 2.0::DOUBLE) / (sum({label})::DOUBLE * sum(1 - {label})) AS roc_auc,
  sum(CASE WHEN {label} = 1 THEN prec END) / sum({label}) AS average_precision
FROM (SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({part + ',' if part else 'PARTITION BY'} {score}) - 1) / 2.0::DOUBLE AS rk,
        sum({label}) OVER ({part} ORDER BY {score} DESC RANGE UNBOUNDED PRECEDING)
          / count(*) OVER ({part} ORDER BY {score} DESC RANGE UNBOUNDED PRECEDING)::DOUBLE AS prec FROM {src}) {group}"""


@query("confusion_metrics", W + ", c AS (" + _counts("label", "prediction_status") + f" FROM results) SELECT tn, fp, fn, tp, {_RATES} FROM c")
def confusion_metrics(spark, sf_dir):
    """Confusion counts and rates."""
    out = me.with_rates(me.confusion_counts(results_from_lineitem(spark, sf_dir)))
    return _round(out, "accuracy", "precision", "recall", "f1", "fpr").drop("support")


@query("confusion_table", W + """ SELECT truth, predicted, CAST(count(label) AS BIGINT) AS count FROM (VALUES (0), (1)) t(truth), (VALUES (0), (1)) p(predicted)
LEFT JOIN results ON label = truth AND prediction_status = predicted GROUP BY truth, predicted""".replace(
    "FROM (VALUES (0), (1)) t(truth), (VALUES (0), (1)) p(predicted)", "FROM (SELECT * FROM (VALUES (0), (1)) t(truth), (VALUES (0), (1)) p(predicted))"))
def confusion_table(spark, sf_dir):
    """Confusion matrix as rows."""
    return me.confusion_table(results_from_lineitem(spark, sf_dir))


@query("label_confusion", "WITH c AS (" + _counts("quality", "toxic") + f" FROM labels) SELECT tn, fp, fn, tp, {_RATES} FROM c")
def label_confusion(spark, sf_dir):
    """Truth against prediction on the labels table."""
    out = me.with_rates(me.confusion_counts(table(spark, sf_dir, "labels"), "quality", "toxic"))
    return _round(out, "accuracy", "precision", "recall", "f1", "fpr").drop("support")


_DET = """, m AS (SELECT *, CASE label_name WHEN 'BENIGN' THEN 0 WHEN 'ATTACK' THEN 1 END AS y FROM (
  SELECT *, CASE WHEN label_text = 'BENIGN' THEN 'BENIGN' WHEN label_text = 'DDoS' THEN 'ATTACK' ELSE label_text END AS label_name FROM results)),
u AS (SELECT * FROM m WHERE y IS NOT NULL), c AS (""" + _counts("y", "prediction_status") + " FROM u), a AS (" + auc_sql("u", "fine_score", "y") + ")"


@query("detection_metrics", W + _DET + f" SELECT tn, fp, fn, tp, n AS support, {_RATES}, round(roc_auc, 9) AS auc FROM c, a")
def detection_metrics(spark, sf_dir):
    """Metrics over text labels; rows whose label is neither benign nor attack are left out."""
    rows = results_from_lineitem(spark, sf_dir).withColumn(
        "label_name", F.when(F.col("label_text") == "DDoS", "ATTACK").otherwise(F.col("label_text")))
    out = me.detection_metrics(rows, "label_name", "prediction_status", "fine_score")
    return _round(out, "accuracy", "precision", "recall", "f1", "fpr", "auc")


@query("metrics_first_usable_label", W + ", c AS (" + _counts("label", "prediction_status") + f" FROM results) SELECT 'label' AS label_column, tn, fp, fn, tp, {_RATES} FROM c")
def metrics_first_usable_label(spark, sf_dir):
    """The first label column that yields any 0/1 truth is used (Label holds other names here)."""
    rows = results_from_lineitem(spark, sf_dir).withColumn("class", F.concat(F.lit("c_"), "label_text"))
    chosen = me.first_usable_truth(rows, candidates=["LabelBinary", "class", "label"])
    out = me.with_rates(me.confusion_counts(rows, chosen)).drop("support").withColumn("label_column", F.lit(chosen))
    return _round(out, "accuracy", "precision", "recall", "f1", "fpr")


@query("roc_auc", W + ", a AS (" + auc_sql("results", "fine_score", "label") + "), b AS (" + auc_sql("results", "malicious_score", "label") + """)
SELECT a.positives, a.negatives, round(a.roc_auc, 9) AS fine_auc, round(b.roc_auc, 9) AS tied_auc FROM a, b""")
def roc_auc(spark, sf_dir):
    """ROC AUC of a fine score and of one with many ties."""
    return _two_curves(spark, sf_dir).agg(
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"), _of("fine", "roc_auc"), _of("tied", "roc_auc"))


def _two_curves(spark, sf_dir):
    return me.curves_of(results_from_lineitem(spark, sf_dir), {"fine": F.col("fine_score"), "tied": F.col("malicious_score")}, "label")


def _of(name, metric):
    short = {"roc_auc": "auc", "average_precision": "ap"}[metric]
    return F.round(F.max(F.when(F.col("name") == name, F.col(metric))), 9).alias(f"{name}_{short}")


@query("average_precision", W + ", a AS (" + auc_sql("results", "fine_score", "label") + "), b AS (" + auc_sql("results", "malicious_score", "label") + """)
SELECT round(a.average_precision, 9) AS fine_ap, round(b.average_precision, 9) AS tied_ap FROM a, b""")
def average_precision(spark, sf_dir):
    """Average precision, step-wise over distinct scores."""
    return _two_curves(spark, sf_dir).agg(_of("fine", "average_precision"), _of("tied", "average_precision"))


_GAPPED = """, gapped AS (SELECT label, CASE WHEN CAST(l_quantity AS INTEGER) % 10 = 0 THEN NULL WHEN CAST(l_quantity AS INTEGER) % 7 = 0 THEN 'nan'::DOUBLE ELSE fine_score END AS score FROM results),
known AS (SELECT * FROM gapped WHERE score IS NOT NULL AND NOT isnan(score)), zeroed AS (SELECT label, CASE WHEN score IS NULL OR isnan(score) THEN 0 ELSE score END AS score FROM gapped)"""


@query("roc_auc_with_gaps", W + _GAPPED + ", a AS (" + auc_sql("known", "score", "label") + "), b AS (" + auc_sql("zeroed", "score", "label") + """)
SELECT a.positives, a.negatives, round(a.roc_auc, 9) AS known_auc, round(a.average_precision, 9) AS known_ap, round(b.roc_auc, 9) AS zeroed_auc FROM a, b""")
def roc_auc_with_gaps(spark, sf_dir):
    """Scores that are missing or NaN: left out of the curves, or counted as 0."""
    rows = results_from_lineitem(spark, sf_dir).withColumn("score", F.when(F.col("l_quantity").cast("int") % 10 == 0, F.lit(None)).when(
        F.col("l_quantity").cast("int") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("fine_score")))
    a = me.curve_metrics(rows, "score", "label").select(
        "positives", "negatives", F.round("roc_auc", 9).alias("known_auc"), F.round("average_precision", 9).alias("known_ap"))
    zeroed = rows.withColumn("score", me.scored(F.col("score")))
    return a.crossJoin(me.curve_metrics(zeroed, "score", "label").select(F.round("roc_auc", 9).alias("zeroed_auc")))


_STEPS = """, s AS (SELECT rules_score AS score, sum(label) AS pos, sum(1 - label) AS neg FROM results GROUP BY rules_score),
t AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
  lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn, row_number() OVER (ORDER BY score DESC) AS i, count(*) OVER () AS k FROM s)"""


@query("roc_points", W + _STEPS + """ SELECT 'inf' AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr UNION ALL
SELECT CAST(CAST(score AS INTEGER) AS VARCHAR), round(fp / n, 9), round(tp / p, 9) FROM t WHERE i = 1 OR i = k OR np <> pos OR nn <> neg""")
def roc_points(spark, sf_dir):
    """ROC curve points."""
    out = me.roc_points(results_from_lineitem(spark, sf_dir), "rules_score", "label")
    text = F.when(F.col("threshold") == float("inf"), "inf").otherwise(F.col("threshold").try_cast("int").cast("string"))
    return _round(out.withColumn("threshold", text), "fpr", "tpr")


@query("pr_points", W + _STEPS + """ SELECT score AS threshold, round(tp / (tp + fp), 9) AS "precision", round(tp / p, 9) AS recall FROM t
UNION ALL SELECT NULL, 1, 0""")
def pr_points(spark, sf_dir):
    """Precision-recall curve points."""
    return _round(me.pr_points(results_from_lineitem(spark, sf_dir), "rules_score", "label"), "precision", "recall")


def _top_sql(score, rounding, direction, by=""):
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {by + ',' if by else ''} k, CAST(sum(label) AS BIGINT) AS hits, sum(label) / k::DOUBLE AS hit_rate FROM (
  SELECT *, row_number() OVER ({part} ORDER BY {score} DESC, ts_us {direction}, row_id {direction}) AS no,
         CAST(greatest(1, {rounding}(count(*) OVER ({part}) * 0.01::DOUBLE)) AS BIGINT) AS k FROM results) WHERE no <= k GROUP BY {by + ',' if by else ''} k"""


@query("top1_hit_floor", W + " SELECT k, hits, round(hit_rate, 9) AS hit_rate FROM (" + _top_sql("malicious_score", "floor", "ASC") + ")")
def top1_hit_floor(spark, sf_dir):
    """Hit rate of the top 1 %, rounded down, ties in row order."""
    return _round(me.top_hit_rate(results_from_lineitem(spark, sf_dir), "malicious_score", "label", ORDER), "hit_rate")


@query("top1_hit_ceil", W + " SELECT k, hits, round(hit_rate, 9) AS hit_rate FROM (" + _top_sql("malicious_score", "ceil", "DESC") + ")")
def top1_hit_ceil(spark, sf_dir):
    """Hit rate of the top 1 %, rounded up, ties to later rows."""
    return _round(me.top_hit_rate(results_from_lineitem(spark, sf_dir), "malicious_score", "label", ORDER,
                                  rounding="ceil", ties="last"), "hit_rate")


def _grid_sql(src, score, cap=None, name="best"):
    where = f"WHERE fp / (fp + tn + 1e-12::DOUBLE) <= {cap}::DOUBLE" if cap is not None else ""
    return f"""{name}_g AS (SELECT i, i * 0.001::DOUBLE AS threshold, sum(CASE WHEN {score} >= i * 0.001::DOUBLE THEN c1 ELSE 0 END) AS tp,
    sum(CASE WHEN {score} >= i * 0.001::DOUBLE THEN c0 ELSE 0 END) AS fp, sum(CASE WHEN {score} < i * 0.001::DOUBLE THEN c1 ELSE 0 END) AS fn,
    sum(CASE WHEN {score} < i * 0.001::DOUBLE THEN c0 ELSE 0 END) AS tn
  FROM (SELECT unnest(range(1001)) AS i) AS grid, (SELECT {score}, sum(label) AS c1, sum(1 - label) AS c0 FROM {src} GROUP BY {score}) GROUP BY i),
{name} AS (SELECT threshold, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1, fp / (fp + tn + 1e-12::DOUBLE) AS fpr
  FROM {name}_g {where} ORDER BY f1 DESC, i LIMIT 1)"""


for _name, _cap in (("best_f1_threshold", None), ("best_f1_threshold_fpr_cap", 0.2)):
    @query(_name, W + ", " + _grid_sql("results", "malicious_score", _cap) + " SELECT round(threshold, 9) AS threshold, round(f1, 9) AS f1, round(fpr, 9) AS fpr FROM best")
    def _best(spark, sf_dir, _cap=_cap):
        """Best F1 over the threshold grid."""
        return _round(me.best_f1_threshold(results_from_lineitem(spark, sf_dir), "malicious_score", "label", _cap), "threshold", "f1", "fpr")


@query("best_f1_by_file", W + """, x AS (SELECT pcap_file, i, i * 0.001::DOUBLE AS threshold, sum(CASE WHEN rs >= i * 0.001::DOUBLE THEN c1 ELSE 0 END) AS tp,
  sum(CASE WHEN rs >= i * 0.001::DOUBLE THEN c0 ELSE 0 END) AS fp, sum(CASE WHEN rs < i * 0.001::DOUBLE THEN c1 ELSE 0 END) AS fn,
  sum(CASE WHEN rs < i * 0.001::DOUBLE THEN c0 ELSE 0 END) AS tn
  FROM (SELECT unnest(range(1001)) AS i) AS grid, (SELECT coalesce(pcap_file, '?') AS pcap_file, rules_score / 100 AS rs, sum(label) AS c1, sum(1 - label) AS c0 FROM results GROUP BY ALL) GROUP BY ALL),
y AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1 FROM x)
SELECT pcap_file, round(threshold, 9) AS threshold, round(f1, 9) AS f1 FROM y QUALIFY row_number() OVER (PARTITION BY pcap_file ORDER BY f1 DESC, i) = 1""")
def best_f1_by_file(spark, sf_dir):
    """Best threshold of every file in one pass."""
    rows = results_from_lineitem(spark, sf_dir).withColumns({
        "pcap_file": F.coalesce("pcap_file", F.lit("?")), "rs": F.col("rules_score") / 100})
    out = me.best_f1_threshold(rows, "rs", "label", by=["pcap_file"])
    return _round(out, "threshold", "f1").select("pcap_file", "threshold", "f1")


def _variant_sql(name, src, score, decision):
    return f"SELECT '{name}' AS variant, {score} AS score, CAST({decision} AS INTEGER) AS pred, label, ts_us, row_id FROM {src}"


_TABLE_SQL = """, c AS (""" + _counts("label", "pred", "variant,") + """ FROM v GROUP BY variant),
a AS (""" + auc_sql("v", "score", "label", "variant") + """),
h AS (SELECT variant, sum(label) / k::DOUBLE AS hit_rate FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY score DESC, ts_us DESC, row_id DESC) AS no,
   CAST(greatest(1, ceil(count(*) OVER (PARTITION BY variant) * 0.01::DOUBLE)) AS BIGINT) AS k FROM v) WHERE no <= k GROUP BY variant, k),
o AS (SELECT variant, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 9) AS f1, round(roc_auc, 9) AS roc_auc,
   round(fp / (fp + tn + 1e-12::DOUBLE), 9) AS fpr, round(hit_rate, 9) AS hit_rate FROM c JOIN a USING (variant) JOIN h USING (variant))"""
_BOTH = ", " + _fused_sql("baseline") + ", " + _fused_sql("aggressive")


@query("ablation_table", W + _BOTH + ", v AS (" + " UNION ALL ".join([
    _variant_sql("model", "baseline", "malicious_score", "malicious_score >= 0.5::DOUBLE"),
    _variant_sql("rules", "baseline", "rules_score / 100", "rules_score / 100 >= 0.65::DOUBLE"),
    _variant_sql("fusion_baseline", "baseline", "fusion_score", "fusion_decision"),
    _variant_sql("fusion_aggressive", "aggressive", "fusion_score", "fusion_decision")]) + ")" + _TABLE_SQL + " SELECT * FROM o")
def ablation_table(spark, sf_dir):
    """Model, rules and both fusion profiles side by side."""
    out = me.ablation_table(_fused(spark, sf_dir, BASE), _fused(spark, sf_dir, AGG), "label", ORDER)
    return _round(out, "f1", "roc_auc", "fpr", "hit_rate")


@query("calibration_table", W + _BOTH + ", bm AS (SELECT * FROM baseline), " + ", ".join([
    _grid_sql("baseline", "malicious_score", None, "mb"), _grid_sql("baseline", "malicious_score", 0.2, "mc"),
    _grid_sql("baseline", "fusion_score", None, "fb"), _grid_sql("baseline", "fusion_score", 0.2, "fc")]) + ", v AS (" + " UNION ALL ".join([
        _variant_sql("model_fixed", "baseline", "malicious_score", "malicious_score >= 0.5::DOUBLE"),
        _variant_sql("model_best", "baseline, mb", "malicious_score", "malicious_score >= mb.threshold"),
        _variant_sql("model_capped", "baseline, mc", "malicious_score", "malicious_score >= mc.threshold"),
        _variant_sql("fusion_system", "baseline", "fusion_score", "fusion_decision"),
        _variant_sql("fusion_best", "baseline, fb", "fusion_score", "fusion_score >= fb.threshold"),
        _variant_sql("fusion_capped", "baseline, fc", "fusion_score", "fusion_score >= fc.threshold"),
        _variant_sql("fusion_aggressive", "aggressive", "fusion_score", "fusion_decision")]) + ")" + _TABLE_SQL + """
SELECT o.*, round(CASE variant WHEN 'model_fixed' THEN 0.5::DOUBLE WHEN 'model_best' THEN mb.threshold WHEN 'model_capped' THEN mc.threshold
  WHEN 'fusion_best' THEN fb.threshold WHEN 'fusion_capped' THEN fc.threshold END, 9) AS threshold FROM o, mb, mc, fb, fc""")
def calibration_table(spark, sf_dir):
    """Seven threshold variants of model and fused score."""
    out = me.calibration_table(_fused(spark, sf_dir, BASE), _fused(spark, sf_dir, AGG), "label", ORDER)
    return _round(out, "f1", "roc_auc", "fpr", "hit_rate", "threshold")


@query("eval_by_file", W + ", r AS (SELECT *, coalesce(pcap_file, '?') AS pf FROM results), a AS (" + auc_sql("r", "fine_score", "label", "pf") + """),
h AS (SELECT pf, k, sum(label) / k::DOUBLE AS hit FROM (SELECT *, row_number() OVER (PARTITION BY pf ORDER BY fine_score DESC, ts_us, row_id) AS no,
  CAST(greatest(1, floor(count(*) OVER (PARTITION BY pf) * 0.01::DOUBLE)) AS BIGINT) AS k FROM r) WHERE no <= k GROUP BY pf, k)
SELECT pf AS pcap_file, positives + negatives AS rows, positives, round(positives / (positives + negatives)::DOUBLE, 9) AS share, round(roc_auc, 9) AS roc_auc,
  round(average_precision, 9) AS average_precision, round(hit, 9) AS top1_hit, k AS top1_rows FROM a JOIN h USING (pf)""")
def eval_by_file(spark, sf_dir):
    """Evaluation row per capture file."""
    rows = results_from_lineitem(spark, sf_dir).withColumn("pcap_file", F.coalesce("pcap_file", F.lit("?")))
    return _round(me.evaluate_by_file(rows, "pcap_file", "fine_score", "label", ORDER), "share", "roc_auc", "average_precision", "top1_hit")


@query("profile_groups", W + _BOTH + """, v AS (SELECT 'A' AS grp, fusion_score, fusion_decision AS pred, label FROM baseline
UNION ALL SELECT 'B', fusion_score, fusion_decision, label FROM aggressive), c AS (""" + _counts("label", "pred", "grp,") + " FROM v GROUP BY grp), a AS ("
       + auc_sql("v", "fusion_score", "label", "grp") + f") SELECT grp AS run, tn, fp, fn, tp, {_RATES}, round(roc_auc, 9) AS auc FROM c JOIN a USING (grp)")
def profile_groups(spark, sf_dir):
    """Detection metrics per profile run."""
    cols = [F.col("fusion_score"), F.col("fusion_decision"), F.col("label")]
    both = (_fused(spark, sf_dir, BASE).select(F.lit("A").alias("run"), *cols)
            .unionByName(_fused(spark, sf_dir, AGG).select(F.lit("B").alias("run"), *cols)))
    out = me.detection_metrics(both, "label", "fusion_decision", "fusion_score", by=["run"]).drop("support")
    return _round(out, "accuracy", "precision", "recall", "f1", "fpr", "auc")


@query("column_minmax", W + """ SELECT row_id, round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER () + 1e-12::DOUBLE), 9) AS scaled FROM results""")
def column_minmax(spark, sf_dir):
    """Min-max scaled score."""
    return me.minmax_scaled(results_from_lineitem(spark, sf_dir), "l_extendedprice").select("row_id", F.round("scaled", 9).alias("scaled"))


@query("label_mismatch", W + """, b AS (SELECT row_id, label FROM results), c AS (SELECT CASE WHEN l_quantity > 2 THEN row_id ELSE 'new ' || row_id END AS row_id, CASE WHEN l_quantity > 45 THEN 1 - label ELSE label END AS label FROM results)
SELECT count(*) FILTER (WHERE c.row_id IS NULL) AS left_only, count(*) FILTER (WHERE b.row_id IS NULL) AS right_only,
  count(*) FILTER (WHERE b.label <> c.label) AS label_differs FROM b FULL JOIN c ON b.row_id = c.row_id""")
def label_mismatch(spark, sf_dir):
    """Labels of two runs compared row by row."""
    b = results_from_lineitem(spark, sf_dir).select("row_id", "label", "l_quantity")
    other = b.withColumn("label", F.when(F.col("l_quantity") > 45, 1 - F.col("label")).otherwise(F.col("label"))).withColumn(
        "row_id", F.when(F.col("l_quantity") > 2, F.col("row_id")).otherwise(F.concat(F.lit("new "), "row_id")))
    return me.label_mismatches(b, other, "row_id", "label")


@query("class_balance", W + " SELECT label, prediction_status, count(*) AS rows, avg(CASE WHEN rules_score > 50 THEN 1.0::DOUBLE ELSE 0 END) AS rule_hit_share FROM results GROUP BY ALL")
def class_balance(spark, sf_dir):
    """Class and prediction distribution with the share of rule hits."""
    return results_from_lineitem(spark, sf_dir).groupBy("label", "prediction_status").agg(
        F.count(F.lit(1)).alias("rows"), F.avg((F.col("rules_score") > 50).cast("double")).alias("rule_hit_share"))
