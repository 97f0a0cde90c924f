"""Every table of the composed result report and its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import analyze as an
from flowspark.plans.adapters import RESULTS_SQL, results_from_lineitem
from flowspark.plans.metric_queries import auc_sql
from flowspark.plans.registry import query

ORDER = ["ts_us", "row_id"]
W = "WITH " + RESULTS_SQL + ", r AS (SELECT *, CAST(malicious_score AS FLOAT)::DOUBLE AS s FROM results)"
TRAINING = {0.01: 0.01, 0.05: 0.08, 0.5: 0.7, 0.9: 0.5, 0.95: 0.9}


def _report(spark, sf_dir, table, *dropped, **metadata):
    rows = results_from_lineitem(spark, sf_dir).drop("label_text", *dropped)
    return an.analyze_results(rows, ORDER, metadata)[table]


def _round(df, *cols, digits=6):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


@query("report_by_file", W + """ SELECT pcap_file, count(*) AS total, round(avg(s), 6) AS mean, round(min(s), 6) AS min, round(max(s), 6) AS max,
  CAST(sum(prediction_status) AS BIGINT) AS malicious_count, round(avg(prediction_status), 6) AS malicious_ratio FROM r GROUP BY pcap_file""")
def report_by_file(spark, sf_dir):
    """The report's table of files."""
    return _round(_report(spark, sf_dir, "by_file", "label"), "mean", "min", "max", "malicious_ratio")


_TOP = """, t AS (SELECT *, row_number() OVER (ORDER BY s DESC, ts_us, row_id) AS rank, count(*) OVER () AS n FROM r),
top AS (SELECT * FROM t WHERE rank <= least(2000, CASE WHEN n >= 20 THEN greatest(20, floor(n * 0.02::DOUBLE)) ELSE greatest(1, floor(n * 0.02::DOUBLE)) END))"""


@query("report_top", W + _TOP + " SELECT rank, round(s, 6) AS malicious_score, prediction_status AS flag, row_id AS flow_id, pcap_file, '' AS top_reasons FROM top")
def report_top(spark, sf_dir):
    """The report's most suspicious rows, two percent of all."""
    return _round(_report(spark, sf_dir, "top", "label", refine_top_percent=2.0), "malicious_score")


@query("report_anomaly_files", W + _TOP + " SELECT pcap_file, CAST(min(rank) AS BIGINT) AS rank FROM top WHERE pcap_file IS NOT NULL GROUP BY pcap_file ORDER BY 2 LIMIT 10")
def report_anomaly_files(spark, sf_dir):
    """The report's first files among the most suspicious rows."""
    return _report(spark, sf_dir, "anomaly_files", "label", refine_top_percent=2.0).withColumn("rank", F.col("rank").cast("long"))


@query("report_quantiles", W + " " + " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS prob, round(quantile_cont(s, {p}::DOUBLE), 6) AS quantile FROM r" for p in an.QUANTILE_POINTS))
def report_quantiles(spark, sf_dir):
    """The report's score quantiles."""
    return _round(_report(spark, sf_dir, "quantiles", "label"), "quantile")


@query("report_histogram", W + """, e AS (SELECT min(s) AS lo, max(s) AS hi FROM r),
c AS (SELECT CAST(least(49, floor((s - lo) * 50 / (hi - lo))) AS INTEGER) AS bin, count(*) AS n FROM r, e GROUP BY 1)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / 50), 6) AS low, round(lo + (b.bin + 1) * ((hi - lo) / 50), 6) AS high, coalesce(n, 0) AS count
FROM (SELECT CAST(unnest(range(50)) AS INTEGER) AS bin) b CROSS JOIN e LEFT JOIN c USING (bin)""")
def report_histogram(spark, sf_dir):
    """The report's histogram of scores."""
    return _round(_report(spark, sf_dir, "histogram", "label"), "low", "high")


@query("report_drift", W + ", q AS (" + " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS prob, quantile_cont(s, {p}::DOUBLE) AS quantile, {TRAINING[p]}::DOUBLE AS baseline FROM r" for p in an.DRIFT_POINTS) + """)
SELECT prob, round(quantile, 6) AS quantile, baseline, round(abs(quantile - baseline) / greatest(abs(baseline), 1e-6::DOUBLE), 6) AS drift
FROM q WHERE abs(quantile - baseline) / greatest(abs(baseline), 1e-6::DOUBLE) > 0.15::DOUBLE""")
def report_drift(spark, sf_dir):
    """The report's drift alerts against training quantiles."""
    return _round(_report(spark, sf_dir, "drift", "label", score_quantiles=TRAINING), "quantile", "drift")


_STEPS = """, st AS (SELECT s AS score, sum(label) AS pos, sum(1 - label) AS neg FROM r GROUP BY s),
t AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n,
  lead(pos) OVER (ORDER BY score DESC) AS np, lead(neg) OVER (ORDER BY score DESC) AS nn, row_number() OVER (ORDER BY score DESC) AS i, count(*) OVER () AS k FROM st)"""


@query("report_roc", W + _STEPS + """ SELECT -1.0::DOUBLE AS threshold, 0::DOUBLE AS fpr, 0::DOUBLE AS tpr UNION ALL
SELECT round(score, 6), round(fp / n, 6), round(tp / p, 6) FROM t WHERE i = 1 OR i = k OR np <> pos OR nn <> neg""")
def report_roc(spark, sf_dir):
    """The report's ROC curve; its start at infinity reads -1 here."""
    out = _report(spark, sf_dir, "roc", threshold=0.5)
    return _round(out.withColumn("threshold", F.when(F.col("threshold") == float("inf"), -1.0).otherwise(F.col("threshold"))), "threshold", "fpr", "tpr")


@query("report_pr", W + _STEPS + """ SELECT round(score, 6) AS threshold, round(tp / (tp + fp), 6) AS "precision", round(tp / p, 6) AS recall FROM t
UNION ALL SELECT NULL, 1, 0""")
def report_pr(spark, sf_dir):
    """The report's precision-recall curve."""
    return _round(_report(spark, sf_dir, "pr", threshold=0.5), "threshold", "precision", "recall")


@query("report_curve", W + ", a AS (" + auc_sql("r", "s", "label") + """)
SELECT positives, negatives, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM a""")
def report_curve(spark, sf_dir):
    """The report's areas under both curves."""
    return _round(_report(spark, sf_dir, "curve", threshold=0.5), "roc_auc", "average_precision")


@query("report_confusion", W + """ SELECT count(*) FILTER (WHERE label = 0 AND s < 0.5) AS tn, count(*) FILTER (WHERE label = 0 AND s >= 0.5) AS fp,
  count(*) FILTER (WHERE label = 1 AND s < 0.5) AS fn, count(*) FILTER (WHERE label = 1 AND s >= 0.5) AS tp FROM r""")
def report_confusion(spark, sf_dir):
    """The report's confusion counts at the model's own threshold."""
    return _report(spark, sf_dir, "confusion", threshold=0.5).select("tn", "fp", "fn", "tp")
