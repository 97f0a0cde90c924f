"""Report, sampling, annotation and matching queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowspark.operators import analyze as an
from flowspark.operators import annotate as ann
from flowspark.operators import sample as sa
from flowspark.operators.rules import rule_settings, score_rules
from flowspark.plans.adapters import FLOWS_SQL, RESULTS_SQL, flows_from_lineitem, results_from_lineitem
from flowspark.plans.registry import query, table
from flowspark.plans.rule_queries import scored_sql

ORDER = ["ts_us", "row_id"]
W = "WITH " + RESULTS_SQL


def _round(df, *cols, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("summary_by_file", W + """ SELECT pcap_file, count(fine_score) AS total, round(avg(fine_score), 9) AS mean, min(fine_score) AS min, max(fine_score) AS max,
  CAST(sum(prediction_status) AS BIGINT) AS malicious_count, round(sum(prediction_status) / count(fine_score)::DOUBLE, 9) AS malicious_ratio FROM results GROUP BY pcap_file""")
def summary_by_file(spark, sf_dir):
    """Score summary per file, files without a name as one group."""
    return _round(an.file_summary(results_from_lineitem(spark, sf_dir), "pcap_file", "fine_score", "prediction_status"), "mean", "malicious_ratio")


@query("global_totals", W + """ SELECT count(*) AS total_rows, count(DISTINCT pcap_file) AS unique_files, CAST(sum(prediction_status) AS BIGINT) AS malicious_total,
  round(avg(prediction_status), 9) AS malicious_ratio, '异常' AS status_text FROM results""")
def global_totals(spark, sf_dir):
    """Dataset totals and status."""
    return _round(an.totals(results_from_lineitem(spark, sf_dir), "pcap_file", "prediction_status"), "malicious_ratio")


@query("score_quantiles", W + """ SELECT p AS prob, round(quantile_cont(CAST(fine_score AS FLOAT)::DOUBLE, p), 9) AS quantile FROM results, (SELECT 1) GROUP BY p""".replace(
    "SELECT p AS prob, round(quantile_cont(CAST(fine_score AS FLOAT)::DOUBLE, p), 9) AS quantile FROM results, (SELECT 1) GROUP BY p",
    " UNION ALL ".join(f"SELECT {p}::DOUBLE AS prob, round(quantile_cont(CAST(fine_score AS FLOAT)::DOUBLE, {p}::DOUBLE), 9) AS quantile FROM results"
                       for p in an.QUANTILE_POINTS)))
def score_quantiles(spark, sf_dir):
    """Exact score quantiles at single precision."""
    rows = results_from_lineitem(spark, sf_dir).withColumn("s", F.col("fine_score").cast("float"))
    return _round(an.score_quantiles(rows, "s"), "quantile")


_TRAIN = {0.01: 0.01, 0.05: 0.08, 0.5: 0.499, 0.9: 0.5, 0.95: 0.9}


@query("drift_alerts", W + ", q AS (" + " UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS prob, quantile_cont(fine_score, {p}::DOUBLE) AS quantile, {_TRAIN[p]}::DOUBLE AS baseline FROM results"
    for p in an.DRIFT_POINTS) + """) SELECT prob, round(quantile, 9) AS quantile, baseline, round(abs(quantile - baseline) / greatest(abs(baseline), 1e-6::DOUBLE), 9) AS drift
FROM q WHERE abs(quantile - baseline) / greatest(abs(baseline), 1e-6::DOUBLE) > 0.15::DOUBLE""")
def drift_alerts(spark, sf_dir):
    """Quantiles that drifted from the training quantiles."""
    return _round(an.drift_alerts(results_from_lineitem(spark, sf_dir), "fine_score", _TRAIN), "quantile", "drift")


@query("score_histogram", W + """, e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM results),
c AS (SELECT CAST(least(49, floor((l_extendedprice - lo) * 50 / (hi - lo))) AS INTEGER) AS bin, count(*) AS n FROM results, e GROUP BY 1)
SELECT b.bin, round(lo + b.bin * ((hi - lo) / 50), 6) AS low, round(lo + (b.bin + 1) * ((hi - lo) / 50), 6) AS high, coalesce(n, 0) AS count
FROM (SELECT CAST(unnest(range(50)) AS INTEGER) AS bin) b CROSS JOIN e LEFT JOIN c USING (bin)""")
def score_histogram(spark, sf_dir):
    """Fifty equal-width bins."""
    return _round(an.histogram(results_from_lineitem(spark, sf_dir), "l_extendedprice"), "low", "high", digits=6)


_TOP = """, t AS (SELECT *, row_number() OVER (ORDER BY {score} {dir}, ts_us, row_id) AS rank, count(*) OVER () AS n FROM results),
top AS (SELECT * FROM t WHERE rank <= least(2000, CASE WHEN n >= 20 THEN greatest(20, floor(n * 0.01::DOUBLE)) ELSE greatest(1, floor(n * 0.01::DOUBLE)) END))"""


@query("topn_scores", W + _TOP.format(score="malicious_score", dir="DESC") + " SELECT rank, row_id, malicious_score FROM top")
def topn_scores(spark, sf_dir):
    """Most suspicious rows, ties in row order."""
    return an.top_rows(results_from_lineitem(spark, sf_dir), "malicious_score", ORDER).select("rank", "row_id", "malicious_score")


@query("topn_lowest", W + _TOP.format(score="fine_score", dir="ASC") + " SELECT rank, row_id, fine_score FROM top")
def topn_lowest(spark, sf_dir):
    """Lowest scores, for scores where small means bad."""
    return an.top_rows(results_from_lineitem(spark, sf_dir), "fine_score", ORDER, descending=False).select("rank", "row_id", "fine_score")


_FEATS = ["l_quantity", "l_extendedprice", "tax_points", "line_number", "rules_score", "malicious_score"]


@query("topn_reasons", W + _TOP.format(score="fine_score", dir="DESC") + ", st AS (SELECT " + ", ".join(
    f"avg(CAST({c} AS FLOAT)::DOUBLE)::FLOAT AS m_{c}, greatest(stddev_pop(CAST({c} AS FLOAT)::DOUBLE), 1e-6::DOUBLE)::FLOAT AS s_{c}" for c in _FEATS) + """ FROM top),
z AS (SELECT rank, row_id, unnest([""" + ", ".join(
    f"{{'i': {i}, 'name': '{c}', 'z': abs((CAST({c} AS FLOAT) - m_{c}) / s_{c})}}" for i, c in enumerate(_FEATS)) + """]) AS f FROM top, st),
k AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY f.z DESC, f.i) AS no FROM z)
SELECT rank, row_id, coalesce(string_agg(printf('%s:%.2f', f.name, f.z::DOUBLE), ', ' ORDER BY no) FILTER (WHERE f.z > 0 AND no <= 5), '') AS top_reasons FROM k GROUP BY rank, row_id""")
def topn_reasons(spark, sf_dir):
    """Why each top row stands out."""
    top = an.top_rows(results_from_lineitem(spark, sf_dir), "fine_score", ORDER)
    return an.top_reasons(top, _FEATS).select("rank", "row_id", "top_reasons")


@query("top_feature_rows", W + _TOP.format(score="fine_score", dir="DESC") + """, ids AS (SELECT DISTINCT pcap_file FROM top WHERE pcap_file IS NOT NULL)
SELECT pcap_file, l_quantity, rules_score FROM (SELECT *, row_number() OVER (PARTITION BY pcap_file ORDER BY ts_us, row_id) AS no FROM results
WHERE pcap_file IN (SELECT pcap_file FROM ids)) WHERE no = 1""")
def top_feature_rows(spark, sf_dir):
    """First full row of every id among the top rows (semi join)."""
    rows = results_from_lineitem(spark, sf_dir)
    top = an.top_rows(rows, "fine_score", ORDER)
    return an.first_rows_by_id(rows, top, "pcap_file", ["l_quantity", "rules_score"], ORDER)


@query("anomaly_files", W + _TOP.format(score="fine_score", dir="DESC") + """ SELECT pcap_file, min(rank) AS rank FROM top WHERE pcap_file IS NOT NULL GROUP BY pcap_file ORDER BY 2 LIMIT 10""")
def anomaly_files(spark, sf_dir):
    """First ten files among the top rows."""
    top = an.top_rows(results_from_lineitem(spark, sf_dir), "fine_score", ORDER)
    return an.anomaly_files(top, "pcap_file").withColumn("rank", F.col("rank").cast("long"))


@query("anomaly_samples", W + """ SELECT pcap_file, row_id, sample FROM (SELECT *, row_number() OVER (PARTITION BY pcap_file ORDER BY ts_us, row_id) AS sample
FROM results WHERE prediction_status = 1) WHERE sample <= 3""")
def anomaly_samples(spark, sf_dir):
    """First three anomalies of every file."""
    out = an.anomaly_samples(results_from_lineitem(spark, sf_dir), "pcap_file", F.col("prediction_status") == 1, ORDER)
    return out.select("pcap_file", "row_id", "sample")


@query("batch_summary", W + """, f AS (SELECT pcap_file, count(*) AS n, count(*) FILTER (WHERE rules_score > 98 AND prediction_status = 1 AND fine_score > 0.9::DOUBLE) AS bad FROM results GROUP BY 1)
SELECT count(*) AS files_ok, CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (WHERE bad > 0) AS anomaly_files, CAST(sum(bad) AS BIGINT) AS anomaly_rows, 0 AS files_failed FROM f""")
def batch_summary(spark, sf_dir):
    """Totals of a batch run over many files."""
    flag = (F.col("rules_score") > 98) & (F.col("prediction_status") == 1) & (F.col("fine_score") > 0.9)
    return an.batch_summary(results_from_lineitem(spark, sf_dir), "pcap_file", flag)


@query("run_status", W + ", q AS (" + " UNION ALL ".join(
    f"SELECT quantile_cont(fine_score, {p}::DOUBLE) AS v, {_TRAIN[p]}::DOUBLE AS b FROM results" for p in an.DRIFT_POINTS) + """)
SELECT count(*) AS total, CAST(sum(prediction_status) AS BIGINT) AS anomalies, round(avg(prediction_status), 9) AS ratio,
 (SELECT count(*) FROM q WHERE abs(v - b) / greatest(abs(b), 1e-6::DOUBLE) > 0.15::DOUBLE) AS alerts, max(ts_us) AS last_update FROM results""")
def run_status(spark, sf_dir):
    """Status line of the last run."""
    rows = results_from_lineitem(spark, sf_dir)
    summary = an.totals(rows, None, "prediction_status").crossJoin(rows.agg(F.max("ts_us").alias("__at")))
    return _round(an.run_status(summary, an.drift_alerts(rows, "fine_score", _TRAIN), F.col("__at")), "ratio")


@query("manifest_rollup", W + """ SELECT coalesce(pcap_file, '') AS pcap_file, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS labeled_rows, false AS is_total FROM results GROUP BY 1
UNION ALL SELECT NULL, count(*), count(*) FILTER (WHERE label = 1), true FROM results""")
def manifest_rollup(spark, sf_dir):
    """Rows per file and in total in one pass."""
    return an.manifest(results_from_lineitem(spark, sf_dir), "pcap_file", F.col("label") == 1)


@query("page_rows", W + " SELECT row_id, fine_score FROM results ORDER BY ts_us, row_id LIMIT 100 OFFSET 200")
def page_rows(spark, sf_dir):
    """Third page of one hundred rows."""
    return an.page(results_from_lineitem(spark, sf_dir), 3, 100, ORDER).select("row_id", "fine_score")


@query("page_count", W + " SELECT count(*) AS rows, CAST(greatest(1, ceil(count(*) / 100.0::DOUBLE)) AS BIGINT) AS pages FROM results")
def page_count(spark, sf_dir):
    """Number of pages."""
    return an.page_count(results_from_lineitem(spark, sf_dir), 100)


@query("preview_rows", W + " SELECT row_id FROM results ORDER BY row_id DESC LIMIT 50")
def preview_rows(spark, sf_dir):
    """First fifty rows by a chosen column."""
    return an.preview(results_from_lineitem(spark, sf_dir), "row_id", descending=True).select("row_id")


@query("analysis_report", W + """, r AS (SELECT *, CAST(malicious_score AS FLOAT) AS s FROM results),
cut AS (SELECT quantile_cont(s::DOUBLE, 0.95::DOUBLE) AS t FROM r)
SELECT count(*) AS total_rows, count(DISTINCT pcap_file) AS unique_files, CAST(sum(prediction_status) AS BIGINT) AS malicious_total,
  count(*) FILTER (WHERE label = 1 AND s >= t) AS tp, count(*) FILTER (WHERE label = 0 AND s >= t) AS fp FROM r, cut""")
def analysis_report(spark, sf_dir):
    """Totals and confusion counts of the composed result report."""
    rows = results_from_lineitem(spark, sf_dir).drop("label_text")
    tables = an.analyze_results(rows, ORDER)
    return tables["totals"].select("total_rows", "unique_files", "malicious_total").crossJoin(tables["confusion"].select("tp", "fp"))


# ---------------------------------------------------------------------------
# Samples
# ---------------------------------------------------------------------------
_PLACE_SQL = "(l_orderkey * 7919 + l_partkey * 104729 + l_suppkey * 1299709 + l_linenumber * 15485863) % 1000003"
KEY = ["row_id"]


def _draw(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("*", f"{_PLACE_SQL} AS place", "l_returnflag <> 'R' AS benign",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd')) AS row_id")
    return rows.select("row_id", "place", "benign", "l_returnflag")


_DRAW_SQL = f"""WITH r AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) AS row_id,
  {_PLACE_SQL} AS place, l_returnflag <> 'R' AS benign, l_returnflag FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY benign ORDER BY place, row_id) AS no FROM r)"""


@query("balanced_sample", _DRAW_SQL + " SELECT row_id, benign FROM n WHERE no <= 500")
def balanced_sample(spark, sf_dir):
    """Five hundred rows of each class."""
    return sa.balanced_sample(_draw(spark, sf_dir), "benign", 500, KEY, place=F.col("place")).select("row_id", "benign")


@query("attack_all_sample", _DRAW_SQL + " SELECT row_id, benign FROM n WHERE NOT benign OR no <= 700")
def attack_all_sample(spark, sf_dir):
    """All attack rows and seven hundred benign ones."""
    return sa.attack_all_sample(_draw(spark, sf_dir), "benign", 700, KEY, place=F.col("place")).select("row_id", "benign")


@query("ratio_sample", _DRAW_SQL + " SELECT row_id, benign FROM n WHERE no <= CASE WHEN benign THEN 750 ELSE 300 END")
def ratio_sample(spark, sf_dir):
    """Three hundred attack rows and two and a half times as many benign ones."""
    return sa.ratio_sample(_draw(spark, sf_dir), "benign", 300, 2.5, KEY, place=F.col("place")).select("row_id", "benign")


@query("stratified_split", _DRAW_SQL + """, m AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY place, row_id) AS k,
  round(count(*) OVER (PARTITION BY l_returnflag) * 0.2::DOUBLE) AS t FROM r) SELECT row_id, l_returnflag, k <= t AS is_test FROM m""")
def stratified_split(spark, sf_dir):
    """Exact 80/20 split of every class."""
    return sa.stratified_split(_draw(spark, sf_dir), "l_returnflag", KEY, place=F.col("place")).select("row_id", "l_returnflag", "is_test")


@query("seeded_split_counts", "SELECT l_returnflag, CAST(round(count(*) * 0.2::DOUBLE) AS BIGINT) AS test_rows, count(*) AS rows FROM lineitem GROUP BY 1")
def seeded_split_counts(spark, sf_dir):
    """Class counts of the hash-seeded split."""
    split = sa.stratified_split(_draw(spark, sf_dir), "l_returnflag", KEY)
    return split.groupBy("l_returnflag").agg(F.count_if("is_test").alias("test_rows"), F.count(F.lit(1)).alias("rows"))


@query("union_of_files", W + """ SELECT src, count(*) AS rows, count(extra) AS with_extra FROM (SELECT 'a' AS src, row_id, NULL AS extra FROM results
UNION ALL SELECT 'b', row_id, CASE WHEN label = 1 THEN l_quantity END FROM results) GROUP BY src""")
def union_of_files(spark, sf_dir):
    """Tables with different columns under one schema."""
    rows = results_from_lineitem(spark, sf_dir)
    both = sa.union_files([rows.select(F.lit("a").alias("src"), "row_id"),
                           rows.select(F.lit("b").alias("src"), "row_id", F.when(F.col("label") == 1, F.col("l_quantity")).alias("extra"))])
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("rows"), F.count("extra").alias("with_extra"))


# ---------------------------------------------------------------------------
# Annotations and matching
# ---------------------------------------------------------------------------
_ANN_SQL = """, a AS (SELECT sha1(concat_ws('|', trim(pcap_file), src)) AS flow_key, lab AS label, who AS annotator, day_text AS timestamp, seq FROM (
  SELECT concat('capture_', CAST(o_custkey % 40 AS VARCHAR), '.pcap') AS pcap_file, concat('10.0.0.', CAST(o_custkey % 256 AS VARCHAR)) AS src,
    CASE WHEN o_orderstatus = 'F' THEN 1.0 WHEN o_orderstatus = 'O' THEN 0.0 END::DOUBLE AS lab, o_orderpriority AS who,
    strftime(o_orderdate, '%Y-%m-%d') AS day_text, o_orderkey AS seq FROM orders)),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY timestamp DESC, seq DESC) AS no FROM a) WHERE no = 1)"""


def _annotations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr(
        "concat('capture_', CAST(o_custkey % 40 AS STRING), '.pcap') AS pcap_file", "concat('10.0.0.', CAST(o_custkey % 256 AS STRING)) AS src_ip",
        "CASE WHEN o_orderstatus = 'F' THEN '1.0' WHEN o_orderstatus = 'O' THEN '0' ELSE 'unsure' END AS label", "o_orderpriority AS annotator",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS timestamp", "o_orderkey AS seq")
    return rows.withColumn("flow_key", ann.flow_key(["pcap_file", "src_ip"]))


def _latest(spark, sf_dir):
    return ann.latest_annotations(_annotations(spark, sf_dir), ["timestamp", "seq"])


@query("annotation_latest", "WITH x AS (SELECT 1)" + _ANN_SQL + " SELECT flow_key, label, annotator, timestamp FROM latest")
def annotation_latest(spark, sf_dir):
    """Newest annotation per flow key."""
    return _latest(spark, sf_dir).select("flow_key", "label", "annotator", "timestamp")


@query("annotation_summary", "WITH x AS (SELECT 1)" + _ANN_SQL + """ SELECT count(*) AS total, count(*) FILTER (WHERE label > 0.5) AS anomalies,
  count(*) FILTER (WHERE label = 0) AS normals FROM latest""")
def annotation_summary(spark, sf_dir):
    """Counts of annotated flows."""
    return ann.annotation_summary(_latest(spark, sf_dir))


@query("annotation_apply", "WITH x AS (SELECT 1)" + _ANN_SQL + """, c AS (SELECT c_custkey, sha1(concat_ws('|', concat('capture_', CAST(c_custkey % 40 AS VARCHAR), '.pcap'),
  concat('10.0.0.', CAST(c_custkey % 256 AS VARCHAR)))) AS flow_key FROM customer)
SELECT c_custkey, c.flow_key, label AS manual_label FROM c LEFT JOIN latest ON c.flow_key = latest.flow_key""")
def annotation_apply(spark, sf_dir):
    """Manual labels joined onto flows by key."""
    flows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('capture_', CAST(c_custkey % 40 AS STRING), '.pcap') AS pcap_file",
                                                        "concat('10.0.0.', CAST(c_custkey % 256 AS STRING)) AS src_ip")
    return ann.apply_annotations(flows, _latest(spark, sf_dir)).select("c_custkey", "flow_key", "manual_label")


@query("flow_keys", "WITH " + FLOWS_SQL + """ SELECT row_id, sha1(concat_ws('|', src_ip, dst_ip, CAST(dst_port AS VARCHAR), nullif(trim(protocol), ''))) AS flow_key FROM flows""")
def flow_keys(spark, sf_dir):
    """SHA-1 identity of every flow."""
    flows = flows_from_lineitem(spark, sf_dir)
    return flows.select("row_id", ann.flow_key(["src_ip", "dst_ip", "dst_port", "protocol"]).alias("flow_key"))


@query("label_override_by_file", W + """, o(pcap_file, override) AS (SELECT DISTINCT concat('capture_', CAST(s_suppkey % 40 AS VARCHAR), '.pcap'), CASE WHEN s_suppkey % 40 < 10 THEN s_suppkey % 40 % 2 END FROM supplier)
SELECT row_id, CASE WHEN override IS NOT NULL THEN CAST(override AS VARCHAR) ELSE label_text END AS label FROM results LEFT JOIN o USING (pcap_file)""")
def label_override_by_file(spark, sf_dir):
    """A label given for a whole file wins over the row's own label."""
    given = table(spark, sf_dir, "supplier").selectExpr(
        "concat('capture_', CAST(s_suppkey % 40 AS STRING), '.pcap') AS pcap_file", "CASE WHEN s_suppkey % 40 < 10 THEN CAST(s_suppkey % 40 % 2 AS STRING) END AS override").distinct()
    rows = an.attach_by_file(results_from_lineitem(spark, sf_dir), given, "pcap_file")
    return rows.select("row_id", F.coalesce("override", "label_text").alias("label"))


@query("match_rows_by_key", """WITH s AS (SELECT o_orderkey AS sel, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'f' || (o_custkey % 7) END AS pcap_file, 'k' || o_custkey AS flow_id FROM orders),
r AS (SELECT c_custkey AS ref, 'f' || (c_custkey % 7) AS pcap_file, 'k' || c_custkey AS flow_id FROM customer),
s1 AS (SELECT *, row_number() OVER (PARTITION BY pcap_file, flow_id ORDER BY sel) AS no FROM s WHERE pcap_file IS NOT NULL),
r1 AS (SELECT *, row_number() OVER (PARTITION BY pcap_file, flow_id ORDER BY ref) AS no FROM r),
m1 AS (SELECT sel, ref, 'pcap_file+flow_id' AS matched_by FROM s1 JOIN r1 USING (pcap_file, flow_id, no)),
s2 AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY sel) AS no FROM s WHERE sel NOT IN (SELECT sel FROM m1)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY ref) AS no FROM r WHERE ref NOT IN (SELECT ref FROM m1))
SELECT * FROM m1 UNION ALL SELECT sel, ref, 'flow_id' FROM s2 JOIN r2 USING (flow_id, no)""")
def match_rows_by_key(spark, sf_dir):
    """Selected rows found again by prioritised keys, one reference row each."""
    s = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS sel", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('f', o_custkey % 7) END AS pcap_file",
                                                  "concat('k', o_custkey) AS flow_id")
    r = table(spark, sf_dir, "customer").selectExpr("c_custkey AS ref", "concat('f', c_custkey % 7) AS pcap_file", "concat('k', c_custkey) AS flow_id")
    return ann.match_rows(s, r, "sel", "ref")


@query("detect_and_rank", "WITH " + scored_sql(rule_settings()) + """, per AS (SELECT src_ip, count(*) AS flows, max(rules_score) AS worst, avg(rules_score) AS mean_score FROM scored GROUP BY src_ip)
SELECT src_ip, flows, worst, round(mean_score, 6) AS mean_score FROM per""")
def detect_and_rank(spark, sf_dir):
    """Rule scores rolled up per source."""
    scored = score_rules(flows_from_lineitem(spark, sf_dir), order=ORDER)
    s = F.col("rules_score").cast("double")
    return scored.groupBy("src_ip").agg(F.count(F.lit(1)).alias("flows"), F.max(s).alias("worst"), F.round(F.avg(s), 6).alias("mean_score"))
