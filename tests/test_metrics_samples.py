import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import analyze as an
from flowspark.operators import annotate as ann
from flowspark.operators import metrics as me
from flowspark.operators import sample as sa


def data(n=400, seed=1):
    rnd = random.Random(seed)
    return [(i, rnd.choice("abc"), round(rnd.random() * 20) / 20, int(rnd.random() < 0.4)) for i in range(n)]


def frame(spark):
    return spark.createDataFrame(data(), "id long, grp string, s double, y int").repartition(4)


def auc_ap(rows):
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    ap, last = 0.0, 0.0
    for t in sorted({r[2] for r in rows}, reverse=True):
        picked = [r[3] for r in rows if r[2] >= t]
        recall = sum(picked) / len(pos)
        ap += (recall - last) * sum(picked) / len(picked)
        last = recall
    return wins / (len(pos) * len(neg)), ap


def check(spark):
    df, rows = frame(spark), data()
    m = me.curve_metrics(df, "s", "y").first()
    auc, ap = auc_ap(rows)
    assert m.roc_auc == pytest.approx(auc) and m.average_precision == pytest.approx(ap)
    for r in me.curve_metrics(df, "s", "y", ["grp"]).collect():
        auc, ap = auc_ap([x for x in rows if x[1] == r.grp])
        assert r.roc_auc == pytest.approx(auc) and r.average_precision == pytest.approx(ap)
    for ties, sign in (("first", 1), ("last", -1)):
        t = me.top_hit_rate(df, "s", "y", ["id"], percent=0.07, ties=ties).first()
        best = sorted(rows, key=lambda x: (-x[2], sign * x[0]))[:28]
        assert t.k == 28 and t.hits == sum(x[3] for x in best)
    by = {r.grp: r.hits for r in me.top_hit_rate(df, "s", "y", ["id"], percent=0.1, rounding="ceil", by=["grp"]).collect()}
    for g in "abc":
        part = sorted([x for x in rows if x[1] == g], key=lambda x: (-x[2], x[0]))
        assert by[g] == sum(x[3] for x in part[:-(-len(part) // 10)])
    area = me.roc_points(df, "s", "y").orderBy("fpr", "tpr").collect()
    x, y = [p.fpr for p in area], [p.tpr for p in area]
    assert np.trapezoid(y, x) == pytest.approx(auc_ap(rows)[0])
    assert me.roc_points(df, "s", "y", simplify=False).count() >= len(area)


def test_metrics_plain(spark):
    check(spark)


def test_metrics_in_slices(spark, force_hot):
    check(spark)


def test_best_threshold(spark):
    def brute(cap):
        best = (-1.0, None)
        for i in range(1001):
            t = i * 0.001
            tp = sum(r[3] for r in data() if r[2] >= t)
            fp = sum(1 - r[3] for r in data() if r[2] >= t)
            p, n = sum(r[3] for r in data()), sum(1 - r[3] for r in data())
            f1 = 2 * tp / (tp + fp + p) if tp + fp + p else 0.0
            if (cap is None or fp / (n + 1e-12) <= cap) and f1 > best[0]:
                best = (f1, t)
        return best
    for cap in (None, 0.2):
        r = me.best_f1_threshold(frame(spark), "s", "y", cap).first()
        assert (r.f1, r.threshold) == pytest.approx(brute(cap))
    assert me.best_f1_threshold(frame(spark).withColumn("s", F.lit(1.0)), "s", "y", 0.1).count() == 0


def test_one_class_has_no_curve(spark):
    r = me.curve_metrics(frame(spark).where("y = 1"), "s", "y").first()
    assert r.roc_auc is None and r.average_precision is None


def test_detection_metrics_labels(spark):
    df = spark.createDataFrame([("BENIGN", 0), ("ATTACK", 1), ("MALICIOUS", 0), ("other", 1), (None, 1), ("NORMAL", 7)], "Label string, prediction_status int")
    r = me.detection_metrics(df).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.support) == (1, 0, 1, 1, 3)
    assert me.first_usable_truth(df) == "Label"
    assert me.first_usable_truth(df.withColumn("Label", F.lit("x"))) is None


@pytest.mark.parametrize("forced", [False, True])
def test_samples(spark, forced, request):
    if forced:
        request.getfixturevalue("force_hot")
    df = frame(spark).withColumn("benign", F.col("y") == 0)
    counts = lambda d: {r.benign: r["count"] for r in d.groupBy("benign").count().collect()}
    total = counts(df)
    assert counts(sa.balanced_sample(df, "benign", 50, ["id"])) == {True: 50, False: 50}
    assert counts(sa.attack_all_sample(df, "benign", 30, ["id"])) == {True: 30, False: total[False]}
    assert counts(sa.ratio_sample(df, "benign", 20, 2.5, ["id"])) == {True: 50, False: 20}
    assert counts(sa.balanced_sample(df, "benign", 10_000, ["id"])) == total
    split = sa.stratified_split(df, "grp", ["id"])
    for r in split.groupBy("grp").agg(F.count_if("is_test").alias("t"), F.count(F.lit(1)).alias("n")).collect():
        assert r.t == round(r.n * 0.2)
    ids = lambda d: {r.id for r in d.where("is_test").collect()}
    assert ids(split) == ids(sa.stratified_split(df.repartition(3), "grp", ["id"]))
    assert ids(split) != ids(sa.stratified_split(df, "grp", ["id"], seed=1))


def test_report_tables(spark):
    df = frame(spark).select("id", F.concat(F.lit("f"), "grp").alias("pcap_file"), F.col("s").alias("malicious_score"),
                             F.col("y").alias("prediction_status"), F.when(F.col("y") == 1, "Bot").otherwise("BENIGN").alias("Label"), (F.col("id") * 2.0).alias("feat"))
    df = df.unionByName(df.limit(1).withColumn("malicious_score", F.lit(float("inf"))))
    out = an.analyze_results(df, ["id"], {"feature_columns": ["feat"], "score_quantiles": {"0.5": 0.1}, "threshold": 0.5})
    t = out["totals"].first()
    assert (t.total_rows, t.unique_files) == (400, 3)
    assert out["top"].count() == 20 and "top_reasons" in out["top"].columns
    assert out["histogram"].agg(F.sum("count")).first()[0] == 400 and out["histogram"].count() == 50
    assert [r.prob for r in out["drift"].collect()] == [0.5]
    assert out["quantiles"].count() == 6 and out["anomaly_files"].count() <= 3
    c = out["confusion"].first()
    assert c.tp + c.fn == sum(r[3] for r in data())


def test_annotations(spark, tmp_path):
    from flowspark.operators.upsert import read_annotations
    from flowspark.sources.sinks import append_annotations
    flows = spark.createDataFrame([("f1", "10.0.0.1"), ("f2", " "), (None, None)], "flow_id string, src_ip string")
    store = str(tmp_path / "ann")
    append_annotations(ann.annotation_records(flows.where("flow_id = 'f1'"), 1.0), store)
    append_annotations(ann.annotation_records(flows.where("flow_id = 'f1'"), 0.0, "me", "later"), store)
    append_annotations(ann.annotation_records(flows.where("flow_id = 'f2'"), 1.0), store)
    latest = read_annotations(spark, store)
    got = {r.flow_id: r.manual_label for r in ann.apply_annotations(flows, latest).collect()}
    assert got == {"f1": 0.0, "f2": 1.0, None: None}
    s = ann.annotation_summary(latest).first()
    assert (s.total, s.anomalies, s.normals) == (2, 1, 1)
    import hashlib
    assert {r.flow_key for r in ann.with_flow_key(flows).where("flow_id = 'f2'").collect()} == {hashlib.sha1(b"f2").hexdigest()}


def test_many_rows_of_few_scores_are_counted_not_sketched(spark, monkeypatch):
    import numpy as np

    from flowspark.operators import ordered
    monkeypatch.setattr(ordered, "_selected_quantiles", lambda *a: pytest.fail("sketched"))
    spark.conf.set("spark.flowspark.hotMinRows", "100")
    try:
        values = [(i * i % 11) / 10 for i in range(3000)]
        got = {r["prob"]: r["quantile"] for r in ordered.exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.05, 0.5, 0.95]).collect()}
    finally:
        spark.conf.unset("spark.flowspark.hotMinRows")
    assert got == {p: pytest.approx(float(np.quantile(values, p))) for p in (0.05, 0.5, 0.95)}


def test_a_report_asks_once_whether_a_label_holds_numbers(spark):
    from flowspark.operators.analyze import analyze_results
    rows = [(i, float(i % 10) / 10, "1" if i % 10 > 6 else "0", "attack" if i % 10 > 4 else "benign") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, malicious_score double, prediction_status string, label string")
    tables = analyze_results(df, ["id"], {"threshold": 0.65})
    got = tables["confusion"].first()
    assert (got.tn, got.fp, got.fn, got.tp) == (50, 0, 20, 30) and tables["totals"].first().malicious_total == 30
    for name in ("confusion", "totals", "histogram"):
        assert tables[name]._jdf.queryExecution().optimizedPlan().toString().count("__numeric") == 0
