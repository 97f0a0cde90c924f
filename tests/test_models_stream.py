import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from flowspark.operators import model as mo
from flowspark.operators.plugins import apply_features, loaded_features, register_feature
from flowspark.sources.sinks import append_registry
from flowspark.streaming import watch

from helpers import eth, ip4, pcap, tcp


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(300, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    pdf = [(i, float(a), float(b), float(c), int(t)) for i, ((a, b, c), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(pdf, "id long, a double, b double, c double, `﻿labelbinary ` int").cache()


def test_train_registry_ensemble_predict(spark, rows, tmp_path):
    fits = []
    for seed in (1, 2):
        fit = mo.train_classifier(rows, "LabelBinary", ["id"], seed=seed, estimator=GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=seed))
        assert fit["features"] == ["a", "b", "c"] and fit["metrics"]["roc_auc"] > 0.85 and fit["samples"] == 300
        assert fit["holdout"].count() == pytest.approx(60, abs=1)
        path = str(tmp_path / f"m{seed}")
        fit["model"].write().save(path)
        append_registry(mo.registry_row(spark, fit, path, weight_metric="f1_score"), str(tmp_path / "reg"))
        fits.append(fit)
    registry = spark.read.parquet(str(tmp_path / "reg"))
    assert {r.weight for r in registry.collect()} == {f["metrics"]["f1"] for f in fits}
    assert mo.latest_model(registry).first().model_path.endswith("m2")
    ensemble = mo.Ensemble.load(registry)
    assert len(ensemble.members) == 2
    single = [mo.Ensemble([(m, 1.0)], ensemble.features).score(rows) for m, _ in ensemble.members]
    s = [{r.id: r.malicious_score for r in d.collect()} for d in single]
    w = [x for _, x in ensemble.members]
    for r in ensemble.score(rows).collect():
        assert r.malicious_score == pytest.approx((w[0] * s[0][r.id] + w[1] * s[1][r.id]) / sum(w))
    out = mo.predict_flows(rows, ensemble, ["id"])
    assert out.count() == 300 and {r.prediction for r in out.select("prediction").distinct().collect()} <= {0, 1}
    summary = mo.prediction_summary(out).first()
    assert summary.rows == 300 and summary.anomaly_count + summary.normal_count == 300
    with pytest.raises(ValueError):
        mo.predict_flows(rows.drop("b"), ensemble, ["id"])
    again = mo.train_classifier(rows, "LabelBinary", ["id"], seed=1, estimator=GBTClassifier(labelCol="y", maxIter=4, maxDepth=3, seed=1))
    assert again["metrics"] == fits[0]["metrics"]


def test_fit_on_training_rows_and_other_estimators(spark, rows):
    from pyspark.ml.classification import RandomForestClassifier
    fit = mo.train_classifier(rows, "LabelBinary", ["id"], estimator=RandomForestClassifier(labelCol="y", numTrees=10, seed=3))
    r = mo.training_fit_metrics(rows, rows.columns[-1], fit["model"], fit["features"]).first()
    assert r.f1 > 0.9 and r.auc > 0.95


def test_members_reset_and_weights(spark):
    reg = spark.createDataFrame([(str(i), i, i == 3, {"train_f1": v}) for i, v in enumerate([0.1, 0.2, 0.0, 0.4, 0.5])],
                                "model_id string, trained_at int, reset boolean, metrics map<string,double>")
    kept = mo.ensemble_members(reg, 10).orderBy("age").collect()
    assert [r.model_id for r in kept] == ["4", "3"]
    w = reg.select(mo.member_weight("f1", F.lit(7), F.col("metrics")).alias("w")).collect()
    assert [r.w for r in w] == [0.1, 0.2, 7.0, 0.4, 0.5]
    assert mo.positive_index([0, 1]) == 1 and mo.positive_index([0, 1, 2], {0: "x", 1: "y", 2: "Attack"}) == 2


def test_plugins(spark):
    @register_feature("double_id")
    def double(df):
        return df.withColumn("twice", F.col("id") * 2)
    assert "double_id" in loaded_features()
    assert apply_features(spark.range(3), ["double_id"]).agg(F.sum("twice")).first()[0] == 6


def test_watch_treats_each_capture_once(spark, tmp_path):
    src, out, chk = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "chk")
    src.mkdir()
    frames = [(1_700_000_000_000_000 + i * 1000, eth(ip4("10.0.0.1", f"10.0.1.{i % 40}", 6, tcp(1000 + i, 22 + i % 35)))) for i in range(120)]
    (src / "a.pcap").write_bytes(pcap(frames))
    watch.watch_captures(spark, str(src), out, chk, once=True).awaitTermination()
    first = watch.file_status(spark, out).collect()
    assert [(r.parsed_packets, r.flows) for r in first] == [(120, 120)] and first[0].anomalies > 0
    (src / "b.PCAP").write_bytes(pcap(frames[:10]))
    (src / "c.pcap").write_bytes(b"broken")
    watch.watch_captures(spark, str(src), out, chk, once=True).awaitTermination()
    rows = {r.file.split("/")[-1]: r for r in watch.file_status(spark, out).collect()}
    assert rows["a.pcap"].flows == 120 and rows["b.PCAP"].flows == 10 and rows["c.pcap"].error
    assert watch.run_totals(spark, out).first().total_rows == 130
    detected = spark.read.parquet(f"{out}/detected")
    assert detected.where("rules_reasons like '%端口扫描%'").select("file").distinct().count() == 1
