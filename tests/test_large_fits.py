"""Fits of large tables leave their rows where they are and grow forests in parts."""

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from flowspark.operators import model as mo
from flowspark.operators import sample as sa


@pytest.fixture
def rows(spark):
    rows = spark.range(6000).select("id", F.rand(1).alias("a"), F.randn(3).alias("b"))
    return rows.withColumn("label", (F.col("a") + F.col("b") * 0.2 > 0.6).cast("int")).cache()


def test_a_large_forest_is_grown_in_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(mo, "LARGE_FIT_ROWS", 1000, raising=False)
    monkeypatch.setattr(mo, "FIT_TASK_BYTES", 100_000)
    grown, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, d, *a: (grown.append((self.getNumTrees(), d.rdd.getNumPartitions())), fit(self, d, *a))[1])
    seen, whole = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, d, *a: (seen.append(d._jdf.queryExecution().executedPlan().toString()), whole(self, d, *a))[1])
    got = mo.train_classifier(rows, "label", ["id"], features=["a", "b"], estimator=RandomForestClassifier(labelCol="y", numTrees=23, maxDepth=4, seed=1))
    assert [n for n, _ in grown] == [10, 10, 3] * 2 and all(parts > 8 for _, parts in grown)
    assert got["model"].stages[-1].getNumTrees == len(got["model"].stages[-1].trees) == 23
    assert len({t.toDebugString.split("\n", 1)[1] for t in got["model"].stages[-1].trees}) > 15      # parts differ
    assert got["metrics"]["roc_auc"] > 0.95 and not any("Exchange" in plan for plan in seen)
    out = {r.variant: r for r in mo.baseline_models(rows.where("id % 5 > 0"), rows.where("id % 5 = 0"), ["a", "b"], "label", ["id"], trees=23).collect()}
    assert out["random_forest"].roc_auc > 0.95 and out["logistic_regression"].roc_auc > 0.95
    assert grown[6:] == [(n, grown[6][1]) for n in (10, 10, 3)]


@pytest.mark.parametrize("key", [["id"], ["k"], ["same"], ["k", "id"]])
def test_a_split_of_many_rows_moves_none(spark, key):
    """Null classes, null keys and rows that all share a key."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("k"), F.lit(1).alias("same"))
    want = sa.stratified_split(rows, "g", key)
    before = spark.conf.get("spark.flowspark.hotMinRows", "1000000")
    spark.conf.set("spark.flowspark.hotMinRows", "3")
    try:
        got = sa.stratified_split(rows, "g", key)
        held = sorted(got.collect(), key=str)
    finally:
        spark.conf.set("spark.flowspark.hotMinRows", before)
    assert got.columns == want.columns and held == sorted(want.collect(), key=str)
    if key == ["id"]:
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
