"""Boosted trees of one task are those of MLlib."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from flowspark.operators import model as mo


@pytest.fixture(scope="module")
def rows(spark):
    rows = spark.range(3000).select("id", F.rand(1).alias("f0"), F.floor(F.rand(2) * 20).cast("double").alias("f1"), F.randn(3).alias("f2"), F.lit(1.0).alias("f3"))
    return rows.withColumn("y", (F.col("f0") + F.col("f1") / 20 + F.col("f2") * 0.3 + F.rand(5) * 0.6 > 1.2).cast("int")).cache()


def test_one_task_fits_what_mllib_fits(spark, rows, tmp_path, monkeypatch):
    from flowspark.operators import boost
    monkeypatch.setattr(boost, "CHUNK", 256)      # here; the task has its own
    learner = GBTClassifier(labelCol="y", maxIter=6, stepSize=0.1, maxDepth=4, seed=42)
    names = [f"f{i}" for i in range(4)]
    mllib = Pipeline(stages=[mo._assembler(4), learner]).fit(rows)
    own = Pipeline(stages=[mo._assembler(4), boost.BoostedTrees(learner, names)]).fit(rows)
    own.write().save(str(tmp_path / "m"))
    score = lambda m, n: m.transform(rows).select("id", mo.positive_score(F.col("probability"), 1).alias(n))
    both = score(mllib, "a").join(score(PipelineModel.load(str(tmp_path / "m")), "b"), "id")
    assert both.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-9
    table = rows.toPandas()
    splits = [boost.feature_splits(table[n].to_numpy(), 31) for n in names]
    bins = np.stack([np.searchsorted(at, table[n]).astype(np.uint8) for n, at in zip(names, splits, strict=True)])
    trees = boost.boosted_trees(bins, 2.0 * table["y"].to_numpy() - 1.0, np.array([len(x) + 1 for x in splits]), 6, 0.1, 4)
    assert [t[0] for t in trees] == [3000.0] * 6 and splits[3].size == 0
    means = [t.rootNode().prediction() for t in own.stages[-1]._java_obj.trees()]
    assert np.allclose(means, [t[1] / t[0] for t in trees])


def test_a_fit_does_not_start_jobs_for_every_round(spark, rows):
    spark.sparkContext.setJobGroup("boosted", "a fit")
    try:
        got = mo.train_classifier(rows, "y", ["id"], features=["f0", "f1", "f2", "f3"], max_iter=30, max_depth=3)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got["metrics"]["roc_auc"] > 0.8 and got["model"].stages[-1].getNumTrees == 30
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted")) < 100


def test_values_mllib_refuses_are_still_refused(spark, rows):
    from flowspark.operators import boost
    gaps = mo._assembler(4).transform(rows.withColumn("f2", F.when(F.col("id") > 5, F.col("f2"))))
    with pytest.raises(Exception, match="NaN or Infinity"):
        boost.BoostedTrees(GBTClassifier(labelCol="y", maxIter=2), ["f0", "f1", "f2", "f3"]).fit(gaps)
