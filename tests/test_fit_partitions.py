"""What one task sorts or reads does not grow with the input."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from flowspark.operators import model as mo
from flowspark.operators import pages


def test_stored_pages_are_sorted_in_ranges_that_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "ROWS_PER_TASK", 100)
    rows = spark.range(2000).select((F.col("id") * 37 % 2000).alias("k"))
    pages.store_pages(rows, str(tmp_path / "p"), ["k"], 10)
    index = spark.read.parquet(str(tmp_path / "p/index"))
    assert index.count() >= 16 and index.agg(F.max("rows")).first()[0] < 400
    assert [r.k for r in pages.read_page(spark, str(tmp_path / "p"), 150, 10).collect()] == list(range(1490, 1500))


def test_a_fit_gets_partitions_by_its_cached_bytes(spark, monkeypatch):
    rows = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 > 3).cast("int").alias("label")).coalesce(2).cache()
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, d, *a: (seen.append(d.rdd.getNumPartitions()), fit(self, d, *a))[1])
    monkeypatch.setattr(mo, "FIT_TASK_BYTES", 16_000)
    got = mo.train_classifier(rows, "label", ["id"], features=["a"], estimator=RandomForestClassifier(labelCol="y", numTrees=3, maxDepth=3, seed=1))
    assert seen == [16, 16] and got["samples"] == 2000 and got["metrics"]["roc_auc"] == 1.0
    seen.clear()
    out = mo.baseline_models(rows.where("id % 5 > 0"), rows.where("id % 5 = 0"), ["a"], "label", ["id"], trees=3).collect()
    assert seen == [13, 13] and all(r.roc_auc == 1.0 for r in out)


def test_both_fits_read_even_partitions_whatever_the_files(spark, monkeypatch):
    rows = spark.range(9000).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    rows = rows.repartition(8, F.when(F.col("id") < 8000, 0).otherwise(F.col("id"))).cache()      # nearly all in one partition
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, d, *a: (seen.append(d.rdd.glom().map(len).collect()), fit(self, d, *a))[1])
    monkeypatch.setattr(mo, "EVEN_FIT_ROWS", 1000, raising=False)
    got = mo.train_classifier(rows, "label", ["id"], features=["a"], max_iter=3, max_depth=2)
    cores = spark.sparkContext.defaultParallelism
    assert sorted(map(sum, seen)) == [7200, 9000] and got["samples"] == 9000 and got["metrics"]["roc_auc"] == 1.0
    assert all(max(sizes) < 2 * sum(sizes) / cores for sizes in seen)
