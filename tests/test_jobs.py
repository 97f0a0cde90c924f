import random

from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from flowspark.plans import jobs
from helpers import eth, ip4, pcap, tcp, udp


def test_extract_train_predict_analyze(spark, tmp_path):
    rnd = random.Random(4)
    src = tmp_path / "captures"
    src.mkdir()
    for name in "ab":
        frames, t = [], 1_700_000_000_000_000
        for i in range(400):
            t += rnd.randrange(100, 200_000)
            host = rnd.randrange(60)
            body = udp(4000 + host, 53, b"d" * 20) if host % 3 == 0 else tcp(4000 + host, 80, rnd.choice([2, 16, 24]), 900, b"p" * rnd.randrange(90))
            frames.append((t, eth(ip4(f"10.0.0.{host}", "10.1.1.1", 17 if host % 3 == 0 else 6, body))))
        (src / f"{name}.pcap").write_bytes(pcap(frames))
    flows = jobs.extract_job(spark, str(src), str(tmp_path / "x"), records=True)
    assert flows.count() == 120
    info = jobs.labelled_extraction(flows, spark.createDataFrame([(flows.first()["file"], 1)], "file string, label int"), str(tmp_path / "labelled")).first()
    assert info.rows == 120 and info.has_labels
    csv = tmp_path / "csv"
    flows.drop("file").withColumn("LabelBinary", (F.col("Protocol") == 17).cast("int")).write.option("header", True).csv(str(csv))
    models = str(tmp_path / "models")
    tree = GBTClassifier(labelCol="y", maxIter=3, maxDepth=2, seed=1)
    fit = jobs.train_job(spark, str(csv), models, estimator=tree)
    assert len(fit["features"]) == 80 and fit["metrics"]["f1"] == 1.0
    predicted = jobs.predict_job(spark, str(csv), models, str(tmp_path / "pred"))
    assert predicted.count() == 120
    assert spark.read.json(str(tmp_path / "pred/summary")).first()["coverage"] == 1.0
    assert spark.read.json(str(tmp_path / "pred/metrics")).first()["label_column"] == "LabelBinary"
    meta = jobs.registry_metadata(spark.read.parquet(f"{models}/registry"))
    report = jobs.analyze_job(predicted, str(tmp_path / "report"), ["row_id"], meta)
    assert report["totals"].first().total_rows == 120 and report["top"].count() == 20
    assert report["curve"].first().roc_auc > 0.9
    assert spark.read.text(f"{models}/events").count() == 2
