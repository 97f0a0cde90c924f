"""The end-to-end jobs: extract, train, predict, analyse.

Each stage is written and read back, which bounds its lineage and lets the next
stage read it as often as it likes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.exprs import col
from flowspark.operators import model as mo
from flowspark.operators.analyze import analyze_results
from flowspark.operators.clean import coverage_summary, drop_predictions, rename_headers, unsw_rule_inputs
from flowspark.operators.flows import assemble_flows
from flowspark.operators.metrics import detection_metrics, first_usable_truth
from flowspark.sources import captures as cap
from flowspark.sources import sinks, tables


def extract_job(spark: SparkSession, source: str, out: str, *, mode: str = "all", start: int = 0, size: int = 1,
                records: bool = False) -> DataFrame:
    """Captures to `out`/packets, `out`/flows (one directory per capture) and, if wanted, `out`/records."""
    listing = cap.select_files(cap.list_captures(spark, source), mode, start, size)
    cap.decode_captures(listing).write.mode("overwrite").parquet(f"{out}/packets")
    decoded = spark.read.parquet(f"{out}/packets")
    assemble_flows(cap.packets_of(decoded)).write.mode("overwrite").parquet(f"{out}/flows")
    flows = spark.read.parquet(f"{out}/flows")
    if records:
        sinks.write_extractions(sinks.extraction_records(decoded, flows), f"{out}/records")
    return flows


def train_job(spark: SparkSession, source: str, models: str, *, label: str = "LabelBinary", weight_metric: str = "samples",
              reset: bool = False, **training) -> dict:
    """Every CSV under `source` to a model, a registry row and a log line under `models`."""
    rows = tables.read_csv_tree(spark, source).withColumn("__row", F.monotonically_increasing_id())
    stage = f"{models}/training"
    rows.write.mode("overwrite").parquet(stage)
    stored = spark.read.parquet(stage)
    features = training.pop("features", None) or mo.infer_features(stored.drop("__row"), label)
    fit = mo.train_classifier(stored, label, ["__row"], features=features, **training)
    row = mo.registry_row(spark, fit, "", weight_metric=weight_metric, reset=reset)
    record = row.first()
    path = f"{models}/members/{record['model_id']}"
    fit["model"].write().save(path)
    sinks.append_registry(spark.createDataFrame([record], row.schema).withColumn("model_path", F.lit(path)), f"{models}/registry")
    sinks.append_event(spark, f"{models}/events", "training", {"model_id": record["model_id"], "samples": fit["samples"], **fit["metrics"]})
    return fit


def predict_job(spark: SparkSession, source: str, models: str, out: str, *, profile: str | None = None) -> DataFrame:
    """Flow CSVs to `out`, scored by the ensemble under `models`; returns the stored predictions."""
    registry = spark.read.parquet(f"{models}/registry")
    ensemble = mo.Ensemble.load(registry)
    rows = drop_predictions(tables.read_csv_files(tables.list_csv(spark, source), infer=True))
    if any(c not in rows.columns for c in ensemble.features):
        rows = rename_headers(rows)
    rows = unsw_rule_inputs(rows).withColumn("row_id", F.monotonically_increasing_id())
    rows.write.mode("overwrite").parquet(f"{out}/input")
    stored = spark.read.parquet(f"{out}/input")
    sinks.write_predictions(mo.predict_flows(stored, ensemble, ["row_id"], profile=profile), f"{out}/predictions")
    predicted = spark.read.parquet(f"{out}/predictions")
    info = mo.prediction_summary(predicted).crossJoin(coverage_summary(stored, ensemble.features).select("coverage", "low_coverage"))
    info.write.mode("overwrite").json(f"{out}/summary")
    truth = first_usable_truth(predicted)
    if truth:
        detection_metrics(predicted, truth, "prediction_status", "fusion_score").withColumn("label_column", F.lit(truth)) \
            .write.mode("overwrite").json(f"{out}/metrics")
    sinks.append_event(spark, f"{models}/events", "predict", {"output": out, **info.select("anomaly_count", "status_text").first().asDict()})
    return predicted


def analyze_job(predicted: DataFrame, out: str, order: list[str], metadata: dict | None = None) -> dict[str, DataFrame]:
    """Every report table under `out`; returns the stored tables."""
    report = analyze_results(predicted, order, metadata)
    sinks.write_tables(report, out)
    spark = predicted.sparkSession
    return {name: spark.read.parquet(f"{out}/{name}") for name in report}


def registry_metadata(registry: DataFrame) -> dict:
    """What the reports need to know of the newest model: features, threshold, training quantiles."""
    m = mo.latest_model(registry).first()
    return {"feature_columns": list(m["features"]), "threshold": m["threshold"], "score_quantiles": dict(m["quantiles"] or {}),
            "refine_top_percent": m["top_percent"], "rule_profile": m["rule_profile"]}


def labelled_extraction(flows: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """Captures with a label per file to one flow CSV; returns whether every row got a label."""
    labelled = sinks.label_flows(flows, labels)
    sinks.write_flow_csv(labelled, path)
    return labelled.agg(F.count(F.lit(1)).alias("rows"), F.bool_and(F.trim(col("Label")) != "").alias("has_labels"))
