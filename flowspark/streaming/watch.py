"""Watch a directory and treat every new capture once.

The file source's checkpoint replaces a list of files already seen, and every
micro-batch runs the same functions as a batch job.  Output is written per
batch number, so a batch that is run again after a failure replaces its own
output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowspark.operators.analyze import totals
from flowspark.operators.flows import assemble_flows, packet_statistics
from flowspark.operators.fusion import final_decision, fuse_votes
from flowspark.operators.model import score_captures
from flowspark.operators.rules import CAPTURE_TRIGGER_CAP, rule_settings, score_rules
from flowspark.sources.captures import decode_captures, packets_of

POLL_SECONDS = 5          # fixed value
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
CAPTURE_GLOB = "*.{[pP][cC][aA][pP],[pP][cC][aA][pP][nN][gG]}"


def detect_flows(flows: DataFrame, ensemble=None, profile: str = "baseline") -> DataFrame:
    """Rule score, reasons and decision of every flow; rules look at one capture at a time.

    Without a model the model score is 0 and rules decide through the trigger.
    """
    settings = rule_settings(profile, trigger_cap=CAPTURE_TRIGGER_CAP)
    scored = score_captures(flows, ensemble)[0] if ensemble is not None else flows.withColumn("malicious_score", F.lit(0.0))
    scored = scored.withColumn("__at", F.unix_micros(F.to_timestamp("Timestamp")))
    ruled = score_rules(scored, settings, order=["__at", "Flow ID"], scope=["file"],
                        normalize_protocol=True, integral_ports=True)
    out = final_decision(fuse_votes(ruled, settings), settings)
    if ensemble is None:
        out = out.withColumn("prediction_status", F.col("rules_flag")).withColumn(
            "fusion_status", F.when(F.col("rules_triggered"), "异常").otherwise("正常"))
    return out.drop("__at")


def process_batch(listing: DataFrame, out: str, batch_id: int, ensemble=None, profile: str = "baseline") -> None:
    """Captures of one micro-batch: packets, flows, decisions, status rows."""
    spark = listing.sparkSession
    decoded_path, flow_path = f"{out}/packets/batch={batch_id}", f"{out}/flows/batch={batch_id}"
    decode_captures(listing).write.mode("overwrite").parquet(decoded_path)
    decoded = spark.read.parquet(decoded_path)
    assemble_flows(packets_of(decoded)).write.mode("overwrite").parquet(flow_path)
    detect_flows(spark.read.parquet(flow_path), ensemble, profile).write.mode("overwrite").parquet(f"{out}/detected/batch={batch_id}")
    detected = spark.read.parquet(f"{out}/detected/batch={batch_id}")
    bad = detected.groupBy("file").agg(F.count(F.lit(1)).alias("flows"), F.sum("prediction_status").cast("long").alias("anomalies"))
    status = packet_statistics(decoded).join(bad, "file", "left").na.fill(0, ["flows", "anomalies"])
    if ensemble is None:
        status = status.withColumns({"coverage": F.lit(None).cast("double"), "warnings": F.array().cast("array<string>")})
    else:
        covered = score_captures(spark.read.parquet(flow_path), ensemble)[1].select("file", "coverage", "warnings")
        status = status.join(covered, "file", "left").withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    status.withColumn("finished_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/status/batch={batch_id}")


def watch_captures(spark: SparkSession, watch_dir: str, out: str, checkpoint: str, *, ensemble=None, profile: str = "baseline",
                   max_files: int = 1, poll_seconds: int = POLL_SECONDS, once: bool = False) -> StreamingQuery:
    """Start the watch; with `once`, treat what is there and stop."""
    files = (spark.readStream.schema(BINARY_FILE).format("binaryFile").option("pathGlobFilter", CAPTURE_GLOB)
             .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(watch_dir)
             .select("path", "length"))
    writer = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, number: process_batch(batch, out, number, ensemble, profile))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{poll_seconds} seconds")
    return writer.start()


def run_totals(spark: SparkSession, out: str) -> DataFrame:
    """Totals over everything detected so far."""
    return totals(spark.read.parquet(f"{out}/detected"), "file", "prediction_status")


def file_status(spark: SparkSession, out: str) -> DataFrame:
    """Latest status row per capture."""
    rows = spark.read.parquet(f"{out}/status")
    return rows.groupBy("file").agg(F.max_by(F.struct(
        "parsed_packets", "dropped_packets", "flows", "anomalies", "coverage", "warnings", "error"), "finished_at").alias("s")).select("file", "s.*")
