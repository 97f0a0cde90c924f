"""Session defaults for scripts and tests; jobs on a cluster bring their own session."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> None:
    """Settings the wide projections here want; a value set by the user is left alone.

    The JVM does not compile methods over 8000 bytes.  Whole-stage code for 40
    rules or 80 features exceeds that and then runs interpreted, ten times
    slower; with this limit Spark generates such a projection in small methods.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, "65535") == "65535":
        spark.conf.set(key, "8000")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="flowspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> str | None:
    """Send this package to the executors of a cluster that does not have it installed; the archive's path, or None in local mode."""
    if spark.sparkContext.master.startswith("local["):
        return None
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="flowspark-package-"), "flowspark"), "zip",
                                  os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    return archive


def local_session(app: str = "flowspark", cpus: str = "*", **conf: str) -> SparkSession:
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("FLOWSPARK_DRIVER_MEMORY", "12g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.caseSensitive": "true",
        # Recording the Python call site of every column makes wide plans slow to build.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    defaults.update(conf)
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if spark.conf.get("spark.checkpoint.dir", "") == "" and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flowspark-checkpoint-"))
    return spark
