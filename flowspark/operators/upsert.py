"""Manual labels as a log of upsert batches over a bucketed base, merged on read.

    path/log/<number>-<id>           one batch each: rows as they were given, in their order
    path/base/<number>-<id>          the newest record per flow key, a folder per bucket of the key
    path/base-merged/<number>-<id>   the batches that are in that base

A folder counts once its job has committed (Spark writes _SUCCESS last), so a writer or a compaction that is lost
half-way leaves a folder that nobody reads. A reader takes the newest base whose list of batches is complete, and the
complete batches that it does not hold. Compaction writes a new base beside the old one and removes nothing; `vacuum`
removes what the newest base has made needless.

Batches count in the order of their numbers, rows of a batch in the order they had; the last one of a key wins.
Two writers at a time may take one number; then the id decides, the same for all readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.ordered import SMALL_TABLE_ROWS, _is_small
from flowspark.schema import ANNOTATION_SCHEMA

FIELDS = [f.name for f in ANNOTATION_SCHEMA]
BUCKET_ROWS = 1_000_000


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete folders below `path`, oldest first."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def _next(names: list[str]) -> str:
    last = max((int(n.split("-")[0]) for n in names), default=0)
    return f"{last + 1:012d}-{uuid.uuid4().hex[:8]}"


def upsert(spark: SparkSession, path: str, rows: DataFrame) -> str:
    """Append a batch (flow_key, label, annotator, notes, timestamp; later rows of a key win) and return its name."""
    name = _next(_folders(spark, f"{path}/log"))
    fields = [(F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in ANNOTATION_SCHEMA]
    rows.where(F.col("flow_key").isNotNull()).select(*fields, F.monotonically_increasing_id().alias("__row")).write.parquet(f"{path}/log/{name}")
    return name


def _newest(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The last record of every key among the batches."""
    rows = spark.read.parquet(*[f"{path}/log/{n}" for n in names])
    batch = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    rows = rows.select(*FIELDS, F.struct(batch.alias("batch"), F.col("__row").alias("row")).alias("__at"))
    newest = rows.groupBy("flow_key").agg(F.max_by(F.struct(*FIELDS[1:]), "__at").alias("r"))
    return newest.select("flow_key", "r.*")


def _state(spark: SparkSession, path: str) -> tuple[str | None, list[str], list[str]]:
    """The newest base, the batches in it and those behind it."""
    bases = _folders(spark, f"{path}/base-merged")
    base = bases[-1] if bases else None
    merged = [r["batch"] for r in spark.read.parquet(f"{path}/base-merged/{base}").collect()] if base else []     # a row per batch
    known = set(merged)
    return base, merged, [n for n in _folders(spark, f"{path}/log") if n not in known]


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """The newest record of every key: the base, but for keys that the log has changed, and the log's records.

    The base is not shuffled as long as the keys of the log are few.
    """
    base, _, log = _state(spark, path)
    if base is None and not log:
        return spark.createDataFrame([], ANNOTATION_SCHEMA)
    stored = spark.read.parquet(f"{path}/base/{base}").select(*FIELDS) if base else None
    if not log:
        return stored
    newest = _newest(spark, path, log)
    if stored is None:
        return newest
    changed = newest.select("flow_key")
    if _is_small(changed, SMALL_TABLE_ROWS):
        changed = F.broadcast(changed)
    return stored.join(changed, "flow_key", "left_anti").unionByName(newest)


def compact(spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS) -> str | None:
    """Merge the log into a new base and return its name; readers change over when all of it is there."""
    base, merged, log = _state(spark, path)
    if not log:
        return base
    rows = read_annotations(spark, path)
    buckets = max(1, -(-rows.count() // bucket_rows))
    name = _next(_folders(spark, f"{path}/base-merged") + _folders(spark, f"{path}/base"))
    bucket = F.pmod(F.xxhash64("flow_key"), F.lit(buckets)).cast("int")
    rows.withColumn("bucket", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", "flow_key").write.partitionBy("bucket").parquet(f"{path}/base/{name}")
    # The list of batches makes the base count, so it comes last.
    spark.createDataFrame([(n,) for n in [*merged, *log]], "batch string").coalesce(1).write.parquet(f"{path}/base-merged/{name}")
    return name


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Remove batches that the newest base holds and older bases; call it when no reader uses them any more."""
    base, merged, _ = _state(spark, path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    gone = [f"log/{n}" for n in merged] + [f"{kind}/{n}" for kind in ("base-merged", "base") for n in _folders(spark, f"{path}/{kind}") if base and n < base]
    fs = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [g for g in gone if fs.delete(hadoop.Path(f"{path}/{g}"), True)]
