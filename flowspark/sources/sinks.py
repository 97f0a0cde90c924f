"""Writers.  Every sink takes a DataFrame and writes it in parallel."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.exprs import col
from flowspark.operators.analyze import manifest
from flowspark.operators.clean import align_schema, label_binary
from flowspark.operators.flows import packet_statistics
from flowspark.operators.ordered import SMALL_TABLE_ROWS, lookup_join, number_rows
from flowspark.operators.upsert import upsert
from flowspark.schema import FLOW_COLUMNS, LABEL, LABEL_BINARY, STRING_COLUMNS
from flowspark.session import store

FLOWS_PER_RECORD = 1000
ROWS_PER_FILE = 1_000_000
PARTS_PER_BUCKET = 5000       # of 200 packets each
LEAST_PARTS_PER_DIRECTORY = 1000
MOST_WRITE_TASKS = 100_000
ROWS_PER_WRITE_TASK = 250_000      # where files are smaller, a task writes several


def write_flow_csv(flows: DataFrame, path: str, label: Column | None = None, mode: str = "overwrite") -> None:
    """The 85 columns in file order; `label` overrides the flow's own."""
    out = flows.withColumn(LABEL, F.coalesce(label.cast("string"), col(LABEL))) if label is not None else flows
    out.select(*[col(c) for c in FLOW_COLUMNS]).write.mode(mode).option("header", True).csv(path)


def spread_by_size(df: DataFrame, file: str, rows_per_file: int, spread: list[str]) -> tuple[DataFrame, int]:
    """Rows dealt out so that the files of a capture follow its size, and the most rows a file may hold (0: any).

    A capture gets one share per `rows_per_file` of its rows, by hash of the `spread` columns; a share is whole in one task
    and makes one file. Where files are small, a share has the rows of `files` files instead, a task per file would cost more than
    its rows: the task begins a new file after 1.25 times `rows_per_file` rows. With five files a share or more that leaves room for the
    file each share leaves unfilled, so that there are never more than one per `rows_per_file` rows begun. The sizes come from one count.
    """
    files = ROWS_PER_WRITE_TASK // rows_per_file
    files = files if files >= 5 else 1
    parts = F.ceil(F.col("__rows") / rows_per_file)
    sizes = df.groupBy(file).agg(F.count(F.lit(1)).alias("__rows")).select(
        F.col(file).alias("__file"), F.greatest(F.lit(1), F.floor(F.col("__rows") / (rows_per_file * files)) if files > 1 else parts).cast("int").alias("__parts"))
    sizes = store(sizes, "capture-sizes")
    total = sizes.agg(F.sum("__parts")).first()[0] or 1
    small = sizes.count() <= SMALL_TABLE_ROWS       # a name and a number per capture
    joined = df.join(F.broadcast(sizes) if small else sizes, F.col(f"`{file}`").eqNullSafe(F.col("__file")))
    part = F.pmod(F.xxhash64(*[col(c) for c in spread]), F.col("__parts"))
    dealt = joined.withColumn("__part", part).repartition(int(min(total, MOST_WRITE_TASKS)), F.col(f"`{file}`"), F.col("__part"))
    return dealt.drop("__file", "__parts", "__part"), -(-5 * rows_per_file // 4) if files > 1 else 0


def write_flows_per_capture(flows: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE) -> None:
    """One directory per capture, with about a file per `rows_per_file` flows."""
    dealt, most = spread_by_size(flows, "file", rows_per_file, ["Flow ID", "Timestamp"])
    dealt.write.mode(mode).option("maxRecordsPerFile", most).partitionBy("file").option("header", True).csv(path)


def label_flows(flows: DataFrame, labels: DataFrame) -> DataFrame:
    """Flows with the label given for their capture (`labels`: file, label), else their own."""
    joined = lookup_join(flows, labels.select("file", F.col("label").cast("string").alias("__given")), ["file"])
    return joined.withColumn(LABEL, F.coalesce("__given", col(LABEL))).drop("__given")


def label_precedence(flows: DataFrame, override: int | None = None) -> DataFrame:
    """Label of flows read from extraction records: override, else the record's, else the flow's."""
    given = F.lit(None if override is None else str(override)).cast("string")
    return flows.withColumn(LABEL, F.coalesce(given, F.col("record_label").cast("string"), col(LABEL)))


def extraction_records(decoded: DataFrame, flows: DataFrame, flows_per_record: int = FLOWS_PER_RECORD) -> DataFrame:
    """Extraction records as written to JSON lines.

    A capture with many flows gets several records of at most
    `flows_per_record` flows each, so no record grows with the capture.
    """
    stats = packet_statistics(decoded)
    place = F.xxhash64(col("Flow ID"))
    numbered = number_rows(flows, ["file"], [place, col("Flow ID"), col("Timestamp")], place.cast("double"), "__no")
    parts = numbered.withColumn("part", F.floor((F.col("__no") - 1) / flows_per_record)).groupBy("file", "part").agg(
        F.collect_list(F.struct(*[col(c) for c in FLOW_COLUMNS])).alias("flows"))
    rows = stats.join(parts, "file", "left")
    ok = F.col("error").isNull()
    notes = F.array_compact(F.array(
        F.when(F.col("parsed_packets") == 0, "未能从 PCAP 中解析出任何数据包，文件可能为空或格式不兼容。").when(
            F.col("dropped_packets") > 0, F.format_string("有 %d 个数据包在解析时被跳过，预测可靠性可能受影响。", F.col("dropped_packets")))))
    return rows.select(
        ok.alias("success"), F.col("file").alias("path"), F.coalesce("flows", F.array()).alias("flows"),
        F.when(ok, F.create_map(F.lit("parsed_packets"), F.col("parsed_packets"), F.lit("dropped_packets"), F.col("dropped_packets"))).alias("packet_stats"),
        F.when(ok, notes).alias("warnings"), "error")


def write_extractions(records: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write the records and return source, record and success counts."""
    records.write.mode(mode).json(path)
    back = records.sparkSession.read.json(path, schema="success boolean, path string")
    return back.groupBy("path").agg(F.bool_and("success").alias("ok")).agg(
        F.count(F.lit(1)).alias("record_count"), F.count_if("ok").alias("success_count"))


def write_dataset(rows: DataFrame, path: str, file_column: str = "source_path", mode: str = "overwrite") -> dict:
    """Merged data set, manifest per source file, and a one-row description."""
    spark = rows.sparkSession
    aligned = align_schema(rows.drop(file_column))
    keep = aligned.columns
    merged = align_with_file(rows, file_column).withColumn(LABEL_BINARY, label_binary(col(LABEL)))
    merged.write.mode(mode).parquet(f"{path}/dataset")
    stored = spark.read.parquet(f"{path}/dataset")
    listed = manifest(stored, file_column, col(LABEL_BINARY).isin(0, 1))
    listed.write.mode(mode).parquet(f"{path}/manifest")
    total = spark.read.parquet(f"{path}/manifest").where("is_total").first()
    info = {"type": "merged_feature_dataset", "created_at": dt.datetime.now().isoformat(timespec="seconds"),
            "columns": keep + [LABEL_BINARY], "string_columns": sorted(STRING_COLUMNS), "label_column": LABEL,
            "rows": total["rows"], "labeled_rows": total["labeled_rows"], "unlabeled_rows": total["rows"] - total["labeled_rows"],
            "dataset_format": "parquet"}
    spark.createDataFrame([(json.dumps(info),)], "value string").write.mode(mode).text(f"{path}/meta")
    return info


def align_with_file(rows: DataFrame, file_column: str) -> DataFrame:
    """`align_schema` that keeps the file column."""
    from flowspark.functions.exprs import number
    from flowspark.operators.clean import canonical_headers
    names = [c if c == file_column else canonical_headers([c])[0] for c in rows.columns]
    df = rows.toDF(*names)
    text = [*STRING_COLUMNS, LABEL]
    value = lambda c: (F.coalesce(col(c).cast("string"), F.lit("")) if c in names else F.lit("")) if c in text else (
        number(df, c) if c in names else F.lit(0.0))
    return df.select(*[value(c).alias(c) for c in FLOW_COLUMNS], col(file_column))


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """The tables of a report, one directory each."""
    for name, table in tables.items():
        table.write.mode(mode).parquet(f"{path}/{name}")


def append_registry(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def append_event(spark: SparkSession, path: str, event: str, data: dict | None = None) -> None:
    """One line per model event: timestamp, event, data."""
    stamp = dt.datetime.now(dt.timezone.utc).isoformat()
    line = json.dumps({"timestamp": stamp, "event": event, "data": data or {}}, ensure_ascii=False, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def append_annotations(rows: DataFrame, path: str) -> str:
    """Annotations as a batch of the log that `upsert.read_annotations` merges."""
    return upsert(rows.sparkSession, path, rows)


def write_predictions(predicted: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = predicted.write.mode(mode)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def _parts_per_directory(parts_per_bucket: int) -> int:
    """Whole buckets, LEAST_PARTS_PER_DIRECTORY parts or more."""
    return parts_per_bucket * -(-LEAST_PARTS_PER_DIRECTORY // parts_per_bucket)


def write_packet_chunks(chunked: DataFrame, path: str, mode: str = "overwrite", parts_per_bucket: int = PARTS_PER_BUCKET) -> None:
    """Packet table by capture and bucket of parts, in the order of the parts; `part` and `bucket` stay columns.

    A bucket holds `parts_per_bucket` parts, so their number follows the capture's size and not its number of parts. Small buckets
    share a directory: a file for a few hundred packets costs more to write and to list than its rows. The rows of a directory
    are in order, so a reader finds a bucket by the statistics of the file's pages.
    """
    rows = chunked.withColumns({
        "bucket": F.floor(F.col("part") / parts_per_bucket).cast("long"),
        "directory": F.floor(F.col("part") / _parts_per_directory(parts_per_bucket)).cast("int")})
    order = [c for c in ("part", "packet_index") if c in rows.columns]
    rows.repartition("file", "directory").sortWithinPartitions("file", "directory", *order).write.mode(mode).partitionBy("file", "directory").parquet(path)


def read_packet_part(spark: SparkSession, path: str, file: str, part: int, parts_per_bucket: int = PARTS_PER_BUCKET) -> DataFrame:
    """The packets of one part; only its directory is read, and of that the pages with its bucket."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("file") == file) & (F.col("directory") == part // _parts_per_directory(parts_per_bucket))
                      & (F.col("bucket") == part // parts_per_bucket) & (F.col("part") == part)).drop("bucket", "directory")
