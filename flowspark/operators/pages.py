"""Pages of a large table: rows are sorted and stored once, an index of the files says where each page lies.

`store_pages` writes the sorted rows in files and, per file, how many rows come before it. `read_page`
finds the one or two files of a page in the index and reads their rows by number; small
Parquet pages let the reader skip the rest of a file. Nothing is sorted again, and a late page costs what the first one does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ["__part", "__row"]
ROWS_PER_TASK = 250_000       # sorted and written by one task


def store_pages(df: DataFrame, path: str, order: list[str], page_rows: int = 100) -> None:
    """Sorted rows under `path`/rows and the index under `path`/index; `page_rows` is the finest unit that is read."""
    spark = df.sparkSession
    number = F.monotonically_increasing_id()
    # The number of sorted ranges follows the input, so what a task sorts and buffers does not.
    tasks = max(1, -(-df.count() // ROWS_PER_TASK))
    place = [F.col(c) for c in order]
    rows = df.repartitionByRange(tasks, *place).sortWithinPartitions(*place).select(
        "*", F.spark_partition_id().alias("__part"), number.bitwiseAND((1 << 33) - 1).alias("__row"))
    rows.write.option("parquet.page.row.count.limit", str(page_rows)).option("parquet.page.size.row.check.min", str(page_rows)).parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    files = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        *[F.min(c).alias(c) for c in PLACE], F.count(F.lit(1)).alias("rows"))         # a file has one part; plain numbers need no sort
    before = Window.orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)      # a row per file
    files.select("file", *PLACE, "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before")).write.parquet(f"{path}/index")


def page_total(spark: SparkSession, path: str, size: int) -> DataFrame:
    """rows and pages, from the index."""
    total = F.coalesce(F.sum("rows"), F.lit(0))
    return spark.read.parquet(f"{path}/index").agg(total.alias("rows")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("rows") / size)))


def read_page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Page `number` of `size` rows in the stored order; a number outside the pages gives the first or the last page."""
    index = spark.read.parquet(f"{path}/index")
    pages = page_total(spark, path, size).first()["pages"]
    start = (max(1, min(number, pages)) - 1) * size
    files = index.where((F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)).collect()    # those of one page
    rows = spark.read.parquet(f"{path}/rows") if not files else spark.read.parquet(*[f["file"] for f in files])
    here = F.lit(False)
    for f in files:
        low = f["__row"] + max(0, start - f["before"])
        high = f["__row"] + min(f["rows"], start + size - f["before"]) - 1
        here = here | ((F.col("__part") == f["__part"]) & F.col("__row").between(low, high))
    return rows.where(here).orderBy(*PLACE).drop(*PLACE)
