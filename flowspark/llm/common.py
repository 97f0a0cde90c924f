"""Text expressions and helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import scratch_dir

#: Fixed by the contracts of the queries.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NON_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; pure ASCII text takes the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, gap: str = SPACE_RUN) -> Column:
    """The non-empty pieces between runs of `gap`."""
    return F.array_remove(F.split(text, gap), "")


def gram_hashes(words: Column, k: int) -> Column:
    """One 64-bit hash per run of k neighbouring words; none if there are fewer.

    `words` has to be a stored column. Items are read by position: slice() would
    copy the whole array for every run.
    """
    return F.when(F.size(words) >= k, F.transform(
        F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    )).otherwise(F.array().cast("array<bigint>"))


def text_key(text: str | Column = "text") -> Column:
    """Tells rows that share an id apart by their text."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def boxed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, text, key): a document's whole row as one struct, so that no name of the caller's can meet one of an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"),
                       F.col(f"`{text}`").alias("text"), text_key(F.col(f"`{text}`")).alias("key"))


def unboxed(rows: DataFrame, columns: list[str], **replaced: Column) -> list[Column]:
    """The caller's columns out of `row`, some of them replaced."""
    return [replaced.get(c, F.col("row").getField(c)).alias(c) for c in columns]


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}-{uuid.uuid4().hex[:6]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
