"""Line dedup: a line that several documents share stays in the first of them only.

Method: (key hash, document, position) rows are range-partitioned and sorted;
each partition is streamed once and the lines behind the first document of a
hash are marked. Documents get a compressed bitmap of kept lines; the text
meets its bitmap last.

A hash whose rows fill several partitions (a line in a third of all documents)
needs no single task: the ranges cut between its documents. Only the first run
of a partition can be the rest of a run that began earlier, so partitions report
the ends of their first and last run, and these few rows decide the open cases.

Defined cases: a null or empty text is one empty line; null ids count as one
document that comes after all others; rows that repeat an id are that document
again (its lines never drop each other); a repeated row gives a repeated row;
an empty table gives an empty one; no other columns than id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import SPACES, ascii_lower, boxed, save, split_words, text_key, unboxed, whole

MIN_KEY_CHARS = 10
SURE, OPEN, MARK = 0, 1, 2       # dropped; dropped if the run began earlier; end of a run


def line_key(line: Column) -> Column:
    """What makes two lines equal: white space at the ends and A-Z case do not count."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _first_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream rows sorted by (h1, h2, document): what has to go, as row numbers' columns."""
    run = None            # (h1, h2) of the current run
    first_doc = None      # the run's first document in this partition
    in_first = True       # whether this is the partition's first run
    last = None           # the current run's first row, for the closing mark
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        h1 = batch.column("h1").to_numpy(zero_copy_only=False)
        h2 = batch.column("h2").to_numpy(zero_copy_only=False)
        doc = batch.column("doc_key").to_numpy(zero_copy_only=False)
        starts = np.empty(n, bool)
        starts[0] = run is None or (h1[0], h2[0]) != run
        starts[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        run_no = np.cumsum(starts)                       # 0: continues the run of the batch before
        heads = np.flatnonzero(starts)
        first_docs = np.concatenate([[0 if first_doc is None else first_doc], doc[heads]]).astype(np.int64)
        is_first_doc = doc == first_docs[run_no]
        from_first_run = (run_no == (1 if run is None else 0)) & in_first
        kind = np.where(is_first_doc, np.where(from_first_run, OPEN, -1), SURE).astype(np.int32)
        if len(heads):
            last = batch.slice(int(heads[-1]), 1)
            first_doc = int(doc[heads[-1]])
            in_first = run is None and len(heads) == 1
        run = (h1[-1], h2[-1])
        marked = np.flatnonzero(kind >= 0)
        if len(marked):
            out = batch.take(pa.array(marked))
            yield out.append_column("kind", pa.array(kind[marked], pa.int32()))
    if last is not None:
        yield last.append_column("kind", pa.array([MARK], pa.int32()))


def _bitmap(positions: pd.Series) -> pd.Series:
    """Kept lines as a deflated bitmap; lines behind its end are kept."""
    def pack(found):
        found = np.asarray(found, dtype=np.int64)
        bits = np.ones((int(found.max()) // 8 + 1) * 8, bool)
        bits[found] = False
        return zlib.compress(np.packbits(bits).tobytes())
    return positions.map(pack)


def _apply(text: pd.Series, bitmap: pd.Series) -> pd.DataFrame:
    texts, dropped = [], []
    for body, packed in zip(text, bitmap, strict=True):
        if packed is None:
            texts.append(None)
            dropped.append(0)
            continue
        lines = body.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))[:len(lines)]
        gone = np.flatnonzero(bits == 0)
        for at in gone:
            lines[at] = None
        texts.append("\n".join(x for x in lines if x is not None))
        dropped.append(len(gone))
    return pd.DataFrame({"text": pd.Series(texts, dtype=object), "n_dropped": pd.Series(dropped, dtype="int64")})


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, keep): a bitmap for every document that loses lines."""
    lines = docs.select(
        F.col(doc_id).alias("doc_id"), text_key(text).alias("text_key"),
        F.posexplode(F.split(whole(text), "\n")).alias("pos", "line"))
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    rows = lines.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"),
        F.xxhash64("doc_id").alias("doc_key"), "doc_id", "text_key", "pos")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").asc_nulls_last(), F.col("text_key"), F.col("pos")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = save(ordered.mapInArrow(_first_occurrences, rows.schema.add("kind", "integer")), "line-marks")
    ends = (marked.where(F.col("kind") != SURE).groupBy("h1", "h2")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"))).alias("first"),
                 F.count(F.when(F.col("kind") == MARK, 1)).alias("marks")))
    late = (marked.where(F.col("kind") == OPEN).join(ends, ["h1", "h2"])
            .where(~F.col("first.d").eqNullSafe(F.col("doc_id"))))
    gone = marked.where(F.col("kind") == SURE).select("doc_id", "text_key", "pos").unionByName(
        late.select("doc_id", "text_key", "pos"))
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone")).select(
        "doc_id", "text_key", F.pandas_udf(_bitmap, "binary")("gone").alias("keep"))


def kept_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, kept, n_lines, n_dropped): every document with the text that is left of it."""
    maps = keep_bitmaps(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), min_chars)
    maps = maps.select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "keep")
    rows = boxed(docs, doc_id, text)
    joined = rows.join(maps, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("key") == F.col("of_key")), "left")
    # Only texts that lose lines travel to Python.
    loses = F.col("keep").isNotNull()
    cut = F.pandas_udf(_apply, "text string, n_dropped long")(F.when(loses, whole("text")), F.col("keep"))
    return joined.withColumn("cut", cut).select(
        "row", "id", F.when(loses, F.col("cut.text")).otherwise(F.col("text")).alias("kept"),
        F.size(F.split(whole("text"), "\n")).cast("long").alias("n_lines"), F.col("cut.n_dropped").alias("n_dropped"))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_KEY_CHARS, doc_id: str = "doc_id",
                        text: str = "text", least_words: int = 0) -> DataFrame:
    """`docs` without the lines that an earlier document has.

    A text that loses nothing comes back as it was, null included; one that loses lines and has fewer than
    `least_words` words left goes.
    """
    rows = kept_lines(docs, min_chars, doc_id, text)
    if least_words:
        rows = rows.where((F.col("n_dropped") == 0) | (F.size(split_words(whole("kept"))) >= least_words))
    return rows.select(*unboxed(rows, docs.columns, **{text: F.col("kept")}))
