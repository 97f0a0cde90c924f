"""Flow tables from CSV and JSON-lines files."""

from __future__ import annotations

import codecs
import csv
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.exprs import clean_double, col
from flowspark.schema import EXTRACTION_SCHEMA, FLOW_COLUMNS, FLOW_FILE_HEADER, LABEL, LABEL_BINARY, NUMERIC_FEATURES, STRING_COLUMNS, _unique
from flowspark.sources.captures import _File, list_files

# Encodings tried in turn.
CSV_ENCODINGS = ["utf-8", "utf-8-sig", "gb18030", "latin1"]
FLOW_CSV_ENCODINGS = ["utf-8", "utf-8-sig", "cp1252", "latin-1"]
JAVA_CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "gb18030": "GB18030", "latin1": "ISO-8859-1",
                 "latin-1": "ISO-8859-1", "cp1252": "windows-1252"}
ALIKE = {"utf-8-sig": "utf-8", "latin-1": "latin1"}       # one test for both
ONE_BYTE = ["latin1", "latin-1", "cp1252"]      # characters are bytes
MOST_BYTES = 4            # of a character
PROBE_BYTES = 1 << 20     # the header lies within
RANGE_BYTES = 16 << 20
MOST_RANGE_TASKS = 10_000
RANGE_TASKS_A_CORE = 4
FIELD = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'       # a comma outside quotes
PREFERRED_NAMES = ["vectorized", "feature", "train"]      # fixed values


def list_csv(spark: SparkSession, source: str | list[str], recursive: bool = False) -> DataFrame:
    """CSV files of a directory, one file, or a list of files."""
    if isinstance(source, str):
        return list_files(spark, source, (".csv",), recursive)
    return reduce(DataFrame.unionByName, [list_files(spark, s, ("",), False) for s in source])


def _carried(data: bytes, size: int, start: int, encoding: str) -> int:
    """Where decoding `data` from byte `start` stands behind the character that covers byte `size` - 1: bytes taken from the next range, -1 if it fails.

    `data` is a range of `size` bytes and the few bytes behind it; a character belongs to the range it begins in.
    """
    if start >= size:
        return start - size
    if data.isascii() and encoding in CSV_ENCODINGS + FLOW_CSV_ENCODINGS:
        return 0                   # a character a byte in all of them
    decoder = codecs.getincrementaldecoder("utf-8" if encoding == "utf-8-sig" else encoding)()
    try:
        decoder.decode(data[start:size])
        for taken in range(MOST_BYTES):
            if not decoder.getstate()[0]:
                return taken
            if size + taken >= len(data):
                return -1          # the file ends within a character
            decoder.decode(data[size + taken:size + taken + 1])
    except UnicodeDecodeError:
        pass
    return -1


def _all_carried(data: bytes, size: int, starts: range, encoding: str) -> list[int]:
    """`_carried` for every start; one that lies between two characters of an earlier start's text ends as that one does."""
    takes: list[int] = []
    whole = lambda part: _carried(part, len(part), 0, encoding) == 0
    for start in starts:
        same = next((s for s in starts[:len(takes)] if whole(data[s:start])), None) if start < size else None
        takes.append(_carried(data, size, start, encoding) if same is None else takes[same])
    return takes


def _test_ranges(batches: Iterator[pd.DataFrame], encodings: list[str]) -> Iterator[pd.DataFrame]:
    """Per range and encoding: for each number of bytes that the range before may have taken, how many this one takes from the next."""
    for batch in batches:
        out = []
        for path, k, start, end in batch[["path", "k", "start", "stop"]].itertuples(index=False):
            try:
                f = _File(path)
                try:
                    data = f.read(start, end - start + MOST_BYTES - 1)
                finally:
                    f.close()
                known: dict[str, list[int]] = {}
                for encoding in encodings:
                    starts = range(MOST_BYTES) if start and encoding not in ONE_BYTE else range(1)
                    head = None
                    if not start:
                        text = codecs.getincrementaldecoder("utf-8-sig" if encoding == "utf-8" else encoding)("ignore").decode(data[:PROBE_BYTES])
                        line = text.splitlines()[0] if text.strip() else ""
                        head = next(csv.reader([line]), []) if line else []
                    decoder = ALIKE.get(encoding, encoding)
                    if decoder not in known:
                        known[decoder] = _all_carried(data, end - start, starts, encoding)
                    out.append((path, k, encoding, known[decoder], head, None))
            except Exception as e:
                out.append((path, k, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=["path", "k", "encoding", "takes", "header", "error"])


def probe_csv(listing: DataFrame, encodings: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, encoding, header, error: one row per file; the first encoding that decodes all of it counts.

    Files are tested in byte ranges, in parallel. A range does not know where its first character begins, so
    it reports for every possible place where it would leave the next range; the reports of a file are
    then followed from its first byte to its last.
    """
    names = encodings or CSV_ENCODINGS
    ranges = listing.select("path", "length", F.explode(F.sequence(
        F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(F.col("length") / range_bytes) - 1))).alias("k")).select(
        "path", "k", (F.col("k") * range_bytes).alias("start"), F.least("length", (F.col("k") + 1) * range_bytes).alias("stop"))
    size = listing.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("length") / range_bytes))), F.sum("length")).first()
    # Small ranges and small files share tasks: a task by RANGE_BYTES of input, and some for each core.
    n = min(size[0] or 1, max(-(-(size[1] or 0) // RANGE_BYTES), RANGE_TASKS_A_CORE * listing.sparkSession.sparkContext.defaultParallelism))
    tested = ranges.repartition(int(min(n, MOST_RANGE_TASKS)), "path", "k").mapInPandas(
        lambda it: _test_ranges(it, names), "path string, k long, encoding string, takes array<int>, header array<string>, error string")
    step = F.struct("k", "takes")
    files = tested.groupBy("path", "encoding").agg(F.sort_array(F.collect_list(step)).alias("steps"), F.max("header").alias("header"), F.max("error").alias("error"))
    ends = F.aggregate("steps", F.lit(0), lambda at, s: F.when(at < 0, at).otherwise(F.coalesce(F.get(s["takes"], at), F.lit(-1))))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in names]), F.col("encoding")), F.lit(0))
    fits = F.when((ends == 0) & F.col("error").isNull(), F.struct(rank.alias("rank"), "encoding", "header"))
    found = files.groupBy("path").agg(F.min(fits).alias("best"), F.max("error").alias("error"))
    lost = F.coalesce("error", F.when(F.col("best").isNull(), F.lit("ValueError: no encoding fits")))
    return found.select("path", F.when(lost.isNull(), F.col("best.encoding")).alias("encoding"),
                        F.when(lost.isNull(), F.col("best.header")).alias("header"), lost.alias("error"))


def read_csv_files(listing: DataFrame, *, columns: list[str] | None = None, encodings: list[str] | None = None,
                   infer: bool = False, skip_unreadable: bool = False, file_column: str | None = None,
                   range_bytes: int = RANGE_BYTES, probed: DataFrame | None = None) -> DataFrame:
    """All files under the union of their columns; headers are trimmed, a repeated name gets `.1`.

    `probed` is the stored result of `probe_csv` where there is one already. Files are grouped by encoding and header, and each group is one scan, so a
    projection reaches every scan.
    """
    spark = listing.sparkSession
    found = probe_csv(listing, encodings, range_bytes) if probed is None else probed
    groups = found.groupBy("encoding", "header", "error").agg(F.collect_list("path").alias("paths")).collect()
    bad = [p for g in groups if g["error"] for p in g["paths"]]
    if bad and not skip_unreadable:
        raise ValueError(f"cannot read {bad[:3]}")
    frames = []
    for g in groups:
        if g["error"] or not g["header"]:
            continue
        names = _unique([h.strip() for h in g["header"]])
        charset = JAVA_CHARSETS[g["encoding"]]
        if charset not in ("UTF-8", "ISO-8859-1"):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        reader = spark.read.option("header", True).option("encoding", charset)
        if infer:
            frame = reader.option("inferSchema", True).csv(g["paths"])
        else:
            schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
            frame = reader.option("enforceSchema", True).schema(schema).csv(g["paths"])
        lineage = F.col("_metadata.file_path")
        if file_column:
            frame = frame.select(*[F.col(f"`{c}`") for c in frame.columns], lineage.alias(file_column))
            names = names + [file_column]
        frames.append(frame.toDF(*names))
    if not frames:
        raise ValueError("no readable CSV file")
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if columns:
        missing = [c for c in columns if c not in out.columns]
        if missing:
            raise KeyError(f"missing columns: {missing}")
        out = out.select(*[col(c) for c in columns], *([file_column] if file_column else []))
    return out


def read_csv_tree(spark: SparkSession, source: str, infer: bool = True) -> DataFrame:
    """Every CSV under a directory tree; unreadable files are left out."""
    return read_csv_files(list_csv(spark, source, recursive=True), infer=infer, skip_unreadable=True)


def newest_dataset(listing: DataFrame) -> DataFrame:
    """The newest file, those with a telling name first."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    preferred = reduce(lambda a, b: a | b, (name.contains(t) for t in PREFERRED_NAMES))
    return listing.orderBy(preferred.desc(), F.col("modified_ms").desc(), "path").limit(1)


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Text lines with their place in the file (`__at`)."""
    lines = spark.read.text(path)
    return lines.select("value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                          F.monotonically_increasing_id().alias("line")).alias("__at"))


def _fields(value: Column) -> Column:
    """Fields of a CSV line; the quote-aware split is only paid for by lines with quotes."""
    unquoted = F.transform(F.split(value, FIELD, -1), lambda f: F.when(
        f.startswith('"') & f.endswith('"') & (F.length(f) > 1),
        F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    return F.when(value.contains('"'), unquoted).otherwise(F.split(value, ",", -1))


def _without_bom(value: Column) -> Column:
    return F.when(value.startswith("\ufeff"), F.substring(value, F.lit(2), F.length(value) - 1)).otherwise(value)


def _is_header(value: Column, header: list[str]) -> Column:
    """Whether the fields of a line are the header's; only a line with quotes has to be split for that."""
    plain = F.lit(False) if any("," in h for h in header) else value == F.lit(",".join(header))
    return F.when(value.contains('"'), _fields(value) == F.array(*[F.lit(h) for h in header])).otherwise(plain)


def repair_misaligned(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """Rows of 88 values under 86 headers, with the two surplus values (77th and 78th) removed.

    Takes one file or a list of files.  A row of any other width, or a header of
    other than 86 columns, is an error.
    """
    paths = [source] if isinstance(source, str) else list(source)
    probes = probe_csv(list_csv(spark, paths), ["utf-8", "utf-8-sig"]).select("header", "error").distinct().collect()
    for probe in probes:
        if probe["error"]:
            raise ValueError(probe["error"])
        if len(probe["header"]) != 86:
            raise ValueError(f"expected 86 header columns, found {len(probe['header'])}")
    header = probes[0]["header"]
    rows = spark.read.text(paths).where((F.trim("value") != "")).select(_without_bom(F.col("value")).alias("value"))
    # Asked of the text: a filter on the fields would be pushed below them and split every line twice.
    values = rows.where(~_is_header(F.col("value"), header)).select(_fields(F.col("value")).alias("f"))
    checked = F.when(F.size("f") == 88, F.col("f")).otherwise(
        F.raise_error(F.concat(F.lit("expected 88 values, found "), F.size("f").cast("string"))).cast("array<string>"))
    fixed = values.select(checked.alias("f"))
    return fixed.select(*[F.col("f")[i if i < 76 else i + 2].alias(n) for i, n in enumerate(_unique(header))])


def read_extractions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Flows of extraction records (JSON lines); a record without success is an error.

    Columns: the flow columns, `path`, and the record's own label as `record_label`.
    """
    records = spark.read.schema(EXTRACTION_SCHEMA).json(path)
    failed = F.raise_error(F.concat(F.lit("extraction failed for "), F.coalesce("path", F.lit("?")), F.lit(": "), F.coalesce("error", F.lit("unknown error"))))
    flows = F.when(F.coalesce("success", F.lit(False)), F.col("flows")).otherwise(failed.cast(EXTRACTION_SCHEMA["flows"].dataType))
    return records.select("path", F.col("label").alias("record_label"), F.explode(flows).alias("f")).select("path", "record_label", "f.*")


# Accepted headers of a vectorised data set.
VECTORIZED_HEADERS = [
    FLOW_FILE_HEADER, FLOW_FILE_HEADER + [LABEL_BINARY],
    [c for c in FLOW_FILE_HEADER if c not in STRING_COLUMNS], [c for c in FLOW_FILE_HEADER if c not in STRING_COLUMNS] + [LABEL_BINARY],
    NUMERIC_FEATURES + [LABEL], NUMERIC_FEATURES + [LABEL, LABEL_BINARY],
    FLOW_COLUMNS, FLOW_COLUMNS + [LABEL_BINARY],
]


def read_vectorized(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The 80 features, `label_text` and the place (file, block, line) of a vectorised data set: one file, or several with one header.

    A row longer than the header whose last value is 0 or 1 takes that as its
    label; otherwise the Label column counts, blank meaning unlabelled.
    """
    paths = [path] if isinstance(path, str) else list(path)
    probes = probe_csv(list_csv(spark, paths), FLOW_CSV_ENCODINGS).select("header", "error").distinct().collect()
    lost = [p["error"] for p in probes if p["error"]]
    if lost:
        raise ValueError(lost[0])
    if len(probes) != 1:
        raise ValueError("the files of a data set differ in their headers")
    header = [h.strip() for h in probes[0]["header"]]
    if header not in VECTORIZED_HEADERS:
        raise ValueError("header does not match a vectorised data set")
    names = _unique(header)
    rows = _lines(spark, paths).where(F.trim("value") != "").select("__at", _fields(F.regexp_replace("value", "^\ufeff", "")).alias("f"))
    rows = rows.where(F.transform("f", lambda x: F.trim(x)) != F.array(*[F.lit(h) for h in header]))
    last = F.trim(F.element_at("f", -1))
    given = F.trim(F.get(F.col("f"), F.lit(names.index(LABEL))))
    label = F.when((F.size("f") > len(header)) & last.isin("0", "1"), last).otherwise(F.nullif(given, F.lit("")))
    return rows.select(*[clean_double(F.get(F.col("f"), F.lit(names.index(c)))).alias(c) for c in NUMERIC_FEATURES],
                       label.alias("label_text"), F.col("__at.file").alias("file"), F.col("__at.block").alias("block"), F.col("__at.line").alias("line"))
