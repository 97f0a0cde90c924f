"""Stored pages, the annotation log, files by size, encodings by range."""

import codecs
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowspark.operators import model as mo
from flowspark.operators import pages, upsert
from flowspark.sources import captures as cap
from flowspark.sources import sinks, tables


def _scanned(df):
    """Rows that the file scans of a collected frame gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    total, stack = 0, [plan]
    while stack:
        node = stack.pop()
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        if node.nodeName().endswith("QueryStage"):
            stack.append(node.plan())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


def test_pages_read_their_own_rows_only(spark, tmp_path):
    dice = random.Random(1)
    data = [(dice.randint(0, 500), i, "x" * 20) for i in range(20_000)]
    rows = spark.createDataFrame(data, "k int, id int, pad string").repartition(5)
    path = str(tmp_path / "pages")
    pages.store_pages(rows, path, ["k", "id"], 100)
    want = sorted((k, i) for k, i, _ in data)
    assert pages.page_total(spark, path, 300).first().pages == 67
    for number, at in ((1, 0), (40, 39), (67, 66), (99, 66), (0, 0)):
        df = pages.read_page(spark, path, number, 300)
        assert [(r.k, r.id) for r in df.collect()] == want[at * 300:at * 300 + 300]
        assert df.columns == rows.columns
    df = pages.read_page(spark, path, 180, 100)
    assert df.count() == 100
    df.collect()
    assert _scanned(df) < 2 * 100 + 1
    pages.store_pages(rows.limit(0), str(tmp_path / "none"), ["k"], 10)
    assert pages.read_page(spark, str(tmp_path / "none"), 3, 10).count() == 0


def _batch(spark, records):
    return spark.createDataFrame(records, "flow_key string, label string, annotator string, timestamp string")


def test_upserts_before_and_after_compaction(spark, tmp_path):
    path, dice, want = str(tmp_path / "log"), random.Random(2), {}
    assert upsert.read_annotations(spark, path).count() == 0 and upsert.compact(spark, path) is None

    def now():
        return {r.flow_key: (r.label, r.annotator) for r in upsert.read_annotations(spark, path).collect()}
    for batch in range(5):
        records = [(f"k{dice.randint(0, 30)}", dice.choice(["1", "0", "unsure"]), f"a{batch}-{i}", f"2024-01-0{9 - batch}") for i in range(25)]
        upsert.upsert(spark, path, _batch(spark, records).coalesce(1))
        want |= {k: ({"1": 1.0, "0": 0.0}.get(label), who) for k, label, who, _ in records}
        assert now() == want
        if batch in (1, 3):
            upsert.compact(spark, path, bucket_rows=7)
            assert now() == want
    # A writer and a compaction that died half-way count for nothing.
    _batch(spark, [("k1", "0", "lost", "x")]).write.parquet(f"{path}/log/000000000099-dead")
    (tmp_path / "log/log/000000000099-dead/_SUCCESS").unlink()
    _batch(spark, [("k1", "0", "lost", "x")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/base/000000000099-dead")
    assert now() == want
    upsert.compact(spark, path)
    assert now() == want
    gone = upsert.vacuum(spark, path)
    assert len([g for g in gone if g.startswith("log/")]) == 5 and now() == want
    assert spark.read.parquet(f"{path}/base/{upsert._state(spark, path)[0]}").count() == len(want)


def test_files_follow_the_size_of_a_capture(spark, tmp_path):
    rows = spark.createDataFrame([("big", f"f{i}", "t") for i in range(1000)] + [(f"s{i % 20}", f"g{i}", "t") for i in range(200)] + [(None, "h", "t")],
                                 "file string, `Flow ID` string, Timestamp string").repartition(6)
    path = tmp_path / "flows"
    sinks.write_flows_per_capture(rows, str(path), rows_per_file=100)
    files = {d.name: len(list(d.glob("*.csv"))) for d in path.iterdir() if d.is_dir()}
    assert 5 <= files.pop("file=big") <= 10 and set(files.values()) == {1} and len(files) == 21
    assert spark.read.option("header", True).csv(str(path)).count() == 1201


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_encodings_by_ranges_equal_the_whole_file(spark, tmp_path, size):
    text = "名字,值\n" + "".join(f"异常{i},é€🙂{'a' * (i % 5)}\n" for i in range(40))
    west = "name,value\n" + "".join(f"né{i},ü{'b' * (i % 7)}\n" for i in range(40))
    files = {"utf8.csv": text.encode(), "bom.csv": b"\xef\xbb\xbf" + text.encode(), "gb.csv": text.encode("gb18030"), "west.csv": west.encode("latin1"),
             "cut.csv": text.encode()[:-2] + b"\xe5", "empty.csv": b"", "ascii.csv": b"a,b\n1,2\n"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    want = {}
    for name, data in files.items():
        for encoding in tables.CSV_ENCODINGS:
            try:
                data.decode(encoding)
            except UnicodeDecodeError:
                continue
            want[name] = encoding
            break
    listing = tables.list_csv(spark, str(tmp_path))
    got = {r.path.split("/")[-1]: r for r in tables.probe_csv(listing, range_bytes=size).collect()}
    assert {n: r.encoding for n, r in got.items()} == want
    if size > 64:
        assert got["gb.csv"].header == ["名字", "值"] == got["bom.csv"].header and got["west.csv"].header == ["name", "value"]
    lost = {r.path.split("/")[-1]: r.error for r in tables.probe_csv(listing, ["utf-8"], size).collect()}
    assert {n for n, e in lost.items() if e} == {"gb.csv", "west.csv", "cut.csv"}


def test_small_ranges_share_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_bytes(("name,value\n" + "异常,é\n" * 4000).encode())
    frame = type(spark.range(0))
    seen, deal = [], frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *a: (seen.append(n), deal(self, n, *a))[1])
    assert [r.encoding for r in tables.probe_csv(tables.list_csv(spark, str(tmp_path)), range_bytes=16).collect()] == ["utf-8"]
    assert max(seen) <= 8 * spark.sparkContext.defaultParallelism


def test_a_range_is_decoded_once_where_starts_and_encodings_agree(tmp_path, monkeypatch):
    path = tmp_path / "a.csv"
    batch = lambda: iter([pd.DataFrame({"path": [str(path)], "k": [1], "start": [16], "stop": [path.stat().st_size]})])
    decoded, make = [], codecs.getincrementaldecoder

    def counting(name):
        class Counting(make(name)):
            def decode(self, data, final=False):
                decoded.append(len(data))
                return super().decode(data, final)
        return Counting

    monkeypatch.setattr(tables.codecs, "getincrementaldecoder", counting)
    for text, times in (("1,2,three\n" * 5000, 0), ("1,2,three\n" * 5000 + "é\n", 1)):
        path.write_bytes(text.encode())
        decoded.clear()
        out = next(tables._test_ranges(batch(), ["utf-8", "utf-8-sig"]))
        assert out["takes"].tolist() == [[0, 0, 0, 0]] * 2 and out["error"].isna().all()
        assert sum(n > 100 for n in decoded) == times


def test_explicit_capture_lists_and_modes(spark, tmp_path):
    for name in "cab":
        (tmp_path / f"{name}.pcap").write_bytes(b"x")
    given = [str(tmp_path / f"{n}.pcap") for n in ("c", "missing", "a")]
    names = lambda df: [r.path[-6] for r in df.collect()]
    listing = cap.list_captures(spark, given)
    assert names(cap.select_files(listing, "all")) == ["c", "a"] == names(cap.select_files(listing, "batch", 1, 1))
    assert names(cap.select_files(listing, "file", 5)) == ["c"]
    assert names(cap.select_files(cap.list_captures(spark, str(tmp_path)), "auto")) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="unknown mode"):
        cap.select_files(listing, "some")
    with pytest.raises(FileNotFoundError):
        cap.list_captures(spark, [str(tmp_path / "none.pcap")])


class Half:
    def __init__(self, features):
        self.features = features

    def score(self, df):
        return df.withColumn("malicious_score", F.col(f"`{self.features[0]}`") * 0.5)


def test_capture_scores_and_warnings(spark):
    flows = spark.createDataFrame([("a", 1.0, "x"), ("a", None, "x"), ("b", None, "x")], "file string, `Flow Duration` double, note string")
    scored, report = mo.score_captures(flows, Half(["Flow Duration", "dur"]))
    assert scored.columns == ["file", "Flow Duration", "note", "malicious_score", "available_features", "missing_features"]
    got = {r.file: (r.flows, r.shared_features, r.coverage, r.missing_columns, len(r.warnings)) for r in report.collect()}
    assert got == {"a": (2, 2, 0.5, [], 0), "b": (1, 2, 0.0, [], 1)}
    _, report = mo.score_captures(flows, Half(["none of these"]))
    assert {w for r in report.collect() for w in r.warnings} == {mo.NO_SHARED_FEATURES}
    _, report = mo.score_captures(flows, Half(["dur", *[f"n{i}" for i in range(9)]]))
    assert {w for r in report.collect() for w in r.warnings} == {"模型特征仅有 1 个与当前流量重叠（10.0%），预测可靠性较低。"}
    assert mo.positive_index([0, 1], {0: "attack", 1: "benign"}) == 0


def test_small_files_of_a_large_capture_share_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "ROWS_PER_WRITE_TASK", 1000)
    rows = spark.range(20_000).select(F.when(F.col("id") < 18_000, "large").when(F.col("id") < 19_990, "middle").otherwise("small").alias("file"),
                                      F.col("id").cast("string").alias("Flow ID"), F.lit("t").alias("Timestamp"))
    dealt, most = sinks.spread_by_size(rows, "file", 100, ["Flow ID"])
    assert most == 125 and dealt.rdd.getNumPartitions() == 20        # 18 + 1 + 1 shares, not a task per file (201)
    sinks.write_flows_per_capture(rows, str(tmp_path / "c"), rows_per_file=100)
    back = spark.read.option("header", True).csv(str(tmp_path / "c")).groupBy("file", F.col("_metadata.file_path")).count()
    found = {r.file: (r.rows, r.files, r.most) for r in back.groupBy("file").agg(
        F.sum("count").alias("rows"), F.count("*").alias("files"), F.max("count").alias("most")).collect()}
    assert [found[f][0] for f in ("large", "middle", "small")] == [18_000, 1990, 10]
    for n, files, largest in found.values():
        assert n / 125 <= files <= -(-n // 100) and largest <= 125
