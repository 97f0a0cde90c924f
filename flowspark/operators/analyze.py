"""Reports over scored flows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.exprs import col, finite_or_null
from flowspark.operators.clean import ANOMALOUS, NORMAL, any_numeric, binarize_truth, pick_column
from flowspark.operators.metrics import confusion_counts, curve_of, pr_of, roc_of, score_steps, with_rates
from flowspark.operators.ordered import exact_quantiles, lookup_join, number_rows, slice_number

# Column candidates, best first.
SCORE_CANDIDATES = ["fusion_score", "malicious_score", "anomaly_score", "score", "iforest_score"]
LABEL_CANDIDATES = ["prediction_status", "prediction_label", "is_malicious", "is_anomaly", "predicted_label", "label", "anomaly"]
TRUTH_CANDIDATES = ["LabelBinary", "labelbinary", "Label", "label", "class", "ground_truth"]
FILE_CANDIDATES = ["pcap_file", "source_file", "__source_file__", "__source_path__"]
ID_CANDIDATES = ["flow_id", "Flow ID", "packet_id", "row_id", "id"]
META_COLUMNS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol", "timestamp", "capture_time",
                "attack", "category", "threat", "severity"]
HIGH_IS_BAD = ["fusion_score", "malicious_score", "prob_malicious", "proba_malicious"]

# Report sizes and drift rule.
MAX_TOP_ROWS = 2000
MIN_TOP_ROWS = 20
MIN_TOP_FRACTION = 0.01
TOP_REASONS = 5
QUANTILE_POINTS = [0.01, 0.05, 0.5, 0.9, 0.95, 0.99]
DRIFT_POINTS = [0.01, 0.05, 0.5, 0.9]
DRIFT_LIMIT = 0.15


def file_summary(df: DataFrame, file: str, score: str, label: str | None = None) -> DataFrame:
    """Per file: scored rows, mean, min, max, and malicious rows; rows without a file form their own group."""
    s = F.col(score)
    aggs = [F.count(s).alias("total"), F.avg(s).alias("mean"), F.min(s).alias("min"), F.max(s).alias("max")]
    if label:
        aggs.append(F.sum(label).cast("long").alias("malicious_count"))
    out = df.groupBy(file).agg(*aggs)
    if label:
        out = out.withColumn("malicious_ratio", F.col("malicious_count") / F.greatest("total", F.lit(1)))
    return out


def totals(df: DataFrame, file: str | None, label: str | None) -> DataFrame:
    """Rows, distinct files, malicious rows, their share and the overall status."""
    files = F.countDistinct(file) if file else F.lit(0)
    bad = F.coalesce(F.sum(label), F.lit(0)).cast("long") if label else F.lit(0).cast("long")
    out = df.agg(F.count(F.lit(1)).alias("total_rows"), files.alias("unique_files"), bad.alias("malicious_total"))
    return out.withColumns({
        "malicious_ratio": F.when(F.col("total_rows") > 0, F.col("malicious_total") / F.col("total_rows")).otherwise(0.0),
        "status_text": F.when(F.col("malicious_total") > 0, ANOMALOUS).otherwise(NORMAL)})


def score_quantiles(df: DataFrame, score: str, points: list[float] | None = None) -> DataFrame:
    """Exact quantiles: columns prob, quantile."""
    return exact_quantiles(df, score, points or QUANTILE_POINTS)


def drift_alerts(df: DataFrame, score: str, training: dict[float, float], limit: float = DRIFT_LIMIT) -> DataFrame:
    """Quantiles that moved by more than `limit` relative to the training quantiles."""
    shared = [p for p in DRIFT_POINTS if p in training]
    base = F.create_map(*[F.lit(float(x)) for p in shared for x in (p, training[p])])
    now = exact_quantiles(df, score, shared).withColumn("baseline", F.element_at(base, F.col("prob")))
    moved = F.abs(F.col("quantile") - F.col("baseline")) / F.greatest(F.abs("baseline"), F.lit(1e-6))
    return now.withColumn("drift", moved).where(F.col("drift") > limit)


def histogram(df: DataFrame, score: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from minimum to maximum, the last one closed; empty bins included."""
    s = F.col(score).cast("double")
    ends = df.agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((s - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).cast("int")
    counted = df.where(s.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / bins
    return frame.join(F.broadcast(counted), "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"))


def top_rows(df: DataFrame, score: str, order: list[str], descending: bool = True, percent: float = 1.0,
             most: int = MAX_TOP_ROWS) -> DataFrame:
    """The most suspicious rows with their `rank`: percent of all rows, 20 to `most` of them.  Ties keep row order."""
    by_score = F.col(score).desc() if descending else F.col(score).asc()
    ranking = [by_score, *[F.col(c).asc() for c in order]]
    size = df.agg(F.count(F.lit(1)).alias("__n"))
    share = max(percent / 100.0, MIN_TOP_FRACTION)
    n = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(share)))
    n = F.when(F.col("__n") >= MIN_TOP_ROWS, F.greatest(F.lit(MIN_TOP_ROWS), n)).otherwise(n)
    first = df.orderBy(*ranking).limit(most)       # a top-k report: at most `most` rows from here on
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*ranking)))
    return ranked.crossJoin(F.broadcast(size)).where(F.col("rank") <= F.least(n, F.lit(most))).drop("__n")


def first_rows_by_id(df: DataFrame, ids: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """`columns` of the first row (in `order`) of every wanted id; `ids` is a small report."""
    wanted = df.select(*[col(c) for c in dict.fromkeys([key, *columns, *order])]).join(
        F.broadcast(ids.select(col(key)).distinct()), key, "left_semi")
    picked = wanted.groupBy(col(key)).agg(F.min_by(F.struct(*[col(c) for c in columns]), F.struct(*[col(c) for c in order])).alias("__r"))
    return picked.select(col(key), "__r.*")


def top_reasons(top: DataFrame, features: list[str], k: int = TOP_REASONS, out: str = "top_reasons") -> DataFrame:
    """The k features that stand out most in each top row, by z-score over the top rows, as "name:0.00, ..."."""
    value = lambda c: F.coalesce(col(c).cast("float"), F.lit(0.0).cast("float"))
    everyone = Window.partitionBy()                # at most MAX_TOP_ROWS rows
    stats, parts = {}, []
    for i, c in enumerate(features):
        v = value(c).cast("double")
        stats[f"__m{i}"], stats[f"__s{i}"] = F.avg(v).over(everyone), F.stddev_pop(v).over(everyone)
        std = F.greatest(F.col(f"__s{i}"), F.lit(1e-6)).cast("float")
        z = F.abs(((value(c) - F.col(f"__m{i}").cast("float")) / std).cast("float"))
        parts.append(F.struct((-z).alias("z"), F.lit(i).alias("i"), F.lit(c).alias("name")))
    ranked = F.slice(F.array_sort(F.array(*parts)), 1, k)
    shown = F.transform(F.filter(ranked, lambda p: p["z"] < 0),
                        lambda p: F.format_string("%s:%.2f", p["name"], (-p["z"]).cast("double")))
    return top.withColumns(stats).withColumn(out, F.array_join(shown, ", ")).drop(*stats)


def anomaly_files(top: DataFrame, file: str, limit: int = 10) -> DataFrame:
    """Distinct files among the top rows, by their best rank."""
    return top.where(col(file).isNotNull()).groupBy(file).agg(F.min("rank").alias("rank")).orderBy("rank").limit(limit)


def anomaly_samples(df: DataFrame, source: str, flag: Column, order: list[str], slice_on: str | None = None,
                    limit: int = 3) -> DataFrame:
    """The first `limit` flagged rows of every source."""
    slicing = partial(slice_number, df, slice_on or order[0])
    return number_rows(df.where(flag), [source], [F.col(c) for c in order], slicing, "sample", limit=limit)


def batch_summary(df: DataFrame, file: str, flag: Column, failed: DataFrame | None = None) -> DataFrame:
    """Files ok and failed, rows, files with anomalies, anomalous rows; `failed` has a row per unreadable file."""
    per_file = df.groupBy(file).agg(F.count(F.lit(1)).alias("__rows"), F.count_if(flag).alias("__bad"))
    out = per_file.agg(
        F.count(F.lit(1)).alias("files_ok"), F.coalesce(F.sum("__rows"), F.lit(0)).alias("total_rows"),
        F.count_if(F.col("__bad") > 0).alias("anomaly_files"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("anomaly_rows"))
    if failed is None:
        return out.withColumn("files_failed", F.lit(0).cast("long"))
    return out.crossJoin(F.broadcast(failed.agg(F.count(F.lit(1)).alias("files_failed"))))


def run_status(summary: DataFrame, alerts: DataFrame, updated: Column | None = None) -> DataFrame:
    """One row: total, anomalies, ratio, number of drift alerts, last update."""
    count = alerts.agg(F.count(F.lit(1)).alias("alerts"))
    return summary.crossJoin(F.broadcast(count)).select(
        F.col("total_rows").alias("total"), F.col("malicious_total").alias("anomalies"),
        F.col("malicious_ratio").alias("ratio"), "alerts", (F.current_timestamp() if updated is None else updated).alias("last_update"))


def manifest(df: DataFrame, file: str, labeled: Column) -> DataFrame:
    """Rows and labelled rows per file, and the total (file null, is_total true) in the same pass."""
    return df.withColumn(file, F.coalesce(col(file), F.lit(""))).rollup(file).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(labeled).alias("labeled_rows"),
        (F.grouping(file) == 1).alias("is_total"))


def page(df: DataFrame, number: int, size: int, order: list[str]) -> DataFrame:
    """Page `number` (from 1) of `size` rows."""
    return df.orderBy(*[F.col(c) for c in order]).offset(max(0, number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("rows") / size)))


def preview(df: DataFrame, by: str, descending: bool = False, rows: int = 50) -> DataFrame:
    """The first rows sorted by any column."""
    return df.orderBy(col(by).desc() if descending else col(by).asc()).limit(rows)


def prepare_results(df: DataFrame, metadata: dict | None = None) -> tuple[DataFrame, dict]:
    """Choose score, label, truth, file and id columns; drop rows without a finite score."""
    metadata = metadata or {}
    names = {k: pick_column(df.columns, c) for k, c in (
        ("score", SCORE_CANDIDATES), ("label", LABEL_CANDIDATES), ("truth", TRUTH_CANDIDATES),
        ("file", FILE_CANDIDATES), ("id", ID_CANDIDATES))}
    if not names["score"]:
        raise ValueError("no score column")
    score = finite_or_null(col(names["score"]).try_cast("float"))
    rows = df.withColumn("__score", score).where(F.col("__score").isNotNull())
    for kind in ("label", "truth"):
        if names[kind]:
            rows = binarize_truth(rows, names[kind], f"__{kind}", is_numeric=any_numeric(rows, names[kind]))
    if names["truth"] and not names["label"]:
        rows, names["label"] = rows.withColumn("__label", F.col("__truth")), names["truth"]
    stated = str(metadata.get("score_column", "")).strip().lower()
    names["descending"] = names["score"].lower() in HIGH_IS_BAD or stated in HIGH_IS_BAD
    return rows, names


def analyze_results(df: DataFrame, order: list[str], metadata: dict | None = None) -> dict[str, DataFrame]:
    """Every table of the result report: totals, by_file, top, quantiles, histogram, drift, roc, pr, ...

    All are lazy but the counts per score behind the curves, which are stored if there is a truth column, and whether label and truth
    hold numbers, which is asked once and not with every table.
    """
    metadata = metadata or {}
    rows, names = prepare_results(df, metadata)
    label = "__label" if names["label"] else None
    out = {"totals": totals(rows, names["file"], label)}
    if names["file"]:
        out["by_file"] = file_summary(rows, names["file"], "__score", label)
    top = top_rows(rows, "__score", order, names["descending"], float(metadata.get("refine_top_percent") or 1.0))
    features = [c for c in metadata.get("feature_columns") or [] if c in df.columns]
    if names["id"] and features:
        side = first_rows_by_id(df, top, names["id"], features, order)
        top = top.drop(*features).join(F.broadcast(side), names["id"], "left")
        top = top_reasons(top, features)
    else:
        top = top.withColumn("top_reasons", F.lit(""))
    shown = [names["id"], names["file"], *[c for c in META_COLUMNS if c in df.columns]]
    out["top"] = top.select("rank", F.col("__score").alias(names["score"]), *([F.col("__label").alias("flag")] if label else []),
                            *[col(c) for c in dict.fromkeys(shown) if c], "top_reasons")
    if names["file"]:
        out["anomaly_files"] = anomaly_files(top, names["file"])
    out["quantiles"] = score_quantiles(rows, "__score")
    out["histogram"] = histogram(rows, "__score")
    if metadata.get("score_quantiles"):
        training = {float(k): float(v) for k, v in metadata["score_quantiles"].items()}
        out["drift"] = drift_alerts(rows, "__score", training)
    if names["truth"]:
        threshold = metadata.get("threshold")
        if threshold is None:
            cut = 0.95 if names["descending"] else 0.05
            threshold = exact_quantiles(rows, "__score", [cut]).first()["quantile"]
        hit = (F.col("__score") >= threshold) if names["descending"] else (F.col("__score") <= threshold)
        judged = rows.withColumn("__pred", hit.cast("int"))
        steps = score_steps(judged, "__score", "__truth")
        out["roc"], out["pr"], out["curve"] = roc_of(steps), pr_of(steps), curve_of(steps)
        out["confusion"] = with_rates(confusion_counts(judged, "__truth", "__pred"))
    return out


def attach_by_file(df: DataFrame, table: DataFrame, file: str) -> DataFrame:
    """Attributes per file (a label override, say) onto its rows."""
    return lookup_join(df, table, [file])
