"""Training, the model registry, the weighted ensemble and k-nearest neighbours."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.exprs import col, number
from flowspark.operators.analyze import QUANTILE_POINTS
from flowspark.operators.boost import BoostedTrees
from flowspark.operators.clean import (
    ANOMALOUS, META_COLUMNS, NORMAL, add_alias_copies, infer_features, interpret_prediction, pick_column, with_coverage)
from flowspark.operators.forest import TREES_AT_ONCE, ForestInParts
from flowspark.operators.fusion import final_decision, fuse_votes
from flowspark.operators.metrics import confusion_counts, curve_metrics, evaluate_variants, variant_rows, with_rates
from flowspark.operators.ordered import exact_quantiles
from flowspark.operators.rules import rule_settings, score_rules
from flowspark.operators.sample import stratified_split
from flowspark.schema import REGISTRY_SCHEMA
from flowspark.session import store

# Training defaults.
MAX_ITER, LEARNING_RATE, TEST_SIZE, SEED = 300, 0.1, 0.2, 42
MAX_MEMBERS = 10
FIT_TASK_BYTES = 256 << 20       # of a fit's cached rows in one partition
EVEN_FIT_ROWS = 100_000          # from here on the rows of a fit are dealt out evenly over the cores
LARGE_FIT_ROWS = 4_000_000       # from here on they are read from stored files of a task's size, and not shuffled
LABEL_MAP = {0: "BENIGN", 1: "MALICIOUS"}
POSITIVE_WORDS = ["异常", "恶意", "malicious", "anomaly", "attack", "1", "-1"]
LOW_COVERAGE = 0.2
# Warnings of capture scoring.
NO_SHARED_FEATURES = "模型特征与当前 PCAP 提取的特征没有重叠，预测结果不可信，请检查训练/提取特征是否一致。"
FEW_SHARED_FEATURES = "模型特征仅有 %d 个与当前流量重叠（%.1f%%），预测可靠性较低。"
FEW_FILLED_FEATURES = "特征覆盖率仅 %.1f%% ，输入列大多为补零。"
# Metrics that may weigh a member, best first.
WEIGHT_METRICS = {
    "auc": ["val_auc", "validation_auc", "train_auc", "train_auc_macro"],
    "f1": ["val_f1", "validation_f1", "val_f1_weighted", "train_f1_weighted", "train_f1", "train_f1_macro"],
}


def positive_index(classes: list, label_map: dict[int, str] | None = None) -> int:
    """Index of the positive class: by name, else 1, else -1, else the last one."""
    names = [str((label_map or {}).get(int(c), c)).strip().lower() for c in classes]
    for i, name in enumerate(names):
        if name in POSITIVE_WORDS:
            return i
    for wanted in (1, -1):
        if wanted in classes:
            return list(classes).index(wanted)
    return len(classes) - 1


def positive_score(probability: Column, index: int) -> Column:
    return F.element_at(vector_to_array(probability), index + 1)


def feature_frame(df: DataFrame, features: list[str], label: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Features coerced to numbers under plain names f0..fn, next to `keep` and the 0/1 `y`."""
    cols = [number(df, c).alias(f"f{i}") for i, c in enumerate(features)]
    y = [number(df, label).cast("int").alias("y")] if label else []
    return df.select(*[col(c) for c in keep or []], *cols, *y)


def _assembler(n: int) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"f{i}" for i in range(n)], outputCol="features", handleInvalid="keep")


def _dealt(df: DataFrame, key: list[str], parts: int) -> DataFrame:
    """Partitions that follow the data (hash and order of the key), so a lost one is computed again as it was."""
    return df.repartition(parts, *[col(c) for c in key]).sortWithinPartitions(*[col(c) for c in key])


def _fit_row_bytes(rows: int, features: int, learner) -> int:
    """What MLlib keeps of a row: its bins and one count per tree, a thousand bytes for 200 trees, whatever the size of the stored row."""
    trees = learner.getOrDefault("numTrees") if learner.hasParam("numTrees") else 1
    return 100 + 16 * features + 4 * (trees if rows < LARGE_FIT_ROWS else min(trees, TREES_AT_ONCE))


def _fit_partitions(rows: int, features: int, learner) -> int:
    """Partitions of FIT_TASK_BYTES of what MLlib keeps."""
    return -(-rows * _fit_row_bytes(rows, features, learner) // FIT_TASK_BYTES)


def _in_parts(learner, rows: int):
    """Forests over large tables grow some trees at a time, as MLlib keeps a count per row and tree of a fit."""
    return ForestInParts(learner) if rows >= LARGE_FIT_ROWS and isinstance(learner, RandomForestClassifier) else learner


@contextmanager
def _a_file_per_task(df: DataFrame, rows: int) -> Iterator[None]:
    """The files of a large stored table are read by a task each, whatever the session's size of a split."""
    spark, name = df.sparkSession, "spark.sql.files.maxPartitionBytes"
    if rows < LARGE_FIT_ROWS:
        yield
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent()
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(f.getLen() for f in files)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _spread_to_fit(df: DataFrame, key: list[str], rows: int, features: int, learner) -> DataFrame:
    """The rows in as many partitions as a fit needs, so that what a task reads of them does not grow with the input."""
    parts = _fit_partitions(rows, features, learner)
    return df if rows >= LARGE_FIT_ROWS or parts <= df.sparkSession.sparkContext.defaultParallelism else _dealt(df, key, parts)


def _stored_for_fits(df: DataFrame, key: list[str], rows: int, features: int, learner) -> DataFrame:
    """The rows stored once for all fits, in files of one size.

    A fit reads its input several times before it keeps it. Its hundreds of rounds then wait for the largest partition, and partitions
    cut from whatever files the input came in differ several times in size, or leave most cores without rows.
    From LARGE_FIT_ROWS rows on they stay in their order, without the key, in files of what a task takes.
    """
    if rows >= LARGE_FIT_ROWS:
        return store(df.drop(*key), "fit-rows", FIT_TASK_BYTES // _fit_row_bytes(rows, features, learner))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return store(_dealt(df, key, cores) if rows >= EVEN_FIT_ROWS else df, "fit-rows")


def _fit_both(pipeline: Pipeline, first: DataFrame, second: DataFrame, together: bool) -> tuple[PipelineModel, PipelineModel]:
    """Both fits; at the same time if what they keep is small: a round's stages are short, and one fit's wait is the other's work."""
    if not together:
        return pipeline.fit(first), pipeline.fit(second)
    with ThreadPoolExecutor(2) as pool:
        fits = [pool.submit(inheritable_thread_target(first.sparkSession)(pipeline.fit), rows) for rows in (first, second)]
        return fits[0].result(), fits[1].result()


def train_classifier(df: DataFrame, label: str, key: list[str], *, features: list[str] | None = None, estimator=None,
                     max_iter: int = MAX_ITER, step: float = LEARNING_RATE, max_depth: int = 5, seed: int = SEED,
                     test_size: float = TEST_SIZE, label_map: dict[int, str] | None = None) -> dict:
    """Hold-out metrics from an exact stratified split, then a refit on all rows.

    Returns the fitted pipeline, its features, and the metrics, score quantiles
    and best threshold of the hold-out.  Any Spark ML estimator may replace the
    boosted trees; `label_map` names the classes and so tells which one is positive.
    The input is read several times: pass a stored table.
    """
    found = pick_column(df.columns, [label], "label")
    if found is None:
        raise ValueError(f"no label column {label}")
    features = features or infer_features(df, found)
    rows = feature_frame(df, features, found, [k for k in key])
    total = int(df.count())
    learner = estimator or GBTClassifier(labelCol="y", maxIter=max_iter, stepSize=step, maxDepth=max_depth, seed=seed)
    marked = _stored_for_fits(stratified_split(rows, "y", key, test_size, seed), key, total, len(features), learner)
    boosted = BoostedTrees(learner, [f"f{i}" for i in range(len(features))]) if estimator is None else None
    pipeline = Pipeline(stages=[_assembler(len(features)), boosted or _in_parts(learner, total)])
    spread = lambda d: _spread_to_fit(d, key, total, len(features), learner)
    together = total < LARGE_FIT_ROWS and _fit_partitions(total, len(features), learner) <= df.sparkSession.sparkContext.defaultParallelism
    with _a_file_per_task(marked, total):
        fitted, whole = _fit_both(pipeline, spread(marked.where(~F.col("is_test"))), spread(marked.drop("is_test")), together)
    positive = positive_index(_classes(fitted), label_map)
    scored = store(fitted.transform(marked.where("is_test")).select(
        (F.col("y") == positive).cast("int").alias("y"), (F.col("prediction") == positive).cast("int").alias("p"),
        positive_score(F.col("probability"), positive).alias("s")), "holdout")
    rates = with_rates(confusion_counts(scored, "y", "p")).crossJoin(curve_metrics(scored, "s", "y")).first()
    quantiles = {r["prob"]: r["quantile"] for r in exact_quantiles(scored, "s", QUANTILE_POINTS).collect()}
    metrics = {k: rates[k] for k in ("accuracy", "precision", "recall", "f1", "roc_auc") if rates[k] is not None}
    metrics.update(train_f1_weighted=rates["f1"], **({"val_auc": rates["roc_auc"]} if rates["roc_auc"] is not None else {}))
    return {"model": whole, "features": features, "metrics": metrics, "quantiles": quantiles,
            "threshold": quantiles.get(0.95), "samples": total, "holdout": scored}


def _classes(model: PipelineModel) -> list[int]:
    return list(range(getattr(model.stages[-1], "numClasses", 2)))


def training_fit_metrics(df: DataFrame, label: str, model: PipelineModel, features: list[str]) -> DataFrame:
    """F1 and AUC of a fitted model on the rows it was trained on."""
    scored = score_with(df, model, features, label=label)
    return with_rates(confusion_counts(scored, "y", "p")).select("f1").crossJoin(
        curve_metrics(scored, "s", "y").select(F.col("roc_auc").alias("auc")))


def score_with(df: DataFrame, model: PipelineModel, features: list[str], label: str | None = None,
               label_map: dict[int, str] | None = None) -> DataFrame:
    index = positive_index(_classes(model), label_map)
    out = model.transform(feature_frame(df, features, label))
    return out.select(*(["y"] if label else []), F.col("prediction").cast("int").alias("p"),
                      positive_score(F.col("probability"), index).alias("s"))


# ---------------------------------------------------------------------------
# Registry and ensemble
# ---------------------------------------------------------------------------
def weight_metric_name(name: str | None) -> str:
    token = str(name or "").strip().lower()
    return {"": "samples", "roc_auc": "auc", "f1_score": "f1", "sample_count": "samples", "rows": "samples"}.get(token, token)


def member_weight(metric: str, samples: Column, metrics: Column) -> Column:
    """Weight of a member: its metric if positive and finite, else its number of samples."""
    usable = [F.when((v > 0) & (v < float("inf")), v) for n in WEIGHT_METRICS.get(weight_metric_name(metric), [])
              for v in [F.try_element_at(metrics, F.lit(n))]]
    fallback = F.greatest(F.coalesce(samples, F.lit(1)), F.lit(1)).cast("double")
    return F.coalesce(*usable, fallback)


def registry_row(spark, trained: dict, model_path: str, *, weight_metric: str = "samples", profile: str = "baseline",
                 reset: bool = False, when: dt.datetime | None = None) -> DataFrame:
    """The registry record of a training run."""
    record = (uuid.uuid4().hex, when or dt.datetime.now(dt.timezone.utc), model_path, trained["features"], LABEL_MAP, 1, None,
              weight_metric_name(weight_metric), trained["samples"], {k: float(v) for k, v in trained["metrics"].items()},
              {float(k): float(v) for k, v in trained["quantiles"].items()}, trained["threshold"], 1.0, profile, reset)
    row = spark.createDataFrame([record], REGISTRY_SCHEMA)
    return row.withColumn("weight", member_weight(weight_metric, F.col("samples"), F.col("metrics")))


def ensemble_members(registry: DataFrame, max_members: int = MAX_MEMBERS, by: list[str] | None = None,
                     time: str = "trained_at", tie: str = "model_id") -> DataFrame:
    """The newest members since the last reset, with `age` 1 for the newest (registries are small tables)."""
    by = list(by or [])
    newest = Window.partitionBy(*by).orderBy(F.col(time).desc(), F.col(tie).desc())
    rows = registry.withColumn("age", F.row_number().over(newest))
    if "reset" in registry.columns:
        cut = F.min(F.when(F.col("reset"), F.col("age"))).over(Window.partitionBy(*by))
        rows = rows.withColumn("__cut", cut).where(F.col("__cut").isNull() | (F.col("age") <= F.col("__cut"))).drop("__cut")
    return rows.where(F.col("age") <= max(1, max_members))


def latest_model(registry: DataFrame) -> DataFrame:
    return registry.agg(F.max_by(F.struct(*[col(c) for c in registry.columns]), F.struct("trained_at", "model_id")).alias("m")).select("m.*")


def metrics_table(registry: DataFrame) -> DataFrame:
    """One row per training run and metric."""
    return registry.select("model_id", "trained_at", "samples", F.size("features").alias("n_features"),
                           F.explode("metrics").alias("metric", "value"))


def vote(members: list[tuple[Column, float | None]]) -> Column:
    """Weighted mean of the members' positive scores, each paired with 1 - score.

    A weight that is missing, not finite or not positive counts as 1; a row on
    which no member says anything gets 0.5.
    """
    weights = [w if w is not None and 0.0 < w < float("inf") else 1.0 for _, w in members]
    total = sum(weights)
    pos = sum((F.coalesce(c, F.lit(0.0)) * F.lit(w / total) for (c, _), w in zip(members, weights)), F.lit(0.0))
    neg = sum((F.coalesce(1.0 - c, F.lit(0.0)) * F.lit(w / total) for (c, _), w in zip(members, weights)), F.lit(0.0))
    return F.when(pos + neg > 0, pos / (pos + neg)).otherwise(F.lit(0.5))


def vote_classes(members: list[tuple[Column, list, float | None]], classes: list) -> Column:
    """Normalised class probabilities of members with different class lists (arrays of probabilities)."""
    weights = [w if w is not None and 0.0 < w < float("inf") else 1.0 for _, _, w in members]
    total = sum(weights)
    sums = []
    for cls in classes:
        parts = [F.coalesce(F.get(p, F.lit(own.index(cls))), F.lit(0.0)) * F.lit(w / total)
                 for (p, own, _), w in zip(members, weights) if cls in own]
        sums.append(sum(parts, F.lit(0.0)))
    whole = sum(sums, F.lit(0.0))
    return F.array(*[F.when(whole > 0, s / whole).otherwise(F.lit(1.0 / len(classes))) for s in sums])


class Ensemble:
    """Members of a registry applied together; scoring is a chain of column transformations.

    A member is (model, weight) or (model, weight, its own features); `features`
    stands for members without their own.  `label_map` names the classes and so
    tells which one is positive.
    """

    def __init__(self, members: list[tuple], features: list[str], label_map: dict[int, str] | None = None):
        self.members = [(m[0], m[1]) for m in members]
        self.member_features = [list(m[2]) if len(m) > 2 else list(features) for m in members]
        self.features = list(dict.fromkeys(c for own in self.member_features for c in own)) or list(features)
        self.label_map = label_map or LABEL_MAP

    @classmethod
    def load(cls, registry: DataFrame, max_members: int = MAX_MEMBERS) -> "Ensemble":
        rows = ensemble_members(registry, max_members).orderBy("age").collect()       # at most max_members rows
        return cls([(PipelineModel.load(r["model_path"]), r["weight"], r["features"]) for r in rows], list(rows[0]["features"]))

    def score(self, df: DataFrame, out: str = "malicious_score") -> DataFrame:
        """Add the positive score; every input column is kept."""
        # The caller's columns travel as one struct, so that their names cannot meet the models' own.
        data = df.select(F.struct(*[col(c) for c in df.columns]).alias("__row"), F.struct(
            *[number(df, c).alias(f"v{i}") for i, c in enumerate(self.features)]).alias("__v"))
        names = []
        for i, ((model, _), own) in enumerate(zip(self.members, self.member_features, strict=True)):
            name = f"__m{i}"
            inputs = {f"f{j}": F.col(f"__v.v{self.features.index(c)}") for j, c in enumerate(own)}
            data = model.transform(data.withColumns(inputs)).withColumn(
                name, positive_score(F.col("probability"), positive_index(_classes(model), self.label_map))).drop(
                *inputs, "features", "rawPrediction", "probability", "prediction")
            names.append(name)
        score = vote([(F.col(n), w) for n, (_, w) in zip(names, self.members)])
        return data.select("__row.*", score.alias(out))


def predict_flows(df: DataFrame, ensemble: Ensemble, order: list[str], *, metadata: dict | None = None,
                  profile: str | None = None, trigger_cap: float | None = None, slice_on: str | None = None) -> DataFrame:
    """Batch prediction: model score and label, rule score and reasons, fusion and the final decision."""
    missing = [c for c in ensemble.features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing[:8]}")
    settings = rule_settings(profile, metadata=metadata, trigger_cap=trigger_cap)
    scored = ensemble.score(df).withColumn("prediction", (F.col("malicious_score") > 0.5).cast("int"))
    scored = interpret_prediction(scored, "prediction", LABEL_MAP).withColumnRenamed("normalized_label", "prediction_label")
    flag = F.coalesce(F.col("status") == ANOMALOUS, F.col("malicious_score") >= 0.5)
    scored = scored.withColumns({"model_flag": flag.cast("int"), "model_status": F.when(flag, ANOMALOUS).otherwise(NORMAL)}).drop("status")
    ruled = score_rules(scored, settings, order=order, slice_on=slice_on, normalize_protocol=True, integral_ports=True)
    return final_decision(fuse_votes(ruled, settings), settings)


def score_captures(flows: DataFrame, ensemble: Ensemble, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """Model scores of extracted flows, and per capture how well the model's features are covered.

    Features are looked for under their aliases; one that is missing counts as 0. The report has flows, shared_features,
    coverage (share of the model's features that hold a number), missing_columns and warnings.
    """
    features = ensemble.features
    completed = add_alias_copies(flows, features)
    missing = [c for c in features if c not in completed.columns]
    shared = len(features) - len(missing)
    counted = with_coverage(completed, features).withColumns({c: F.lit(0.0) for c in missing})
    scored = ensemble.score(counted).select(*[col(c) for c in flows.columns], "malicious_score", "available_features", "missing_features")
    part = shared / max(1, len(features))
    about_columns = (F.lit(NO_SHARED_FEATURES) if features and not shared else
                     F.format_string(FEW_SHARED_FEATURES, F.lit(shared), F.lit(100.0 * part)) if part < LOW_COVERAGE else F.lit(None).cast("string"))
    about_values = F.when(about_columns.isNull() & (F.col("coverage") < LOW_COVERAGE), F.format_string(FEW_FILLED_FEATURES, 100.0 * F.col("coverage")))
    report = scored.groupBy(file).agg(
        F.count(F.lit(1)).alias("flows"), F.avg(F.col("available_features") / F.lit(max(1, len(features)))).alias("coverage"))
    return scored, report.select(
        file, "flows", F.lit(shared).alias("shared_features"), "coverage", F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"),
        F.array_compact(F.array(about_columns, about_values)).alias("warnings"))


def prediction_summary(predicted: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("prediction_status") == 1)
    return predicted.agg(F.count(F.lit(1)).alias("rows"), bad.alias("anomaly_count")).withColumns({
        "normal_count": F.col("rows") - F.col("anomaly_count"),
        "status_text": F.when(F.col("anomaly_count") > 0, ANOMALOUS).when(F.col("rows") > 0, NORMAL)})


def match_model(registry: DataFrame, columns: list[str], allowed: list[str] | None = None) -> DataFrame:
    """The model whose features are all at hand: fewest extra columns, then priority, then most features."""
    have = F.array(*[F.lit(c) for c in columns])
    free = F.array(*[F.lit(c) for c in [*META_COLUMNS, *(allowed or [])]])
    rows = registry.where(F.size(F.array_except("features", have)) == 0)
    rows = rows.withColumns({"extra_columns": F.size(F.array_except(F.array_except(have, F.col("features")), free)),
                             "n_features": F.size("features")})
    return rows.orderBy("extra_columns", "priority", F.col("n_features").desc(), "model_id").limit(1)


def shared_features(registry: DataFrame, columns: list[str]) -> DataFrame:
    """Per model: its features at hand (in model order) and those missing."""
    have = F.array(*[F.lit(c) for c in columns])
    return registry.select("model_id", F.array_intersect("features", have).alias("shared"), F.array_except("features", have).alias("missing"))


# ---------------------------------------------------------------------------
# Comparison models
# ---------------------------------------------------------------------------
def balanced_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Add `weight` = rows / (classes * rows of the class)."""
    sizes = df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()      # one row per class of a 0/1 label
    total = sum(r["n"] for r in sizes)
    weight = F.lit(1.0)
    for r in sizes:
        weight = F.when(F.col(y) == r[y], F.lit(total / (len(sizes) * r["n"]))).otherwise(weight)
    return df.withColumn("weight", weight)


def baseline_models(train: DataFrame, test: DataFrame, features: list[str], label: str, key: list[str], *, trees: int = 200,
                    seed: int = SEED) -> DataFrame:
    """F1, ROC AUC, FPR and top-1 % hit rate of a random forest and a logistic regression, class-balanced."""
    forest = RandomForestClassifier(labelCol="y", numTrees=trees, weightCol="weight", seed=seed)
    total = train.count()
    fit_rows = feature_frame(train, features, label, key)
    if total >= LARGE_FIT_ROWS:
        fit_rows = _stored_for_fits(fit_rows, key, total, len(features), forest)
    stored = fit_rows
    fit_rows = balanced_weights(_spread_to_fit(fit_rows, key, total, len(features), forest))
    test_rows = feature_frame(test, features, label, key)
    assembler = _assembler(len(features))
    stages = {
        "random_forest": [assembler, _in_parts(forest, total)],
        "logistic_regression": [assembler, StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                                LogisticRegression(featuresCol="scaled", labelCol="y", maxIter=2000, weightCol="weight")],
    }
    rows = None
    for name, steps in stages.items():
        with _a_file_per_task(stored, total):
            fitted = Pipeline(stages=steps).fit(fit_rows)
        scored = fitted.transform(test_rows).withColumn("s", positive_score(F.col("probability"), 1))
        part = variant_rows(scored.select("y", "s", *key), "y", {name: (F.col("s"), F.col("s") >= 0.5)}, key)
        rows = part if rows is None else rows.unionByName(part)
    return evaluate_variants(rows, key)


def standardized(df: DataFrame, features: list[str], reference: DataFrame | None = None) -> DataFrame:
    """Features minus mean over population deviation of `reference` (default: the input); constant ones only centred."""
    source = reference if reference is not None else df
    aggs = []
    for i, c in enumerate(features):
        v = col(c).cast("double")
        aggs += [F.avg(v).alias(f"__m{i}"), F.stddev_pop(v).alias(f"__s{i}")]
    stats = source.agg(*aggs)
    scaled = {c: (col(c).cast("double") - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") == 0, 1.0).otherwise(F.col(f"__s{i}"))
              for i, c in enumerate(features)}
    return df.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*[x for i in range(len(features)) for x in (f"__m{i}", f"__s{i}")])
