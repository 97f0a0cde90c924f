"""Schema alignment, coercion, labels and row status."""

from __future__ import annotations

import re
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.functions.exprs import col, finite_or_null, lower_text, number
from flowspark.operators.ordered import lookup_join, number_rows, slice_number
from flowspark.schema import FLOW_COLUMNS, HEADER_ALIASES, LABEL, LABEL_BINARY, NUMERIC_FEATURES, STRING_COLUMNS
from flowspark.session import store

ANOMALOUS, NORMAL = "异常", "正常"     # fixed values

# Words that name a class, per use.
TRUTH_BENIGN = ["benign", "normal", "0"]
EVALUATION_BENIGN = ["benign", "normal", "0", "false", "neg", "negative", "no", "none", "clean"]
EVALUATION_MALICIOUS = ["1", "true", "pos", "positive", "yes", "attack", "malicious", "anomaly", "abnormal", "intrusion"]
EVALUATION_MALICIOUS_PARTS = ["attack", "malicious", "anomal", "intrus"]
SAMPLING_BENIGN = ["benign", "normal", "0", "false", "neg", "negative", "clean"]
PREDICTION_ANOMALY = ["1", "-1", "attack", "anomaly", "anomalous", "malicious", "恶意", "异常", "是", "yes", "true"]
PREDICTION_NORMAL = ["0", "benign", "normal", "legit", "合法", "正常", "否", "no", "false"]
ROW_ANOMALY_HINTS = ["异常", "恶意", "malicious", "anomaly", "attack", "threat", "abnormal", "可疑", "suspect", "intrusion"]
ROW_NORMAL_HINTS = ["正常", "normal", "benign", "legit", "legitimate", "safe", "良性", "clean"]
SIMPLE_POSITIVE = ["1", "-1", "异常", "abnormal", "malicious", "anomaly", "threat"]
SIMPLE_NEGATIVE = ["0", "正常", "benign", "normal", "clean"]
EXPORT_STATUS = ["1", "true", "异常", "malicious", "anomaly", "attack"]
EXPORT_LABEL = ["异常", "恶意", "malicious", "anomaly", "attack"]
# Columns a prediction run adds.
PREDICTION_COLUMNS = [
    "prediction", "prediction_label", "prediction_status", "malicious_score", "anomaly_score", "anomaly_confidence",
    "vote_ratio", "risk_score", "is_malicious", "fusion_score", "fusion_decision", "model_status", "model_flag",
    "fusion_status", "manual_label",
]
# Columns never used as a feature when features are inferred.
NO_FEATURE = ["label", "labelbinary", "attack_cat", "attackcat", "class", "category"]
ID_COLUMNS = ["id", "index", "row_id"]
# Columns shown next to predictions, and generated ones, that never count as extra.
META_COLUMNS = ["Flow ID", "Source IP", "Destination IP", "Source Port", "Destination Port", "Protocol", "Timestamp"]
GENERATED_COLUMNS = [
    "label", "labels", "ground_truth", "attack", "attacks", "is_attack", "is_malicious", "malicious", "score",
    "is_anomaly", "prediction", "anomaly_score", "risk_score", "vote_ratio",
]
# Features some models expect under a second name.
MODEL_ALIAS_COPIES = {
    "Flow Duration": "dur", "Total Fwd Packets": "spkts", "Total Backward Packets": "dpkts",
    "Total Length of Fwd Packets": "sbytes", "Total Length of Bwd Packets": "dbytes",
}


# ---------------------------------------------------------------------------
# Headers and schema
# ---------------------------------------------------------------------------
def normalise_header(name: str) -> str:
    return "".join(ch for ch in name.strip().lower() if ch.isalnum())


def canonical_headers(columns: list[str]) -> list[str]:
    """Trimmed names, with known aliases replaced by the canonical column."""
    return [HEADER_ALIASES.get(normalise_header(c), c.strip()) for c in columns]


def rename_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*canonical_headers(df.columns))


def pick_column(columns: list[str], candidates: list[str], how: str = "exact") -> str | None:
    """First candidate present; "label" ignores case, blanks and BOM at the ends, "squashed" all white space."""
    if how == "exact":
        return next((c for c in candidates if c in columns), None)
    norm = {
        "label": lambda s: s.strip().lstrip("\ufeff").lower(),
        "squashed": lambda s: re.sub(r"[\ufeff\s]+", "", s.lower()),
    }[how]
    known = {norm(c): c for c in columns}
    return next((known[norm(c)] for c in candidates if norm(c) in known), None)


def add_alias_copies(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Copy columns so that a flow is found under canonical and alias names alike."""
    by_norm = {normalise_header(c): c for c in df.columns}
    new: dict[str, Column] = {}
    for name in features or []:
        canonical = HEADER_ALIASES.get(normalise_header(name))
        source = by_norm.get(normalise_header(canonical)) if canonical else None
        if source and name not in df.columns:
            new[name] = col(source)
    for alias, canonical in HEADER_ALIASES.items():
        source = by_norm.get(normalise_header(canonical))
        if source and alias not in df.columns and alias not in new:
            new[alias] = col(source)
    # A name differing from an existing column by case only would replace it.
    taken = {c.lower() for c in df.columns}
    return df.withColumns({k: v for k, v in new.items() if k.lower() not in taken or k in (features or [])}) if new else df


def align_schema(df: DataFrame) -> DataFrame:
    """The 85 columns in order: aliases applied, numbers coerced, missing ones 0 or blank."""
    df = rename_headers(df)
    present = set(df.columns)

    def value(name: str) -> Column:
        if name in STRING_COLUMNS or name == LABEL:
            return F.coalesce(col(name).cast("string"), F.lit("")) if name in present else F.lit("")
        return number(df, name) if name in present else F.lit(0.0)

    return df.select(*[value(c).alias(c) for c in FLOW_COLUMNS])


def label_binary(label: Column, mode: str = "lenient") -> Column:
    """0 where the label names BENIGN, else 1; in "strict" mode a blank label is null."""
    text = F.upper(F.coalesce(label.cast("string"), F.lit("")))
    flag = (~text.contains("BENIGN")).cast("int")
    return F.when(F.trim(text) != "", flag) if mode == "strict" else flag


def clean_training(df: DataFrame, features: list[str] | None = None, include_binary: bool = True,
                   mode: str = "lenient") -> DataFrame:
    """Numeric features (coerced, missing ones 0), `Label` and `LabelBinary`."""
    features = features or NUMERIC_FEATURES
    df = df.toDF(*[c.strip() for c in df.columns])
    if LABEL not in df.columns:
        raise ValueError("no Label column")
    out = [(number(df, c) if c in df.columns else F.lit(0.0)).alias(c) for c in features] + [col(LABEL)]
    if include_binary:
        out.append(label_binary(col(LABEL), mode).alias(LABEL_BINARY))
    return df.select(*out)


def infer_features(df: DataFrame, label: str) -> list[str]:
    """The known flow features if a third of them is present, else numeric columns that are no label or id."""
    present = [c for c in NUMERIC_FEATURES if c in df.columns]
    if len(present) >= max(5, len(NUMERIC_FEATURES) // 3):
        return present
    norm = lambda s: s.strip().lstrip("\ufeff").lower()
    drop = {norm(label), *NO_FEATURE}
    found = [f.name for f in df.schema.fields
             if isinstance(f.dataType, (T.NumericType, T.BooleanType))
             and norm(f.name) not in drop and f.name not in ID_COLUMNS]
    if not found:
        raise ValueError("no numeric feature column found")
    return found


def align_train_test(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the union of their numeric columns; missing, NaN and infinite values as 0."""
    numeric = lambda d: [f.name for f in d.schema.fields if isinstance(f.dataType, T.NumericType)]
    names = numeric(train) + [c for c in numeric(test) if c not in numeric(train)]

    def side(d):
        have = numeric(d)
        return d.select(*[
            (F.coalesce(finite_or_null(col(c).cast("double")), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c)
            for c in names])
    return side(train), side(test)


def align_to_model(df: DataFrame, features: list[str], *, fill: float = 0.0, fill_values: dict | None = None,
                   strict: bool = False, allow_extra: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Exactly the model's features in order, and what had to be filled or was ignored."""
    df = df.toDF(*[c.strip() for c in df.columns])
    renamed = canonical_headers(df.columns)
    wanted = set(features)
    aliased = len(set(renamed) & wanted) > len(set(df.columns) & wanted)
    if aliased:
        df = df.toDF(*renamed)
    copies = {t: col(s) for s, t in MODEL_ALIAS_COPIES.items()
              if t in wanted and t not in df.columns and s in df.columns}
    df = df.withColumns(copies) if copies else df
    missing = [c for c in features if c not in df.columns]
    ignored = [c for c in df.columns if c not in wanted]
    allowed = {*(allow_extra or []), *META_COLUMNS, *GENERATED_COLUMNS}
    extra = [c for c in ignored if c not in allowed and not c.startswith("__")
             and not c.lower().startswith("unnamed:")] if strict else []
    if strict and (missing or extra):
        raise ValueError(f"columns differ from training: missing {missing[:10]}, extra {extra[:10]}")
    values = fill_values or {}
    out = df.select(*[
        (number(df, c, "float") if c in df.columns else F.lit(float(values.get(c, fill))).cast("float")).alias(c)
        for c in features])
    return out, {"aliases_applied": aliased, "missing_filled": missing, "ignored_columns": ignored, "extra_columns": extra,
                 "missing_count": len(missing), "coverage": max(0.0, (len(features) - len(missing)) / max(len(features), 1))}


def with_coverage(df: DataFrame, features: list[str]) -> DataFrame:
    """Add per-row counts of model features that hold a number."""
    flags = [col(c).try_cast("double").isNotNull().cast("int") for c in features if c in df.columns]
    have = reduce(lambda a, b: a + b, flags) if flags else F.lit(0)
    return df.withColumn("available_features", have).withColumn(
        "missing_features", F.lit(len(features)) - F.col("available_features"))


def coverage_summary(df: DataFrame, features: list[str], low: float = 0.2) -> DataFrame:
    """Mean coverage of the input and whether it is too low to trust the result."""
    ratio = F.avg(F.col("available_features") / F.lit(max(len(features), 1)))
    return with_coverage(df, features).agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(features)).alias("feature_count"),
        F.coalesce(ratio, F.lit(0.0)).alias("coverage")).withColumn("low_coverage", F.col("coverage") < low)


def drop_predictions(df: DataFrame) -> DataFrame:
    """Remove what an earlier prediction run added."""
    return df.drop(*[c for c in PREDICTION_COLUMNS if c in df.columns])


def unsw_rule_inputs(df: DataFrame) -> DataFrame:
    """Protocol, duration and rates for tables with proto/dur/spkts/... columns."""
    have = set(df.columns)
    new: dict[str, Column] = {}
    num = lambda c: number(df, c)
    per_second = lambda total: F.when(num("dur") != 0, total / num("dur")).otherwise(0.0).cast("float")
    if "protocol" not in have and "proto" in have:
        new["protocol"] = col("proto").cast("string")
    if "flow_duration" not in have and "dur" in have:
        new["flow_duration"] = num("dur").cast("float")
    if "flow_pkts_per_s" not in have:
        if "rate" in have:
            new["flow_pkts_per_s"] = num("rate").cast("float")
        elif {"spkts", "dpkts", "dur"} <= have:
            new["flow_pkts_per_s"] = per_second(num("spkts") + num("dpkts"))
    if "flow_byts_per_s" not in have:
        if {"sbytes", "dbytes", "dur"} <= have:
            new["flow_byts_per_s"] = per_second(num("sbytes") + num("dbytes"))
        elif {"sload", "dload"} <= have:
            new["flow_byts_per_s"] = (num("sload") + num("dload")).cast("float")
    return df.withColumns(new) if new else df


# ---------------------------------------------------------------------------
# Labels
# ---------------------------------------------------------------------------
def _any_numeric(df: DataFrame, name: str) -> DataFrame:
    """Whether any value is a number; the text nan is none."""
    value = col(name).try_cast("double")
    return df.agg(F.coalesce(F.max(value.isNotNull() & ~F.isnan(value)), F.lit(False)).alias("__numeric"))


def any_numeric(df: DataFrame, name: str) -> bool:
    """`_any_numeric` asked at once: the first number found ends it, only a column without any is read whole."""
    value = col(name).try_cast("double")
    return not df.select(value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).isEmpty()


def binarize_truth(df: DataFrame, name: str, out: str = "truth", benign: list[str] | None = None,
                   benign_parts: list[str] | None = None, is_numeric: bool | None = None) -> DataFrame:
    """0/1 truth.  One parseable number anywhere makes the whole column numeric (> 0); otherwise words decide.

    `is_numeric` is `any_numeric` of the column where it is known; without it every use of the result reads the column for it.
    """
    text = lower_text(col(name))
    is_benign = text.isin(benign or TRUTH_BENIGN)
    for part in benign_parts or []:
        is_benign = is_benign | text.contains(part)
    words = ((text != "") & ~is_benign).cast("int")
    numeric = (number(df, name) > 0).cast("int")
    if is_numeric is not None:
        return df.withColumn(out, numeric if is_numeric else words)
    return df.crossJoin(F.broadcast(_any_numeric(df, name))).withColumn(
        out, F.when(F.col("__numeric"), numeric).otherwise(words)).drop("__numeric")


def is_benign(df: DataFrame, name: str, out: str = "benign") -> DataFrame:
    """Sampling's split into benign and attack rows (a blank label is attack)."""
    text = lower_text(col(name))
    words = text.isin(SAMPLING_BENIGN) | text.contains("benign") | text.contains("normal")
    return df.crossJoin(F.broadcast(_any_numeric(df, name))).withColumn(
        out, F.when(F.col("__numeric"), number(df, name) <= 0).otherwise(words)).drop("__numeric")


def binarize_prediction(df: DataFrame, name: str, out: str = "predicted") -> DataFrame:
    """0/1 prediction from booleans, numbers (> 0) or words."""
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return df.withColumn(out, F.coalesce(col(name), F.lit(False)).cast("int"))
    text = lower_text(col(name))
    benign = text.isin(EVALUATION_BENIGN) | text.contains("benign") | text.contains("normal")
    malicious = text.isin(EVALUATION_MALICIOUS)
    for part in EVALUATION_MALICIOUS_PARTS:
        malicious = malicious | text.contains(part)
    words = (malicious | (~benign & (text != ""))).cast("int")
    return df.crossJoin(F.broadcast(_any_numeric(df, name))).withColumn(
        out, F.when(F.col("__numeric"), (number(df, name) > 0).cast("int")).otherwise(words)).drop("__numeric")


def label_index(df: DataFrame, label: str, order: list[str], out: str = "label_index") -> tuple[DataFrame, DataFrame]:
    """Dense class index: integer labels are kept, others are numbered by first appearance.

    Returns the labelled rows with the index, and the mapping (index, label).
    Rows with a blank label are dropped.
    """
    rows = df.where(F.trim(F.coalesce(col(label).cast("string"), F.lit(""))) != "")
    firsts = rows.groupBy(F.trim(col(label).cast("string")).alias("__label")).agg(
        F.min(F.struct(*[col(c) for c in order])).alias("__first"))
    firsts = store(firsts.withColumn("__lead", F.col(f"__first.`{order[0]}`")), "labels")       # a row per label, read several times
    numbered = number_rows(firsts, [], [F.col("__first")], partial(slice_number, firsts, "__lead"), "__no", most=firsts.count())
    all_int = firsts.agg(F.min(F.col("__label").rlike(r"^[+-]?\d+$")).alias("__ints"))
    mapping = numbered.crossJoin(F.broadcast(all_int)).select(
        "__label", F.when(F.col("__ints"), F.col("__label").try_cast("long")).otherwise(F.col("__no") - 1).alias(out))
    keyed = rows.withColumn("__label", F.trim(col(label).cast("string")))
    return lookup_join(keyed, mapping, ["__label"]).drop("__label"), mapping.select(out, F.col("__label").alias("label"))


def label_statistics(df: DataFrame, label: str) -> DataFrame:
    """Total, labelled and dropped rows."""
    given = F.trim(F.coalesce(col(label).cast("string"), F.lit(""))) != ""
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(given).alias("labeled_rows"),
                  F.count_if(~given).alias("dropped_rows"))


def interpret_prediction(df: DataFrame, prediction: str, mapping: dict[int, str] | None = None) -> DataFrame:
    """Add `normalized_label` and `status` (anomalous / normal / null) of a predicted class."""
    value = col(prediction)
    is_text = isinstance(df.schema[prediction].dataType, T.StringType)
    text = value.cast("string")
    code = F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("int")) if is_text else value.cast("int")
    name = text
    if mapping:
        table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in (int(kv[0]), str(kv[1]))])
        mapped = F.try_element_at(table, code)
        name = F.coalesce(F.nullif(mapped, F.lit("")), text)
    word = F.lower(F.trim(name))
    status = (F.when(word.isin(PREDICTION_ANOMALY), ANOMALOUS).when(word.isin(PREDICTION_NORMAL), NORMAL)
              .when(code.isin(1, -1), ANOMALOUS).when(code == 0, NORMAL))
    return df.withColumns({"status": status, "normalized_label": F.coalesce(status, name)})


def prediction_status_counts(df: DataFrame, prediction: str, mapping: dict[int, str] | None = None) -> DataFrame:
    """Anomalous and normal rows and the overall status."""
    out = interpret_prediction(df, prediction, mapping).agg(
        F.count_if(F.col("status") == ANOMALOUS).alias("anomaly_count"),
        F.count_if(F.col("status") == NORMAL).alias("normal_count"), F.count(F.lit(1)).alias("rows"))
    return out.withColumn("status_text", F.when(F.col("anomaly_count") > 0, ANOMALOUS).when(F.col("rows") > 0, NORMAL))


def simple_predict(df: DataFrame, model: dict) -> DataFrame:
    """Threshold predictor: a given label wins over the score; adds prediction, prediction_status, is_malicious."""
    score_name = str(model.get("score_column") or model.get("score_col") or "malicious_score").strip()
    threshold = next((float(model[k]) for k in ("decision_threshold", "threshold", "score_threshold")
                      if model.get(k) is not None), 0.5)
    positive = str(model.get("positive_label") or model.get("positive_class") or "").strip().lower()
    mapping = {str(k): str(v) for k, v in (model.get("label_mapping") or {}).items()}
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else None
    look = lambda key: F.nullif(F.try_element_at(table, key), F.lit("")) if table is not None else F.lit(None).cast("string")

    score = number(df, score_name) if score_name in df.columns else F.lit(0.0)
    given = [F.nullif(col(c).cast("string"), F.lit("")) for c in ("prediction", "predicted_label", "label", "status") if c in df.columns]
    raw = F.trim(F.coalesce(*given)) if given else F.lit(None).cast("string")
    text = F.coalesce(look(raw), raw)
    word = F.lower(text)
    code = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))
    by_score = F.when(score >= threshold, ANOMALOUS).otherwise(NORMAL)
    result = F.when(F.coalesce(raw, F.lit("")) == "", by_score)
    if positive:
        result = result.when(word == positive, ANOMALOUS)
    result = (result.when(word.isin(SIMPLE_POSITIVE), ANOMALOUS).when(word.isin(SIMPLE_NEGATIVE), NORMAL)
              .when(look(code.cast("string")).isNotNull(), look(code.cast("string")))
              .when(code.isin(1, -1), ANOMALOUS).when(code == 0, NORMAL).otherwise(by_score))
    flag = (F.col("prediction") == ANOMALOUS).cast("int")
    return df.withColumns({"prediction": result, score_name: F.format_string("%.6f", score)}).withColumns(
        {"prediction_status": flag, "is_malicious": flag})


def abnormal_rows(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows flagged abnormal by the first column at hand that can tell."""
    have = set(df.columns)
    if "prediction_status" in have:
        c = col("prediction_status")
        keep = F.coalesce(c.try_cast("double") == 1, F.lit(False)) | lower_text(c).isin(EXPORT_STATUS)
    elif "prediction_label" in have:
        keep = lower_text(col("prediction_label")).isin(EXPORT_LABEL)
    elif "malicious_score" in have:
        keep = col("malicious_score").try_cast("double") >= threshold
    elif "prediction" in have:
        keep = col("prediction").isin(1, -1)
    elif "anomaly_score" in have:
        keep = col("anomaly_score") > 0
    else:
        raise ValueError("no column tells abnormal rows")
    return df.where(keep)


# ---------------------------------------------------------------------------
# Row status and messages
# ---------------------------------------------------------------------------
def _status_from_text(c: Column, anomaly: list[str], normal: list[str]) -> Column:
    word = lower_text(c)
    hit = lambda tokens: reduce(lambda a, b: a | b, (word.contains(t) for t in tokens))
    return F.when(word == "", None).when(hit(anomaly), ANOMALOUS).when(hit(normal), NORMAL)


def row_status(df: DataFrame, label: str | None = "prediction_label", prediction: str | None = "prediction", *,
               positive_tokens: list[str] | None = None, positive_classes: list[int] | None = None,
               out: str = "row_status") -> DataFrame:
    """Status by hints inside the label or prediction text, then by positive labels, then by class codes."""
    names = [n for n in (label, prediction) if n and n in df.columns]
    tokens = [t.strip().lower() for t in positive_tokens or [] if t.strip()]
    classes = [int(c) for c in positive_classes or []]
    checks = [_status_from_text(col(n), ROW_ANOMALY_HINTS, ROW_NORMAL_HINTS) for n in names]
    checks += [F.when(lower_text(col(n)).isin([*ROW_ANOMALY_HINTS, *tokens]), ANOMALOUS) for n in names]
    if classes:
        for n in reversed(names):
            value = col(n).try_cast("double")
            whole = F.when(F.abs(value - F.round(value)) < 1e-6, F.round(value).try_cast("int"))
            checks.append(F.when(whole.isin(classes), ANOMALOUS).when(whole.isNotNull(), NORMAL))
    return df.withColumn(out, F.coalesce(*checks))


# Columns that may name a row, best first.
IDENTIFIERS = ["flow_id", "__source_file__", "__source_path__", "pcap_file", "pcap_name", "file_name",
               "src_ip", "dst_ip", "src_port", "dst_port"]


def row_messages(df: DataFrame, row_number: str | None = None, out: str = "message") -> DataFrame:
    """One line per row: status, identity, prediction, score and rule note."""
    have = set(df.columns)
    text = lambda n: F.nullif(F.trim(col(n).cast("string")), F.lit(""))
    names = [F.concat(F.lit(f"{n}="), text(n)) for n in IDENTIFIERS if n in have]
    fallback = F.concat(F.lit("第"), col(row_number).cast("string"), F.lit("行")) if row_number else F.lit("第?行")
    identity = F.coalesce(*names, fallback)
    status = F.lit(None).cast("string")
    if "prediction_status" in have:
        if isinstance(df.schema["prediction_status"].dataType, T.StringType):
            status = text("prediction_status")
        else:
            status = F.when(col("prediction_status").cast("int") != 0, ANOMALOUS).when(col("prediction_status").isNotNull(), NORMAL)
    prefix = F.coalesce(F.concat(F.lit("["), status, F.lit("] ")), F.lit(""))
    labels = [text(n) for n in ("prediction_label", "prediction") if n in have]
    label = F.coalesce(*labels, F.lit("None")) if labels else F.lit("None")
    scores = [col(n).try_cast("double") for n in ("malicious_score", "anomaly_score") if n in have]
    score = F.nanvl(F.coalesce(*scores), F.lit(None).cast("double")) if scores else F.lit(None).cast("double")
    score_text = F.when(score.isNull(), "").otherwise(F.format_string(" 分数=%.4f", score))
    note = F.lit("")
    trigger = next((n for n in ("rules_triggered", "rule_triggered") if n in have), None)
    if trigger:
        points = F.format_string(" 规则分=%.1f", col("rules_score").cast("double")) if "rules_score" in have else F.lit("")
        reason = text("rules_reasons") if "rules_reasons" in have else F.lit(None).cast("string")
        note = F.when(F.coalesce(col(trigger).cast("int"), F.lit(0)) != 0, F.when(
            reason.isNotNull(), F.concat(F.lit(" [规则]"), reason, points)).otherwise(F.concat(F.lit(" [规则命中]"), points))).otherwise("")
    return df.withColumn(out, F.concat(prefix, identity, F.lit(" -> 预测="), label, score_text, note))
