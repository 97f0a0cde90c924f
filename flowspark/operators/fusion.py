"""Model and rule scores fused into a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.exprs import clip, sigmoid
from flowspark.operators.ordered import exact_quantiles
from flowspark.operators.rules import RuleSettings, rule_settings

# Share of the total weight at high and low model confidence, as (model, rules).
CONFIDENCE_SPLIT = {
    "baseline": {"high": (0.9, 0.1), "low": (0.7, 0.3)},
    "aggressive": {"high": (0.45, 0.55), "low": (0.25, 0.75)},
}
HIGH_CONFIDENCE = 0.8        # fixed value
STRONG_RULE_SCORE = 80.0     # fixed value


def model_confidence(score: Column) -> Column:
    p = clip(score, 0.0, 1.0)
    return F.greatest(p, 1.0 - p)


def fused_score(model: Column, rules: Column, settings: RuleSettings, confidence: Column | None = None) -> Column:
    """Weighted sum of model score (0-1) and rule score (0-100).

    Without confidence the configured weights apply.  With it only their sum
    does: how it is split depends on the profile and on whether the model is sure.
    """
    m, r = clip(model, 0.0, 1.0), clip(rules / 100.0, 0.0, 1.0)
    if confidence is None:
        return settings.model_weight * m + settings.rule_weight * r
    total = settings.model_weight + settings.rule_weight
    if not 0.0 < total < float("inf"):
        total = 1.0
    split = CONFIDENCE_SPLIT["aggressive" if settings.aggressive else "baseline"]
    weigh = lambda pair: total * pair[0] * m + total * pair[1] * r
    return F.when(clip(confidence, 0.0, 1.0) >= HIGH_CONFIDENCE, weigh(split["high"])).otherwise(weigh(split["low"]))


def fuse_votes(df: DataFrame, settings: RuleSettings | None = None, *, model: str = "malicious_score",
               rules: str = "rules_score", confidence: str | Column | None = "auto") -> DataFrame:
    """Add `fusion_score`, `fusion_decision` (0/1) and `rules_triggered`.

    `confidence` is a column, "auto" (from the model score) or None (plain weights).
    """
    settings = settings or rule_settings()
    m = F.coalesce(F.col(model).cast("double"), F.lit(0.0))
    r = F.coalesce(F.col(rules).cast("double"), F.lit(0.0))
    sure = confidence
    if isinstance(confidence, str):
        sure = model_confidence(m) if confidence == "auto" else F.col(confidence)
    df = df.withColumns({"fusion_score": fused_score(m, r, settings, sure),
                         "rules_triggered": r >= settings.trigger_threshold})
    decision = F.col("fusion_score") >= settings.fusion_threshold
    if settings.mode.startswith("aggr"):
        decision = decision | F.col("rules_triggered")
    return df.withColumn("fusion_decision", decision.cast("int"))


def final_decision(df: DataFrame, settings: RuleSettings | None = None, rules: str = "rules_score") -> DataFrame:
    """Add `prediction_status`, `fusion_status` and `rules_flag` after `fuse_votes`."""
    settings = settings or rule_settings()
    flag = F.col("fusion_score") >= settings.fusion_threshold
    if settings.profile == "aggressive":
        flag = flag | (F.col(rules) >= STRONG_RULE_SCORE) | F.col("rules_triggered")
    return df.withColumns({
        "prediction_status": flag.cast("int"),
        "fusion_status": F.when(flag, "异常").otherwise("正常"),
        "rules_flag": F.col("rules_triggered").cast("int"),
    })


def vote_risk(df: DataFrame, score: str = "anomaly_score", vote: str = "vote_ratio", *,
              threshold: float | None = None, vote_threshold: float | None = None,
              score_std: float | None = None) -> DataFrame:
    """Add `risk_score` from an anomaly score (small = bad) and a vote ratio.

    Missing settings come from the data: the 5 % quantile, the mean vote, the
    population deviation.
    """
    s, v = F.col(score).cast("double"), F.col(vote).cast("double")
    limits = df.agg(F.avg(v).alias("__vote"), F.stddev_pop(s).alias("__std"))
    if threshold is None:
        cut = exact_quantiles(df, score, [0.05]).select(F.col("quantile").alias("__cut"))
        limits = limits.join(F.broadcast(cut), how="left")
    else:
        limits = limits.withColumn("__cut", F.lit(float(threshold)))
    if vote_threshold is not None:
        limits = limits.withColumn("__vote", F.lit(float(vote_threshold)))
    if score_std is not None:
        limits = limits.withColumn("__std", F.lit(float(score_std)))
    limits = limits.select("__cut", clip(F.coalesce("__vote", F.lit(0.5)), 0.0, 1.0).alias("__vote"),
                           F.when(F.coalesce("__std", F.lit(0.0)) == 0, 1.0).otherwise(F.col("__std")).alias("__std"))
    from_score = sigmoid((F.col("__cut") - s) / (F.col("__std") + 1e-6))
    from_vote = clip((v - F.col("__vote")) / F.greatest(F.lit(1e-6), 1.0 - F.col("__vote")), 0.0, 1.0)
    risk = clip(0.6 * from_score + 0.4 * from_vote, 0.0, 1.0)
    return df.crossJoin(F.broadcast(limits)).withColumn("risk_score", risk).drop("__cut", "__vote", "__std")
