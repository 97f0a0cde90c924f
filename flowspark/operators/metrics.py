"""Evaluation: confusion counts, curves, ranking metrics, threshold search.

Every metric works on counts per distinct score, never on sorted rows, and
takes `by` columns, so that many files, variants or weight pairs are evaluated
in one pass. The counts are stored once (`step_table`); AUC, average precision, the cut at k,
hits and threshold counts are read from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from flowspark.functions.exprs import clip
from flowspark.operators.ordered import (
    SMALL_TABLE_ROWS, _attach_totals, descending, min_hot_rows, number_rows, previous_value, running_sums, slice_number)
from flowspark.session import store

HANDFUL = 1000        # rows of a summary that the driver may hold
GRID_STEPS = 1000     # fixed value: thresholds 0, 0.001, ..., 1

# Truth labels by name.
LABEL_VALUES = {"BENIGN": 0, "NORMAL": 0, "BENIGN/NEUTRAL": 0, "MALICIOUS": 1, "ATTACK": 1}
# Where to look for truth, first usable column wins.
TRUTH_CANDIDATES = ["LabelBinary", "Label", "label", "class", "ground_truth"]


def _div(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def f1_from(tp: Column, fp: Column, fn: Column) -> Column:
    return _div(2.0 * tp, 2 * tp + fp + fn)


def fpr_from(fp: Column, tn: Column) -> Column:
    return fp / (fp + tn + F.lit(1e-12))


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "prediction_status",
                     by: list[str] | None = None) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*(by or [])).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def confusion_table(df: DataFrame, label: str = "label", pred: str = "prediction_status") -> DataFrame:
    """Four rows: truth, predicted, count (zeros included)."""
    c = confusion_counts(df, label, pred)
    cells = [F.struct(F.lit(t).alias("truth"), F.lit(p).alias("predicted"), F.col(n).alias("count"))
             for t, p, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))]
    return c.select(F.inline(F.array(*cells)))


def with_rates(c: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and FPR from confusion counts; 0 where undefined."""
    tn, fp, fn, tp = (F.col(n) for n in ("tn", "fp", "fn", "tp"))
    return c.withColumns({
        "support": tn + fp + fn + tp,
        "accuracy": _div((tp + tn) * 1.0, tn + fp + fn + tp),
        "precision": _div(tp * 1.0, tp + fp), "recall": _div(tp * 1.0, tp + fn),
        "f1": f1_from(tp, fp, fn), "fpr": fpr_from(fp, tn),
    })


def truth_value(df: DataFrame, label: str) -> Column:
    """0/1 truth: names through the label table, numbers as they are; anything else null."""
    if isinstance(df.schema[label].dataType, T.StringType):
        mapping = F.create_map(*[F.lit(x) for kv in LABEL_VALUES.items() for x in kv])
        return F.try_element_at(mapping, F.col(f"`{label}`"))
    value = F.col(f"`{label}`").cast("double")
    return F.when(value.isin(0.0, 1.0), value.cast("int"))


def detection_metrics(df: DataFrame, label: str = "Label", pred: str = "prediction_status",
                      score: str | None = None, by: list[str] | None = None) -> DataFrame:
    """One row per group; only rows with 0/1 truth and 0/1 prediction count."""
    by = list(by or [])
    p = F.col(pred).try_cast("double")
    rows = df.select(*by, truth_value(df, label).alias("__y"), F.when(p.isin(0.0, 1.0), p.cast("int")).alias("__p"),
                     *([F.col(score).cast("double").alias("__s")] if score else []))
    rows = rows.where(F.col("__y").isNotNull() & F.col("__p").isNotNull())
    out = with_rates(confusion_counts(rows, "__y", "__p", by))
    if not score:
        return out.withColumn("auc", F.lit(None).cast("double"))
    curve = curve_metrics(rows.where(F.col("__s").isNotNull()), "__s", "__y", by).select(*by, F.col("roc_auc").alias("auc"))
    return out.join(curve, by, "left") if by else out.join(F.broadcast(curve), how="left")


def first_usable_truth(df: DataFrame, pred: str = "prediction_status", candidates: list[str] | None = None) -> str | None:
    """The first candidate with any row of 0/1 truth and 0/1 prediction (one 1-row pass over all of them)."""
    present = [c for c in (candidates or TRUTH_CANDIDATES) if c in df.columns]
    if not present or pred not in df.columns:
        return None
    p = F.col(pred).try_cast("double").isin(0.0, 1.0)
    row = df.agg(*[F.count_if(truth_value(df, c).isNotNull() & p).alias(f"c{i}") for i, c in enumerate(present)]).first()
    return next((c for i, c in enumerate(present) if row[i] > 0), None)


# ---------------------------------------------------------------------------
# Curves
# ---------------------------------------------------------------------------
def _counted_steps(df: DataFrame, score: str, label: str, by: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    value = F.col(score).cast("double")
    return df.where(value.isNotNull() & ~F.isnan(value)).groupBy(*by, value.alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"),
        *[c.alias(n) for n, c in (more or {}).items()])


def step_table(df: DataFrame, score: str, label: str, by: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    """Per group and distinct score: pos, neg and the sums in `more`, stored.

    Rows without a score (null or NaN) are left out; `scored` gives them one. The input is read
    once; curves, ranking cuts, hits and threshold counts all follow from this table.
    """
    return store(_counted_steps(df, score, label, by, more), "score-steps")


_RUNNING = {"tp": "pos", "fp": "neg"}


def _running(steps: DataFrame, by: list[str]) -> DataFrame:
    upto = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({n: F.sum(c).over(upto) for n, c in _RUNNING.items()})


def cumulated(steps: DataFrame, by: list[str]) -> DataFrame:
    """Steps of a stored table with tp and fp when everything at or above the score is called positive."""
    if steps.count() < min_hot_rows(steps):       # from the files' footers
        return _running(steps, by)
    return running_sums(steps, by, [F.col("score").desc()], -F.col("score"), {n: F.col(c) for n, c in _RUNNING.items()})


def score_steps(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Per distinct score: pos, neg, tp, fp."""
    by = list(by or [])
    return cumulated(step_table(df, score, label, by), by)


def scored(score: Column) -> Column:
    """The score with 0 where there is none (null or NaN)."""
    return F.coalesce(F.nanvl(score.cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def curve_metrics(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """positives, negatives, roc_auc (ties count half) and average_precision; null if a class is missing."""
    return _curves(df, score, label, list(by or []), df.count())


def _curves(df: DataFrame, score: str, label: str, by: list[str], most: int) -> DataFrame:
    """`curve_metrics` of groups of `most` rows at most."""
    if most >= min_hot_rows(df):
        return curve_of(score_steps(df, score, label, by), by)
    # No group is large, and the counts are read once: they need not be stored.
    return curve_of(_running(_counted_steps(df, score, label, by), by), by)


def curve_of(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`curve_metrics` of `score_steps`."""
    by = list(by or [])
    return steps.groupBy(*by).agg(*_curve_sums()).select(*by, *_curve_columns())


def curves_of(df: DataFrame, scores: dict[str, Column], label: str) -> DataFrame:
    """`curve_metrics` of several scores in one pass over the input, a row per `name`."""
    rows = df.select(F.col(label).alias("__y"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("name"), c.cast("double").alias("__s")) for n, c in scores.items()])))
    return _curves(rows, "__s", "__y", ["name"], df.count())


def _curve_sums() -> list[Column]:
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    precision = F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0))
    return [F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), area.alias("__a"), precision.alias("__p")]


def _curve_columns() -> list[Column]:
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return [F.col("positives"), F.col("negatives"),
            F.when(both, F.col("__a") / (F.col("positives") * F.col("negatives").cast("double"))).alias("roc_auc"),
            F.when(both, F.col("__p") / F.col("positives")).alias("average_precision")]


def roc_points(df: DataFrame, score: str, label: str, simplify: bool = True) -> DataFrame:
    """threshold, fpr, tpr from (inf, 0, 0) on; `simplify` leaves out points on a straight line."""
    return roc_of(score_steps(df, score, label), simplify)


def roc_of(steps: DataFrame, simplify: bool = True) -> DataFrame:
    """`roc_points` of `score_steps` without groups."""
    totals = steps.agg(F.sum("pos").alias("__P"), F.sum("neg").alias("__N"),
                       F.max("score").alias("__top"), F.min("score").alias("__low"))
    start = totals.select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    if simplify:
        steps = previous_value(steps, [], [F.col("score")], F.col("score"), F.struct("pos", "neg"), "__next")
    steps = steps.crossJoin(F.broadcast(totals))
    if simplify:
        bend = (F.col("__next.pos") != F.col("pos")) | (F.col("__next.neg") != F.col("neg"))
        steps = steps.where((F.col("score") == F.col("__top")) | (F.col("score") == F.col("__low")) | bend)
    points = steps.select(F.col("score").alias("threshold"), (F.col("fp") / F.col("__N")).alias("fpr"),
                          (F.col("tp") / F.col("__P")).alias("tpr"))
    return start.unionByName(points)


def pr_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, precision, recall per distinct score, and the end point (null, 1, 0)."""
    return pr_of(score_steps(df, score, label))


def pr_of(steps: DataFrame) -> DataFrame:
    """`pr_points` of `score_steps` without groups."""
    totals = steps.agg(F.sum("pos").alias("__P"))
    points = steps.crossJoin(F.broadcast(totals)).select(
        F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.col("__P")).alias("recall"))
    end = totals.select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def step_summary(steps: DataFrame, by: list[str], percent: float = 0.01, rounding: str = "floor",
                 more: dict[str, Column] | None = None) -> DataFrame:
    """Per group, stored: curve metrics, k = `percent` of the rows, and what the cut at k takes.

    `__above` are the positives of all scores taken whole, `__cut` is the score that is taken in part: `__take` rows
    of its `__tie_pos` and `__tie_neg`.
    """
    size = F.ceil if rounding == "ceil" else F.floor
    n = F.col("pos") + F.col("neg")
    totals = steps.groupBy(*by).agg(F.sum(n).alias("__n"), F.count(F.lit(1)).alias("__steps"))
    groups, largest = totals.agg(F.count(F.lit(1)), F.coalesce(F.max("__steps"), F.lit(0))).first()
    run = _running(steps, by) if largest < min_hot_rows(steps) else cumulated(steps, by)
    totals = totals.drop("__steps")
    few = groups <= SMALL_TABLE_ROWS      # a number a group
    if not by:
        run = run.crossJoin(F.broadcast(totals))
    elif few:
        run = run.join(F.broadcast(totals), by)
    else:
        run = _attach_totals(run, totals, by)
    run = run.withColumn("k", F.greatest(F.lit(1), size(F.col("__n") * F.lit(percent))).cast("long"))
    upto = F.col("tp") + F.col("fp")
    before = upto - n
    cut = F.struct(F.col("score").alias("score"), (F.col("k") - before).alias("take"), "pos", "neg")
    out = run.groupBy(*by).agg(
        *_curve_sums(), F.max("k").alias("k"), F.sum(F.when(upto <= F.col("k"), F.col("pos")).otherwise(0)).alias("__above"),
        F.max(F.when((before < F.col("k")) & (upto > F.col("k")), cut)).alias("__at"), *[c.alias(m) for m, c in (more or {}).items()])
    out = out.select(
        *by, *_curve_columns(), "k", "__above", F.col("__at.score").alias("__cut"), F.col("__at.take").alias("__take"),
        F.col("__at.pos").alias("__tie_pos"), F.col("__at.neg").alias("__tie_neg"), *(more or {}))
    if groups <= HANDFUL:
        return steps.sparkSession.createDataFrame(out.collect(), out.schema)
    return store(out, "step-summary")


def with_hits(summary: DataFrame, df: DataFrame, score: str, label: str, order: list[str], slice_on: str | None,
              ties: str, by: list[str], few_groups: bool) -> DataFrame:
    """`step_summary` with hits and hit_rate.

    Rows are looked at only where the score at the cut has both classes; these rows alone are put in order.
    """
    mixed = (F.col("__tie_pos") > 0) & (F.col("__tie_neg") > 0)
    tied, groups = summary.where(mixed).agg(F.max(F.col("__tie_pos") + F.col("__tie_neg")), F.count(F.lit(1))).first()
    partly = F.when(F.col("__tie_neg") == 0, F.col("__take")).otherwise(F.lit(0))
    if tied is not None:
        cut = summary.where(mixed).select(*by, "__cut", "__take")
        kept = [c for c in dict.fromkeys(order + ([slice_on] if slice_on else [])) if c not in by]
        rows = df.select(*by, F.col(score).cast("double").alias("__s"), F.col(label).alias("__y"), *[F.col(c) for c in kept])
        if not by:
            rows = rows.crossJoin(F.broadcast(cut))
        elif few_groups or groups <= SMALL_TABLE_ROWS:
            rows = rows.join(F.broadcast(cut), by)        # the cuts are two numbers a group
        else:
            rows = rows.join(cut, by)
        rows = rows.where(F.col("__s") == F.col("__cut"))
        ranking = [F.col(c).asc() if ties == "first" else F.col(c).desc() for c in order]
        if tied >= min_hot_rows(df):
            slicing = slice_number(rows, slice_on or order[0])
            rows = number_rows(rows, by, ranking, slicing if ties == "first" else descending(slicing), "__no")
        else:
            rows = rows.withColumn("__no", F.row_number().over(Window.partitionBy(*by).orderBy(*ranking)))
        taken = rows.where(F.col("__no") <= F.col("__take")).groupBy(*by).agg(F.sum("__y").alias("__taken"))
        summary = summary.join(taken, by, "left") if by else summary.join(F.broadcast(taken), how="left")
        partly = F.when(mixed, F.coalesce("__taken", F.lit(0))).otherwise(partly)
    hits = (F.coalesce("__above", F.lit(0)) + F.coalesce(partly, F.lit(0))).cast("long")
    return summary.withColumns({"hits": hits, "hit_rate": hits / F.col("k")})


def top_hit_rate(df: DataFrame, score: str, label: str, order: list[str], slice_on: str | None = None, *,
                 percent: float = 0.01, rounding: str = "floor", ties: str = "first",
                 by: list[str] | None = None, few_groups: bool = False) -> DataFrame:
    """Share of positives among the top `percent` of rows by score: columns k, hits, hit_rate.

    `ties` says which rows of the score at the cut are taken: "first" or "last" in row order.
    `few_groups` says that the groups are a fixed handful.
    """
    by = list(by or [])
    summary = step_summary(step_table(df, score, label, by), by, percent, rounding)
    return with_hits(summary, df, score, label, order, slice_on, ties, by, few_groups).select(*by, "k", "hits", "hit_rate")


# ---------------------------------------------------------------------------
# Threshold search
# ---------------------------------------------------------------------------
def grid_counts(df: DataFrame, score: str, label: str | None, by: list[str] | None = None) -> DataFrame:
    """Confusion counts for each of the 1001 grid thresholds (rows per group: 1001); without a label `df` is a step table."""
    by = list(by or [])
    step = 1.0 / GRID_STEPS
    s = F.col(score).cast("double")
    near = F.floor(s * GRID_STEPS)
    reached = (F.when((near + 1) * step <= s, near + 1).when(near * step > s, near - 1).otherwise(near))
    counted = df.groupBy(*by, F.least(F.lit(GRID_STEPS), reached).cast("int").alias("i")).agg(
        *([F.sum("pos").alias("pos"), F.sum("neg").alias("neg")] if label is None else
          [F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")]))
    totals = counted.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    grid = totals.select(*by, "P", "N", F.explode(F.sequence(F.lit(0), F.lit(GRID_STEPS))).alias("i"))
    joined = grid.join(counted, by + ["i"], "left")
    down = Window.partitionBy(*by).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tp, fp = F.coalesce(F.sum("pos").over(down), F.lit(0)), F.coalesce(F.sum("neg").over(down), F.lit(0))
    out = joined.select(*by, "i", (F.col("i") * F.lit(step)).alias("threshold"), "P", "N", tp.alias("tp"), fp.alias("fp"))
    return out.withColumns({"fn": F.col("P") - F.col("tp"), "tn": F.col("N") - F.col("fp")}).drop("P", "N")


def best_f1_threshold(df: DataFrame, score: str, label: str | None, fpr_cap: float | None = None,
                      by: list[str] | None = None) -> DataFrame:
    """Grid threshold with the highest F1 (the smallest one if tied), optionally with FPR <= cap.

    A group without an admissible threshold has no row.
    """
    return _best_f1(grid_counts(df, score, label, by), fpr_cap, list(by or []))


def _best_f1(grid: DataFrame, fpr_cap: float | None, by: list[str]) -> DataFrame:
    grid = grid.withColumns({"f1": f1_from(F.col("tp"), F.col("fp"), F.col("fn")), "fpr": fpr_from(F.col("fp"), F.col("tn"))})
    if fpr_cap is not None:
        grid = grid.where(F.col("fpr") <= fpr_cap)
    best = grid.groupBy(*by).agg(F.max_by(F.struct("threshold", "f1", "fpr"), F.struct("f1", -F.col("i"))).alias("b"))
    return best.where(F.col("b").isNotNull()).select(*by, "b.threshold", "b.f1", "b.fpr")


# ---------------------------------------------------------------------------
# Tables over several scores or decisions
# ---------------------------------------------------------------------------
def variant_rows(df: DataFrame, label: str, variants: dict[str, tuple[Column, Column]], order: list[str],
                 slice_on: str | None = None) -> DataFrame:
    """One narrow row per input row and (score, decision) pair."""
    keep = list(dict.fromkeys(order + ([slice_on] if slice_on else [])))
    parts = [F.struct(F.lit(name).alias("variant"), scored(s).alias("__score"), d.cast("int").alias("__pred"))
             for name, (s, d) in variants.items()]
    return df.select(F.col(label).cast("int").alias("__y"), *keep, F.inline(F.array(*parts)))


_CELLS = {"__tn": (0, 0), "__fp": (0, 1), "__fn": (1, 0), "__tp": (1, 1)}       # truth, decision


def _counted(cell: str) -> Column:
    truth, decision = _CELLS[cell]
    return F.count_if((F.col("__y") == truth) & (F.col("__pred") == decision))


def variant_steps(rows: DataFrame) -> DataFrame:
    """Step table of `variant_rows` output, with the confusion counts of the decisions at every score."""
    return step_table(rows, "__score", "__y", ["variant"], {n: _counted(n) for n in _CELLS})


def evaluate_variants(rows: DataFrame, order: list[str], slice_on: str | None = None, percent: float = 0.01) -> DataFrame:
    """F1, ROC AUC, FPR and top hit rate per variant of `variant_rows` output."""
    summary = step_summary(variant_steps(rows), ["variant"], percent, "ceil", {n: F.sum(n) for n in _CELLS})
    out = with_hits(summary, rows, "__score", "__y", order, slice_on, "last", ["variant"], True)
    tn, fp, fn, tp = (F.col(n) for n in _CELLS)
    return out.select("variant", f1_from(tp, fp, fn).alias("f1"), "roc_auc", fpr_from(fp, tn).alias("fpr"), "hit_rate")


def _system_scores() -> tuple[Column, Column, Column]:
    return (clip(F.col("malicious_score"), 0.0, 1.0), clip(F.col("rules_score") / 100.0, 0.0, 1.0),
            clip(F.col("fusion_score"), 0.0, 1.0))


def ablation_table(base: DataFrame, aggressive: DataFrame, label: str, order: list[str], slice_on: str | None = None, *,
                   model_threshold: float = 0.5, rule_threshold: float = 65.0) -> DataFrame:
    """Model only, rules only, fused baseline, fused aggressive.

    Both inputs hold malicious_score, rules_score, fusion_score, fusion_decision
    and the same rows.
    """
    model, rules, fused = _system_scores()
    rows = variant_rows(base, label, {
        "model": (model, model >= model_threshold),
        "rules": (rules, rules >= rule_threshold / 100.0),
        "fusion_baseline": (fused, F.col("fusion_decision")),
    }, order, slice_on).unionByName(
        variant_rows(aggressive, label, {"fusion_aggressive": (fused, F.col("fusion_decision"))}, order, slice_on))
    return evaluate_variants(rows, order, slice_on)


def calibrated_thresholds(steps: DataFrame, fpr_cap: float) -> dict[tuple[str, str], float]:
    """(variant, "best" | "capped") -> grid threshold, from a step table; a few rows to the driver."""
    grid = store(grid_counts(steps, "score", None, ["variant"]), "threshold-grid")
    best = _best_f1(grid, None, ["variant"]).withColumn("kind", F.lit("best"))
    capped = _best_f1(grid, fpr_cap, ["variant"]).withColumn("kind", F.lit("capped"))
    return {(r["variant"], r["kind"]): r["threshold"] for r in best.unionByName(capped).collect()}


def calibration_table(base: DataFrame, aggressive: DataFrame, label: str, order: list[str],
                      slice_on: str | None = None, fpr_cap: float = 0.2) -> DataFrame:
    """Fixed, best-F1 and FPR-bounded thresholds for the model and the fused score, and the system decisions.

    A variant without an admissible threshold is left out. Variants of one score share its steps: a threshold only
    changes which of them count as positive.
    """
    model, _, fused = _system_scores()
    rows = variant_rows(base, label, {"model": (model, model >= 0.5), "fusion": (fused, F.col("fusion_decision"))}, order, slice_on).unionByName(
        variant_rows(aggressive, label, {"fusion_aggressive": (fused, F.col("fusion_decision"))}, order, slice_on))
    steps = variant_steps(rows)
    found = calibrated_thresholds(steps, fpr_cap)
    variants = {"model_fixed": ("model", 0.5), "fusion_system": ("fusion", None), "fusion_aggressive": ("fusion_aggressive", None)}
    variants |= {f"{source}_{kind}": (source, t) for (source, kind), t in found.items() if source != "fusion_aggressive"}
    parts = []
    for name, (source, t) in variants.items():
        cells = [F.col(n) for n in _CELLS] if t is None else [
            F.when(high, F.col(c)).otherwise(0) for high, c in ((F.col("score") < t, "neg"), (F.col("score") >= t, "neg"),
                                                                (F.col("score") < t, "pos"), (F.col("score") >= t, "pos"))]
        mine = F.col("variant") == source
        sums = [F.coalesce(F.sum(F.when(mine, c)), F.lit(0)).alias(n) for n, c in zip(_CELLS, cells, strict=True)]
        parts.append(F.struct(F.lit(name).alias("name"), F.lit(source).alias("variant"), F.lit(t).cast("double").alias("threshold"), *sums))
    decided = steps.agg(F.array(*parts).alias("all")).select(F.inline("all"))
    summary = step_summary(steps, ["variant"], 0.01, "ceil")
    ranked = with_hits(summary, rows, "__score", "__y", order, slice_on, "last", ["variant"], True)
    tn, fp, fn, tp = (F.col(n) for n in _CELLS)
    return decided.join(F.broadcast(ranked), "variant").select(       # a row per score
        F.col("name").alias("variant"), f1_from(tp, fp, fn).alias("f1"), "roc_auc", fpr_from(fp, tn).alias("fpr"), "hit_rate", "threshold")


def evaluate_by_file(df: DataFrame, file: str, score: str, label: str, order: list[str], slice_on: str | None = None) -> DataFrame:
    """Rows, positives, share, ROC AUC, average precision and top-1 % hit rate of every file; no score counts as 0."""
    df = df.withColumn(score, scored(F.col(score)))
    y = F.col(label)
    steps = step_table(df, score, label, [file], {"rows": F.count(F.lit(1)), "labelled": F.count(y), "total": F.sum(y).cast("long")})
    summary = step_summary(steps, [file], more={"rows": F.sum("rows"), "share": F.sum("total") / F.sum("labelled"), "total": F.sum("total")})
    out = with_hits(summary, df, score, label, order, slice_on, "first", [file], False)
    return out.select(file, "rows", F.col("total").alias("positives"), "share", "roc_auc", "average_precision",
                      F.col("hit_rate").alias("top1_hit"), F.col("k").alias("top1_rows"))


def weight_sweep(df: DataFrame, label: str, model: str, rules: str, weights: list[tuple[float, float]],
                 threshold: float = 0.5, trigger: float = 60.0) -> DataFrame:
    """Fusion metrics for every (model, rule) weight pair in one pass."""
    m, r = clip(F.col(model), 0.0, 1.0), clip(F.col(rules) / 100.0, 0.0, 1.0)
    parts = [F.struct(F.lit(float(a)).alias("model_weight"), F.lit(float(b)).alias("rule_weight"),
                      (a * m + b * r >= threshold).cast("int").alias("__flag")) for a, b in weights]
    rows = df.select(F.col(label).alias("__y"), (F.col(rules) >= trigger).alias("__trig"), F.inline(F.array(*parts)))
    keys = ["model_weight", "rule_weight"]
    extra = rows.groupBy(*keys).agg(F.count_if("__trig").alias("rules_triggered"), F.sum("__flag").cast("long").alias("fused_positive"))
    c = with_rates(confusion_counts(rows, "__y", "__flag", keys))
    pos, neg = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    auc = F.when((pos > 0) & (neg > 0), (F.col("tp") / pos + F.col("tn") / neg) / 2.0)
    return c.withColumn("auc", auc).join(extra, keys).select(
        *keys, "accuracy", "precision", "recall", "f1", "auc", "rules_triggered", "fused_positive")


def minmax_scaled(df: DataFrame, score: str, name: str = "scaled") -> DataFrame:
    """(s - min) / (max - min + 1e-12) over the whole input."""
    ends = df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    scaled = (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(1e-12))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, scaled).drop("__lo", "__hi")


def label_mismatches(left: DataFrame, right: DataFrame, key: str, label: str) -> DataFrame:
    """Rows on either side only, and rows whose labels differ."""
    a = left.select(key, F.col(label).alias("__a"), F.lit(True).alias("__l"))
    b = right.select(key, F.col(label).alias("__b"), F.lit(True).alias("__r"))
    j = a.join(b, key, "full")
    return j.agg(F.count_if(F.col("__r").isNull()).alias("left_only"), F.count_if(F.col("__l").isNull()).alias("right_only"),
                 F.count_if(F.col("__l") & F.col("__r") & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("label_differs"))
