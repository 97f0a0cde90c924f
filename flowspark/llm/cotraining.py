"""Quality classifier by co-training two views, with Spark ML.

The text view sees a document's words (hashed) and its character statistics; the
page view sees its metadata: source, language, length and number of lines. Both are logistic
regressions. In each round either view labels the pool documents it is sure of, for
the other view to learn from. Each view is then calibrated on labelled documents that
neither was trained on, and the calibrated log-odds, less the prior that both hold,
are added up to the score. A view that knows nothing ends near the prior and moves nothing.

Fitting takes a bounded sample of about `MAX_LABELLED` labelled documents, half of it for either class, which weights put
right again, and the share `POOL_SHARE` of all other documents as the pool, both by hash of the id. The models are fitted by
tree aggregation over the stored features. Scoring is one pass over all documents in the JVM, without a shuffle.

Defined cases: a null or empty text has no words, null metadata is a value of its own; a null id has
no label; several labels of a document are averaged; without labelled documents, or
if they are of one class, every score is the smoothed share of good labels; the only labelled document of a class
serves training and calibration; repeated rows
are scored one by one; an empty table stays empty; only the named columns are read,
and a missing metadata column counts as null.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import SPACE_RUN, ascii_lower, save, split_words, whole

MAX_LABELLED = 20_000
POOL_SHARE = 0.25         # of the corpus
ROUNDS = 2
SURE = 0.97               # calibrated probability from which a view labels the pool
WORD_SLOTS = 1 << 13
META_SLOTS = 1 << 8
KEEP = 0.5
VIEWS = ("content", "meta")


def _share(text: Column, others: str, size: Column) -> Column:
    """Share of the characters that remain when runs of the class `others` go."""
    return F.char_length(F.regexp_replace(text, others, "")) / F.greatest(size, F.lit(1))


def with_views(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` and the feature vectors `content` and `meta`."""
    def column(name):
        return F.col(name) if name in docs.columns else F.lit(None).cast("string")
    body = F.col("__text")
    rows = docs.select(*keep, whole(text).alias("__text"), column("source").cast("string").alias("__source"),
                       column("lang").cast("string").alias("__lang"))
    size = F.char_length(body)
    rows = rows.withColumns({
        "__words": split_words(ascii_lower(body), SPACE_RUN),
        "__upper": _share(body, "[^A-Z]+", size), "__symbols": _share(body, r"[^#*$%&|<>{}\[\]=~^_@+\\/]+", size),
        "__bangs": _share(body, "[^!?]+", size), "__digits": _share(body, "[^0-9]+", size),
        "__size": F.log1p(size), "__breaks": F.log1p(F.char_length(F.regexp_replace(body, "[^\n]+", ""))),
        "__meta": F.array(F.concat(F.lit("source="), F.coalesce("__source", F.lit("?"))), F.concat(F.lit("lang="), F.coalesce("__lang", F.lit("?")))),
    })
    rows = rows.withColumn("__mean", F.col("__size") * 0 + size / F.greatest(F.size("__words"), F.lit(1)) / 10)
    rows = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=WORD_SLOTS).transform(rows)
    rows = Normalizer(inputCol="__counts", outputCol="__unit").transform(rows)
    rows = HashingTF(inputCol="__meta", outputCol="__slots", numFeatures=META_SLOTS, binary=True).transform(rows)
    rows = VectorAssembler(inputCols=["__unit", "__upper", "__symbols", "__bangs", "__digits", "__mean"], outputCol="content").transform(rows)
    rows = VectorAssembler(inputCols=["__slots", "__size", "__breaks"], outputCol="meta").transform(rows)
    return rows.select(*keep, *VIEWS)


def _spot(column: str, seed: int) -> Column:
    """A number in [0, 1) by hash."""
    return F.pmod(F.xxhash64(F.col(column), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)


def _fit(rows: DataFrame, features: str):
    return LogisticRegression(featuresCol=features, labelCol="label", weightCol="weight", maxIter=15, regParam=1e-3,
                              rawPredictionCol="raw", probabilityCol="p", predictionCol="guess").fit(rows)


def _log_odds(rows: DataFrame, model, view: str) -> DataFrame:
    """`rows` with the model's margin in `<view>_margin`."""
    return model.transform(rows).withColumn(f"{view}_margin", vector_to_array("raw")[1]).drop("raw", "p", "guess")


def _calibration(rows: DataFrame, view: str) -> tuple[float, float]:
    """(slope, intercept) that turn a margin into log-odds."""
    one = VectorAssembler(inputCols=[f"{view}_margin"], outputCol="margin").transform(rows)
    model = LogisticRegression(featuresCol="margin", labelCol="label", weightCol="weight", maxIter=10, regParam=1e-4).fit(one)
    return float(model.coefficients[0]), float(model.intercept)


class CoTrained:
    """Two models with their calibrations; `fit` makes one, `score` applies it."""

    def __init__(self, prior: float, models: dict | None = None, lines: dict | None = None):
        self.prior, self.models, self.lines = prior, models or {}, lines or {}

    def score(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """Columns `keep`, `content_score`, `meta_score` and `score` (probabilities of good quality)."""
        base = math.log(self.prior / (1 - self.prior))
        if not self.models:
            return docs.select(*keep, *[F.lit(self.prior).alias(c) for c in ("content_score", "meta_score", "score")])
        rows = with_views(docs, keep, text)
        for view in VIEWS:
            rows = _log_odds(rows, self.models[view], view)
        odds = {v: F.lit(self.lines[v][0]) * F.col(f"{v}_margin") + F.lit(self.lines[v][1]) for v in VIEWS}
        def chance(x):
            return 1 / (1 + F.exp(-x))
        return rows.select(*keep, chance(odds["content"]).alias("content_score"), chance(odds["meta"]).alias("meta_score"),
                           chance(odds["content"] + odds["meta"] - F.lit(base)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", text: str = "text",
        max_labelled: int = MAX_LABELLED, pool_share: float = POOL_SHARE, rounds: int = ROUNDS) -> CoTrained:
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(
        (F.avg(F.col(label).cast("double")) >= 0.5).cast("double").alias("label"))
    n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    prior = (good + 1) / (n + 2)
    if n == 0 or good in (0, n):
        return CoTrained(prior)
    share = F.when(F.col("label") == 1, min(1.0, max_labelled / 2 / good)).otherwise(min(1.0, max_labelled / 2 / (n - good)))
    known = known.withColumn("weight", 1 / share).where(_spot("__id", 1) < share)       # about max_labelled rows at most
    picked = docs.join(F.broadcast(known), F.col(doc_id) == F.col("__id"), "left").drop("__id").where(
        F.col("label").isNotNull() | (_spot(doc_id, 2) < F.lit(pool_share)))
    picked = picked.withColumns({"__spot": F.xxhash64(doc_id, F.lit(3)), "weight": F.coalesce("weight", F.lit(1.0))})
    columns = ["label", "weight", *VIEWS]
    sample = save(with_views(picked, ["__spot", "label", "weight"], text), "cotraining-sample")
    # A quarter of each class calibrates, by rank within the bounded sample, so that no class can miss a fold.
    of_class = Window.partitionBy("label")
    ranked = sample.where(F.col("label").isNotNull()).withColumns({
        "__rank": F.row_number().over(of_class.orderBy("__spot")), "__size": F.count(F.lit(1)).over(of_class)})
    checked = ranked.where(F.col("__rank") % 4 == 1).select(*columns)
    train = ranked.where((F.col("__rank") % 4 != 1) | (F.col("__size") == 1)).select(*columns)
    pool = sample.where(F.col("label").isNull()).select(*columns)
    if checked.select("label").distinct().count() < 2:      # the labelled documents at hand are of one class
        return CoTrained(prior)

    taught = {view: train for view in VIEWS}
    models, lines = {}, {}
    for turn in range(rounds + 1):
        for view in VIEWS:
            models[view] = _fit(taught[view], view)
            lines[view] = _calibration(_log_odds(checked, models[view], view), view)
        if turn == rounds:
            break
        sure = math.log(SURE / (1 - SURE))
        for view, other in (VIEWS, VIEWS[::-1]):
            odds = F.lit(lines[other][0]) * F.col(f"{other}_margin") + F.lit(lines[other][1])
            told = _log_odds(pool, models[other], other).withColumn("label", (odds > 0).cast("double")).where(F.abs(odds) > sure)
            taught[view] = train.unionByName(told.select(*columns))
    return CoTrained(prior, models, lines)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(doc_id, content_score, meta_score, score, kept): a row per row of `docs`."""
    model = fit(docs, labels, doc_id=doc_id, text=text, **settings)
    rows = model.score(docs.withColumn("__doc", F.col(doc_id)), ["__doc"], text).withColumnRenamed("__doc", "doc_id")
    return rows.withColumn("kept", F.col("score") >= KEEP)
