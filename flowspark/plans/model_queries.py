"""Model, ensemble and neighbour queries and their SQL twins."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from flowspark.operators import model as mo
from flowspark.operators import neighbours as ne
from flowspark.operators.metrics import confusion_counts, with_rates
from flowspark.operators.rules import rule_settings
from flowspark.operators.sample import stratified_split
from flowspark.plans.adapters import FLOWS_SQL, RESULTS_SQL, epoch_us, flows_from_lineitem, results_from_lineitem
from flowspark.plans.registry import query, table
from flowspark.plans.rule_queries import scored_sql
from flowspark.session import store

W = "WITH " + RESULTS_SQL
FEATURES = ["flow_duration", "flow_pkts_per_s", "flow_byts_per_s", "packet_length_mean", "min_packet_length",
            "total_fwd_pkts", "total_bwd_pkts", "syn_flag_count"]


@query("ensemble_vote_formula", W + """, m AS (SELECT row_id, malicious_score AS a, fine_score AS b, CASE WHEN rules_score > 90 THEN NULL ELSE rules_score / 100 END AS c FROM results),
s AS (SELECT row_id, (3 * a + 0.5::DOUBLE * b + coalesce(c, 0)) / 4.5::DOUBLE AS p, (3 * (1 - a) + 0.5::DOUBLE * (1 - b) + coalesce(1 - c, 0)) / 4.5::DOUBLE AS n FROM m)
SELECT row_id, round(p / (p + n), 9) AS score, CAST(p / (p + n) > 0.5::DOUBLE AS INTEGER) AS prediction FROM s""")
def ensemble_vote_formula(spark, sf_dir):
    """Weighted soft vote of three members; a bad weight counts as one."""
    rows = results_from_lineitem(spark, sf_dir).withColumn("c", F.when(F.col("rules_score") <= 90, F.col("rules_score") / 100))
    score = mo.vote([(F.col("malicious_score"), 3.0), (F.col("fine_score"), 0.5), (F.col("c"), -2.0)])
    return rows.withColumn("s", score).select("row_id", F.round("s", 9).alias("score"), (F.col("s") > 0.5).cast("int").alias("prediction"))


@query("ensemble_class_alignment", W + """, p AS (SELECT row_id, (2 * malicious_score) / 3 AS c0, (2 * (1 - malicious_score) + fine_score) / 3 AS c1, (1 - fine_score) / 3 AS c2 FROM results)
SELECT row_id, round(c0 / (c0 + c1 + c2), 9) AS p_scan, round(c1 / (c0 + c1 + c2), 9) AS p_benign, round(c2 / (c0 + c1 + c2), 9) AS p_dos FROM p""")
def ensemble_class_alignment(spark, sf_dir):
    """Members trained on different classes vote over the union of classes."""
    a = F.array(F.col("malicious_score"), 1 - F.col("malicious_score"))
    b = F.array(F.col("fine_score"), 1 - F.col("fine_score"))
    probs = mo.vote_classes([(a, ["scan", "benign"], 2.0), (b, ["benign", "dos"], 1.0)], ["scan", "benign", "dos"])
    rows = results_from_lineitem(spark, sf_dir).withColumn("p", probs)
    return rows.select("row_id", *[F.round(F.col("p")[i], 9).alias(n) for i, n in enumerate(("p_scan", "p_benign", "p_dos"))])


@query("ensemble_retention", """WITH m AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE greatest(s_suppkey, 1) END::DOUBLE AS weight,
  row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS age FROM supplier) SELECT s_nationkey, s_suppkey, weight, age FROM m WHERE age <= 3""")
def ensemble_retention(spark, sf_dir):
    """Newest members per model tag with their weights."""
    rows = table(spark, sf_dir, "supplier").withColumn("metrics", F.create_map(F.lit("train_f1"), F.col("s_acctbal")))
    rows = rows.withColumn("weight", mo.member_weight("f1_score", F.col("s_suppkey"), F.col("metrics")))
    out = mo.ensemble_members(rows, 3, ["s_nationkey"], time="s_suppkey", tie="s_name")
    return out.select("s_nationkey", "s_suppkey", "weight", "age")


_ALL = ["flow_id", "malicious_score", "fine_score", "rules_score", "label", "l_quantity", "missing_one"]


@query("model_match", """WITH f(i, name) AS (VALUES (0, 'flow_id'), (1, 'malicious_score'), (2, 'fine_score'), (3, 'rules_score'), (4, 'label'), (5, 'l_quantity'), (6, 'missing_one')),
r AS (SELECT p_partkey, p_size, count(*) AS n_features, bool_or(name = 'missing_one') AS absent FROM part JOIN f ON (p_partkey // (2 ** i)::BIGINT) % 2 = 1 GROUP BY ALL)
SELECT p_partkey AS model_id, CAST(14 - n_features AS INTEGER) AS extra_columns, CAST(n_features AS INTEGER) AS n_features FROM r WHERE NOT absent ORDER BY 14 - n_features, p_size, n_features DESC, p_partkey LIMIT 1""")
def model_match(spark, sf_dir):
    """Best model for the columns at hand."""
    bits = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(_ALL)]),
                    lambda f: F.pmod(F.floor(F.col("p_partkey") / F.pow(F.lit(2), f["i"])), F.lit(2)) == 1)
    registry = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("model_id"), F.col("p_size").alias("priority"), F.transform(bits, lambda f: f["n"]).alias("features"))
    columns = results_from_lineitem(spark, sf_dir).columns
    return mo.match_model(registry, columns).select("model_id", "extra_columns", "n_features")


@query("training_run_metrics", """SELECT s_suppkey AS model_id, CAST(2 AS INTEGER) AS n_features, metric, CASE metric WHEN 'f1' THEN s_acctbal ELSE s_acctbal / 2 END AS value
FROM supplier, (VALUES ('f1'), ('roc_auc')) m(metric)""")
def training_run_metrics(spark, sf_dir):
    """Metrics of every training run as rows."""
    registry = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("model_id"), F.col("s_name").alias("trained_at"), F.col("s_suppkey").alias("samples"), F.array(F.lit("a"), F.lit("b")).alias("features"),
        F.create_map(F.lit("f1"), F.col("s_acctbal"), F.lit("roc_auc"), F.col("s_acctbal") / 2).alias("metrics"))
    return mo.metrics_table(registry).select("model_id", "n_features", "metric", "value")


@query("shared_features", """SELECT s_suppkey AS model_id, CASE WHEN s_nationkey % 2 = 0 THEN 'label' ELSE 'label,fine_score' END AS shared, CASE WHEN s_nationkey % 2 = 0 THEN 'x1,x2' ELSE 'x1' END AS missing FROM supplier""")
def shared_features(spark, sf_dir):
    """Features of every model that the data has and lacks."""
    registry = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("model_id"), F.when(
        F.col("s_nationkey") % 2 == 0, F.array(F.lit("x1"), F.lit("label"), F.lit("x2"))).otherwise(
        F.array(F.lit("label"), F.lit("x1"), F.lit("fine_score"))).alias("features"))
    out = mo.shared_features(registry, results_from_lineitem(spark, sf_dir).columns)
    return out.select("model_id", F.array_join("shared", ",").alias("shared"), F.array_join("missing", ",").alias("missing"))


@query("knn_vote", """WITH n AS (SELECT a.vec_id AS q, b.vec_id AS t, b.label AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS no
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT q AS vec_id, round(avg(CAST(y > 4 AS INTEGER)), 9) AS score, count(*) AS neighbours FROM n WHERE no <= 15 GROUP BY q""")
def knn_vote(spark, sf_dir):
    """Mean label of the fifteen nearest other vectors."""
    rows = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") > 4).cast("int"))
    near = ne.nearest_neighbours(rows, rows, "embedding", "vec_id", "vec_id", "y", k=15, leave_self_out=True)
    return ne.knn_vote(near, "vec_id").withColumn("score", F.round("score", 9))


@query("knn_scaled", """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
st AS (SELECT i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM e GROUP BY i),
v AS (SELECT vec_id, CAST(any_value(label) > 4 AS INTEGER) AS y, list((x - m) / s ORDER BY i) AS v FROM e JOIN st USING (i) GROUP BY vec_id),
n AS (SELECT a.vec_id AS q, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS no FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT q AS vec_id, round(avg(y), 9) AS score, count(*) AS neighbours FROM n WHERE no <= 15 GROUP BY q""")
def knn_scaled(spark, sf_dir):
    """Mean label of the fifteen nearest other vectors, every dimension scaled first."""
    rows = table(spark, sf_dir, "embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"e{i}" for i in range(width)]
    flat = rows.select("vec_id", (F.col("label") > 4).cast("int").alias("y"), *[F.get("embedding", F.lit(i)).alias(n) for i, n in enumerate(names)])
    scaled = mo.standardized(flat, names).select("vec_id", "y", F.array(*names).alias("v"))
    near = ne.nearest_neighbours(scaled, scaled, "v", "vec_id", "vec_id", "y", k=15, leave_self_out=True, small_pairs=0)
    return ne.knn_vote(near, "vec_id").withColumn("score", F.round("score", 9))


@query("knn_holdout", """WITH o AS (SELECT o_orderkey AS id, o_totalprice AS price, epoch_us(o_orderdate) / 86400000000.0::DOUBLE AS day, o_custkey::DOUBLE AS customer, CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders),
st AS (SELECT avg(price) AS m1, stddev_pop(price) AS s1, avg(day) AS m2, stddev_pop(day) AS s2, avg(customer) AS m3, stddev_pop(customer) AS s3 FROM o WHERE id % 100 <> 0),
v AS (SELECT id, y, [(price - m1) / s1, (day - m2) / s2, (customer - m3) / s3] AS v FROM o, st),
n AS (SELECT q.id, q.y AS truth, t.y, row_number() OVER (PARTITION BY q.id ORDER BY round(list_distance(q.v, t.v), 9), t.id) AS no FROM v q JOIN v t ON q.id % 100 = 0 AND t.id % 100 <> 0)
SELECT id, truth, round(avg(y), 9) AS score, CAST(avg(y) > 0.5 AS INTEGER) AS prediction FROM n WHERE no <= 15 GROUP BY id, truth""")
def knn_holdout(spark, sf_dir):
    """k-NN as a classifier: hold-out rows against the training rows, scaled by the training rows."""
    names = ["price", "day", "customer"]
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), (epoch_us(F.col("o_orderdate")) / 86_400_000_000.0).alias("day"),
        F.col("o_custkey").cast("double").alias("customer"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    train, test = rows.where("id % 100 <> 0"), rows.where("id % 100 = 0")
    scale = lambda d: mo.standardized(d, names, train).select("id", "y", F.array(*names).alias("v"))
    test = scale(test)
    score = ne.knn_vote(ne.nearest_neighbours(test, scale(train), "v", "id", "id", "y", k=15, small_pairs=0), "id")
    return test.select("id", F.col("y").alias("truth")).join(score, "id").select(
        "id", "truth", F.round("score", 9).alias("score"), (F.col("score") > 0.5).cast("int").alias("prediction"))


@query("standardized_features", W + """, s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2 FROM results)
SELECT row_id, round((l_quantity - m1) / s1, 6) AS l_quantity, round((l_extendedprice - m2) / s2, 6) AS l_extendedprice FROM results, s""")
def standardized_features(spark, sf_dir):
    """Features scaled to mean 0 and deviation 1."""
    out = mo.standardized(results_from_lineitem(spark, sf_dir).select("row_id", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return out.select("row_id", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 6).alias("l_extendedprice"))


def _training_rows(spark, sf_dir):
    flows = flows_from_lineitem(spark, sf_dir)
    return flows.select("row_id", *FEATURES, F.when(F.col("protocol").isin("TCP", "udp"), 1).otherwise(0).alias("LabelBinary"),
                        F.when(F.col("protocol") == "TCP", 6.0).when(F.col("protocol") == "udp", 17.0).otherwise(1.0).alias("proto_code"))


_CLASSES_SQL = "WITH " + FLOWS_SQL + """, y AS (SELECT row_id, CASE WHEN protocol IN ('TCP', 'udp') THEN 1 ELSE 0 END AS y FROM flows),
h AS (SELECT CAST(round(count(*) FILTER (WHERE y = 0) * 0.2::DOUBLE) AS BIGINT) AS negatives, CAST(round(count(*) FILTER (WHERE y = 1) * 0.2::DOUBLE) AS BIGINT) AS positives FROM y)"""


@query("train_gbt_metrics", _CLASSES_SQL + " SELECT negatives, positives, true AS rates_agree, true AS learned, 9 AS n_features FROM h")
def train_gbt_metrics(spark, sf_dir):
    """Boosted trees at the training defaults: the exact hold-out, rates that follow from its counts, and a model that has learned."""
    fit = mo.train_classifier(store(_training_rows(spark, sf_dir), "training"), "LabelBinary", ["row_id"], features=["proto_code", *FEATURES], max_depth=3)
    metrics = fit["metrics"]
    rates = with_rates(confusion_counts(fit["holdout"], "y", "p"))
    agree = (F.abs(F.col("f1") - metrics["f1"]) < 1e-12) & (F.abs(F.col("accuracy") - metrics["accuracy"]) < 1e-12) & F.lit(fit["threshold"] == fit["quantiles"][0.95])
    return rates.select((F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives"), agree.alias("rates_agree"),
                        F.lit(metrics["roc_auc"] > 0.9).alias("learned"), F.lit(len(fit["features"])).alias("n_features"))


@query("ensemble_vote", "WITH " + FLOWS_SQL + " SELECT row_id, true AS is_weighted_mean FROM flows")
def ensemble_vote(spark, sf_dir):
    """Two trained members voting on every flow, against the weighted mean of their stored scores."""
    rows = store(_training_rows(spark, sf_dir), "training")
    features = ["proto_code", *FEATURES]
    members, total, weighted = [], 0.0, F.lit(0.0)
    voted = rows
    again = rows.groupBy(F.xxhash64("row_id").alias("h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    for seed, trees in ((1, 30), (2, 20)):
        fit = mo.train_classifier(rows, "LabelBinary", ["row_id"], features=features, seed=seed,
                                  estimator=RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=6, seed=seed))
        members.append((fit["model"], fit["metrics"]["f1"]))
        alone = mo.Ensemble([(fit["model"], 1.0)], features)
        if again:
            voted = voted.join(store(alone.score(rows, f"member_{seed}").select("row_id", f"member_{seed}"), "member"), "row_id")
        else:       # a row meets its own score only: no row has to travel
            voted = alone.score(voted, f"member_{seed}")
        total += fit["metrics"]["f1"]
        weighted = weighted + fit["metrics"]["f1"] * F.col(f"member_{seed}")
    out = mo.Ensemble(members, features).score(store(voted, "voted"))
    return out.select("row_id", (F.abs(F.col("malicious_score") - weighted / total) < 1e-9).alias("is_weighted_mean"))


@query("baseline_models", "SELECT 'random_forest' AS variant, true AS learned, true AS in_range UNION ALL SELECT 'logistic_regression', true, true")
def baseline_models(spark, sf_dir):
    """A random forest of 200 trees and a logistic regression side by side."""
    rows = store(_training_rows(spark, sf_dir), "training")
    split = store(stratified_split(rows, "LabelBinary", ["row_id"]), "split")
    out = mo.baseline_models(split.where(~F.col("is_test")), split.where("is_test"), ["proto_code", *FEATURES], "LabelBinary", ["row_id"])
    unit = lambda c: F.col(c).between(0.0, 1.0)
    return out.select("variant", (F.col("roc_auc") > 0.6).alias("learned"), (unit("f1") & unit("fpr") & unit("hit_rate")).alias("in_range"))


# Prediction names protocols by number; the rules' SQL does the same.
_PREDICT_SQL = "WITH " + scored_sql(rule_settings()).replace("coalesce(protocol, 'nan') AS proto", """CASE coalesce(protocol, 'nan') WHEN '6' THEN 'TCP' WHEN '17' THEN 'UDP'
  WHEN '1' THEN 'ICMP' WHEN '58' THEN 'ICMP' ELSE coalesce(protocol, 'nan') END AS proto""")


@query("predict_flows", _PREDICT_SQL + " SELECT row_id, rules_score, rules_reasons, true AS fused, true AS decided FROM scored")
def predict_flows(spark, sf_dir):
    """Batch prediction: the rules' scores, and fusion and decision recomputed from the stored model scores."""
    rows = store(flows_from_lineitem(spark, sf_dir), "flows")
    fit = mo.train_classifier(rows.select("row_id", *FEATURES, F.col("label").alias("LabelBinary")), "LabelBinary", ["row_id"], features=FEATURES,
                              estimator=RandomForestClassifier(labelCol="y", numTrees=30, maxDepth=6, seed=7))
    out = mo.predict_flows(rows.drop("label"), mo.Ensemble([(fit["model"], 1.0)], FEATURES), ["ts_us", "row_id"])
    out = store(out.select("row_id", "malicious_score", "rules_score", "rules_reasons", "prediction", "model_flag", "fusion_score", "fusion_decision",
                           "prediction_status"), "predicted")
    m, r = F.col("malicious_score"), F.col("rules_score").cast("double") / 100
    sure = F.greatest(m, 1 - m) >= 0.8
    fused = F.when(sure, 0.9 * m + 0.1 * r).otherwise(0.7 * m + 0.3 * r)
    decision = (F.col("fusion_score") >= rule_settings().fusion_threshold).cast("int")
    decided = ((F.col("prediction") == (m > 0.5).cast("int")) & (F.col("fusion_decision") == decision) & (F.col("prediction_status") == decision)
               & (F.col("model_flag") == (m > 0.5).cast("int").bitwiseOR((m >= 0.5).cast("int"))))
    return out.select("row_id", F.col("rules_score").cast("double").alias("rules_score"), "rules_reasons",
                      (F.abs(F.col("fusion_score") - fused) < 1e-9).alias("fused"), decided.alias("decided"))
