import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import ordered
from flowspark.operators.metrics import curve_metrics
from flowspark.operators.ordered import (
    descending, exact_quantiles, hot_keys, lookup_join, number_rows, previous_value, running_sums, slice_number)


def rows(seed=7, n=400):
    rnd = random.Random(seed)
    keys = [None, "a", "a", "a", "b", "c"] + [f"k{i}" for i in range(30)]
    return [(rnd.choice(keys), i, float(rnd.randrange(50))) for i in range(n)]


def frame(spark):
    return spark.createDataFrame(rows(), "k string, i long, v double").repartition(5)


def expected_lag(data):
    last, out = {}, {}
    for k, i, v in sorted(data, key=lambda r: r[1]):
        out[i] = last.get(k)
        last[k] = v
    return out


def run_all(spark):
    df = frame(spark)
    order, at = [F.col("i")], F.col("i")
    lag = {r.i: r.p for r in previous_value(df, ["k"], order, at, F.col("v"), "p").collect()}
    num = {r.i: r.n for r in number_rows(df, ["k"], order, at, "n").collect()}
    top = {r.i: r.n for r in number_rows(df, ["k"], order, at, "n", limit=4).collect()}
    cum = {r.i: r.s for r in running_sums(df, ["k"], order, at, {"s": F.col("v")}).collect()}
    everything = {r.i: r.s for r in running_sums(df, [], order, at, {"s": F.col("v")}).collect()}
    return lag, num, top, cum, everything


def check(results):
    lag, num, top, cum, everything = results
    data = rows()
    assert lag == expected_lag(data)
    seen, sums, total = {}, {}, 0.0
    for k, i, v in data:
        seen[k] = seen.get(k, 0) + 1
        sums[k] = sums.get(k, 0.0) + v
        total += v
        assert num[i] == seen[k]
        assert (i in top) == (seen[k] <= 4)
        assert cum[i] == sums[k]
        assert everything[i] == total


def test_plain_windows(spark):
    assert hot_keys(frame(spark), ["k"]) is None
    check(run_all(spark))


def test_hot_keys_in_slices(spark, force_hot):
    hot = hot_keys(frame(spark), ["k"], F.col("i"))
    assert hot is not None and 0 < hot.table.count() <= 256
    check(run_all(spark))


@pytest.mark.parametrize("forced", [False, True])
def test_exact_quantiles(spark, forced, request):
    if forced:
        request.getfixturevalue("force_hot")
    probs = [0.0, 0.01, 0.3, 0.5, 0.95, 1.0]
    got = {r.prob: r.quantile for r in exact_quantiles(frame(spark), "v", probs).collect()}
    values = [v for _, _, v in rows()]
    for p in probs:
        assert got[p] == pytest.approx(np.percentile(values, p * 100))
    assert exact_quantiles(frame(spark).where("v > 1000"), "v", probs).count() == 0
    grouped = {(r.k, r.prob): r.quantile for r in exact_quantiles(frame(spark), "v", probs, by=["k"]).collect()}
    assert grouped[("a", 0.5)] == pytest.approx(np.median([v for k, _, v in rows() if k == "a"]))
    assert grouped[(None, 0.5)] == pytest.approx(np.median([v for k, _, v in rows() if k is None]))


@pytest.mark.parametrize("grid", [1000, 30])
def test_selected_quantiles_with_ties_gaps_and_coarse_sketches(spark, force_hot, monkeypatch, grid):
    monkeypatch.setattr(ordered, "GRID", grid)
    dice = random.Random(3)
    data = {"ties": [5.0] * 300 + [4.9], "spread": [dice.uniform(-1, 1) * 10.0 ** dice.randint(-200, 200) for _ in range(400)],
            "few": [1.0, 2.0], "mixed": [float(dice.choice([1, 1, 1, 2, 3, 50])) for _ in range(300)], "nan": [1.0] * 80 + [float("nan")] * 40}
    table = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("ties", None)], "k string, v double").repartition(6)
    probs = [0.0, 0.25, 0.99]
    got = {(r.k, r.prob): r.quantile for r in exact_quantiles(table, "v", probs, by=["k"]).collect()}
    assert len(got) == len(data) * len(probs)
    for k, values in data.items():
        values = sorted(values, key=lambda v: (v != v, v))
        for p in probs:
            low, part = int(p * (len(values) - 1) // 1), p * (len(values) - 1) % 1
            high = values[min(low + (part > 0), len(values) - 1)]
            want = values[low] + (high - values[low]) * part
            assert got[k, p] == pytest.approx(want, rel=1e-9, nan_ok=True), (k, p)


def test_cells_spare_large_groups_the_sketch(spark, monkeypatch):
    spark.conf.set("spark.flowspark.hotMinRows", "100")
    try:
        def refused(*_):
            raise AssertionError("a sketch over all rows")
        monkeypatch.setattr(ordered.F, "percentile_approx", refused)
        dice = random.Random(5)
        spread = [dice.choice([-1, 1]) * 10.0 ** dice.uniform(-3, 3) for _ in range(2000)] + [0.0] * 500 + [-0.0] + [float("inf"), 5e-324, -1.7e308]
        table = spark.createDataFrame([(k, v) for k in (None, "a") for v in spread], "k string, v double").repartition(6)
        probs = [0.0, 0.3, 0.5, 0.9, 1.0]
        got = {(r.k, r.prob): r.quantile for r in exact_quantiles(table, "v", probs, by=["k"]).collect()}
        assert len(got) == 10
        for (_, p), value in got.items():
            assert value == pytest.approx(np.quantile(sorted(spread), p), rel=1e-12, nan_ok=True), p
    finally:
        spark.conf.unset("spark.flowspark.hotMinRows")


@pytest.mark.parametrize("small", [100, 0])
def test_lookup_join_paths(spark, force_hot, small):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("k3", 3)], "k string, w int")
    got = {r.i: r.w for r in lookup_join(frame(spark), table, ["k"], small_rows=small).collect()}
    want = {"a": 1, "b": 2, "k3": 3}
    assert got == {i: want.get(k) for k, i, _ in rows()}


def _gaps(spark):
    data = [(f"2020-01-{1 + i // 30:02d}T{i % 24:02d}:00:00Z", i, None if i % 10 == 0 else float("nan") if i % 17 == 0 else float(i * 37 % 101),
             int(i * 7 % 3 == 0)) for i in range(300)]
    return spark.createDataFrame(data, "at string, i long, score double, label int").repartition(4)


def _by_text(df):
    order = [F.col("at"), F.col("i")]
    return {r.i: (r.p, r.n) for r in number_rows(
        previous_value(df, [], order, slice_number(df, "at"), F.col("i"), "p"), [], order, slice_number(df, "at"), "n").collect()}


def _by_score(df):
    up = {r.i: r.n for r in number_rows(df, [], [F.col("score").asc(), F.col("i")], F.col("score"), "n").collect()}
    down = {r.i: r.n for r in number_rows(df, [], [F.col("score").desc(), F.col("i")], descending(F.col("score")), "n").collect()}
    return up, down


def test_text_order_and_gaps_plain_and_sliced(spark):
    df = _gaps(spark)
    plain = _by_text(df), _by_score(df), curve_metrics(df, "score", "label").collect()
    spark.conf.set("spark.flowspark.hotMinRows", "3")
    spark.conf.set("spark.flowspark.hotSlices", "16")
    try:
        assert (_by_text(df), _by_score(df), curve_metrics(df, "score", "label").collect()) == plain
    finally:
        spark.conf.unset("spark.flowspark.hotMinRows")
        spark.conf.unset("spark.flowspark.hotSlices")
    # rows without a score take no part in a curve
    known = df.where("score is not null and not isnan(score)")
    assert curve_metrics(known, "score", "label").collect() == plain[2]


def test_wide_lookup_is_not_broadcast(spark):
    table = spark.range(50).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1_000_000).alias("wide"))
    joined = lookup_join(spark.range(100).select((F.col("id") % 50).alias("k")), table, ["k"])
    assert joined.count() == 100
