"""Whitening against numpy on the same vectors, exact sums, slabs, and the defined cases."""

import math

import numpy as np
import pytest

from flowspark.llm import whitening
from flowspark.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x int, part int, place int, index long, deviation int"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5, 6) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def random_vectors(n, d, seed):
    dice = np.random.default_rng(seed)
    return (dice.normal(size=(n, d)) @ (dice.normal(size=(d, d)) * 0.3) + dice.normal(size=d)).astype(np.float32)


def plain(vectors, components):
    """Floats by numpy, deviations by Python's whole numbers."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviation = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    centred = np.array([[(n * r[j] - sums[j]) / n for j in range(d)] for r in x])
    covariance = centred.T @ centred / n
    values, vecs = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    return deviation, centred @ vecs[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance)


def compare(rows, vectors, components=8):
    deviation, whitened, explained = plain(vectors, components)
    k = whitened.shape[1]
    assert len(rows) == len(vectors) * k
    got = np.zeros_like(whitened)
    for r in rows:
        assert r.n == len(vectors) and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-6
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        got[r.vec_id, r.component - 1] = r.whitened
    signs = np.sign((got * whitened).sum(0))
    assert np.abs(got - whitened * signs).max() < 1e-7


def test_whitening_equals_numpy(spark):
    vectors = random_vectors(300, 12, 1)
    compare(whiten(table(spark, vectors.tolist()).repartition(5)).collect(), vectors.tolist())


def test_slabs_and_small_blocks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCKS", 4)
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 100)
    vectors = random_vectors(200, 9, 2)
    compare(whiten(table(spark, vectors.tolist()).repartition(3), components=5).collect(), vectors.tolist(), 5)


def test_entries_whose_squares_pass_64_bits_stay_exact(spark):
    vectors = [[float(2 ** (20 + i % 26)), float(-i), float(i * i)] for i in range(40)]
    rows = whiten(table(spark, vectors)).collect()
    deviation, _, _ = plain([[np.float32(c) for c in v] for v in vectors], 3)
    assert {r.vec_id: int(r.deviation) for r in rows} == dict(enumerate(deviation))


def test_unusable_vectors_and_repeated_ids(spark):
    good = random_vectors(30, 3, 3).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    rows = whiten(table(spark, good + good[:1] + bad, [*range(30), None, *range(90, 97)])).collect()
    assert {r.vec_id for r in rows} == {*range(30), None} and len(rows) == 31 * 3 and {r.n for r in rows} == {31}
    first = [r.whitened for r in sorted(rows, key=lambda r: r.component) if r.vec_id == 0]
    assert first == pytest.approx([r.whitened for r in sorted(rows, key=lambda r: r.component) if r.vec_id is None])


def test_flat_data_one_row_and_no_rows(spark):
    line = [[float(i), float(2 * i), 7.0] for i in range(20)]       # one direction only
    rows = whiten(table(spark, line)).collect()
    assert {r.whitened for r in rows if r.component > 1} == {0.0} and {r.identity_error < 1e-9 for r in rows} == {True}
    assert all(r.explained == pytest.approx(1.0) for r in rows if r.component == 1)
    one = whiten(table(spark, [[1.0, 2.0]])).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [
        (1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    for vectors in ([], [None, []]):
        assert whiten(table(spark, vectors)).count() == 0
