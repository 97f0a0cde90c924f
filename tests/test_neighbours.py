"""The pivot join against all pairs, with cells and queries cut small."""

import numpy as np
import pytest

from flowspark.operators import neighbours as ne


def frame(spark, vectors, labels):
    rows = [(i, [float(x) for x in v], int(y)) for i, (v, y) in enumerate(zip(vectors, labels, strict=True))]
    return spark.createDataFrame(rows, "id long, v array<double>, y int").repartition(3)


def nearest(queries, train, k, own):
    d = np.round(np.sqrt(((queries[:, None] - train[None]) ** 2).sum(-1)), 9)
    if own:
        np.fill_diagonal(d, np.inf)
    return [[int(j) for j in np.lexsort((np.arange(len(train)), row))[:k] if np.isfinite(row[j])] for row in d]


def found(result, column):
    got = {}
    for r in result.collect():
        got.setdefault(r.id, {})[r["rank"]] = r[column]
    return {i: [ranks[n] for n in sorted(ranks)] for i, ranks in got.items()}


@pytest.mark.parametrize("small, cell, queries", [(1 << 22, 16_384, 65_536), (0, 16_384, 65_536), (0, 9, 7)])
def test_neighbours_equal_all_pairs(spark, monkeypatch, small, cell, queries):
    monkeypatch.setattr(ne, "CELL_ROWS", cell)
    monkeypatch.setattr(ne, "QUERY_ROWS", queries)
    monkeypatch.setattr(ne, "CHUNK_ENTRIES", 500)
    dice = np.random.default_rng(2)
    vectors = np.concatenate([dice.normal(size=(60, 3)), dice.normal(size=(60, 3)) * 0.1 + 4, np.repeat([[1.0, 2.0, 3.0]], 40, 0),
                              dice.integers(0, 3, (40, 3)).astype(float), [[1e6, 0, 0]]])
    labels = dice.integers(0, 2, len(vectors))
    rows = frame(spark, vectors, labels)
    want = nearest(vectors, vectors, 5, True)
    got = found(ne.nearest_neighbours(rows, rows, "v", "id", "id", "y", k=5, leave_self_out=True, small_pairs=small), "neighbour_id")
    assert got == dict(enumerate(want))
    asked = dice.normal(size=(30, 3)) * 3
    got = found(ne.nearest_neighbours(frame(spark, asked, [0] * 30), rows.withColumnRenamed("id", "t"), "v", "id", "t", "y", k=7, small_pairs=small), "t")
    assert got == dict(enumerate(nearest(asked, vectors, 7, False)))
    votes = {r.id: (r.score, r.neighbours) for r in ne.knn_vote(ne.nearest_neighbours(rows, rows, "v", "id", "id", "y", k=5, leave_self_out=True), "id").collect()}
    assert votes == {i: (pytest.approx(np.mean(labels[near])), 5) for i, near in enumerate(want)}


def test_few_rows_no_rows_and_null_vectors(spark):
    rows = spark.createDataFrame([(1, [0.0], 1), (2, [1.0], 0), (3, None, 1)], "id long, v array<double>, y int")
    got = found(ne.nearest_neighbours(rows, rows, "v", "id", "id", "y", k=5, leave_self_out=True, small_pairs=0), "neighbour_id")
    assert got == {1: [2], 2: [1]}
    small = 0
    assert ne.nearest_neighbours(rows, rows.limit(0), "v", "id", "id", "y", small_pairs=small).count() == 0
    assert ne.nearest_neighbours(rows.limit(0), rows, "v", "id", "id", "y", small_pairs=small).count() == 0


def test_most_pairs_are_never_compared(spark):
    dice = np.random.default_rng(5)
    centres = dice.normal(size=(30, 8)) * 20
    vectors = centres[dice.integers(0, 30, 3000)] + dice.normal(size=(3000, 8))
    rows = frame(spark, vectors, np.zeros(3000))
    compared = ne.compared_pairs(rows, rows, "v", "id", "id", "y", k=10, leave_self_out=True)
    assert 3000 * 10 < compared < 3000 * 3000 / 10


def test_rows_that_no_cell_rules_out_meet_in_blocks(spark, monkeypatch):
    """A query of random rows in many dimensions travels to a few blocks, not to every cell."""
    monkeypatch.setattr(ne, "CELL_ROWS", 200)
    monkeypatch.setattr(ne, "LEAST_BLOCK", 50, raising=False)
    vectors = np.random.default_rng(3).normal(size=(600, 40))
    rows = frame(spark, vectors, np.zeros(600))
    met, sent = ne._met, []

    def watched(visits, *args):
        sent.append(visits.count())
        return met(visits, *args)

    monkeypatch.setattr(ne, "_met", watched)
    got = found(ne.nearest_neighbours(rows, rows, "v", "id", "id", "y", k=5, leave_self_out=True, small_pairs=0), "neighbour_id")
    assert got == dict(enumerate(nearest(vectors, vectors, 5, True)))
    assert sent[-1] == 600


@pytest.mark.parametrize("shift, spread", [(0.0, 1.0), (1e6, 1e-3), (-3e4, 50.0)])
def test_the_shortlist_leaves_out_no_neighbour(shift, spread):
    """Also far from the origin, where single precision tells nothing apart."""
    g = np.random.default_rng(3)
    rows, asked = g.normal(shift, spread, (3000, 16)), g.normal(shift, spread, (200, 16))
    exact = np.sqrt(((asked[:, None] - rows[None]) ** 2).sum(2))
    bound = np.sort(exact, axis=1)[:, 39]
    at, of = ne.Shortlist(rows).within(asked, bound, 15)
    found = set(zip(at.tolist(), of.tolist(), strict=True))
    assert all((i, j) in found for i in range(200) for j in np.argsort(exact[i])[:15].tolist())
    assert len(found) < 200 * 3000 / 10
