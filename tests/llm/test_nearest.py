"""Search by the multi-index against brute force."""

import numpy as np

from placegrid.llm.nearest import nearest, walk


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS query")


def test_recall_and_order(spark):
    vectors = np.random.default_rng(0).normal(size=(6000, 16))
    found = nearest(_table(spark, [(k, v.tolist()) for k, v in enumerate(vectors)])).toPandas()
    hits = 0
    for query, own in found.sort_values("rank").groupby("query_id"):
        scores = vectors @ vectors[query]
        scores[query] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & set(own["vec_id"]))
        assert list(own["rank"]) == list(range(1, 21)) and (np.diff(own["score"]) <= 0).all()
        assert np.allclose(own["score"], scores[own["vec_id"]])
    assert hits >= 0.9 * 20 * 300


def test_copies_odd_vectors_and_few_rows(spark):
    rows = [(k, [1.0, 2.0]) for k in range(60)] + [(100, None), (120, [0.0, 0.0]), (140, [float("nan"), 1.0]), (160, [None, 1.0]), (180, [1.0]), (None, [1.0, 1.0])]
    found = nearest(_table(spark, rows + [(0, [1.0, 2.0])])).toPandas()
    assert sorted(found["query_id"].unique()) == [0, 20, 40]
    assert list(found[found["query_id"] == 0].sort_values("rank")["vec_id"]) == list(range(1, 21))
    assert list(found[found["query_id"] == 20].sort_values("rank")["vec_id"]) == list(range(20))
    few = nearest(_table(spark, rows[:3])).toPandas()
    assert list(few["vec_id"]) == [1, 2] and (few["score"] == 5).all()
    assert nearest(_table(spark, rows[:0])).count() == 0


def test_walk_rises_and_stops():
    rng = np.random.default_rng(2)
    left, right, counts = rng.normal(size=5), rng.normal(size=7), rng.integers(0, 4, 35)
    sums = (left[:, None] + right).ravel()
    cells = walk(left, right, counts, 30)
    assert (np.diff(sums[cells]) >= 0).all() and counts[cells].sum() >= 30 > counts[cells[:-1]].sum()
    assert sorted(walk(left, right, counts, 10**9)) == list(np.flatnonzero(counts))
