import math

import pytest

from cladeflow.operators import samples, selection

A = [0.31, 0.004, 0.16, 0.07, 0.25, 0.006, 0.012, 0.188]
B = [0.04, 0.9, 0.004, 0.03, 0.006, 0.02]
C = [1.0]


@pytest.fixture(scope="module")
def weights(spark):
    rows = [(q, e, w, -10.0) for q, ws in enumerate((A, B, C)) for e, w in enumerate(ws)]
    return spark.createDataFrame(rows, "query long, edge long, lwr double, logl double")


def sizes(rows):
    return [r["count"] for r in rows.groupBy("query").count().orderBy("query").collect()]


def reached(ws, share):
    """How many of the largest weights it takes to reach a share."""
    ws, total = sorted(ws, reverse=True), 0.0
    return next((k + 1 for k in range(len(ws)) if (total := total + ws[k]) >= share - 1e-12), len(ws))


def test_counts(weights):
    every = (A, B, C)
    assert sizes(selection.without_bottom(weights, 0.5)) == [math.ceil(len(ws) * 0.5) for ws in every]
    for share in (0.5, 0.8, 0.95, 0.999):
        assert sizes(selection.accumulated(weights, share)) == [reached(ws, share) for ws in every]
    for least in (0.01, 0.05, 0.2):
        assert sizes(selection.supported(weights, least)) == [max(1, sum(w > least for w in ws)) for ws in every]


def test_least_and_most(weights):
    clamp = lambda n, ws, low, high: min(max(n, low), high, len(ws))
    assert sizes(selection.accumulated(weights, 0.95, 3, 4)) == [clamp(reached(ws, 0.95), ws, 3, 4) for ws in (A, B, C)]
    assert sizes(selection.supported(weights, 0.99, 2, 3)) == [clamp(0, ws, 2, 3) for ws in (A, B)] + [1]
    with pytest.raises(ValueError):
        selection.supported(weights, 0.1, 5, 2)
    with pytest.raises(ValueError):
        selection.accumulated(weights, 1.1)


def test_softmax_and_best(spark):
    rows = spark.createDataFrame([(1, 0, -1000.0), (1, 1, -1000.0), (2, 5, -3.0)], "query long, edge long, logl double")
    assert [r["lwr"] for r in selection.with_weights(rows).orderBy("query", "edge").collect()] == [0.5, 0.5, 1.0]
    assert [(r["query"], r["edge"]) for r in selection.best_edge(rows).orderBy("query").collect()] == [(1, 0), (2, 5)]


def test_strike_box(spark):
    rows = [(1, e, -float(e)) for e in range(60)] + [(2, e, -1.0) for e in range(50)]
    kept = selection.strike_box(spark.createDataFrame(rows, "query long, edge long, logl double"))
    assert sizes(kept) == [4 + 6, 50]


def test_heuristics_and_empty(spark):
    none = spark.createDataFrame([], "query long, edge long, logl double")
    for name in ("dynamic", "fixed", "strike_box"):
        assert selection.select_candidates(none, name, 0.5).count() == 0
    with pytest.raises(ValueError):
        selection.select_candidates(none, "other")


def test_splits_and_merges(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (9,)], "query long")
    assert [r["part"] for r in samples.split_sample(rows, 5).orderBy("query").collect()] == [1, 2, 3, 4]
    work = spark.createDataFrame([(i,) for i in range(7)], "k long")
    parts = samples.split_work(work, 2, "k").groupBy("part").count().orderBy("part").collect()
    assert [r["count"] for r in parts] == [4, 3]
    assert samples.all_pairs(spark.range(10), spark.range(12).withColumnRenamed("id", "e")).count() == 120
    a = spark.createDataFrame([(0, 1, -1.0), (1, 1, -1.0), (2, 1, -1.0)], "query long, edge long, logl double")
    b = spark.createDataFrame([(2, 2, -2.0), (1, 2, -2.0), (3, 2, -2.0)], "query long, edge long, logl double")
    merged = samples.collapse(samples.merge(a, b)).orderBy("query").collect()
    assert [len(r["p"]) for r in merged] == [1, 2, 2, 1]
    values = spark.createDataFrame([(20.0,), (2.0,), (10.0,), (3.0,)], "x double")
    assert sorted(r["difficulty"] for r in samples.difficulty(values, "x").collect()) == [1.0, 1.5, 5.0, 10.0]
    assert samples.local_slices(10, 4) == [(0, 3), (3, 3), (6, 3), (9, 1)]
    assert samples.local_slices(2, 4)[2:] == [(2, 0), (2, 0)]
