import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import balancing
from sparkloom.plans import search


def least_cost(cost):
    """The least total of a perfect matching, by shortest augmenting paths. cost: rows by places, as many or more."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], at, way, low, used = i, 0, np.zeros(m + 1, int), np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[at] = True
            now = cost[match[at] - 1] - u[match[at]] - v[1:]
            better = ~used[1:] & (now < low[1:])
            low[1:][better], way[1:][better] = now[better], at
            step = np.where(used[1:], np.inf, low[1:])
            to = int(step.argmin()) + 1
            by = step[to - 1]
            u[match[used]] += by
            v[used] -= by
            low[~used] -= by
            at = to
            if not match[at]:
                break
        while at:
            match[at] = match[way[at]]
            at = way[at]
    return sum(cost[match[j] - 1, j - 1] for j in range(1, m + 1) if match[j])


@pytest.mark.parametrize("seed", [1, 2])
def test_near_the_least_cost(spark, seed):
    """Most rows lie around one center, and there is hardly any room left over."""
    r = np.random.default_rng(seed)
    centers = balancing.unit_rows(r.normal(size=(5, 6)))
    x = np.concatenate([centers[0] + 0.8 * r.normal(size=(90, 6)), r.normal(size=(50, 6))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, v array<double>").repartition(3)
    got = {q["doc_id"]: q["cluster"] for q in balancing.bounded(rows, centers, 29).collect()}
    assert len(got) == 140 and max(np.bincount(list(got.values()))) <= 29
    distance = 1 - balancing.unit_rows(x) @ centers.T
    total = sum(distance[i, c] for i, c in got.items())
    assert total <= 1.05 * least_cost(np.repeat(distance, 29, axis=1)) and total > distance.min(1).sum()


def test_room_ties_and_errors(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "doc_id long, v array<double>")
    centers = np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    got = {q["doc_id"]: q["cluster"] for q in balancing.bounded(same, centers, 7).collect()}
    assert sorted(np.bincount(list(got.values()))) == [6, 7, 7]
    assert {q["doc_id"]: q["cluster"] for q in balancing.bounded(same.repartition(5), centers, 7).collect()} == got  # on any partitioning
    assert balancing.bounded(same, centers, 20).select("cluster").distinct().collect() == [(0,)]
    assert balancing.bounded(same, centers[:1], 20).count() == 20 and balancing.bounded(same.limit(0), centers, 1).count() == 0
    with pytest.raises(ValueError, match="do not fit"):
        balancing.bounded(same, centers, 6)


def test_empty_clusters_get_far_rows(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.01 * i]) for i in range(10)] + [(50, [-1.0, 0.0]), (51, [0.0, -1.0])], "doc_id long, v array<double>")
    centers = balancing.reseeded(rows, np.array([[1.0, 0.0], [-0.1, 1.0], [-0.2, 1.0]]))
    assert centers.tolist() == [[1.0, 0.0], [0.0, -1.0], [-0.2, 1.0]]  # the last one is nearest to row 50


def test_clusters_of_an_index(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([np.array([3.0, 0, 0, 0]) + 0.1 * r.normal(size=(160, 4)), r.normal(size=(39, 4)), np.zeros((1, 4))])
    rows = spark.createDataFrame([(f"d{i}", v.tolist()) for i, v in enumerate(x)], "doc_id string, v array<double>")
    got = search.clustered(rows, 5, most=1.2)
    assert got.count() == 200 and got.groupBy("shard_id").count().agg(F.max("count")).first()[0] <= 48 and got.select("shard_id").distinct().count() == 5
    few = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0])], "doc_id string, v array<double>")
    assert search.clustered(few, 8).count() == 2 and search.clustered(few.limit(0), 8).count() == 0
    zero = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [0.0, 0.0])], "doc_id string, v array<double>")
    assert search.clustered(zero, 2).count() == 2
