"""The projection finds neighbours, weighs them, and keeps them together better than principal components."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from silverleaf.operators import projection


def cloud(n=600, seed=3):
    """Points on a rolled-up sheet in many dimensions: near ones are near along the sheet only."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 20))
    return centre[rng.integers(0, 12, n)] + 0.25 * rng.normal(size=(n, 20))


def frame(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node long, v array<double>").repartition(3)


def nearest(v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1)[:, :k]


def shared(a, b):
    return np.mean([len(set(x) & set(y)) / len(x) for x, y in zip(a, b)])


@pytest.mark.parametrize("local", [4096, 10])
def test_neighbours_are_found(spark, local):
    v = cloud()
    got = {r["node"]: [e["other"] for e in r["near"]] for r in projection.neighbours(frame(spark, v), 15, local=local).collect()}
    recall = shared(nearest(v, 15), [got[i] for i in range(len(v))])
    assert all(len(set(x)) == 15 and i not in x for i, x in got.items())
    assert recall == 1 if local > 600 else recall >= 0.9


def test_neighbours_over_blocks_are_exact(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=(900, 24)), np.repeat(rng.normal(size=(3, 24)), 40, axis=0)])  # far apart all, and copies
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    got = {r["node"]: [e["d"] for e in r["near"]] for r in projection.neighbours(frame(spark, v), 15, local=100).collect()}
    assert np.allclose([got[i] for i in range(len(v))], np.sort(d, axis=1)[:, :15], atol=1e-9)


def test_weights_add_up_and_are_symmetric(spark):
    lists = projection.neighbours(frame(spark, cloud(80)), 10)
    d = np.array([[e["d"] for e in r["near"]] for r in lists.collect()])
    low, width = projection._bandwidths(d)
    assert np.exp(-(d - low[:, None]) / width[:, None]).sum(axis=1) == pytest.approx(np.log2(10), abs=1e-3)
    w = {(r["a"], r["b"]): r["w"] for r in projection.weights(lists).collect()}
    assert all(0 < x <= 1 and w[b, a] == pytest.approx(x) for (a, b), x in w.items())


def test_curve_fits():
    a, b = projection.curve(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=0.01), pytest.approx(0.895, abs=0.01))


def test_neighbourhoods_outlive_those_of_principal_components(spark):
    v = cloud()
    mean = v - v.mean(axis=0)
    first = mean @ np.linalg.svd(mean, full_matrices=False)[2][:3].T
    start = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(first)], "node long, coords array<double>")

    def kept(x):
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        np.fill_diagonal(d, np.inf)
        return shared(nearest(v, 15), np.argsort(d, axis=1)[:, :15])

    def placed(**options):
        found = projection.umap(frame(spark, v), start, **options).orderBy("node").collect()
        assert [r["node"] for r in found] == list(range(len(v)))
        return np.array([r["coords"] for r in found])

    assert kept(placed()) > kept(first) + 0.05
    assert kept(placed(local=10, epochs=12)) > kept(first)


def test_few_and_equal_rows(spark):
    few = frame(spark, np.ones((2, 4)))
    start = few.select("node", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("coords"))
    assert projection.umap(few, start).count() == 2
    same = frame(spark, np.ones((20, 4)))
    start = same.select("node", F.array(F.lit(0.0), F.lit(0.0), F.col("node").cast("double")).alias("coords"))
    assert np.isfinite(np.array([r["coords"] for r in projection.umap(same, start).collect()])).all()


def test_layout_over_blocks_moves_as_in_one_task_and_leaves_edges_in_place(spark, monkeypatch):
    monkeypatch.setattr(projection, "NEGATIVES", 0)  # pulls alone, as pushes are drawn from other tables
    v = cloud(90)
    start = spark.createDataFrame([(7 * i, x[:3].tolist()) for i, x in enumerate(v)], "node long, coords array<double>")
    graph = projection.weights(projection.neighbours(frame(spark, v).withColumn("node", 7 * F.col("node")), 5)).persist()
    plans, stored = [], projection.stored
    monkeypatch.setattr(projection, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    one, many = (np.array([r["coords"] for r in projection.layout(graph, start, 3, local).orderBy("node").collect()]) for local in (4096, 10))
    assert np.allclose(one, many, atol=1e-9) and not np.allclose(one, v[:, :3], atol=1e-3)
    assert sum("InMemoryTableScan [ka" in p for p in plans) == 3
