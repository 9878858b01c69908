"""Search by cells gives what a scan gives and reads few partitions."""

import numpy as np
import pytest
from silverleaf.functions import vectors
from silverleaf.operators import similarity, vector_index


def stored_rows():
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(20, 12))
    v = centre[rng.integers(0, 20, 900)] + 0.15 * rng.normal(size=(900, 12))
    v *= rng.uniform(0.1, 9, (900, 1))
    out = [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(v)]
    return [*out, (5000, None), (5001, [0.0] * 12), (5002, [1.0, 2.0]), (5003, out[4][1]), (5003, out[4][1])]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    df = spark.createDataFrame(stored_rows(), "asset_id long, embedding array<float>").repartition(3)
    path = str(tmp_path_factory.mktemp("cells"))
    vector_index.write(df, path)
    return df, path


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_search_equals_the_scan(spark, table, metric):
    df, path = table
    for at, threshold in ((4, None), (17, 0.2), (300, 0.95), (5002, None)):
        asked = dict(stored_rows())[at]
        want = [tuple(r) for r in similarity.similar_to_vector(df, asked, metric, threshold).collect()]
        assert [tuple(r) for r in vector_index.search(spark, path, asked, metric, threshold).collect()] == want and want


def test_few_partitions_are_read(spark, table):
    df, path = table
    asked = stored_rows()[4][1]
    found = vector_index.search(spark, path, asked)
    assert "PartitionFilters: [cell" in found._jdf.queryExecution().executedPlan().toString()
    cells = spark.read.parquet(f"{path}/cells").count()
    assert 0 < len(vector_index.reached(spark, path, asked, "cosine", 0.85)) < cells / 3


def test_empty_and_zero(spark, table, tmp_path):
    assert vector_index.search(spark, table[1], [0.0] * 12).count() == 0
    vector_index.write(table[0].limit(0), str(tmp_path / "none"))
    assert vector_index.search(spark, str(tmp_path / "none"), [1.0, 0.0]).count() == 0
