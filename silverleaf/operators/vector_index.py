"""Exact range search over vectors stored by k-means cells.

The table is partitioned by cell; beside it stand the cells' centres and radii, measured
over all rows of a cell, not estimated. By the triangle inequality a cell whose centre is
further from the query than its radius and the search's range together holds nothing in
range, so its partition is not read. Centres are fitted on a bounded sample, as they
decide only how much is read, never what is found.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..lineage import checkpoint
from . import similarity

#: Cells of a table, rows that centres are fitted on, the cell of rows that are never left out.
CELLS, SAMPLE, ALWAYS = 256, 100_000, -1
ROWS = "asset_id BIGINT, embedding ARRAY<FLOAT>, cell INT"
#: Scores are rounded to four places before they are held against the threshold.
SLACK = 6e-5


def write(embeddings: DataFrame, path: str, cells: int = CELLS, sample: int = SAMPLE, seed: int = 42) -> None:
    """Store (asset_id, embedding) below path, by cells of unit vectors.

    Null and zero vectors are left out, as no search finds them; vectors of another length
    than most have are in a cell that every search reads.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("asset_id").cast("long").alias("asset_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter(vectors.valid(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count()
    most = lengths.agg(F.max_by("d", F.struct("count", "d")), F.max("count")).first()
    if most[0] is None:
        dim, n = 0, 0
    else:
        dim, n = most
    usual = rows.filter(F.size("embedding") == dim).withColumn("u", vectors.unit(F.col("embedding")))
    placed = rows.filter(F.size("embedding") != dim).withColumn("cell", F.lit(ALWAYS))
    centres: list[tuple[int, list[float]]] = []
    if n:
        unit = F.pmod(F.xxhash64("asset_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        some = usual.filter(unit < min(1.0, sample / n)).select(array_to_vector("u").alias("f"))
        k = max(1, min(cells, int(math.sqrt(n))))
        model = KMeans(k=k, seed=seed, featuresCol="f", predictionCol="cell").fit(some if not some.isEmpty() else usual.select(array_to_vector("u").alias("f")))
        centres = [(c, [float(x) for x in v]) for c, v in enumerate(model.clusterCenters())]
        placed = model.transform(usual.withColumn("f", array_to_vector("u"))).select("asset_id", "embedding", "cell").unionByName(placed)
    placed.repartition("cell", F.pmod(F.xxhash64("asset_id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/rows")
    known = spark.createDataFrame(centres, "cell int, centre array<double>")
    stored = spark.read.schema(ROWS).parquet(f"{path}/rows").filter(F.col("cell") != ALWAYS).join(F.broadcast(known), "cell")  # at most `cells` rows
    square = F.aggregate(F.zip_with(vectors.unit(F.col("embedding")), "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    radii = stored.groupBy("cell").agg(F.sqrt(F.max(square)).alias("radius"), F.count("*").alias("n"))
    checkpoint(known.join(radii, "cell").select("cell", "centre", "radius", "n")).coalesce(1).write.parquet(f"{path}/cells")


def reached(spark: SparkSession, path: str, vector: list[float], metric: str, threshold: float) -> list[int]:
    """The cells that may hold a vector in range."""
    c = vectors.least_cosine(metric, threshold - SLACK if metric == "cosine" else threshold + SLACK)
    span = math.sqrt(max(0.0, 2 - 2 * c)) + 1e-6
    q = np.array(vector, float) / np.linalg.norm(vector)
    cells = spark.read.schema("cell INT, centre ARRAY<DOUBLE>, radius DOUBLE, n BIGINT").parquet(f"{path}/cells").collect()  # at most CELLS rows
    return sorted(r["cell"] for r in cells if len(r["centre"]) == len(q) and np.linalg.norm(q - np.array(r["centre"])) <= r["radius"] + span)


def search(spark: SparkSession, path: str, vector: list[float], metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """What similarity.similar_to_vector() finds in the stored rows, from the cells in reach."""
    vectors.check(metric)
    limit = vectors.SEARCH_THRESHOLDS[metric] if threshold is None else threshold
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    if sum(x * x for x in vector) ** 0.5 < vectors.MIN_NORM:
        return similarity.similar_to_vector(rows, vector, metric, limit)
    near = rows.filter(F.col("cell").isin([ALWAYS, *reached(spark, path, vector, metric, limit)]))
    return similarity.similar_to_vector(near, vector, metric, limit)
