"""Connected components of a similarity graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpoint

#: Parts that a node's edges are dealt into where they meet the node's minimum.
SALTS = 32
#: Edges that a task contracts at once; edges that one task closes to the end, beyond which all tasks take rounds.
TOGETHER, FEW = 1 << 18, 1 << 16


def _salt(end: str) -> Column:
    return F.pmod(F.xxhash64(end), F.lit(SALTS)).cast("int")


def _spread(nodes: DataFrame) -> DataFrame:
    """One row of each node for each salt that its mask holds."""
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), k)) != 0)
    return nodes.withColumn("s", F.explode(salts)).drop("mask")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it is connected with) of a few edges, without the smallest ones themselves."""
    nodes, place = np.unique(np.r_[a, b], return_inverse=True)
    label = np.arange(len(nodes))
    one, two = place[: len(a)], place[len(a) :]
    while True:  # the larger label's node points to the smaller label, then pointers are followed to the end
        x, y = label[one], label[two]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != label[label]).any():
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v), u > v: edges that connect the same nodes; those of a task are made into stars, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(*(np.concatenate(c) for c in zip(*held)))], ["u", "v"])

        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False).copy() for c in batch.columns])
            size += len(held[-1][0])
            if size >= TOGETHER:
                yield done()
                held, size = [], 0
        if size:
            yield done()

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a != b").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, contract: bool = True) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); the root is the smallest node.

    Tasks first make stars of their own edges, so that long chains are short before any
    shuffle (contract off: edges that are stars of each task already). Then alternating large-star and small-star rounds, each cut by a checkpoint, until every
    node with a smaller neighbour has no other. A hub's edges never gather in one task: its
    minimum and the salts that its edges have are aggregated before the shuffle, and edges
    are joined with them by node and salt. Edges whose lower end is already a root, which
    most soon are, find nothing to join and stay as they are. No more than FEW edges (a
    megabyte) are left to one task instead.
    """
    if contract:
        e = contracted(edges)
    else:
        e = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = checkpoint(e.distinct())
    few = e.limit(FEW + 1).count() <= FEW
    if few:
        e = checkpoint(contracted(e.select(F.col("u").alias("a"), F.col("v").alias("b")).coalesce(1)))
    while not few:
        none = F.lit(0).cast("long")
        both = e.select(F.col("u").alias("node"), F.col("v").alias("other"), none.alias("bit")).unionByName(
            e.select(F.col("v").alias("node"), F.col("u").alias("other"), F.call_function("shiftleft", F.lit(1).cast("long"), _salt("u")).alias("bit"))
        )
        below = F.when(F.col("other") < F.col("node"), F.col("other"))
        nodes = both.groupBy("node").agg(F.min("other").alias("m"), F.max(below).alias("high"), F.bit_or("bit").alias("mask"))
        unsettled = checkpoint(nodes.filter("m < node AND (mask != 0 OR high > m)"))
        if unsettled.isEmpty():
            break
        lower = _spread(unsettled.filter("mask != 0").select(F.col("node").alias("v"), "m", "mask"))
        large = e.withColumn("s", _salt("u")).join(lower, ["v", "s"], "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), _salt("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("high"), F.bit_or(bit).alias("mask"))
        several = _spread(low.filter("high > m").select("u", "m", "mask"))
        small = large.withColumn("s", _salt("v")).join(several, ["u", "s"]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
