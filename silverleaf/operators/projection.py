"""UMAP: a low-dimensional map that keeps neighbours together, for any number of rows.

Three steps, each spread over tasks. Neighbours are exact, from products of all pairs of
blocks of rows. Distances to a row's neighbours become weights by a bisection for the row's own bandwidth, and two
directed weights become one. The layout starts from the first principal components; each
epoch brings the coordinates of two blocks of rows to the edges between them, pulls neighbours together, and
pushes every row away from a few of a bounded table of drawn rows, new in each epoch. Only
coordinates and edges move between tasks, and no task holds more than LOCAL rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..lineage import ranked, stored
from . import blocks

NEIGHBOURS, MIN_DIST = 15, 0.1
#: Epochs, the first step, the weight of pushes against pulls, rows that push each row in an epoch, and rows that they are drawn from.
EPOCHS, ALPHA, NEGATIVES, PUSHES, DRAWN = 60, 0.5, 5, 32, 4_096
#: Rows that one task may hold: it compares them all, and moves them without a shuffle.
LOCAL = 4_096
#: Blocks that the rows of a layout are dealt into, and rows of a block at most.
SPREAD, MOST = 6, 1 << 20


def curve(min_dist: float = MIN_DIST, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a x^2b) nearest to a flat top up to min_dist with an exponential end, by Gauss-Newton."""
    x = np.linspace(0, 3 * spread, 300)
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.0, 1.0
    x[0] = 1e-9
    for _ in range(100):
        p = x ** (2 * b)
        got = 1 / (1 + a * p)
        j = np.stack([-p * got**2, -2 * a * p * np.log(x) * got**2], 1)
        step = np.linalg.lstsq(j, want - got, rcond=None)[0]
        a, b = max(1e-3, a + 0.5 * step[0]), max(1e-3, b + 0.5 * step[1])
    return float(a), float(b)


# Neighbours.


def neighbours(points: DataFrame, k: int = NEIGHBOURS, local: int = LOCAL) -> DataFrame:
    """(node, near): the k nearest other rows by cosine distance of each of (node, v), as (d, other), nearest first.

    All pairs are compared, in blocks of `local` rows or more. A row that stands alone has no list.
    """
    least = F.lit(vectors.MIN_NORM)
    unit = vectors.once(F.greatest(vectors.norm(F.col("v")), least), lambda length: F.transform("v", lambda x: x.cast("double") / length))
    held = stored(blocks.packed(points.select(F.lit(0).alias("g"), "node", unit.alias("v")), local))
    return blocks.nearest(held, k, lambda v, left: v, lambda a, b: 1 - np.einsum("ij,ij->i", a, b))


# Weights.


def _bandwidths(d: np.ndarray, rounds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, bandwidth) of each row of sorted distances, so that its weights add up to log2 of their number."""
    nearest = np.where(d > 0, d, np.inf).min(axis=1)
    nearest[~np.isfinite(nearest)] = 0
    want = math.log2(max(2, d.shape[1]))
    low, high, mid = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(rounds):
        total = np.exp(-np.maximum(0, d - nearest[:, None]) / mid[:, None]).sum(axis=1)
        over = total > want
        high, low = np.where(over, mid, high), np.where(over, low, mid)
        mid = np.where(np.isfinite(high), (low + high) / 2, mid * 2)
    floor = 1e-3 * np.maximum(d.mean(axis=1), 1e-12)
    return nearest, np.maximum(mid, floor)


def weights(lists: DataFrame) -> DataFrame:
    """(a, b, w), both ways round: the fuzzy union of the rows' own weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size in {len(x) for x in batch.column(1)}:
                own = [k for k, x in enumerate(batch.column(1)) if len(x) == size]
                near = [batch.column(1)[k].as_py() for k in own]
                d = np.array([[e["d"] for e in x] for x in near]).reshape(len(own), size)
                nearest, width = _bandwidths(np.maximum(0, d))
                w = np.exp(-np.maximum(0, d - nearest[:, None]) / width[:, None])
                nodes = batch.column(0).to_numpy()[own]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes, size)), pa.array([e["other"] for x in near for e in x], pa.int64()), pa.array(w.ravel())], ["a", "b", "w"])

    one = stored(lists.mapInArrow(run, "a long, b long, w double"))
    two = one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    total = one.unionByName(two).groupBy("a", "b").agg(F.sum("w").alias("s"), F.count("*").alias("n"), F.max("w").alias("m"))
    other = F.col("s") - F.col("m")
    return total.select("a", "b", F.when(F.col("n") == 2, F.col("s") - F.col("m") * other).otherwise(F.col("s")).alias("w"))


# Layout.


def _pull(gap: np.ndarray, w: np.ndarray, a: float, b: float) -> np.ndarray:
    """What edges of weight w move their near ends by; gap: near end less far end."""
    square = np.maximum((gap**2).sum(1), 1e-12)
    return np.clip((-2 * a * b * square ** (b - 1) / (1 + a * square**b))[:, None] * gap, -4, 4) * w[:, None]


def _hashed(nodes: np.ndarray, epoch: int) -> np.ndarray:
    """A number from 0 to 1 of each node, new in each epoch."""
    mixed = (nodes.astype(np.uint64) + np.uint64((epoch + 1) * 0xD6E8FEB86659FD93 % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(34)) / float(1 << 30)


def _push(nodes: np.ndarray, x: np.ndarray, table: np.ndarray, epoch: int, a: float, b: float) -> np.ndarray:
    """The mean push of PUSHES rows of a table, drawn by hash, on each row."""
    turn = np.arange(PUSHES, dtype=np.uint64) + np.uint64(PUSHES * epoch)
    mixed = nodes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) ^ (turn * np.uint64(0xD6E8FEB86659FD93))[None]
    mixed ^= mixed >> np.uint64(31)
    chosen = ((mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(33)).astype(np.int64) % len(table)
    gap = x[:, None] - table[chosen]
    square = (gap**2).sum(2, keepdims=True)
    return np.where(square > 0, np.clip(2 * b / ((0.001 + square) * (1 + a * square**b)) * gap, -4, 4), 0).mean(axis=1)


def _moved(nodes: np.ndarray, x: np.ndarray, pulled: np.ndarray, total: np.ndarray, table: np.ndarray, epoch: int, epochs: int, a: float, b: float) -> np.ndarray:
    """Rows after an epoch: pulls and NEGATIVES pushes for each, per unit of the row's own weight."""
    step = (pulled + NEGATIVES * total[:, None] * _push(nodes, x, table, epoch, a, b)) / np.maximum(1, total)[:, None]
    return x + ALPHA * (1 - epoch / epochs) * step


def layout(graph: DataFrame, start: DataFrame, epochs: int = EPOCHS, local: int = LOCAL) -> DataFrame:
    """(node, coords) after some epochs from (node, coords), along (a, b, w).

    Rows are dealt into SPREAD blocks (of MOST rows at most), and edges are held by the pair
    of blocks that they are between. An epoch sends each block's coordinates to its pairs,
    adds up there what edges pull at a row, so a row with very many edges is no burden, and
    moves each row once. Pushes come from DRAWN rows or so, new in each epoch, which are
    sent to all tasks. Up to `local` rows take
    the same steps in one task, where pushes come from all of them.
    """
    a_, b_ = curve()
    at = stored(start.select("node", F.col("coords").cast("array<double>").alias("coords")))
    n = at.count()
    if n <= local:

        def all_epochs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            left = left.sort_values("node")
            nodes, x = left["node"].to_numpy(), np.stack(left["coords"]).astype(float)
            right = right.sort_values(["a", "b"])
            i, j, w = np.searchsorted(nodes, right["a"]), np.searchsorted(nodes, right["b"]), right["w"].to_numpy(float)
            total = np.bincount(i, w, len(nodes))
            for epoch in range(epochs):
                pulled = np.zeros_like(x)
                np.add.at(pulled, i, _pull(x[i] - x[j], w, a_, b_))
                x = _moved(nodes, x, pulled, total, x, epoch, epochs, a_, b_)
            return pd.DataFrame({"node": nodes, "coords": list(x)})

        one = F.lit(0).alias("g")
        return at.select("node", "coords", one).groupBy("g").cogroup(graph.select("a", "b", "w", one).groupBy("g")).applyInPandas(all_epochs, "node long, coords array<double>")
    dims, parts = len(at.first()["coords"]), max(SPREAD, math.ceil(n / MOST))
    # A row's place from 0 says its block and its place within it. Edges between two blocks are held once, as both ways have one weight.
    places = ranked(at, ["node"], "place")
    of = places.select("node", F.pmod("place", F.lit(parts)).alias("k"), F.floor(F.col("place") / parts).cast("int").alias("i"))
    one, two = (of.select(F.col("node").alias(x), F.col("k").alias(f"k{x}"), F.col("i").alias(f"i{x}")) for x in "ab")
    placed = graph.filter("w > 0").join(one, "a").join(two, "b").filter("ka <= kb")
    packed = placed.groupBy("ka", "kb").agg(F.collect_list(F.struct("ia", "ib", "w")).alias("e"))
    # Held by the key that every epoch joins by, so that edges don't move again.
    edges = stored(packed.select("ka", "kb", "e.ia", "e.ib", "e.w")).repartition(parts * parts, "ka", "kb").persist(StorageLevel.DISK_ONLY)
    totals = graph.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("total"))
    rows = places.join(totals, "node", "left").groupBy(F.pmod("place", F.lit(parts)).alias("k"))
    rows = rows.agg(F.array_sort(F.collect_list(F.struct("place", "node", "coords", F.coalesce("total", F.lit(0.0)).alias("total")))).alias("r"))
    rows = stored(rows.select("k", F.col("r.node").alias("nodes"), F.col("r.total").alias("totals"), F.flatten("r.coords").alias("coords")))
    fixed = rows.select("k", "nodes", "totals").repartition(parts, "k").persist(StorageLevel.DISK_ONLY)
    at = rows.select("k", "coords")

    def matrix(cell: pa.ListScalar) -> np.ndarray:
        return cell.values.to_numpy(zero_copy_only=False).reshape(-1, dims)

    def points(nodes: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.ravel()))], ["node", "coords"])

    def summed(i: np.ndarray, moved: np.ndarray, rows: int) -> pa.Array:
        return pa.array([np.stack([np.bincount(i, moved[:, k], rows) for k in range(dims)], 1).ravel()], pa.list_(pa.float64()))

    def pulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ka, kb, ia, ib, w, l, r in zip(*batch.columns):
                (i, j, w), x, y = (c.values.to_numpy(zero_copy_only=False) for c in (ia, ib, w)), matrix(l), matrix(r)
                moved = _pull(x[i] - y[j], w, a_, b_)
                yield pa.RecordBatch.from_arrays([pa.array([ka.as_py()]), summed(i, moved, len(x))], ["k", "force"])
                if ka.as_py() != kb.as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([kb.as_py()]), summed(j, -moved, len(y))], ["k", "force"])

    zero = F.lit(0).cast("long")
    for epoch in range(epochs):
        share = min(1.0, DRAWN / n)  # about DRAWN rows of whatever number

        def drawn(batches: Iterator[pa.RecordBatch], epoch: int = epoch, share: float = share) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for nodes, coords in zip(*batch.columns):
                    x = matrix(coords)
                    yield points(*(v[_hashed(nodes.values.to_numpy(zero_copy_only=False), epoch) < share] for v in (np.arange(len(x)), x)))

        table = np.array([r["coords"] for r in fixed.join(at, "k").select("nodes", "coords").mapInArrow(drawn, "node long, coords array<double>").collect()])
        left = at.select(F.col("k").alias("ka"), F.explode(F.sequence("k", F.lit(parts - 1).cast("long"))).alias("kb"), F.col("coords").alias("l"))
        right = at.select(F.explode(F.sequence(zero, "k")).alias("ka"), F.col("k").alias("kb"), F.col("coords").alias("r"))
        ends = edges.join(left, ["ka", "kb"]).join(right, ["ka", "kb"]).select("ka", "kb", "ia", "ib", "w", "l", "r")
        force = ends.mapInArrow(pulls, "k long, force array<double>").groupBy("k").agg(F.collect_list("force").alias("forces"))

        def move(batches: Iterator[pa.RecordBatch], epoch: int = epoch, table: np.ndarray = table) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, nodes, totals, coords, forces in zip(*batch.columns):
                    x, total = matrix(coords), totals.values.to_numpy(zero_copy_only=False)
                    pulled = sum((matrix(f) for f in (forces if forces.is_valid else ())), np.zeros_like(x))
                    ids = nodes.values.to_numpy(zero_copy_only=False)
                    out = [_moved(ids[p], x[p], pulled[p], total[p], table, epoch, epochs, a_, b_) for p in (slice(s, s + LOCAL) for s in range(0, len(x), LOCAL))]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()]), pa.array([np.concatenate(out).ravel()], pa.list_(pa.float64()))], ["k", "coords"])

        now = fixed.join(at, "k").join(force, "k", "left").select("k", "nodes", "totals", "coords", "forces")
        at = stored(now.mapInArrow(move, "k long, coords array<double>"))
    edges.unpersist()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, coords in zip(*batch.columns):
                yield points(nodes.values.to_numpy(zero_copy_only=False), matrix(coords))

    made = stored(fixed.join(at, "k").select("nodes", "coords").mapInArrow(unpacked, "node long, coords array<double>"))
    fixed.unpersist()
    return made


def umap(points: DataFrame, start: DataFrame, k: int = NEIGHBOURS, epochs: int = EPOCHS, local: int = LOCAL) -> DataFrame:
    """(node, coords) of (node, v), v not null and of one length; start: (node, coords), which are scaled to a span of about ten.

    Equal rows stay together unless start tells them apart. Fewer than three rows stay
    where they start.
    """
    held = stored(points.select("node", F.col("v").cast("array<double>").alias("v")))
    wide = start.select(F.max(F.array_max(F.transform("coords", F.abs))).alias("m")).first()["m"] or 1.0
    at = start.select("node", F.transform("coords", lambda x: x * (10.0 / max(1e-12, wide))).alias("coords"))
    if held.count() < 3:
        return at
    return layout(weights(neighbours(held, k, local)), at, epochs, local)
