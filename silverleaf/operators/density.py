"""HDBSCAN: clusters of any density, from a minimum spanning forest of mutual reachability.

Large data sets are spread over tasks at every step. Vectors are packed into blocks, and
pairs of blocks are multiplied once for the nearest of each point, from which core
distances and most edges follow in rounds (Boruvka). Only points whose lists can't tell
their component's nearest point outside are compared with all others. The forest's edges, in order of weight,
are then merged a chunk at a time. A merged set is known by four numbers (its least point,
its size, and two sums from which stabilities follow), so a chunk needs these of the sets
that it touches and nothing of what is below. A second pass over the chunks, from the top,
hands the labels of chosen clusters down.

Edges are in one total order (distance to six places, then the two points), so the forest
and its clusters don't depend on how the points are dealt out. Sets of no more than LOCAL
points are one task each and get the same labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..lineage import ranked, stored
from . import blocks
from .graph import components

#: Points of a data set that one task holds; vectors of a block; edges merged at once.
LOCAL, BLOCK, CHUNK = 2_048, 4_096, 1 << 20
#: Nearest points that each point knows; points of a block that are compared with all.
NEAR, SEARCHED = 10, 1 << 14
PLACES = 6
NOISE = -1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows, to PLACES places."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)
    return np.round(np.sqrt(np.maximum(0, square)), PLACES)


# The tree: merging edges in order, bottom up, then labels, top down.


class Tree:
    """Merges of sets by edges in order; a set is (size, kept, below) and named by its least point.

    kept is the sum, over the set's points, of the density at which each leaves the cluster
    that the set is part of; below is the best stability of the clusters inside it.
    """

    def __init__(self, min_size: int):
        self.min_size = min_size
        self.at: dict[int, int] = {}  # name of a set from outside: its node
        self.name: list[int] = []
        self.state: list[tuple[int, float, float]] = []
        self.parts: list[tuple[int, int, float] | None] = []  # two nodes and the density where they merge
        self.up: list[int] = []

    def _node(self, name: int, state: tuple[int, float, float], parts: tuple[int, int, float] | None = None) -> int:
        self.name.append(name)
        self.state.append(state)
        self.parts.append(parts)
        self.up.append(len(self.up))
        return len(self.name) - 1

    def leaf(self, name: int, state: tuple[int, float, float]) -> int:
        if name not in self.at:
            self.at[name] = self._node(name, state)
        return self.at[name]

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def _chosen(self, x: int, density: float) -> tuple[bool, float]:
        """Whether the cluster that is born at x is better than those inside it, and the better stability."""
        size, kept, below = self.state[x]
        own = kept - size * density
        return own >= below - 1e-9 * max(1.0, abs(kept)), max(own, below)

    def merge(self, a: int, b: int, density: float) -> None:
        a, b = self.top(a), self.top(b)
        (m, kept_a, below_a), (n, kept_b, below_b) = self.state[a], self.state[b]
        if m >= self.min_size and n >= self.min_size:
            state = (m + n, (m + n) * density, self._chosen(a, density)[1] + self._chosen(b, density)[1])
        elif m >= self.min_size:
            state = (m + n, n * density + kept_a, below_a)
        elif n >= self.min_size:
            state = (m + n, m * density + kept_b, below_b)
        else:
            state = (m + n, (m + n) * density, 0.0)
        self.up[a] = self.up[b] = self._node(min(self.name[a], self.name[b]), state, (a, b, density))

    def labels(self, given: dict[int, int | None]) -> dict[int, int]:
        """The label of every set from outside, or None where it is open; given are those of the tops, by name.

        A label is the least point of a chosen cluster; NOISE is final, too.
        """
        of: list[int | None] = [None] * len(self.name)
        for x in range(len(self.name) - 1, -1, -1):
            if self.up[x] == x:
                of[x] = given.get(self.name[x])
            if self.parts[x] is None:
                continue
            a, b, density = self.parts[x]
            big = [self.state[y][0] >= self.min_size for y in (a, b)]
            for y, own in zip((a, b), big):
                if of[x] is not None:
                    of[y] = of[x]
                elif not own:
                    of[y] = NOISE
                elif all(big) and self._chosen(y, density)[0]:
                    of[y] = self.name[y]
        return {name: of[x] for name, x in self.at.items()}


def _density(w: np.ndarray) -> np.ndarray:
    """1 / w; points at one place get twice the largest finite density."""
    positive = w[w > 0]
    most = 2 / positive.min() if len(positive) else 1.0
    return np.where(w > 0, 1 / np.where(w > 0, w, 1), most)


def spanning_tree(v: np.ndarray, min_samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(w, a, b), a < b, in order: the minimum spanning tree of mutual reachability of a few rows."""
    n = len(v)
    place = min(min_samples, n) - 1
    core = np.concatenate([np.partition(distances(v[at : at + 256], v), place, axis=1)[:, place] for at in range(0, n, 256)])
    best, source, done = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    out, at, own = [], 0, np.arange(n)
    for _ in range(n - 1):  # Prim, with the mutual reachability of one row at a time
        done[at] = True
        reach = np.maximum(distances(v[at : at + 1], v)[0], np.maximum(core, core[at]))
        low, high = np.minimum(own, at), np.maximum(own, at)
        old_low, old_high = np.minimum(own, source), np.maximum(own, source)
        closer = ~done & ((reach < best) | ((reach == best) & ((low < old_low) | ((low == old_low) & (high < old_high)))))
        best[closer], source[closer] = reach[closer], at
        left = np.flatnonzero(~done)
        left = left[best[left] == best[left].min()]
        ends = np.stack([np.minimum(left, source[left]), np.maximum(left, source[left])])
        pick = np.lexsort(ends[::-1])[0]
        at = int(left[pick])
        out.append((best[at], ends[0][pick], ends[1][pick]))
    w, a, b = (np.array(x) for x in zip(*out)) if out else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
    order = np.lexsort((b, a, w))
    return w[order], a[order], b[order]


def hdbscan_labels(v: np.ndarray, min_cluster_size: int = 2, min_samples: int = 2) -> np.ndarray:
    """The least row of each row's cluster by Euclidean distance, or NOISE."""
    n = len(v)
    if n < max(2, min_cluster_size):
        return np.full(n, NOISE)
    w, a, b = spanning_tree(v, min_samples)
    tree = Tree(min_cluster_size)
    for x, y, density in zip(a.tolist(), b.tolist(), _density(w).tolist()):
        tree.merge(tree.leaf(x, (1, 0.0, 0.0)), tree.leaf(y, (1, 0.0, 0.0)), density)
    found = tree.labels({})
    return np.array([NOISE if found[k] is None else found[k] for k in range(n)])


# The forest over blocks.


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """distances of rows one by one."""
    gap = a - b
    return np.round(np.sqrt(np.einsum("ij,ij->i", gap, gap)), PLACES)


def _scored(v: np.ndarray, left: bool) -> np.ndarray:
    """Rows whose products, one from the left and one not, fall with the distance: (|a|^2 - d^2) / 2."""
    return np.c_[v, np.ones(len(v))] if left else np.c_[v, -(v * v).sum(1) / 2]


def _least_outside(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """(comp, other, w, a, b): edges by which rows may be nearest to another component, the best of each few rows.

    a: nodes, vectors, components, core distances and the weights above which edges are not
    looked for; b: the same without the last.
    """
    (an, av, ac, ak, most), (bn, bv, bc, bk) = a, b
    left, right = _scored(av, True), _scored(bv, False)
    wrong, blur = 4 * blocks.slack(left, right) + 1e-12, 2 * 10.0**-PLACES
    square, core = (av * av).sum(1), (bk * bk).astype(np.float32)
    own = np.maximum(most, ak) + blur
    for at, of, c in blocks.tiles(left, right):
        part, there = slice(at, at + len(c)), slice(of, of + c.shape[1])
        c *= -2
        c += square[part, None].astype(np.float32)
        np.maximum(c, core[None, there], out=c)
        c[ac[part, None] == bc[None, there]] = np.inf
        reach = np.sqrt(np.maximum(np.maximum(c.min(axis=1).astype(np.float64) + wrong, ak[part] ** 2), 0)) + blur
        i, j = np.divmod(np.flatnonzero(c <= (np.minimum(reach, own[part]) ** 2 + wrong)[:, None]), c.shape[1])
        i, j = i[np.isfinite(c[i, j])] + at, j[np.isfinite(c[i, j])] + of
        for few in range(0, len(i), 1 << 16):
            x, y = i[few : few + (1 << 16)], j[few : few + (1 << 16)]
            w = np.maximum(_apart(av[x], bv[y]), np.maximum(ak[x], bk[y]))
            yield _best(ac[x], bc[y], w, np.minimum(an[x], bn[y]), np.maximum(an[x], bn[y]))


def _best(c: np.ndarray, other: np.ndarray, w: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first edge of each component."""
    order = np.lexsort((b, a, w, c))
    order = order[np.r_[True, c[order][1:] != c[order][:-1]][: len(order)]]
    return tuple(x[order] for x in (c, other, w, a, b))


_FOUND = "comp long, other long, w double, a long, b long"


def _searched(packed: DataFrame, points: DataFrame, core: DataFrame, comp: DataFrame, rows: DataFrame) -> DataFrame:
    """Edges from (node, most) to other components: the best of each component is among them."""
    state = packed.select("g", "k", F.explode("nodes").alias("node")).join(comp, "node").join(core, "node")
    state = state.groupBy("g", "k").agg(F.array_sort(F.collect_list(F.struct("node", "comp", "core"))).alias("s"))
    right = packed.join(state.select("g", "k", F.col("s.comp").alias("comps"), F.col("s.core").alias("cores")), ["g", "k"])
    own = stored(points.join(rows, "node").join(comp, "node").join(core, "node"))
    shares = own.groupBy("g").agg(F.ceil(F.count("*") / SEARCHED).cast("long").alias("parts"))
    ends = F.broadcast(shares.join(packed.groupBy("g").agg(F.max("n").alias("n")), "g"))
    dealt = own.join(ends, "g").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")))
    row = F.collect_list(F.struct("node", "v", "comp", "core", "most"))
    left = dealt.groupBy("g", "p", "n").agg(row.alias("l")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    right = right.drop("n").join(F.broadcast(shares), "g").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    both = left.select("g", "p", "k", *(F.col(f"l.{c}").alias(f"l_{c}") for c in ("node", "v", "comp", "core", "most"))).join(right, ["g", "p", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cells in zip(*batch.columns):
                arrays = [blocks.matrix(c) if place in (1, 6) else c.values.to_numpy(zero_copy_only=False) for place, c in enumerate(cells)]
                found = list(_least_outside(tuple(arrays[:5]), tuple(arrays[5:])))
                if found:
                    best = _best(*(np.concatenate(x) for x in zip(*found)))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["comp", "other", "w", "a", "b"])

    return both.select("l_node", "l_v", "l_comp", "l_core", "l_most", "nodes", "vs", "comps", "cores").mapInArrow(run, _FOUND)


def spanning_forest(points: DataFrame, min_samples: int) -> DataFrame:
    """(g, w, a, b), a < b: the minimum spanning tree of each set of (g, node, v), by mutual reachability.

    Every point has a list of its nearest, which also say how near all others are at least.
    In a round, a component takes the best edge of its lists if all that is not listed is
    farther. Where few components can, points that may have better edges outside are
    compared with all points; the largest component of each set needn't be.
    """
    k = max(NEAR, min_samples - 1)
    packed = stored(blocks.packed(points, BLOCK))
    lists = stored(blocks.nearest(packed, k, _scored, _apart))
    place = F.least(F.lit(min_samples - 1), F.size("near")) - 1
    own = F.get("near", place)["d"] if min_samples > 1 else F.lit(0.0)
    near = points.select("g", "node").join(lists, "node", "left").select("g", "node", F.coalesce(own, F.lit(0.0)).alias("core"), F.slice("near", 1, NEAR).alias("near"))
    near = stored(near)
    core = near.select("node", "core")
    bound = near.select("g", "node", F.when(F.size("near") == NEAR, F.greatest("core", F.element_at("near", -1)["d"])).otherwise(F.lit(math.inf)).alias("bound"))
    edge = near.select(F.col("node").alias("x"), "core", F.explode("near").alias("e")).select("x", "core", F.col("e.other").alias("y"), "e.d")
    edge = edge.join(core.select(F.col("node").alias("y"), F.col("core").alias("core_y")), "y").select("x", "y", F.greatest("d", "core", "core_y").alias("w"))
    edge, comp = stored(edge), core.select("node", F.col("node").alias("comp"))
    forest: DataFrame | None = None
    while True:
        ends = edge.join(comp.select(F.col("node").alias("x"), "comp"), "x").join(comp.select(F.col("node").alias("y"), F.col("comp").alias("other")), "y").filter("comp != other")
        edge = stored(ends.select("x", "y", "w", "comp", "other"))
        listed = edge.groupBy("comp").agg(F.min(F.struct("w", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "other")).alias("e"))
        sets = stored(bound.join(comp, "node").groupBy("comp").agg(F.min("g").alias("g"), F.count("*").alias("size"), F.min("bound").alias("bound")).join(listed, "comp", "left"))
        edge = edge.select("x", "y", "w")
        several = sets.groupBy("g").agg(F.count("*").alias("n"), F.max(F.struct("size", "comp"))["comp"].alias("largest")).filter("n > 1")
        open_ = stored(sets.join(F.broadcast(several), "g").withColumn("settled", F.coalesce(F.col("e.w") < F.col("bound"), F.lit(False))))
        count = open_.agg(F.count("*").alias("n"), F.sum(F.col("settled").cast("long")).alias("settled")).first()
        if not count["n"]:
            break
        chosen = open_.filter("settled").select("comp", "e.*")
        if 4 * count["settled"] < count["n"]:
            asked = open_.filter("NOT settled AND comp != largest").select("comp", F.coalesce("e.w", F.lit(math.inf)).alias("most"))
            rows = bound.join(comp, "node").join(asked, "comp").filter("bound <= most").select("node", "most")
            best = _searched(packed, points, core, comp, rows).select("comp", F.struct("w", "a", "b", "other").alias("e"))
            best = best.unionByName(open_.filter("NOT settled AND comp != largest AND e IS NOT NULL").select("comp", "e")).groupBy("comp").agg(F.min("e").alias("e"))
            chosen = chosen.unionByName(best.select("comp", "e.*"))
        chosen = stored(chosen)
        new = chosen.select("w", "a", "b").distinct()
        forest = new if forest is None else forest.unionByName(new)
        roots = components(chosen.select(F.col("comp").alias("a"), F.col("other").alias("b")))
        comp = stored(comp.join(roots.withColumnRenamed("node", "was"), F.col("comp") == F.col("was"), "left").select("node", F.coalesce("root", "comp").alias("comp")))
    empty = points.select("g", F.lit(0.0).alias("w"), F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    if forest is None:
        return empty
    return stored(forest.join(points.select("g", F.col("node").alias("a")), "a").select("g", "w", "a", "b"))


# Merging the forest, chunk by chunk.

_STATE = "node long, size long, kept double, below double, was long"


def forest_labels(forest: DataFrame, min_size: int, chunk: int = CHUNK) -> DataFrame:
    """(node, label) of every point that an edge of the forest touches; label NOISE for noise."""
    least = forest.filter("w > 0").groupBy("g").agg(F.min("w").alias("least"))
    density = F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(F.coalesce(2 / F.col("least"), F.lit(1.0)))
    edges = ranked(forest.join(least, "g", "left").select("w", "a", "b", density.alias("density")), ["w", "a", "b"], "place")
    edges = stored(edges.select((F.col("place") / chunk).cast("long").alias("chunk"), "place", "a", "b", "density"))
    chunks = math.ceil(edges.count() / chunk)
    states: DataFrame | None = None
    moved_by: list[DataFrame] = []
    inputs: list[DataFrame] = []

    def tree_of(batches: Iterator[pd.DataFrame]) -> tuple[Tree, dict[int, int | None]]:
        tree, given = Tree(min_size), {}
        rows = pd.concat(list(batches), ignore_index=True).sort_values("place")
        for r in rows.itertuples(index=False):
            ends = []
            for name, size, kept, below in ((r.a, r.size_a, r.kept_a, r.below_a), (r.b, r.size_b, r.kept_b, r.below_b)):
                ends.append(tree.leaf(int(name), (int(size), float(kept), float(below))))
            tree.merge(*ends, float(r.density))
            if "label" in rows and not pd.isna(r.label):
                given[int(r.top)] = int(r.label)
        return tree, given

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, _ = tree_of(batches)
        out = []
        for name, x in tree.at.items():
            top = tree.top(x)
            out.append((tree.name[top], *tree.state[top], name))
        yield pd.DataFrame(out, columns=["node", "size", "kept", "below", "was"])

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, given = tree_of(batches)
        yield pd.DataFrame([(k, v) for k, v in tree.labels(given).items()], columns=["node", "label"]).astype({"label": "Int64"})

    def with_states(rows: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            one = [F.lit(x).cast(t).alias(f"{c}_{end}") for c, x, t in (("size", 1, "long"), ("kept", 0.0, "double"), ("below", 0.0, "double"))]
            if states is None:
                rows = rows.select("*", *one)
            else:
                named = states.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("size", "kept", "below")))
                rows = rows.join(named, end, "left").withColumns({f"{c}_{end}": F.coalesce(f"{c}_{end}", F.lit(x)) for c, x in (("size", 1), ("kept", 0.0), ("below", 0.0))})
        return rows

    for c in range(chunks):
        held = stored(with_states(edges.filter(F.col("chunk") == c)))
        moved = stored(held.coalesce(1).mapInPandas(climb, _STATE))
        inputs.append(held)
        moved_by.append(moved)
        if c + 1 < chunks:
            new = moved.select("node", "size", "kept", "below").distinct()
            if states is not None:
                new = new.unionByName(states.join(moved.select(F.col("was").alias("node")), "node", "left_anti"))
            states = stored(new)
            rest = edges.filter(F.col("chunk") > c)
            for end in ("a", "b"):
                to = moved.select(F.col("was").alias(end), F.col("node").alias("to"))
                rest = rest.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            edges = stored(rest)
    labels: DataFrame | None = None
    for held, moved in zip(reversed(inputs), reversed(moved_by)):
        tops = moved.select(F.col("was").alias("a"), F.col("node").alias("top"))
        if labels is None:
            rows = held.join(tops, "a").withColumn("label", F.lit(None).cast("long"))
        else:
            rows = held.join(tops, "a").join(labels.withColumnRenamed("node", "top"), "top", "left")
        own = rows.coalesce(1).mapInPandas(descend, "node long, label long")
        if labels is not None:
            own = own.unionByName(labels.join(moved.select(F.col("was").alias("node")), "node", "left_anti"))
        labels = stored(own)
    if labels is None:
        return forest.select(F.col("a").alias("node"), F.lit(NOISE).cast("long").alias("label")).limit(0)
    return labels.select("node", F.coalesce("label", F.lit(NOISE).cast("long")).alias("label"))


def _local(rows: DataFrame, min_cluster_size: int, min_samples: int, unit: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("asset_id")
        v = np.stack(pdf["embedding"]).astype(np.float64)
        if unit:
            v /= np.linalg.norm(v, axis=1, keepdims=True)
        ids, label = pdf["asset_id"].to_numpy(), hdbscan_labels(v, min_cluster_size, min_samples)
        own = label != NOISE
        return pd.DataFrame({"asset_id": ids[own], "cluster_id": ids[label[own]]})

    return rows.groupBy("g").applyInPandas(run, "asset_id long, cluster_id long")


def hdbscan(embeddings: DataFrame, min_cluster_size: int = 2, min_samples: int = 2, group: str | None = None, unit: bool = True, local: int = LOCAL) -> DataFrame:
    """(asset_id, cluster_id) on unit vectors, or on points as they are; a cluster is named by its smallest id.

    Each value of `group` is a data set of its own. Invalid and null vectors drop out with
    unit; ids must be distinct within a set. A set smaller than a cluster has none.
    """
    valid = embeddings.filter(vectors.valid(F.col("embedding"))) if unit else embeddings.filter("embedding IS NOT NULL")
    rows = valid.select((F.col(group) if group else F.lit(0)).alias("g"), F.col("asset_id").cast("long").alias("asset_id"), "embedding")
    sizes = stored(rows.groupBy("g").count())
    large = sizes.filter(F.col("count") > local).select("g")
    small = _local(rows.join(large, rows["g"].eqNullSafe(large["g"]), "left_anti"), min_cluster_size, min_samples, unit)
    if large.isEmpty():
        return small
    v = vectors.unit(F.col("embedding")) if unit else F.col("embedding").cast("array<double>")
    numbered = ranked(large, ["g"], "set").withColumnRenamed("g", "of")
    points = rows.join(numbered, F.col("g").eqNullSafe(F.col("of"))).select(F.col("set").alias("g"), "asset_id", v.alias("v"))
    points = stored(ranked(points.select("g", "asset_id", "v"), ["g", "asset_id"], "node"))
    found = forest_labels(spanning_forest(points.select("g", "node", "v"), min_samples), min_cluster_size)
    names = points.select(F.col("node").alias("label"), F.col("asset_id").alias("cluster_id"))
    own = points.select("node", "asset_id").join(found.filter(F.col("label") != NOISE), "node").join(names, "label").select("asset_id", "cluster_id")
    return small.unionByName(own)
