"""HDBSCAN over blocks and chunks gives what one task gives, and that what the definition says."""

import numpy as np
import pytest
from silverleaf.operators import density


def kruskal(v, min_samples):
    """The minimum spanning tree of mutual reachability from all pairs in order."""
    n, d = len(v), density.distances(v, v)
    core = np.sort(d, axis=1)[:, min(min_samples, n) - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    root, out = list(range(n)), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for w, a, b in sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.append((w, a, b))
    return out


def condensed(v, min_size, min_samples):
    """Labels from the tree by the textbook: condense from the top, keep the clusters of greatest stability."""
    n = len(v)
    edges = kruskal(v, min_samples)
    least = min((w for w, _, _ in edges if w > 0), default=None)
    level = [1 / w if w > 0 else 2 / least if least else 1.0 for w, _, _ in edges]
    sets = {i: [i] for i in range(n)}
    owner, kids = list(range(n)), {}
    for k, (_, a, b) in enumerate(edges):
        x, y = owner[a], owner[b]
        sets[n + k], kids[n + k] = sets[x] + sets[y], (x, y, level[k])
        for i in sets[n + k]:
            owner[i] = n + k
    clusters = {}  # node where it is born: (stability, clusters inside)

    def follow(x, birth):
        top, total = x, 0.0
        while True:
            if x < n:
                return
            a, b, lam = kids[x]
            big = [y for y in (a, b) if len(sets[y]) >= min_size]
            if len(big) == 1:
                total += (lam - birth) * (len(sets[x]) - len(sets[big[0]]))
                x = big[0]
                continue
            total += (lam - birth) * len(sets[x])
            clusters[top] = (total, big if len(big) == 2 else [])
            for y in clusters[top][1]:
                follow(y, lam)
            return

    root = 2 * n - 2
    follow(root, 0.0)
    label = np.full(n, density.NOISE)

    def best(x):
        own, inside = clusters[x]
        below = [best(y) for y in inside]
        total = sum(b for b, _ in below)
        if x != root and own >= total - 1e-9:
            return own, [x]
        return total, [c for _, found in below for c in found]

    for x in best(root)[1]:
        label[sets[x]] = min(sets[x])
    return label


def points(seed, n=70):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, 3)) * 4
    v = centre[rng.integers(0, 5, n)] + rng.normal(size=(n, 3)) * 0.3
    v[:12] = rng.normal(size=(12, 3)) * 6
    v[20] = v[21] = v[22]
    return v.round(3)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("min_size,min_samples", [(2, 2), (2, 1), (5, 5), (8, 3)])
def test_labels_follow_the_definition(seed, min_size, min_samples):
    v = points(seed)
    w, a, b = density.spanning_tree(v, min_samples)
    assert list(zip(w, a, b)) == kruskal(v, min_samples)
    assert (density.hdbscan_labels(v, min_size, min_samples) == condensed(v, min_size, min_samples)).all()


def test_few_points():
    assert (density.hdbscan_labels(np.zeros((1, 3))) == -1).all() and (density.hdbscan_labels(np.zeros((4, 3)), 5) == -1).all()
    assert density.hdbscan_labels(np.zeros((0, 3))).tolist() == []
    assert (density.hdbscan_labels(np.ones((6, 3)), 2) >= -1).all()


def test_spread_over_tasks_is_the_same(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 25)
    rows = [(g if g else None, 1000 * g + i, x.tolist()) for g in range(2) for i, x in enumerate(points(g, 60))] + [(7, 9000, [1.0, 2.0, 3.0]), (7, 9001, None)]
    df = spark.createDataFrame(rows, "run long, asset_id long, embedding array<double>")
    want = sorted(map(tuple, density.hdbscan(df, 3, 3, "run", False).collect()))
    assert sorted(map(tuple, density.hdbscan(df, 3, 3, "run", False, local=0).collect())) == want and len({c for _, c in want}) > 4


def test_only_points_whose_lists_end_within_their_component_are_compared_again(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 25)
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(80, 3)) * 5, rng.normal(size=(40, 3)) * 0.01 + 20, np.full((15, 3), 30.0)]).round(6)
    asked, searched = [], density._searched
    monkeypatch.setattr(density, "_searched", lambda packed, points, core, comp, rows: asked.append(rows.count()) or searched(packed, points, core, comp, rows))
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "g long, node long, v array<double>")
    got = sorted((r["w"], r["a"], r["b"]) for r in density.spanning_forest(df, 3).collect())
    assert got == [(w, a, b) for w, a, b in kruskal(v, 3)]
    assert asked and sum(asked) < 2 * len(v)  # a round of block pairs compares every point


def test_merging_in_chunks_is_the_same(spark):
    edges = [(0, float(w), int(a), int(b)) for w, a, b in kruskal(points(3, 60), 2)]
    df = spark.createDataFrame(edges, "g long, w double, a long, b long")
    want = condensed(points(3, 60), 4, 2)
    for chunk in (1 << 20, 23):
        got = {r["node"]: r["label"] for r in density.forest_labels(df, 4, chunk).collect()}
        assert got == dict(enumerate(want.tolist()))
    assert density.forest_labels(df.limit(0), 4).count() == 0
