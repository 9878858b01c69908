"""Fingerprints, the Gray index and components against brute force."""

import numpy as np
import pytest
import xxhash
from silverleaf.llm import near_dedup as nd

from .data import ALL_IDS, awkward, empty, ids, table


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """id -> component of (id, fingerprint) rows."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (pairs[i][1] ^ pairs[j][1]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(pairs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(pairs)}


@pytest.mark.parametrize("text", ["", None, "one", "One TWO three", "a b c d", "A b c d e f g a b c d", "É é x\ty\nz \x0b q w e r t y", "x" * 99])
def test_fingerprint(text):
    assert nd.fingerprint(text) == brute_fingerprint(text)


def scattered(n, rng, centres, flips, bits=64):
    fps = rng.integers(0, 1 << 63, centres, np.uint64)[rng.integers(0, centres, n)]
    for _ in range(flips):
        fps = fps ^ np.where(rng.random(n) < 0.75, np.uint64(1) << rng.integers(0, bits, n).astype(np.uint64), np.uint64(0))
    return np.unique(fps)


@pytest.mark.parametrize("fanout", [2, 4, 16])
@pytest.mark.parametrize("n", [1, 2, 4, 5, 63, 65, 300, 3000])
def test_gray_index_finds_exactly_what_is_near_in_each_group(monkeypatch, n, fanout):
    monkeypatch.setattr(nd, "FANOUT", fanout)
    rng = np.random.default_rng(n)
    fps = scattered(n, rng, 8, 5)
    group = np.sort(rng.integers(0, 1 + len(fps) // 40, len(fps)) ** 2)  # of very different sizes, some of one row
    fps = rng.permutation(fps)
    index = nd.GrayIndex(group, fps)
    asked = np.flatnonzero(index.top > 0)
    one, two = index.matches(asked, 4)
    got = {tuple(sorted(p)) for p in zip(index.order[one].tolist(), index.order[two].tolist())}
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 4) & (group[:, None] == group[None])
    assert len(got) == len(one) and got == {(i, j) for i, j in np.argwhere(near).tolist() if i < j}


def test_patterns_are_factored_and_groups_are_pruned():
    """A node's own mask holds no bit of a node above it, and whole subtrees are dropped."""
    fps = scattered(4000, np.random.default_rng(8), 4000, 3)
    index = nd.GrayIndex(np.zeros(len(fps), np.int64), fps)
    assert len(index.levels) >= 6
    for (_, mask, _, _, _), (_, above, _, first, fan) in zip(index.levels, index.levels[1:]):
        assert not (mask[first] & above).any() and (fan <= nd.FANOUT).all()
    value, mask, _, _, _ = index.levels[1]
    met = np.bitwise_count((index.rows[:200, None] ^ value[None]) & ~(np.bitwise_or.reduceat(index.rows, index.levels[1][3]) ^ np.bitwise_and.reduceat(index.rows, index.levels[1][3]))[None]) <= 4
    assert met.mean() < 0.25


def brute_labels(key, fps):
    want = np.arange(len(fps))
    near = (np.bitwise_count(fps[:, None] ^ fps[None]) <= 4) & (key[:, None] == key[None])
    while True:
        low = np.where(near, want[None], len(fps)).min(axis=1)
        if (low == want).all():
            return want
        want = low


@pytest.mark.parametrize("indexed", [100, 8192])
@pytest.mark.parametrize("meetings", [500, 1 << 20])
@pytest.mark.parametrize("n", [65, 700, 2500])
def test_labels_of_groups_equal_brute_force(monkeypatch, n, meetings, indexed):
    monkeypatch.setattr(nd, "INDEXED", indexed)
    monkeypatch.setattr(nd, "MEETINGS", meetings)
    rng = np.random.default_rng(n)
    fps = rng.permutation(scattered(n, rng, 5, 9, 30))
    for key in (np.zeros(len(fps), np.int64), np.sort(rng.integers(0, 9, len(fps)))):
        assert (nd._labels(key, fps, 4) == brute_labels(key, fps)).all()


@pytest.mark.parametrize("distinct,r", [(0, 1), (10_000, 1), (10_000_000, 2), (40_000_000_000, 3)])
def test_groups_of_even_fingerprints_stay_small(distinct, r):
    assert nd.shared_blocks(distinct, 4) == r


@pytest.mark.parametrize("r", [1, 2, 3])
def test_blocks_tile_and_pairs_meet(r):
    tiles = nd.blocks(4 + r)
    assert sum(w for _, w in tiles) == 64 and len(tiles) == 4 + r
    rng = np.random.default_rng(1)
    for _ in range(200):
        flips = rng.choice(64, 4, replace=False)
        assert sum(not any(s <= f < s + w for f in flips) for s, w in tiles) >= r


@pytest.mark.parametrize("r", [1, 2, 3])
def test_groups_dealt_out_again_lose_no_link(spark, monkeypatch, r):
    monkeypatch.setattr(nd, "shared_blocks", lambda distinct, max_bits: r)
    rng = np.random.default_rng(4)
    fps = [int(x) for x in np.unique(rng.integers(0, 1 << 26, 3000)) << 20]
    rows = spark.createDataFrame([(x, k) for k, x in enumerate(fps)], "fp long, node long")
    want = {(r["node"], r["root"]) for r in nd.components(nd.links(rows)).collect()}
    assert want and {(r["node"], r["root"]) for r in nd.components(nd.links(rows, group=20)).collect()} == want
    brute = brute_labels(np.zeros(len(fps), np.int64), np.array(fps, np.uint64))
    sizes = np.bincount(brute, minlength=len(fps))
    assert want == {(k, int(b)) for k, b in enumerate(brute) if sizes[b] > 1}


@pytest.mark.parametrize("spread", [40, 4000])
def test_large_dense_groups_are_linked_whole(spark, spread):
    """Chains of single-bit steps within one group: everything is one component."""
    rng = np.random.default_rng(spread)
    fps = [0]
    for _ in range(400):
        fps.append(fps[-1] ^ (1 << int(rng.integers(0, 22))))
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x, x) for x in fps], "fp long, node long")
    roots = nd.components(nd.links(df)).collect()
    assert {r["node"] for r in roots} == set(fps) and {r["root"] for r in roots} == {0}


def test_every_group_goes_through_the_index(spark, monkeypatch):
    """On the whole table too, links come from the Gray index alone."""
    docs = table(spark, "documents", "sf0.01")
    fps = np.array(sorted({r["fp"] for r in nd.fingerprints(docs).collect()}), np.int64).view(np.uint64)
    tiles, linked = nd.blocks(4 + nd.shared_blocks(len(fps), 4)), set()
    for shift, width in tiles:
        key = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        order = np.argsort(key, kind="stable")
        index = nd.GrayIndex(key[order], fps[order])
        assert (index.top[index.size > 1] > 0).all() and (index.size > 1).any()
        one, two = index.matches(np.flatnonzero(index.top > 0), 4)
        linked |= {tuple(sorted(p)) for p in zip(order[index.order[one]].tolist(), order[index.order[two]].tolist())}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    assert linked == {(i, j) for i, j in np.argwhere(near).tolist() if i < j}


def test_query_equals_brute_force(spark):
    docs = table(spark, "documents")
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    want = brute_components(rows)
    got = nd.near_duplicates(docs).collect()
    assert {r["id"]: r["component_id"] for r in got} == want
    assert {r["id"]: r["fp"] & (1 << 64) - 1 for r in got} == dict(rows)
    kept = nd.keep_one(docs).collect()
    assert ids(kept, "doc_id") == sorted({c for c in want.values()})


def test_awkward_rows(spark):
    got = nd.near_duplicates(awkward(spark)).collect()
    assert ids(got) == ALL_IDS
    by_id = {r["id"]: r for r in got}
    assert by_id[6]["component_id"] == 5 and by_id[3]["component_id"] == by_id[2]["component_id"] == 1 and by_id[1]["fp"] == 0
    kept = nd.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert ids(kept.collect(), "doc_id") == [1, 4, 5, 7, 8, 9, None]
    assert nd.near_duplicates(empty(spark)).count() == nd.keep_one(empty(spark)).count() == 0


def test_rows_without_ids_and_with_one_id_are_deduplicated_by_text(spark):
    text = lambda k: " ".join(f"w{(k * 7919 + j) % 1000}" for j in range(60))
    data = [(None, text(1), "b"), (None, text(1), "a"), (None, text(2), "c"), (3, text(2), "d"), (4, text(3), "e"), (4, text(4), "f"), (4, text(4), "g"), (9, text(3), "h"), (None, None, "i"), (None, "", "j")]
    df = spark.createDataFrame(data, "doc_id long, text string, row string").repartition(4)
    kept = sorted(r["row"] for r in nd.keep_one(df).collect())
    assert kept == ["a", "d", "e", "f", "i"]
    found = {(r["id"], r["component_id"]) for r in nd.near_duplicates(df.withColumnRenamed("row", "root")).collect()}
    assert found == {(None, None), (None, 3), (3, 3), (4, 4), (9, 4)}
