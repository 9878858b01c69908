"""Expectations on small literal tables, for what the oracles don't reach."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from silverleaf import schema
from silverleaf.catalog import Library, Stale
from silverleaf.functions import bits, text, vectors
from silverleaf.operators import browse, cluster, density, dml, graph, reports, scoring, similarity
from silverleaf.plans import ingest, params
from silverleaf.plans.params import BrowseQuery, Filters, SortCriterion
from silverleaf.sources import json_schema, scan, sidecar

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors don't import tests


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def assets(spark):
    data = [
        (1, "a/x.jpg", ".jpg", "aaa", 100, True),
        (2, "a/y.jpg", ".jpg", "aaa", 200, True),
        (3, "b/z.png", ".png", "bbb", None, False),
        (4, "b/w.png", ".png", None, 150, None),
        (5, "c.gif", ".gif", None, 150, None),
    ]
    df = spark.createDataFrame(data, "id long, relpath string, ext string, sha256 string, taken_at long, favorited boolean")
    return df.withColumns({"filename": text.basename(F.col("relpath")), "archived": F.lit(False), "trashed": F.lit(False)})


# Parameters.


def test_parameters():
    assert params.parse_sort("a:b:c") == ("a", "b", "c")
    assert params.parse_sort("a:b") is params.parse_sort("a::c") is params.parse_sort(None) is None
    assert [params.parse_score(x) for x in ("1.5", " ", "x", None, 2)] == [1.5, None, None, None, 2.0]
    levels = params.parse_levels([{"sort_by": "a:b:c", "min_score": "1"}, {"sort_by": "bad"}, {"sort_by": "d:e:f"}])
    assert len(levels) == 1 and levels[0].min_score == 1.0
    assert [params.page_count(n) for n in (0, 50, 51)] == [1, 1, 2]
    assert [params.page_of_rank(n) for n in (0, 49, 50)] == [1, 1, 2]
    assert BrowseQuery(page=3).offset == 100 and BrowseQuery(page=0).offset == 0


# Browsing.


def test_filters_never_match_null(assets):
    assert [browse.count_assets(assets, Filters(favorited=v)).first()["n"] for v in (True, False, None)] == [2, 1, 5]
    assert browse.list_assets(assets, Filters(ext=".PNG")).count() == 2


def test_undated_last_and_pages_join_up(assets):
    assert [r["id"] for r in browse.list_assets(assets).collect()] == [2, 4, 5, 1, 3]
    pages = [r["id"] for k in range(3) for r in browse.list_assets(assets, limit=2, offset=2 * k).collect()]
    assert pages == [2, 4, 5, 1, 3]


def test_dedupe_filters_first(assets):
    assert rows(browse.deduped(assets), "id") == [(1,), (3,), (4,), (5,)]
    assert browse.count_deduped(assets).first()["n"] == 4
    assert rows(browse.deduped(assets.filter("id <> 1")), "id") == [(2,), (3,), (4,), (5,)]
    assert browse.count_newer(assets, 100, dedupe=True).first()["n"] == 3 == browse.count_newer(assets, 100).first()["n"]


def test_scores_sort_range_and_version(spark, assets):
    data = [(i, "s", "v", "m", i * 10.0, "1") for i in range(1, 5)] + [(2, "s", "v", "other", 1.0, "2")]
    scores = spark.createDataFrame(data, "asset_id long, scorer_id string, variant_id string, metric_key string, value double, scorer_version string")
    by = SortCriterion("s", "v", "m", True, 20.0, 30.0)
    assert [r["id"] for r in browse.list_by_score(assets, scores, by).collect()] == [3, 2]
    two = (SortCriterion("s", "v", "m", False), SortCriterion("s", "v", "other", False))
    assert [(r["id"], r["score_2"]) for r in browse.list_multi_sort(assets, scores, two).collect()] == [(1, None), (2, 1.0), (3, None), (4, None)]
    ranged = (two[0], SortCriterion("s", "v", "other", True, 0.5))
    assert browse.count_multi_sort(assets, scores, ranged).first()["n"] == 1
    assert rows(browse.without_score(assets, scores, "s", "v", "m"), "id") == [(5,)]
    assert browse.without_score(assets, scores, "s", "v", "m", "2").count() == 5
    assert browse.has_scores(scores, "s", "v") and not browse.has_scores(scores, "s", "w")
    page, count = browse.browse(assets, scores, BrowseQuery(criteria=two))
    assert page.count() == count.first()["n"] == 4
    page, count = browse.browse(assets, scores, BrowseQuery())
    assert page.count() == count.first()["n"] == 4


def test_alias_paths_resolve(spark, assets):
    paths = spark.createDataFrame([(9, 2, "old/name.jpg", 0)], schema.struct("asset_paths"))
    assert browse.by_relpath(assets, paths, "old/name.jpg").first()["id"] == 2
    assert browse.by_relpath(assets, paths, "a/x.jpg").first()["id"] == 1
    assert browse.by_relpath(assets, paths, "nowhere").first() is None
    assert rows(browse.alias_paths(paths, 2), "relpath") == [("old/name.jpg",)]


# Writes.


def test_upsert_is_idempotent_and_keeps_what_is_not_given(spark):
    table = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, x string, y long")
    change = spark.createDataFrame([(2, "B"), (3, "C")], "k long, x string")
    once = dml.upsert_columns(table, change, ["k"])
    assert rows(once, "k", "x", "y") == [(1, "a", 5), (2, "B", 6), (3, "C", None)]
    assert rows(dml.upsert_columns(once, change, ["k"]), "k", "x", "y") == rows(once, "k", "x", "y")
    assert rows(dml.upsert(table, change, ["k"]), "k", "x", "y") == [(1, "a", 5), (2, "B", None), (3, "C", None)]
    assert rows(dml.insert_or_ignore(table, change, ["k"]), "k", "x") == [(1, "a"), (2, "b"), (3, "C")]
    last = spark.createDataFrame([(2, "old", 1), (2, "new", 2)], "k long, x string, t long")
    assert rows(dml.upsert(table, last, ["k"], "t"), "k", "x") == [(1, "a"), (2, "new")]
    assert dml.truncate(table).count() == 0


def test_new_ids_go_on_in_order(spark):
    table = spark.createDataFrame([(7, "z")], "id long, name string")
    new = spark.createDataFrame([(f"n{k:03}",) for k in range(100)], "name string").repartition(7)
    made = dml.append_with_ids(table, new, ["name"])
    assert rows(made.filter("id > 7"), "id", "name") == sorted([(8 + k, f"n{k:03}") for k in range(100)], key=repr)
    assert rows(dml.append_with_ids(table.limit(0), new.limit(1), ["name"]), "id") == [(1,)]


def test_null_safe_delete(spark):
    clusters = spark.createDataFrame([(1, "m", None), (2, "m", "{}"), (3, "n", None)], "id long, method string, params_json string")
    members = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "cluster_id long, asset_id long")
    left, kept = dml.delete_clusters(clusters, members, "m", None)
    assert rows(left, "id") == [(2,), (3,)] and rows(kept, "cluster_id") == [(2,), (3,)]


def test_presets_keep_their_creation_time(spark):
    presets = spark.createDataFrame([(3, "one", "a:b:c", None, None, None, 5, 5)], schema.struct("view_presets"))
    change = spark.createDataFrame([("one", "d:e:f"), ("two", None)], "name string, sort_by string")
    made = dml.upsert_presets(presets, change, 9)
    assert rows(made, "id", "name", "sort_by", "created_at", "updated_at") == [(3, "one", "d:e:f", 5, 9), (4, "two", None, 9, 9)]


def test_known_content_becomes_an_alias(spark):
    assets, paths = spark.createDataFrame([], schema.struct("assets")), spark.createDataFrame([], schema.struct("asset_paths"))

    def scanned(*found):
        return spark.createDataFrame([(p, p, ".jpg", s) for p, s in found], "relpath string, filename string, ext string, sha256 string")

    assets, paths = dml.upsert_assets(assets, paths, scanned(("b", "cafe"), ("a", "cafe"), ("c", "dead"), ("d", None), ("e", None)), 1)
    assets, paths = assets.cache(), paths.cache()
    assert rows(assets, "id", "relpath") == [(1, "a"), (2, "c"), (3, "d"), (4, "e")]
    assert rows(paths, "asset_id", "relpath") == [(1, "b")]
    again, same = dml.upsert_assets(assets, paths, scanned(("b", "cafe"), ("a", "cafe"), ("c", "dead")), 2)
    assert rows(again, "id", "relpath") == rows(assets, "id", "relpath") and rows(same, "asset_id", "relpath") == [(1, "b")]
    moved, links = dml.upsert_assets(assets, paths, scanned(("c", "cafe")), 3)
    assert rows(moved, "id", "relpath") == [(1, "a"), (3, "d"), (4, "e")] and rows(links, "asset_id", "relpath") == [(1, "b"), (1, "c")]


def test_library_snapshots_and_listens(spark, tmp_path):
    lib, told = Library(spark, f"file://{tmp_path}/lib"), []
    lib.listeners.append(told.append)
    assert lib.read("albums").count() == 0
    lib.write("albums", spark.createDataFrame([(1, "a", "a", 0)], schema.struct("albums")))
    lib.write("albums", lib.read("albums").withColumn("name", F.lit("b")))  # reads the table that it replaces
    lib.vacuum("albums")
    assert rows(Library(spark, f"file://{tmp_path}/lib").read("albums"), "id", "name") == [(1, "b")]
    assert told == ["albums"] * 2
    fs, claim = lib._path("albums/_markers/000000000003")
    assert fs.createNewFile(claim)  # a writer that died before it was done, or is still at it
    assert rows(lib.read("albums"), "id", "name") == [(1, "b")]
    with pytest.raises(Stale):
        lib.write("albums", lib.read("albums"))
    fs.setTimes(claim, 1000, -1)  # so long ago that it must have died
    lib.write("albums", lib.read("albums").withColumn("name", F.lit("c")))
    assert rows(lib.read("albums"), "id", "name") == [(1, "c")] and lib._markers("albums")[-1][0] == 4
    lib._mark("_schema", "7")
    with pytest.raises(schema.SchemaMismatch):
        Library(spark, f"file://{tmp_path}/lib")


# Expressions.


def test_text_expressions(spark):
    df = spark.createDataFrame([("a b/IMG.x.JPG", 1686836381, 1536), ("noext", None, 3 << 40)], "p string, t long, n long")
    made = df.select(text.basename(F.col("p")).alias("b"), text.extension(F.col("p")).alias("e"), text.album_of(F.col("p")).alias("a"), text.when_utc(F.col("t")).alias("w"), text.human_size(F.col("n")).alias("h"))
    assert [tuple(r) for r in made.collect()] == [("IMG.x.JPG", ".jpg", "a b", "2023-06-15 13:39 UTC", "1 KB"), ("noext", "", None, "—", "3 TB")]
    one = spark.range(1)
    assert one.select(text.thumbnail_path(F.lit(12345))).first()[0] == "thumbs/0012/12345.jpg"
    assert one.select(text.canonical_json(b=F.lit(1), a=F.lit("x"))).first()[0] == '{"a":"x","b":1}'
    assert one.select(text.parse_params(F.lit(None).cast("string"))).first()[0] == {} == one.select(text.parse_params(F.lit("{"))).first()[0]
    assert one.select(text.slug(F.lit("--My Photos!--"))).first()[0].startswith("My-Photos-")


def test_hashes_of_any_length(spark):
    df = spark.createDataFrame([("0", "1", 1), ("f" * 64, "0", 256), ("aabbccdd11223344", "aabbccdd11223344", 0), ("zz", "0", None)], "a string, b string, d int")
    assert all(r["x"] == r["d"] for r in df.select("d", bits.hamming_hex(F.col("a"), F.col("b")).alias("x")).collect())


def test_gradient_hash(spark):
    grid = np.random.default_rng(0).integers(0, 255, (16, 17))
    want = sum(1 << (r * 16 + c) for r in range(16) for c in range(16) if grid[r, c] > grid[r, c + 1])
    df = spark.createDataFrame([(grid.ravel().tolist(),)], "g array<int>")
    assert int(df.select(bits.gradient_hash(F.col("g"))).first()[0], 16) == want


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(vectors.norm(F.col("a")), vectors.dot(vectors.unit(F.col("a")), F.col("b")), vectors.min_max(F.col("a")), vectors.valid(F.col("a"), 3)).first()
    assert tuple(got) == (5.0, 0.8, [0.0, 1.0], False)
    assert df.select(vectors.min_max(F.array(F.lit(2.0), F.lit(2.0)))).first()[0] == [0.5, 0.5]
    with pytest.raises(ValueError):
        vectors.check("manhattan")


# Similarity and clusters.


def unit_vectors(n, d=16, seed=42):
    v = np.random.default_rng(seed).normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, first=1):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(v)], "asset_id long, embedding array<float>").repartition(3)


def brute_edges(v, limit, first=1):
    c = v @ v.T
    return {(i + first, j + first) for i in range(len(v)) for j in range(i + 1, len(v)) if c[i, j] >= limit}


@pytest.mark.parametrize("block", [4, 7, 1000])
def test_all_pairs_meet_once_whatever_the_blocks(spark, block):
    v = unit_vectors(60).astype(np.float32).astype(float)
    got = rows(cluster.vector_edges(frame(spark, v), "cosine", 0.3, block), "a", "b")
    assert len(got) == len(set(got)) and set(got) == brute_edges(v, 0.3)


def test_metrics_agree_at_matching_thresholds(spark):
    df = frame(spark, unit_vectors(40, 4))
    want = rows(cluster.vector_edges(df, "cosine", 0.5), "a", "b")
    assert want == rows(cluster.vector_edges(df, "euclidean", 1.0), "a", "b") == rows(cluster.vector_edges(df, "combined", np.pi / 3), "a", "b")


@pytest.mark.parametrize("window", [1, 3, 50])
def test_windowed_pairs_equal_brute_force(spark, window):
    rng = np.random.default_rng(3)
    hashes = [int(x) for x in rng.integers(0, 1 << 12, 80)]
    df = spark.createDataFrame([(i, f"{h:x}") for i, h in enumerate(hashes)] + [(999, "not hex")], "asset_id long, phash_hex string").repartition(4)
    order = sorted(range(80), key=lambda i: (hashes[i], i))
    want = {(order[i], order[j]) for i in range(80) for j in range(i + 1, min(80, i + window + 1)) if (hashes[order[i]] ^ hashes[order[j]]).bit_count() <= 2}
    got = rows(cluster.windowed_hash_edges(df, 2, window), "a", "b")
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_components_of_chains_stars_and_cycles(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200)] + [(300, 300)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long").repartition(5)), "node", "root"))
    assert got == {i: 0 for i in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200, 202: 200}


@pytest.mark.parametrize("contract,few", [(True, 0), (False, 0), (False, 1 << 16)])
def test_components_of_hubs_equal_brute_force(spark, monkeypatch, contract, few):
    """Hubs that are no roots, with many larger and many smaller neighbours, over many partitions."""
    monkeypatch.setattr(graph, "FEW", few)
    rng = np.random.default_rng(2)
    edges = [(1000, int(k)) for k in rng.integers(0, 3000, 400)] + [(5, 1000)] + [tuple(map(int, p)) for p in rng.integers(3000, 9000, (2500, 2))]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7), contract), "node", "root"))
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: find(n) for n in linked}


def test_tags_are_unique_and_removed_by_name(spark):
    tags = spark.createDataFrame([(1, "a", 5)], "id long, term string, created_at long")
    one, fresh = dml.insert_tag(tags, "  b ", 6)
    same, again = dml.insert_tag(one, "b", 7)
    assert fresh and not again and rows(same, "id", "term", "created_at") == [(1, "a", 5), (2, "b", 6)]
    left, gone = dml.delete_tag(same, "a")
    assert gone and rows(left, "id", "term") == [(2, "b")] and not dml.delete_tag(left, "a")[1]
    with pytest.raises(ValueError):
        dml.insert_tag(tags, "  ", 1)


def hash_table(spark, data):
    return spark.createDataFrame([(i, f"{h:016x}", "dhash16") for i, h in data.items()], "asset_id long, phash_hex string, algo string")


@pytest.mark.parametrize("chunk", [1 << 16, 23])
def test_linkage_in_chunks_is_greedy_linkage(spark, chunk):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 3))
    x[40:60] = x[40]
    near = np.linalg.norm(x[:, None] - x[None], axis=2) < 1.2
    label = cluster.greedy_complete_linkage(near)
    pairs = [(10 * i, 10 * j) for i in range(90) for j in range(i + 1, 90) if near[i, j]]
    linked = {n for p in pairs for n in p}
    want = {10 * i: 10 * int(np.flatnonzero(label == label[i])[0]) for i in range(90) if 10 * i in linked}
    got = cluster.first_fit(spark.createDataFrame(pairs, "a long, b long"), chunk)
    assert {r["asset_id"]: r["cluster_id"] for r in got.collect()} == want


def test_chains_are_split_by_complete_linkage(spark):
    chain = hash_table(spark, {1: 0, 2: 0x3FF, 3: 0xFFC00})
    found, skipped = cluster.hash_clusters(chain, 10)
    assert rows(found, "cluster_id", "asset_id", "diameter") == [(1, 1, 10.0), (1, 2, 10.0)] and skipped == 0
    whole, _ = cluster.hash_clusters(hash_table(spark, {1: 0, 2: 0x3FF, 3: 0x3FF << 10 | 0x3FF}), 10, single_linkage=True)
    assert len(rows(whole, "asset_id")) == 3
    assert cluster.hash_clusters(chain, 10, max_size=1)[1] == 1
    same, _ = cluster.hash_clusters(hash_table(spark, {1: 0xAABBCCDD11223344, 2: 0xAABBCCDD11223344}))
    assert rows(same, "asset_id", "diameter", "is_representative") == [(1, 0.0, True), (2, 0.0, False)]


def test_linkage_puts_all_within_reach():
    near = np.random.default_rng(1).random((30, 30)) < 0.6
    near = (near & near.T) | np.eye(30, dtype=bool)
    label = cluster.greedy_complete_linkage(near)
    assert all(near[np.ix_(label == k, label == k)].all() for k in range(label.max() + 1))


def test_vector_clusters_name_a_medoid(spark):
    v = np.vstack([unit_vectors(1) + 0.01 * unit_vectors(4, seed=1), -unit_vectors(1)])
    for metric in vectors.METRICS:
        found, _ = cluster.vector_clusters(frame(spark, v), metric)
        got = found.collect()
        assert {r["asset_id"] for r in got} == {1, 2, 3, 4} and sum(r["is_representative"] for r in got) == 1
        best = 1.0 if metric == "cosine" else 0.0
        assert next(r["distance"] for r in got if r["is_representative"]) == pytest.approx(best, abs=1e-6)


def blobs(n=6, d=8):
    centre = np.eye(d)[:3]
    return np.vstack([c + 0.005 * np.random.default_rng(k).normal(size=(n, d)) for k, c in enumerate(centre)] + [np.array([[1.0, -1.0] * (d // 2)])])


def test_density_methods_find_the_same_blobs(spark):
    df = frame(spark, blobs())
    want = [(1 + i, 1 + 6 * (i // 6)) for i in range(18)]
    assert rows(cluster.dbscan(df, 0.05, 3), "asset_id", "cluster_id") == sorted(want, key=repr)
    # The stray point leaves its cluster late, so this method counts it as one of its members.
    assert rows(cluster.hdbscan(df, 3, 2).filter("asset_id < 19"), "asset_id", "cluster_id") == sorted(want, key=repr)
    assert (density.hdbscan_labels(np.zeros((1, 3))) == -1).all()
    faces = df.withColumnRenamed("asset_id", "id")
    for method in ("dbscan", "hdbscan"):
        got = cluster.face_clusters(faces, method, 0.05, 2, 3).collect()
        assert len({r["cluster_id"] for r in got}) == 3 == sum(r["is_representative"] for r in got)
    for bad in ({"method": "x"}, {"method": "dbscan", "eps": 0}, {"min_cluster_size": 1}):
        with pytest.raises(ValueError):
            cluster.face_clusters(faces, **bad)


def test_points_of_one_direction_are_told_apart_by_distance(spark):
    rng = np.random.default_rng(4)
    v = np.vstack([r * np.array([1.0, 1.0, 0.0]) + 0.01 * rng.normal(size=(6, 3)) for r in (1, 5, 9)])
    want = [(1 + i, 1 + 6 * (i // 6)) for i in range(18)]
    assert rows(cluster.hdbscan(frame(spark, v), 4, 4, unit=False), "asset_id", "cluster_id") == sorted(want, key=repr)


def test_map_has_every_point_and_few_clusters(spark):
    points, clusters = cluster.embedding_map(frame(spark, blobs()), 3)
    assert points.count() == 19 and clusters.agg(F.sum("size")).first()[0] == 19 and clusters.count() <= 3
    points, clusters = cluster.embedding_map(frame(spark, blobs()), 4, "hdbscan")
    assert points.count() == 19 and clusters.count() <= 4
    assert cluster.embedding_map(frame(spark, blobs()).limit(0))[0].count() == 0
    assert [cluster.cluster_count(n, 24) for n in (1, 4, 100, 10_000)] == [1, 2, 10, 24]


def test_capped_clusters_go_to_the_nearest(spark):
    data = [(1, [0.0], 0), (2, [0.1], 0), (3, [9.0], 1), (4, [9.1], 1), (5, [8.0], 2), (6, [5.0], -1)]
    df = spark.createDataFrame(data, "asset_id long, coords array<double>, label int")
    assert rows(cluster.cap_clusters(df, 2), "asset_id", "label") == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, -1)]


def test_searches(spark):
    v = np.vstack([unit_vectors(5), np.zeros((1, 16))])
    df = frame(spark, v)
    near = similarity.similar_to_vector(df, [float(x) for x in v[0] * 3], "cosine", -1.0).collect()
    assert near[0]["asset_id"] == 1 and near[0]["score"] == 1.0 and len(near) == 5
    assert 1 not in {r["asset_id"] for r in similarity.similar_to_asset(df, 1, "nonsense", -1.0).collect()}
    assert similarity.similar_to_asset(df, 6).count() == similarity.similar_to_asset(df, 77).count() == 0
    hashes = hash_table(spark, {1: 0, 2: 1, 3: 0xFFFFFFFF})
    assert rows(similarity.similar_to_hash(hashes, "0", 5.9), "asset_id", "score") == [(1, 0), (2, 1)]
    assert similarity.similar_to_hash(hashes, "xyz").count() == 0
    assets = df.select(F.col("asset_id").alias("id"), F.lit(1).alias("taken_at"), F.lit("f").alias("filename"))
    none = df.limit(0).select("asset_id")
    assert similarity.similarity_status(none, assets, df, 99) == "unknown_asset"
    assert similarity.similarity_status(none, assets, df.limit(0), 1) == "no_embedding"
    assert similarity.similarity_status(none, assets, df, 1) == "no_match"
    assert similarity.with_details(df.select("asset_id"), assets).count() == 6


def test_best_of_cluster_falls_back(spark):
    members = spark.createDataFrame([(1, 10, False), (1, 11, True), (2, 20, True), (2, 21, False)], "cluster_id long, asset_id long, is_representative boolean")
    scores = spark.createDataFrame([(10, "s", "b", "m", 9.0), (10, "s", "a", "m", 1.0), (11, "s", "a", "m", 2.0)], "asset_id long, scorer_id string, variant_id string, metric_key string, value double")
    assert rows(reports.best_of_cluster(members, scores, "s", "m"), "cluster_id", "asset_id", "score") == [(1, 11, 2.0), (2, 20, None)]


# Scoring.


class Length(scoring.Scorer):
    spec = scoring.Spec("len", "Length", "1", (scoring.Variant("v", "V", (scoring.Metric("n", "N"), scoring.Metric("half", "Half"))),))

    def score_batch(self, items):
        if any(i["text"] == "bad" for i in items):
            raise ValueError("bad item")
        return [{"n": len(i["text"]), "half": len(i["text"]) / 2} for i in items]


def test_scorers_do_what_is_missing(spark):
    assets = spark.range(1, 6)
    inputs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "asset_id long, text string")
    table = spark.createDataFrame([(1, "len", "v", "n", 9.0, "1", 0), (2, "len", "v", "n", 9.0, "0", 0)], schema.struct("asset_scores"))
    made, targets, done = scoring.run_scorer(Length, assets, table, inputs, 7)
    assert rows(made.filter("metric_key = 'n'"), "asset_id", "value", "scorer_version") == [(1, 9.0, "1"), (2, 2.0, "1"), (3, 3.0, "1")]
    assert targets.count() == 4 and done.count() == 2
    assert scoring.run_scorer(Length, assets, table, inputs, 7, skip_existing=False)[1].count() == 5
    assert Length().score_one({"text": "four"}) == {"n": 4, "half": 2.0}
    with pytest.raises(KeyError):
        scoring.run_by_id({}, "len")
    with pytest.raises(KeyError):
        Length("w")
    with pytest.raises(Exception, match="len/v on assets"):
        scoring.score_rows(Length, spark.createDataFrame([(1, "bad")], "asset_id long, text string")).collect()


def test_registered_specs(spark):
    assert [s.scorer_id for s in scoring.SPECS] == ["simple", "brisque", "aesthetic", "nsfw", "clip_iqa", "nima", "pyiqa", "cafe_style"]
    assert sum(len(s.variants) for s in scoring.SPECS) == 15 == len({(r["scorer_id"], r["variant_id"]) for r in scoring.spec_table(spark).collect()})
    assert [m.key for m in scoring.SPECS[5].metrics()] == ["nima_score"]


def test_score_arithmetic(spark):
    x = lambda v: F.lit(v).cast("double")
    got = spark.range(1).select(
        scoring.brisque_quality(x(30)), scoring.nima_score(x(0.5), "technical"), scoring.nima_score(x(None), "technical"), scoring.iqa_quality(x(50), "musiq"), scoring.iqa_quality(x(3), "niqe"),
        scoring.aesthetic(x(11)), scoring.sharpness(x(1000)), scoring.contrast(x(500)), scoring.brightness(x(None)), scoring.noise(x(5)),
        scoring.clip_quality(F.array(x(1), x(0)), [1.0, 0.0], [0.0, 1.0]), scoring.label_scores(F.create_map(F.lit("a"), x(0.3)), ["a", "b"]),
    ).first()
    assert tuple(got)[:10] == (70.0, 5.5, 1.0, 0.5, 0.25, 10.0, 50.0, 100.0, 0.0, 20.0)
    assert got[10] == pytest.approx(1.0) and got[11] == {"a": 0.3, "b": 0.0}


# Sources and ingestion.

FULL = '{"title": "p.jpg", "imageViews": "42", "creationTime": {"timestamp": "1686836581"}, "photoTakenTime": {"timestamp": "1686836381"}, "geoData": {"latitude": 48.0, "longitude": 11.0, "altitude": 520.0}, "favorited": true, "url": "u", "googlePhotosOrigin": {"mobileUpload": {"deviceType": "ANDROID_PHONE", "deviceFolder": {"localFolderName": "Camera"}}}, "appSource": {"androidPackageName": "app"}}'


def test_sidecars(spark):
    docs = [(1, FULL), (2, "{}"), (3, "no json"), (4, '{"imageViews": "many", "title": "t"}'), (5, '{"geoData": {}, "googlePhotosOrigin": {"webUpload": {"computerUpload": {}}, "fromPartnerSharing": {}}}')]
    got = {r["id"]: r for r in sidecar.parse(spark.createDataFrame(docs, "id long, json string")).collect()}
    one = got[1]
    assert (one["taken_at"], one["created_at_sidecar"], one["image_views"], one["geo_lat"], one["geo_exif_lat"]) == (1686836381, 1686836581, 42, 48.0, None)
    assert (one["origin_type"], one["origin_device_type"], one["origin_device_folder"], one["app_source_package"], one["favorited"]) == ("mobileUpload", "ANDROID_PHONE", "Camera", "app", True)
    assert (got[2]["valid"], got[2]["title"], got[2]["taken_at"], got[2]["favorited"]) == (True, "", None, None)
    assert not got[3]["valid"] and not got[4]["valid"] and got[4]["title"] is None
    assert (got[5]["geo_lat"], got[5]["origin_type"], got[5]["origin_device_type"]) == (0.0, "fromPartnerSharing", None)


def test_json_profile(spark):
    docs = spark.createDataFrame([('{"a": 1, "b": [1, "x"]}',), ('{"a": null}',), ("{",)], "json string")
    got = {r["path"]: r for r in json_schema.profile(docs).collect()}
    assert (got["$"]["seen"], got["$.a"]["kinds"], got["$.a"]["required"], got["$.b"]["required"]) == (2, ["integer", "null"], True, False)
    assert (got["$.b"]["min_items"], got["$.b[]"]["seen"], got["!"]["seen"]) == (2, 2, 1)


@pytest.fixture
def tree(tmp_path):
    def put(path, data):
        p = tmp_path / "photos" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)

    put("Photos from 2023/IMG 1.jpg", b"one")
    put("Photos from 2023/IMG 1.jpg.supplemental-metadata.json", FULL.encode())
    put("Trip+/copy.JPG", b"one")
    put("Trip+/b.png", b"two")
    put("Trip+/b.supplemental-metadata.json", b"no json")
    put("root.gif", b"three")
    put("notes.txt", b"text")
    return tmp_path


def test_index_of_a_tree_and_again(spark, tree):
    root = f"{tree}/photos"
    found = scan.images(scan.files(spark, root))
    assert [(r["relpath"], r["mime"], r["size_bytes"], r["sidecar_relpath"]) for r in sorted(found.collect(), key=lambda r: r["relpath"])] == [
        ("Photos from 2023/IMG 1.jpg", "image/jpeg", 3, "Photos from 2023/IMG 1.jpg.supplemental-metadata.json"),
        ("Trip+/b.png", "image/png", 3, "Trip+/b.supplemental-metadata.json"),
        ("Trip+/copy.JPG", "image/jpeg", 3, None),
        ("root.gif", "image/gif", 5, None),
    ]
    lib = Library(spark, f"file://{tree}/lib")
    for now in (1, 2):
        ingest.index(lib, root, now)
        assert rows(lib.read("assets"), "id", "relpath", "taken_at") == [(1, "Photos from 2023/IMG 1.jpg", 1686836381), (2, "Trip+/b.png", None), (3, "root.gif", None)]
        assert rows(lib.read("asset_paths"), "asset_id", "relpath") == [(1, "Trip+/copy.JPG")]
        assert rows(lib.read("albums"), "id", "name") == [(1, "Photos from 2023"), (2, "Trip+")]
        assert rows(lib.read("album_assets"), "album_id", "asset_id") == [(1, 1), (2, 1), (2, 2)]
    assert ingest.rescan(lib, root, 3).count() == 0
    with pytest.raises(FileNotFoundError):
        scan.files(spark, f"{tree}/nowhere")


def test_sidecar_stream_reads_each_file_once(spark, tree):
    from silverleaf.streaming import incremental

    seen = []
    lib = Library(spark, f"file://{tree}/lib")
    for _ in range(2):
        q = incremental.sidecar_stream(lib, f"{tree}/photos", f"{tree}/ckpt", lambda df, k: seen.extend(r["valid"] for r in df.collect()))
        q.awaitTermination(120)
    assert sorted(seen) == [False, True]
    queue = spark.createDataFrame([(5,)], "asset_id long")
    work = lambda q: q.withColumns({"phash_hex": F.lit("0f"), "algo": F.lit("dhash16"), "computed_at": F.lit(1)})
    assert incremental.derive(lib, "phash", queue, work) and not incremental.derive(lib, "phash", queue.limit(0), work)
    assert rows(lib.read("phash"), "asset_id", "phash_hex") == [(5, "0f")]


def test_registry(spark, tmp_path):
    from datetime import UTC, datetime

    from silverleaf.plans.registry import CHANGED, DEFAULTS, Registry

    reg = Registry(spark, f"file://{tmp_path}/registry/")
    assert reg.libraries().isEmpty() and reg.settings() == DEFAULTS
    for k, root in enumerate(["/photos/My Trip!", "/photos/b/", "/other/b", "/photos/My Trip!"]):
        reg.open(root, f"{root}/lib", datetime(2024, 1, 1 + k, tzinfo=UTC))
    found = reg.libraries().collect()
    assert [r["name"] for r in found] == ["My Trip!", "b", "b"] and len({r["id"] for r in found}) == 3
    assert found[0]["id"].startswith("My-Trip-") and found[0]["last_opened_at"].day == 4
    assert reg.set(batch_size=64, half_precision=False) == DEFAULTS | {"batch_size": 64, "half_precision": False} and reg.libraries().count() == 3
    for bad in ({"batch_size": 7}, {"other": 1}, {"accelerator": None}):
        with pytest.raises(ValueError):
            reg.set(**bad)
    later = [("batch_size", "x", datetime(2099, 1, 1)), ("accelerator", "onnx", datetime(2099, 1, 1)), ("unheard", "1", datetime(2099, 1, 1))]
    spark.createDataFrame(later, CHANGED).write.mode("append").parquet(f"{tmp_path}/registry/settings")
    assert reg.settings() == DEFAULTS | {"accelerator": "onnx", "half_precision": False}
