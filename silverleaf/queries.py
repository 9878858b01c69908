"""Registered queries over the test tables, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, text, vectors
from .operators import browse, cluster, dml, graph, reports, scoring, similarity
from .plans.params import Filters, SortCriterion
from .sources import json_schema
from .sources.adapters import duck, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LENGTH = SortCriterion("text", "default", "length")
QUALITY = SortCriterion("labels", "default", "quality")
TOXIC = SortCriterion("labels", "default", "toxic", descending=False)
#: A fixed query vector: the first stored one is what the SQL uses as well.
SEARCH, CLUSTER, HAMMING, WINDOW = 0.30, 0.40, 17, 200


def query(name: str, tables: str, sql: str | None = None, engine: str | None = None):
    """Register a function of the named tables; `engine` names those the SQL needs as well."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = tables.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*(table(spark, sf_dir, t) for t in names))

        QUERIES[name] = run
        if sql is not None:
            from .sources.adapters import VIEWS

            ORACLE_SQL[name] = duck(sql, *(t for t in (engine.split() if engine is not None else names) if t in VIEWS))
        return f

    return put


# Browsing.

_A = "id, relpath, taken_at, favorited"


@query("browse_plain", "assets", f"SELECT {_A} FROM assets ORDER BY taken_at DESC NULLS LAST, id LIMIT 50 OFFSET 50")
def _(assets):
    return browse.list_assets(assets, limit=50, offset=50).select(*_A.split(", "))


@query("browse_filtered", "assets", f"SELECT {_A} FROM assets WHERE favorited = TRUE AND archived = FALSE AND trashed = FALSE ORDER BY taken_at DESC NULLS LAST, id LIMIT 100")
def _(assets):
    return browse.list_assets(assets, Filters(True, False, False)).select(*_A.split(", "))


@query("browse_ext", "assets", f"SELECT {_A} FROM assets WHERE ext = '.de' ORDER BY taken_at DESC NULLS LAST, id LIMIT 100")
def _(assets):
    return browse.list_assets(assets, Filters(ext=".DE")).select(*_A.split(", "))


@query("count_plain", "assets", "SELECT count(*) AS n FROM assets WHERE favorited = FALSE")
def _(assets):
    return browse.count_assets(assets, Filters(favorited=False))


@query("browse_deduped", "assets", f"SELECT {_A} FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(sha256, id::VARCHAR) ORDER BY id) AS rn FROM assets WHERE archived = FALSE) WHERE rn = 1 ORDER BY taken_at DESC NULLS LAST, id LIMIT 100")
def _(assets):
    return browse.list_deduped(assets, Filters(archived=False)).select(*_A.split(", "))


@query("deduped_all", "assets", "SELECT min(id) AS id, count(*) AS copies FROM assets GROUP BY sha256")
def _(assets):
    sizes = assets.groupBy("sha256").agg(F.count("*").alias("copies"))
    return browse.deduped(assets).join(sizes, "sha256").select("id", "copies")


@query("count_deduped", "assets", "SELECT count(DISTINCT coalesce(sha256, id::VARCHAR)) AS n FROM assets WHERE favorited = TRUE")
def _(assets):
    return browse.count_deduped(assets, Filters(favorited=True))


@query("duplicates_of", "assets", "SELECT id, relpath FROM assets WHERE sha256 = (SELECT sha256 FROM assets GROUP BY sha256 ORDER BY count(*) DESC, sha256 LIMIT 1)")
def _(assets):
    top = assets.groupBy("sha256").count().orderBy(F.desc("count"), "sha256").first()
    return browse.duplicates_of(assets, top["sha256"]).select("id", "relpath")


@query("asset_by_id", "assets", "SELECT id, relpath, ext FROM assets WHERE id = 17")
def _(assets):
    return browse.by_id(assets, 17).select("id", "relpath", "ext")


@query("asset_by_alias", "assets", "SELECT id, ext FROM assets WHERE id = 5")
def _(assets):
    paths = assets.filter("id = 5").select(F.col("id").alias("asset_id"), F.lit("old/name.txt").alias("relpath"))
    return browse.by_relpath(assets, paths, "old/name.txt").select("id", "ext")


@query("lookup_sha256", "assets", "SELECT a.id, a.sidecar_relpath IS NOT NULL AS has_sidecar FROM assets a WHERE id = (SELECT min(id) FROM assets WHERE sha256 = (SELECT sha256 FROM assets WHERE id = 3))")
def _(assets):
    return browse.by_sha256(assets, browse.by_id(assets, 3).first()["sha256"])


@query("all_ids", "assets", "SELECT id FROM assets")
def _(assets):
    return browse.all_ids(assets)


@query("needing_rescan", "assets", "SELECT id, relpath, sidecar_relpath FROM assets WHERE indexer_version IS NULL OR indexer_version < 2")
def _(assets):
    return browse.needing_rescan(assets)


@query("count_needing_rescan", "assets", "SELECT count(*) AS n FROM assets WHERE indexer_version IS NULL OR indexer_version < 2")
def _(assets):
    return browse.needing_rescan(assets).agg(F.count("*").alias("n"))


@query("browse_by_score", "assets asset_scores", "SELECT id, relpath, value AS score FROM assets JOIN asset_scores ON asset_id = id WHERE scorer_id = 'text' AND variant_id = 'default' AND metric_key = 'length' ORDER BY value DESC, id LIMIT 50")
def _(assets, scores):
    return browse.list_by_score(assets, scores, LENGTH, limit=50).select("id", "relpath", "score")


@query("browse_by_score_range", "assets asset_scores", "SELECT id, relpath, value AS score FROM assets JOIN asset_scores ON asset_id = id WHERE scorer_id = 'text' AND metric_key = 'length' AND value >= 100 AND value <= 2000 AND favorited = TRUE ORDER BY value, id LIMIT 100 OFFSET 10")
def _(assets, scores):
    by = SortCriterion("text", "default", "length", False, 100.0, 2000.0)
    return browse.list_by_score(assets, scores, by, Filters(favorited=True), offset=10).select("id", "relpath", "score")


@query("count_by_score", "assets asset_scores", "SELECT count(*) AS n FROM assets JOIN asset_scores ON asset_id = id WHERE scorer_id = 'labels' AND metric_key = 'quality' AND value >= 1")
def _(assets, scores):
    return browse.count_with_score(assets, scores, SortCriterion("labels", "default", "quality", True, 1.0))


_MULTI = """
FROM assets JOIN asset_scores s1 ON s1.asset_id = id AND s1.scorer_id = 'text' AND s1.metric_key = 'length'
LEFT JOIN asset_scores s2 ON s2.asset_id = id AND s2.scorer_id = 'labels' AND s2.metric_key = 'quality'
LEFT JOIN asset_scores s3 ON s3.asset_id = id AND s3.scorer_id = 'labels' AND s3.metric_key = 'toxic'
"""


@query("browse_multi_sort", "assets asset_scores", f"SELECT id, s2.value AS score_1, s3.value AS score_2, s1.value AS score_3 {_MULTI} WHERE s2.value IS NOT NULL ORDER BY s2.value DESC NULLS LAST, s3.value ASC NULLS LAST, s1.value DESC NULLS LAST, id LIMIT 100")
def _(assets, scores):
    return browse.list_multi_sort(assets, scores, (QUALITY, TOXIC, LENGTH)).select("id", "score_1", "score_2", "score_3")


@query("browse_multi_sort_nulls_last", "assets asset_scores", f"SELECT id, s1.value AS score_1, s2.value AS score_2 {_MULTI} ORDER BY s1.value ASC NULLS LAST, s2.value ASC NULLS LAST, id")
def _(assets, scores):
    first = SortCriterion("text", "default", "length", False)
    return browse.list_multi_sort(assets, scores, (first, SortCriterion("labels", "default", "quality", False)), limit=None).select("id", "score_1", "score_2")


@query("count_multi_sort", "assets asset_scores", f"SELECT count(*) AS n {_MULTI} WHERE s2.value >= 1")
def _(assets, scores):
    return browse.count_multi_sort(assets, scores, (LENGTH, SortCriterion("labels", "default", "quality", True, 1.0)))


@query("scores_of_asset", "asset_scores", "SELECT scorer_id, variant_id, metric_key, value FROM asset_scores WHERE asset_id = (SELECT min(asset_id) FROM asset_scores WHERE scorer_id = 'labels')")
def _(scores):
    first = scores.filter("scorer_id = 'labels'").agg(F.min("asset_id")).first()[0]
    return browse.scores_of(scores, first).select("scorer_id", "variant_id", "metric_key", "value")


@query("score_metrics", "asset_scores", "SELECT DISTINCT scorer_id, variant_id, metric_key FROM asset_scores")
def _(scores):
    return browse.score_metrics(scores)


@query("score_facets", "asset_scores", "SELECT DISTINCT scorer_id, variant_id, metric_key, 'Text length' AS metric_name FROM asset_scores WHERE scorer_id = 'text'")
def _(scores):
    length = scoring.Spec("text", "Text", "1", (scoring.Variant("default", "Default", (scoring.Metric("length", "Text length"),)),))
    specs = scoring.spec_table(scores.sparkSession, (*scoring.SPECS, length))
    return browse.score_facets(scores, specs).select("scorer_id", "variant_id", "metric_key", "metric_name")


@query("missing_scores", "assets asset_scores", "SELECT id FROM assets WHERE id NOT IN (SELECT asset_id FROM asset_scores WHERE scorer_id = 'labels' AND metric_key = 'quality')")
def _(assets, scores):
    return browse.without_score(assets, scores, "labels", "default", "quality")


@query("stale_scores", "assets asset_scores", "SELECT id FROM assets WHERE id NOT IN (SELECT asset_id FROM asset_scores WHERE scorer_id = 'labels' AND metric_key = 'toxic' AND scorer_version = '1')")
def _(assets, scores):
    return browse.without_score(assets, scores, "labels", "default", "toxic", "1")


@query("missing_phash", "assets phash", "SELECT id FROM assets WHERE id NOT IN (SELECT asset_id FROM phash WHERE algo = 'dhash16')")
def _(assets, phash):
    return browse.without_phash(assets, phash, "dhash16")


@query("missing_embedding", "assets clip_embeddings", "SELECT id FROM assets WHERE id NOT IN (SELECT asset_id FROM clip_embeddings)")
def _(assets, embeddings):
    return browse.without_embedding(assets, embeddings)


@query("missing_faces", "assets face_embeddings", "SELECT id FROM assets WHERE id NOT IN (SELECT asset_id FROM face_embeddings WHERE run_id = 2)")
def _(assets, faces):
    return browse.without_faces(assets, faces, 2)


@query("embeddings_with_paths", "clip_embeddings assets", "SELECT asset_id, relpath FROM clip_embeddings JOIN assets ON id = asset_id")
def _(embeddings, assets):
    return browse.embeddings_with_paths(embeddings, assets).select("asset_id", "relpath")


@query("timeline_range", "order_assets", "SELECT min(taken_at) AS oldest, max(taken_at) AS newest FROM order_assets")
def _(assets):
    return browse.taken_range(assets)


@query("timeline_years", "order_assets", "SELECT year(make_timestamp(min(taken_at) * 1000000))::BIGINT AS first_year, year(make_timestamp(max(taken_at) * 1000000))::BIGINT AS last_year FROM order_assets")
def _(assets):
    return browse.taken_range(assets).select(text.year_utc(F.col("oldest")).alias("first_year"), text.year_utc(F.col("newest")).alias("last_year"))


@query("timeline_seek", "assets", "SELECT greatest(1, count(DISTINCT coalesce(sha256, id::VARCHAR)) // 50 + 1)::BIGINT AS page FROM assets WHERE taken_at > 1550000000")
def _(assets):
    return browse.seek_page(assets, 1_550_000_000)


@query("count_newer", "assets", "SELECT count(*) AS n FROM assets WHERE taken_at > 1550000000 AND favorited = TRUE")
def _(assets):
    return browse.count_newer(assets, 1_550_000_000, True)


# Reports.


@query("cluster_run_report", "clustering_runs clusters cluster_members", "SELECT r.id, r.created_at, count(DISTINCT c.id) AS n_clusters, min(CASE WHEN c.id = (SELECT min(x.id) FROM clusters x WHERE x.run_id = r.id) THEN m.asset_id END) AS rep_asset_id FROM clustering_runs r LEFT JOIN clusters c ON c.run_id = r.id LEFT JOIN cluster_members m ON m.cluster_id = c.id AND m.is_representative GROUP BY r.id, r.created_at")
def _(runs, clusters, members):
    return reports.clustering_runs(runs, clusters, members).select("id", "created_at", "n_clusters", "rep_asset_id")


@query("cluster_list", "clusters cluster_members order_assets", "SELECT c.id, count(*) AS member_count, min(CASE WHEN is_representative THEN asset_id END) AS rep_asset_id FROM clusters c JOIN cluster_members m ON m.cluster_id = c.id WHERE c.run_id = 7 GROUP BY c.id")
def _(clusters, members, assets):
    return reports.clusters_of_run(clusters, members, assets, 7).select("id", "member_count", "rep_asset_id")


@query("cluster_list_all", "clusters cluster_members order_assets", "SELECT c.id, count(*) AS member_count, min(CASE WHEN is_representative THEN asset_id END) AS rep_asset_id FROM clusters c JOIN cluster_members m ON m.cluster_id = c.id GROUP BY c.id ORDER BY member_count DESC, c.id LIMIT 50 OFFSET 50")
def _(clusters, members, assets):
    return reports.clusters_with_representatives(clusters, members, assets, 50, 50).select("id", "member_count", "rep_asset_id")


@query("cluster_members", "cluster_members order_assets", "SELECT a.id, a.relpath, distance, is_representative FROM cluster_members JOIN order_assets a ON a.id = asset_id WHERE cluster_id = (SELECT min(cluster_id) FROM cluster_members)")
def _(members, assets):
    first = members.agg(F.min("cluster_id")).first()[0]
    return reports.cluster_members(members, assets, first).select("id", "relpath", "distance", "is_representative")


@query("cluster_hashes", "face_cluster_members phash", "SELECT face_id AS asset_id, CASE WHEN algo = 'dhash16' THEN phash_hex END AS phash_hex FROM face_cluster_members LEFT JOIN phash ON asset_id = face_id WHERE cluster_id = 0")
def _(members, phash):
    return reports.cluster_hashes(members.withColumnRenamed("face_id", "asset_id"), phash.filter("algo = 'dhash16'"), 0)


_BEST = "SELECT cluster_id, asset_id, score FROM (SELECT cluster_id, m.asset_id, score, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC NULLS LAST, is_representative DESC, m.asset_id) AS rn FROM cluster_members m LEFT JOIN (SELECT asset_id, value AS score FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY variant_id) AS k FROM order_scores) WHERE k = 1) s ON s.asset_id = m.asset_id) WHERE rn = 1"


@query("best_of_cluster", "cluster_members order_scores", _BEST)
def _(members, scores):
    return reports.best_of_cluster(members, scores, "price", "total")


@query("export_manifest", "cluster_members order_scores order_assets", f"SELECT '/in/' || relpath AS source, '/out/' || format('cluster{{:06d}}_', cluster_id) || id::VARCHAR AS target FROM ({_BEST}) b JOIN order_assets ON id = b.asset_id")
def _(members, scores, assets):
    return reports.export_manifest(reports.best_of_cluster(members, scores, "price", "total"), assets, "/in", "/out")


@query("face_run_report", "face_detection_runs face_embeddings", "SELECT r.id, r.model_id, count(f.id) AS n_faces FROM face_detection_runs r LEFT JOIN face_embeddings f ON f.run_id = r.id GROUP BY r.id, r.model_id")
def _(runs, faces):
    return reports.detection_runs(runs, faces).select("id", "model_id", "n_faces")


@query("latest_run", "face_detection_runs", "SELECT id FROM face_detection_runs ORDER BY (finished_at IS NOT NULL) DESC, coalesce(finished_at, started_at) DESC, id DESC LIMIT 1")
def _(runs):
    return reports.latest_detection_run(runs)


_FACE_JOIN = "LEFT JOIN face_clusters c ON c.run_id = r.id LEFT JOIN face_cluster_members m ON m.cluster_id = c.id LEFT JOIN face_embeddings f ON f.id = m.face_id"


@query("face_cluster_run_report", "face_cluster_runs face_clusters face_cluster_members face_embeddings", f"SELECT r.id, r.method, count(DISTINCT c.id) AS n_clusters, count(m.face_id) AS n_faces, count(DISTINCT f.asset_id) AS n_assets, min(CASE WHEN m.is_representative THEN f.asset_id END) AS rep_asset_id FROM face_cluster_runs r {_FACE_JOIN} GROUP BY r.id, r.method")
def _(runs, clusters, members, faces):
    return reports.face_cluster_runs(runs, clusters, members, faces).select("id", "method", "n_clusters", "n_faces", "n_assets", "rep_asset_id")


@query("face_cluster_report", "face_clusters face_cluster_members face_embeddings", "SELECT c.id, c.label, count(*) AS n_faces, count(DISTINCT f.asset_id) AS n_assets, min(CASE WHEN m.is_representative THEN f.asset_id END) AS rep_asset_id FROM face_clusters c JOIN face_cluster_members m ON m.cluster_id = c.id JOIN face_embeddings f ON f.id = m.face_id WHERE c.run_id = 1 GROUP BY c.id, c.label")
def _(clusters, members, faces):
    return reports.face_clusters(clusters, members, faces, 1)


@query("face_cluster_assets", "face_cluster_members face_embeddings assets", "SELECT face_id, f.asset_id, a.filename, round(distance, 6) AS distance, is_representative::INT AS is_representative FROM face_cluster_members JOIN face_embeddings f ON f.id = face_id JOIN assets a ON a.id = f.asset_id WHERE cluster_id = 3")
def _(members, faces, assets):
    boxed = faces.withColumns({c: F.lit(0.0) for c in ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "det_score")})
    return reports.face_cluster_assets(members, boxed, assets, 3).select("face_id", "asset_id", "filename", F.round("distance", 6).alias("distance"), "is_representative")


@query("album_list", "albums album_assets assets", "SELECT b.id, b.name, count(l.asset_id) AS n_assets, (SELECT a.id FROM album_assets x JOIN assets a ON a.id = x.asset_id WHERE x.album_id = b.id ORDER BY taken_at DESC NULLS LAST, a.id LIMIT 1) AS cover_asset_id FROM albums b LEFT JOIN album_assets l ON l.album_id = b.id GROUP BY b.id, b.name")
def _(albums, links, assets):
    return reports.albums(albums, links, assets).select("id", "name", "n_assets", "cover_asset_id")


@query("album_assets_page", "album_assets assets", "SELECT id, filename, taken_at FROM album_assets JOIN assets ON id = asset_id WHERE album_id = 2 ORDER BY taken_at DESC NULLS LAST, filename, id LIMIT 20 OFFSET 5")
def _(links, assets):
    return reports.album_assets(links, assets, 2, 20, 5).select("id", "filename", "taken_at")


@query("count_album_assets", "album_assets", "SELECT count(*) AS n FROM album_assets WHERE album_id = 4")
def _(links):
    return reports.count_album_assets(links, 4)


# Writes: the resulting tables.

_SCORE = "asset_id, scorer_id, variant_id, metric_key, value, scorer_version"
_NEW_SCORES = "SELECT doc_id AS asset_id, 'labels' AS scorer_id, 'default' AS variant_id, 'quality' AS metric_key, 0.5::DOUBLE AS value, '9' AS scorer_version FROM documents"


@query("upsert_scores", "asset_scores documents", f"SELECT {_SCORE} FROM asset_scores s WHERE NOT (scorer_id = 'labels' AND metric_key = 'quality') UNION ALL {_NEW_SCORES}")
def _(scores, documents):
    new = documents.select(F.col("doc_id").alias("asset_id"), F.lit("quality").alias("metric_key"), F.lit(0.5).alias("value"))
    return dml.upsert_scores(scores, new, "labels", "default", "9", 0).select(*_SCORE.split(", "))


@query("upsert_partial_columns", "clusters customer", "SELECT id, method, c_name AS params_json, run_id FROM clusters JOIN customer ON c_custkey = id UNION ALL SELECT c_custkey + 10000000, NULL, c_name, NULL FROM customer")
def _(clusters, customer):
    own = customer.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("params_json"))
    other = own.withColumn("id", F.col("id") + 10_000_000)
    return dml.upsert_columns(clusters, own.unionByName(other), ["id"]).select("id", "method", "params_json", "run_id")


@query("insert_or_ignore", "cluster_members", "SELECT cluster_id, asset_id, distance FROM cluster_members UNION ALL SELECT -1, asset_id, min(distance) FROM cluster_members GROUP BY asset_id")
def _(members):
    other = members.withColumn("cluster_id", F.lit(-1).cast("long"))
    again = members.withColumn("distance", F.lit(-5.0))
    return dml.insert_or_ignore(members, again.unionByName(other), ["cluster_id", "asset_id"]).select("cluster_id", "asset_id", "distance")


@query("delete_run_cascade", "clustering_runs clusters cluster_members", "SELECT 'run' AS kind, id AS a, 0::BIGINT AS b FROM clustering_runs WHERE id <> 3 UNION ALL SELECT 'cluster', id, run_id FROM clusters WHERE run_id <> 3 UNION ALL SELECT 'member', cluster_id, asset_id FROM cluster_members WHERE cluster_id NOT IN (SELECT id FROM clusters WHERE run_id = 3)")
def _(runs, clusters, members):
    r, c, m = dml.delete_clustering_run(runs, clusters, members, 3)
    zero = F.lit(0).cast("long")
    return (
        r.select(F.lit("run").alias("kind"), F.col("id").alias("a"), zero.alias("b"))
        .unionByName(c.select(F.lit("cluster").alias("kind"), F.col("id").alias("a"), F.col("run_id").alias("b")))
        .unionByName(m.select(F.lit("member").alias("kind"), F.col("cluster_id").alias("a"), F.col("asset_id").alias("b")))
    )


@query("delete_null_safe", "clusters cluster_members", "SELECT id, method, params_json FROM clusters WHERE NOT (method = 'BUILDING' AND params_json IS NULL)")
def _(clusters, members):
    return dml.delete_clusters(clusters, members, "BUILDING", None)[0].select("id", "method", "params_json")


@query("face_run_closure", "face_detection_runs face_cluster_runs face_clusters face_cluster_members face_embeddings", "SELECT DISTINCT c.id FROM face_clusters c LEFT JOIN face_cluster_runs r ON r.id = c.run_id LEFT JOIN face_cluster_members m ON m.cluster_id = c.id LEFT JOIN face_embeddings f ON f.id = m.face_id WHERE r.detection_run_id = 2 OR f.run_id = 2")
def _(runs, cluster_runs, clusters, members, faces):
    return dml.face_run_closure(runs, cluster_runs, clusters, members, faces, 2)[1]


@query("delete_face_run", "face_detection_runs face_cluster_runs face_clusters face_cluster_members face_embeddings", "SELECT m.cluster_id, m.face_id FROM face_cluster_members m WHERE m.cluster_id NOT IN (SELECT c.id FROM face_clusters c LEFT JOIN face_cluster_runs r ON r.id = c.run_id LEFT JOIN face_cluster_members m ON m.cluster_id = c.id LEFT JOIN face_embeddings f ON f.id = m.face_id WHERE r.detection_run_id = 2 OR f.run_id = 2)")
def _(runs, cluster_runs, clusters, members, faces):
    return dml.delete_face_run(runs, cluster_runs, clusters, members, faces, 2)[3].select("cluster_id", "face_id")


@query("append_with_ids", "albums documents", "SELECT id, name FROM albums UNION ALL SELECT (SELECT max(id) FROM albums) + row_number() OVER (ORDER BY n), n FROM (SELECT DISTINCT 'new ' || lang AS n FROM documents)")
def _(albums, documents):
    new = documents.select(F.concat(F.lit("new "), "lang").alias("name")).distinct()
    return dml.append_with_ids(albums.select("id", "name"), new, ["name"])


@query("canonical_and_aliases", "assets", "SELECT relpath, min(id) OVER (PARTITION BY sha256) AS canonical FROM assets")
def _(assets):
    first = assets.groupBy("sha256").agg(F.min("id").alias("canonical"))
    return assets.join(first, "sha256").select("relpath", "canonical")


@query("rename_and_finish", "face_detection_runs", "SELECT id, CASE WHEN id = 4 THEN 77 ELSE finished_at END AS finished_at FROM face_detection_runs")
def _(runs):
    return dml.finish_run(runs, 4, 77).select("id", "finished_at")


# Vectors and hashes. The query vector is the first stored one.

_DOT = "list_inner_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_NORM = "(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"


def _similar(metric: str, threshold: float, embeddings: DataFrame) -> DataFrame:
    return similarity.similar_to_asset(embeddings, 0, metric, threshold)


def _similar_sql(score: str, test: str) -> str:
    return f"SELECT asset_id, score FROM (SELECT a.asset_id, round({score}, 4) AS score FROM clip_embeddings a, clip_embeddings q WHERE q.asset_id = 0 AND a.asset_id <> 0) WHERE {test}"


query("similar_cosine", "clip_embeddings", _similar_sql(f"{_DOT} / {_NORM}", "score >= 0.1"))(partial(_similar, "cosine", 0.1))
query("similar_euclidean", "clip_embeddings", _similar_sql(f"sqrt(greatest(0, 2 - 2 * {_DOT} / {_NORM}))", "score <= 1.35"))(partial(_similar, "euclidean", 1.35))
query("similar_angular", "clip_embeddings", _similar_sql(f"acos(greatest(-1, least(1, {_DOT} / {_NORM})))", "score <= 1.45"))(partial(_similar, "combined", 1.45))


@query("search_topk", "clip_embeddings", f"SELECT a.asset_id, round({_DOT}, 4) AS score FROM clip_embeddings a, clip_embeddings q WHERE q.asset_id = 7 ORDER BY score DESC, a.asset_id LIMIT 20 OFFSET 20")
def _(embeddings):
    vector = embeddings.filter("asset_id = 7").first()["embedding"]
    return similarity.search(embeddings, list(vector), 20, 2)


_UNIT = "list_transform({v}::DOUBLE[], lambda x: x / sqrt(list_inner_product({v}::DOUBLE[], {v}::DOUBLE[])))"


_SIM = f"round(list_inner_product({_UNIT.format(v='a.embedding')}, {_UNIT.format(v='q.embedding')}), 4)"


@query("vocab_topk", "embeddings", f"SELECT asset_id, term, score FROM (SELECT a.vec_id AS asset_id, 'term ' || q.label AS term, {_SIM} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, 'term ' || q.label) AS rn FROM embeddings a, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q) WHERE rn <= 3")
def _(embeddings):
    terms = embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.concat(F.lit("term "), "label").alias("term"), "vector")
    return similarity.terms_of_assets(embeddings.select(F.col("vec_id").alias("asset_id"), "embedding"), terms, 3)


@query("centroids", "face_cluster_members clip_embeddings", f"SELECT cluster_id, round(m[1] / sqrt(list_inner_product(m, m)), 4) AS first, len(m)::BIGINT AS dim FROM (SELECT cluster_id, list(x ORDER BY k) AS m FROM (SELECT label::BIGINT AS cluster_id, k, avg(u[k]) AS x FROM (SELECT label, {_UNIT.format(v='embedding')} AS u FROM embeddings), (SELECT unnest(range(1, 65)) AS k) GROUP BY label, k) GROUP BY cluster_id)", "")
def _(members, embeddings):
    rows = members.withColumnRenamed("face_id", "asset_id").join(embeddings, "asset_id")
    return similarity.centroids(rows, "cluster_id").select("cluster_id", F.round(F.get("centroid", 0), 4).alias("first"), F.size("centroid").cast("long").alias("dim"))


_MEAN = "SELECT g, list(x / length ORDER BY k) AS c FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY g)) AS length FROM (SELECT g, k, avg(u[k]) AS x FROM ({units}), (SELECT unnest(range(1, 65)) AS k) GROUP BY g, k)) GROUP BY g"
_GROUP_UNITS = f"SELECT label AS g, {_UNIT.format(v='embedding')} AS u FROM embeddings WHERE label = 2"


@query("similar_to_group", "face_cluster_members clip_embeddings", f"SELECT asset_id, score FROM (SELECT vec_id AS asset_id, round(list_inner_product({_UNIT.format(v='embedding')}, c), 4) AS score FROM embeddings, ({_MEAN.format(units=_GROUP_UNITS)}) WHERE label <> 2) WHERE score >= 0.05 ORDER BY score DESC, asset_id LIMIT 50", "")
def _(members, embeddings):
    own = members.filter("cluster_id = 2").select(F.col("face_id").alias("asset_id"))
    return similarity.similar_to_group(embeddings, own, 0.05)


_SCALED = "round((embedding[{k}]::DOUBLE - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE), 4)"


@query("vector_minmax", "clip_embeddings", f"SELECT asset_id, {_SCALED.format(k=1)} AS x, {_SCALED.format(k=2)} AS y, {_SCALED.format(k=64)} AS z FROM clip_embeddings")
def _(embeddings):
    scaled = vectors.min_max(F.col("embedding"))
    return embeddings.select("asset_id", *(F.get(scaled, k).alias(c) for k, c in ((0, "x"), (1, "y"), (63, "z"))))


@query("phash_list", "phash", "SELECT asset_id, phash_hex FROM phash WHERE algo = 'dhash16'")
def _(phash):
    return browse.phashes(phash, "dhash16")


_HAMMING = "bit_count(xor(('0x' || a.phash_hex)::BIGINT, ('0x' || b.phash_hex)::BIGINT))::BIGINT"


@query("similar_hamming", "phash", f"SELECT a.asset_id, {_HAMMING} AS score FROM phash a, phash b WHERE b.asset_id = 1 AND a.asset_id <> 1 AND {_HAMMING} <= 24")
def _(phash):
    return similarity.hash_similar_to_asset(phash, 1, 24.9)


@query("hamming_pairs_windowed", "phash", f"SELECT a.asset_id AS a, b.asset_id AS b, {_HAMMING} AS distance FROM (SELECT *, row_number() OVER (ORDER BY phash_hex, asset_id) AS k FROM phash) a JOIN (SELECT *, row_number() OVER (ORDER BY phash_hex, asset_id) AS k FROM phash) b ON b.k > a.k AND b.k - a.k <= {WINDOW} WHERE {_HAMMING} <= {HAMMING}")
def _(phash):
    return cluster.windowed_hash_edges(phash, HAMMING, WINDOW)


_PAIRS = f"SELECT a.asset_id AS a, q.asset_id AS b, {_DOT} / {_NORM} AS c FROM clip_embeddings a JOIN clip_embeddings q ON a.asset_id < q.asset_id"


@query("similarity_edges", "clip_embeddings", f"SELECT a, b, round(c, 4) AS cosine FROM ({_PAIRS}) WHERE c >= {CLUSTER}")
def _(embeddings):
    return cluster.vector_edges(embeddings, "cosine", CLUSTER).withColumn("cosine", F.round("cosine", 4))


_COMPONENTS = f"edges AS (SELECT a, b FROM ({_PAIRS}) WHERE c >= {CLUSTER}), both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.seen FROM reach r JOIN both_ways e ON e.a = r.node), comp AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)"


@query("components", "clip_embeddings")
def _(embeddings):
    return graph.components(cluster.vector_edges(embeddings, "cosine", CLUSTER))


ORACLE_SQL["components"] = duck("SELECT node, root FROM comp", "clip_embeddings").replace(" SELECT node, root FROM comp", f", {_COMPONENTS} SELECT node, root FROM comp")


@query("component_diameter", "clip_embeddings")
def _(embeddings):
    found = graph.components(cluster.vector_edges(embeddings, "cosine", CLUSTER)).withColumnRenamed("node", "asset_id")
    return cluster.diameters(found, embeddings, "root")


ORACLE_SQL["component_diameter"] = duck("SELECT 1", "clip_embeddings").replace(" SELECT 1", f", {_COMPONENTS} SELECT x.root, round(min({_DOT} / {_NORM}), 4) AS least_cosine FROM comp x JOIN comp y ON x.root = y.root AND x.node < y.node JOIN clip_embeddings a ON a.asset_id = x.node JOIN clip_embeddings q ON q.asset_id = y.node GROUP BY x.root")


@query("component_medoid", "clip_embeddings")
def _(embeddings):
    found = graph.components(cluster.vector_edges(embeddings, "cosine", CLUSTER)).withColumnRenamed("node", "asset_id")
    return similarity.medoids(found.join(embeddings, "asset_id"), "root").withColumn("distance", F.round("distance", 4))


_COMP_UNITS = f"SELECT root AS g, node, {_UNIT.format(v='embedding')} AS u FROM comp JOIN embeddings ON vec_id = node"
ORACLE_SQL["component_medoid"] = duck("SELECT 1", "clip_embeddings").replace(" SELECT 1", f", {_COMPONENTS}, units AS ({_COMP_UNITS}), centres AS ({_MEAN.format(units='SELECT g, u FROM units')}) SELECT root, asset_id, round(1 - sim, 4) AS distance FROM (SELECT u.g AS root, u.node AS asset_id, round(list_inner_product(u.u, c.c), 9) AS sim, row_number() OVER (PARTITION BY u.g ORDER BY round(list_inner_product(u.u, c.c), 9) DESC, u.node) AS rn FROM units u JOIN centres c ON c.g = u.g) WHERE rn = 1")


@query("hash_clusters", "phash")
def _(phash):
    return cluster.hash_clusters(phash, HAMMING, WINDOW, algo=None)[0]


@query("complete_linkage", "clip_embeddings")
def _(embeddings):
    found = cluster.vector_clusters(embeddings, "cosine", CLUSTER)[0]
    return found.select("cluster_id", "asset_id", F.round("diameter", 4).alias("diameter"))


@query("dbscan", "clip_embeddings")
def _(embeddings):
    return cluster.dbscan(embeddings, 1 - CLUSTER, 3)


_DBSCAN = f"edges AS (SELECT a, b FROM ({_PAIRS}) WHERE c >= {CLUSTER}), both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), core AS (SELECT a AS p FROM both_ways GROUP BY a HAVING count(*) + 1 >= 3), inner_edges AS (SELECT a, b FROM both_ways WHERE a IN (SELECT p FROM core) AND b IN (SELECT p FROM core)), reach(node, seen) AS (SELECT p, p FROM core UNION SELECT e.b, r.seen FROM reach r JOIN inner_edges e ON e.a = r.node), comp AS (SELECT node, min(seen) AS root FROM reach GROUP BY node)"
ORACLE_SQL["dbscan"] = duck("SELECT 1", "clip_embeddings").replace(" SELECT 1", f", {_DBSCAN} SELECT node AS asset_id, root AS cluster_id FROM comp UNION ALL SELECT e.a, min(root) FROM both_ways e JOIN comp ON node = e.b WHERE e.a NOT IN (SELECT p FROM core) GROUP BY e.a")


@query("face_clusters", "face_embeddings")
def _(faces):
    return cluster.face_clusters(faces, "dbscan", 1 - CLUSTER, 2).withColumn("distance", F.round("distance", 4))


@query("hdbscan", "face_embeddings")
def _(faces):
    return cluster.hdbscan(faces.withColumn("asset_id", F.col("id")), 2, 2, "run_id")


@query("kmeans_sizes", "clip_embeddings")
def _(embeddings):
    from pyspark.ml.functions import array_to_vector

    points = embeddings.select("asset_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("f"))
    return cluster.kmeans(points, "f", 10).groupBy("label").agg(F.count("*").alias("n"))


@query("embedding_map", "clip_embeddings")
def _(embeddings):
    return cluster.embedding_map(embeddings)[0]


# JSON, text, tags.


@query("json_fields", "events", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(events):
    return events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("json_schema", "events", "SELECT '$' AS path, count(*) AS seen, NULL::BOOLEAN AS required, '' AS examples FROM events UNION ALL SELECT '$.k', count(*), TRUE, array_to_string(list_sort(list(DISTINCT props->>'$.k'))[:3], ' ') FROM events WHERE json_exists(props, '$.k')")
def _(events):
    return json_schema.profile(events, "props").select("path", "seen", "required", F.array_join("examples", " ").alias("examples"))


@query("format_paths", "assets", "SELECT id, format('thumbs/{:04d}/{:d}.jpg', id // 1000, id) AS thumb, '/lib/' || relpath AS full, split_part(relpath, '/', 1) AS album FROM assets")
def _(assets):
    return assets.select("id", text.thumbnail_path(F.col("id")).alias("thumb"), text.absolute("/lib", F.col("relpath")).alias("full"), text.album_of(F.col("relpath")).alias("album"))


@query("humanize_size", "assets", "SELECT id, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN size_bytes // 1024 || ' KB' ELSE size_bytes // 1048576 || ' MB' END AS size FROM assets")
def _(assets):
    return assets.select("id", text.human_size(F.col("size_bytes")).alias("size"))


@query("when_utc", "assets", "SELECT id, coalesce(strftime(make_timestamp(taken_at * 1000000), '%Y-%m-%d %H:%M UTC'), '—') AS shown, year(make_timestamp(taken_at * 1000000))::BIGINT AS year FROM assets")
def _(assets):
    return assets.select("id", text.when_utc(F.col("taken_at")).alias("shown"), text.year_utc(F.col("taken_at")).alias("year"))


@query("slugs", "documents", "SELECT DISTINCT regexp_replace(source || ' / ' || lang, '[^A-Za-z0-9._-]+', '-', 'g') || '-' || substr(sha256(source || ' / ' || lang), 1, 12) AS slug FROM documents")
def _(documents):
    return documents.select(text.slug(F.concat("source", F.lit(" / "), "lang")).alias("slug")).distinct()


@query("score_arithmetic", "documents", "SELECT doc_id, 100 - greatest(0, least(100, n_chars / 10.0::DOUBLE)) AS brisque, 1 / (1 + greatest(0, n_chars::DOUBLE)) AS niqe, greatest(1, least(10, n_chars / 1000.0::DOUBLE * 9 + 1)) AS nima FROM documents")
def _(documents):
    n = F.col("n_chars").cast("double")
    return documents.select("doc_id", scoring.brisque_quality(n / 10).alias("brisque"), scoring.iqa_quality(n, "niqe").alias("niqe"), scoring.nima_score(n / 1000, "technical").alias("nima"))


@query("tags_union_except", "benchmark documents", "SELECT term, bool_or(tag) AS user_tag FROM (SELECT text AS term, FALSE AS tag FROM benchmark UNION ALL SELECT text, TRUE FROM documents) GROUP BY term")
def _(benchmark, documents):
    vocabulary = benchmark.select(F.col("text").alias("term"), F.col("item_id").alias("ord"))
    return reports.vocabulary_with_tags(vocabulary, documents.select(F.col("text").alias("term")))


@query("presets_upsert", "nation", "SELECT CASE WHEN n_nationkey < 20 THEN n_nationkey::BIGINT ELSE n_nationkey::BIGINT END AS id, n_name AS name, 5::BIGINT AS created_at, 9::BIGINT AS updated_at FROM nation")
def _(nation):
    presets = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit(5).cast("long").alias("created_at"), F.lit(6).cast("long").alias("updated_at"))
    return dml.upsert_presets(presets, nation.select(F.col("n_name").alias("name")), 9)


@query("events_per_day", "events", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(events):
    from .streaming.incremental import windowed_counts

    return windowed_counts(events, "ts", "event_type")


@query("gradient_hash", "clip_embeddings", "SELECT asset_id, lpad(lower(to_hex(list_reduce(list_transform(range(60), lambda k: CASE WHEN embedding[k // 15 * 16 + k % 15 + 1] > embedding[k // 15 * 16 + k % 15 + 2] THEN 1::BIGINT << k ELSE 0 END), lambda a, b: a | b))), 15, '0') AS phash_hex FROM clip_embeddings")
def _(embeddings):
    return embeddings.select("asset_id", bits.gradient_hash(F.col("embedding"), 4, 15).alias("phash_hex"))


from . import queries_more  # noqa: E402,F401  (registers itself)
