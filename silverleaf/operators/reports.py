"""Run, cluster, face and album reports.

Counts are aggregated before they are joined, so no join fans out. Where a group has
several representatives the smallest id stands for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .browse import matching, page  # noqa: F401  (re-exported for album pages)


def _count(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias(name))


def _or_zero(name: str):
    return F.coalesce(name, F.lit(0).cast("long")).alias(name)


def representatives(members: DataFrame, item: str = "asset_id") -> DataFrame:
    """(cluster_id, rep): one representative of each cluster that has any."""
    return members.filter("is_representative").groupBy("cluster_id").agg(F.min(item).alias("rep"))


# Clustering runs and clusters.


def clustering_runs(runs: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Each run with its number of clusters and its first cluster's representative, newest first."""
    per_run = clusters.groupBy(F.col("run_id").alias("id")).agg(F.count("id").alias("n_clusters"), F.min("id").alias("cluster_id"))
    rows = runs.join(per_run, "id", "left").join(representatives(members), "cluster_id", "left")
    return rows.select("id", "method", "params_json", "created_at", "n_skipped", _or_zero("n_clusters"), F.col("rep").alias("rep_asset_id")).orderBy(F.desc("created_at"), F.desc("id"))


def clusters_of_run(clusters: DataFrame, members: DataFrame, assets: DataFrame, run_id: int | None = None) -> DataFrame:
    """Clusters that have a representative, largest first; of one run or of all."""
    own = clusters if run_id is None else clusters.filter(F.col("run_id") == run_id)
    sizes = _count(members, "cluster_id", "member_count")
    rows = own.join(sizes, own.id == sizes.key).join(representatives(members), own.id == F.col("cluster_id"))
    named = rows.join(assets.select(F.col("id").alias("rep"), F.col("relpath").alias("rep_relpath")), "rep")
    return named.select("id", "run_id", "method", "diameter", "member_count", F.col("rep").alias("rep_asset_id"), "rep_relpath").orderBy(F.desc("member_count"), "id")


def clusters_with_representatives(clusters: DataFrame, members: DataFrame, assets: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return page(clusters_of_run(clusters, members, assets), limit, offset)


def cluster_members(members: DataFrame, assets: DataFrame, cluster_id: int) -> DataFrame:
    own = members.filter(F.col("cluster_id") == cluster_id).select(F.col("asset_id").alias("id"), "distance", "is_representative")
    return assets.join(own, "id").orderBy(F.desc("is_representative"), "id")


def cluster_hashes(members: DataFrame, phash: DataFrame, cluster_id: int) -> DataFrame:
    own = members.filter(F.col("cluster_id") == cluster_id).select("asset_id")
    return own.join(phash.select("asset_id", "phash_hex"), "asset_id", "left").orderBy("asset_id")


def best_of_cluster(members: DataFrame, scores: DataFrame, scorer_id: str, metric_key: str) -> DataFrame:
    """(cluster_id, asset_id, score): the highest score, else the representative, else the smallest id.

    An asset's score is that of its first variant by name.
    """
    own = scores.filter((F.col("scorer_id") == scorer_id) & (F.col("metric_key") == metric_key))
    first = own.groupBy("asset_id").agg(F.min_by("value", "variant_id").alias("score"))
    order = [F.desc_nulls_last("score"), F.desc("is_representative"), F.asc("asset_id")]
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(*order))
    return members.join(first, "asset_id", "left").withColumn("rn", rank).filter("rn = 1").select("cluster_id", "asset_id", "score")


def export_manifest(best: DataFrame, assets: DataFrame, root: str, target: str) -> DataFrame:
    """(source, target): where the best of each cluster is, and the name that it is copied to."""
    name = F.concat(F.format_string("cluster%06d_", "cluster_id"), F.element_at(F.split("relpath", "/"), -1))
    return best.join(assets.select(F.col("id").alias("asset_id"), "relpath"), "asset_id").select(F.concat_ws("/", F.lit(root), "relpath").alias("source"), F.concat_ws("/", F.lit(target), name).alias("target"))


# Faces.


def detection_runs(runs: DataFrame, faces: DataFrame) -> DataFrame:
    n = _count(faces, "run_id", "n_faces")
    return runs.join(n, runs.id == n.key, "left").select(*runs.columns, _or_zero("n_faces")).orderBy(F.desc("id"))


def latest_detection_run(runs: DataFrame) -> DataFrame:
    """The finished run that ended last; without any, the one that started last."""
    order = [F.col("finished_at").isNotNull().desc(), F.coalesce("finished_at", "started_at").desc_nulls_last(), F.desc("id")]
    return runs.orderBy(*order).limit(1).select("id")


def _faces_of_clusters(members: DataFrame, faces: DataFrame) -> DataFrame:
    return members.join(faces.select(F.col("id").alias("face_id"), "asset_id"), "face_id")


def face_cluster_runs(runs: DataFrame, clusters: DataFrame, members: DataFrame, faces: DataFrame, run_id: int | None = None) -> DataFrame:
    """Each run with its clusters, faces, distinct assets and smallest representative asset.

    Cluster and member counts are summed from per-cluster counts; only the distinct
    assets need the face rows, once.
    """
    own = runs if run_id is None else runs.filter(F.col("id") == run_id)
    which = clusters.select(F.col("id").alias("cluster_id"), F.col("run_id").alias("key"))
    placed = _faces_of_clusters(members, faces).join(which, "cluster_id")
    stats = placed.groupBy("key").agg(F.count("*").alias("n_faces"), F.countDistinct("asset_id").alias("n_assets"), F.min(F.when(F.col("is_representative"), F.col("asset_id"))).alias("rep_asset_id"))
    count = which.groupBy("key").agg(F.count("*").alias("n_clusters"))
    rows = own.join(count, own.id == count.key, "left").drop("key").join(stats, F.col("id") == stats.key, "left")
    return rows.select(*runs.columns, _or_zero("n_clusters"), _or_zero("n_faces"), _or_zero("n_assets"), "rep_asset_id").orderBy(F.desc("id"))


def face_clusters(clusters: DataFrame, members: DataFrame, faces: DataFrame, run_id: int) -> DataFrame:
    own = clusters.filter(F.col("run_id") == run_id)
    stats = _faces_of_clusters(members, faces).groupBy("cluster_id").agg(F.count("*").alias("n_faces"), F.countDistinct("asset_id").alias("n_assets"), F.min(F.when(F.col("is_representative"), F.col("asset_id"))).alias("rep_asset_id"))
    return own.join(stats, own.id == stats.cluster_id).select("id", "label", "n_faces", "n_assets", "rep_asset_id").orderBy(F.desc("n_faces"), "id")


def face_cluster_assets(members: DataFrame, faces: DataFrame, assets: DataFrame, cluster_id: int) -> DataFrame:
    own = members.filter(F.col("cluster_id") == cluster_id).select(F.col("face_id"), "distance", "is_representative")
    box = F.struct(F.col("bbox_x1").alias("x1"), F.col("bbox_y1").alias("y1"), F.col("bbox_x2").alias("x2"), F.col("bbox_y2").alias("y2"))
    rows = own.join(faces.select(F.col("id").alias("face_id"), "asset_id", box.alias("bbox"), "det_score"), "face_id")
    named = rows.join(assets.select(F.col("id").alias("asset_id"), "relpath", "filename"), "asset_id")
    return named.withColumn("is_representative", F.col("is_representative").cast("int")).orderBy(F.desc("is_representative"), F.asc("distance"), "face_id")


# Albums.


def albums(albums: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """Each album with its size and cover, the newest asset, by name whatever the case."""
    dated = links.join(assets.select(F.col("id").alias("asset_id"), "taken_at"), "asset_id")
    rank = F.row_number().over(Window.partitionBy("album_id").orderBy(F.desc_nulls_last("taken_at"), "asset_id"))
    cover = dated.withColumn("rn", rank).filter("rn = 1").select(F.col("album_id"), F.col("asset_id").alias("cover_asset_id"))
    size = _count(links, "album_id", "n_assets")
    rows = albums.join(size, albums.id == size.key, "left").join(cover, albums.id == cover.album_id, "left")
    return rows.select("id", "name", "relpath", _or_zero("n_assets"), "cover_asset_id").orderBy(F.collate("name", "UTF8_LCASE"), "name", "id")


def album_assets(links: DataFrame, assets: DataFrame, album_id: int, limit: int | None = None, offset: int = 0) -> DataFrame:
    own = links.filter(F.col("album_id") == album_id).select(F.col("asset_id").alias("id"))
    return page(assets.join(own, "id").orderBy(F.desc_nulls_last("taken_at"), "filename", "id"), limit, offset)


def count_album_assets(links: DataFrame, album_id: int) -> DataFrame:
    return links.filter(F.col("album_id") == album_id).agg(F.count("*").alias("n"))


# Presets and tags.


def view_presets(presets: DataFrame) -> DataFrame:
    return presets.orderBy("name")


def user_tags(tags: DataFrame) -> DataFrame:
    return tags.select("term").orderBy("created_at", "id")


def vocabulary_with_tags(vocabulary: DataFrame, tags: DataFrame) -> DataFrame:
    """(term, user_tag): the vocabulary without repeats, then tags that it lacks; a flag says which are tags."""
    base = vocabulary.groupBy("term").agg(F.min("ord").alias("ord"))
    base = base.join(tags.select("term", F.lit(True).alias("tag")).distinct(), "term", "left")
    novel = tags.select("term").distinct().join(vocabulary, "term", "left_anti")
    return base.select("term", F.coalesce("tag", F.lit(False)).alias("user_tag")).unionByName(novel.select("term", F.lit(True).alias("user_tag")))
