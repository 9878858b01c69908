"""Writes as pure functions: the table as it is and the changes give the table as it will be.

Parquet has no row updates, so a write is a plan for the new table, which the catalog
stores in place of the old one. Each function shuffles the table once on its key (or
not at all where the changes are broadcast by Spark); inserts never rewrite keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import ranked
from ..schema import KEYS


def _last(changes: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One change for each key: the last by `order`; without it any (they should agree)."""
    if order is None:
        return changes.dropDuplicates(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return changes.withColumn("rn", rank).filter("rn = 1").drop("rn", order)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of `changes` replace rows with their key, or are added."""
    new = _last(changes, keys, order)
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new, allowMissingColumns=True)


def upsert_columns(table: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Like upsert, but a matched row keeps every column that `changes` does not carry."""
    new = _last(changes, keys, order)
    carried = [c for c in new.columns if c not in keys]
    marked = new.select(*keys, F.struct(*carried).alias("new"))
    old = table.select(*keys, F.struct(*(c for c in table.columns if c not in keys)).alias("old"))
    both = old.join(marked, keys, "full_outer")
    values = [F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) if c in carried else F.col(c) if c in keys else F.col(f"old.{c}").alias(c) for c in table.columns]
    return both.select(*values)


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows whose key is new; the first stays."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def append_with_ids(table: DataFrame, rows: DataFrame, natural_key: list[str], id_col: str = "id") -> DataFrame:
    """Adds rows with ids that go on from the largest, in the order of their natural key."""
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    numbered = ranked(rows, natural_key, "__k").join(F.broadcast(top))
    new = numbered.withColumn(id_col, (F.col("__top") + F.col("__k") + 1).cast("long")).drop("__k", "__top")
    return table.unionByName(new, allowMissingColumns=True)


def delete_where(table: DataFrame, test: Column) -> DataFrame:
    """Rows for which the test is not true stay; so do those for which it is unknown."""
    return table.filter(~F.coalesce(test, F.lit(False)))


def delete_matching(table: DataFrame, gone: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose columns (keys of `on`) match a row of `gone` (values of `on`) go."""
    names = {v: f"__{k}" for k, v in on.items()}
    ids = gone.select(*(F.col(v).alias(n) for v, n in names.items())).distinct()
    test = [F.col(k) == F.col(names[v]) for k, v in on.items()]
    return table.join(ids, test, "left_anti")


def set_where(table: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE, as one projection."""
    return table.withColumns({c: F.when(test, v).otherwise(F.col(c)) for c, v in values.items()})


def truncate(table: DataFrame) -> DataFrame:
    return table.limit(0)


# Writes with rules of their own.


def upsert_assets(assets: DataFrame, paths: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(assets, asset_paths) after a scan: known content under a new path is an alias.

    Of equal contents in one scan the smallest path is the asset. A path whose content
    became a duplicate of another asset's leaves the assets and becomes an alias. Smallest
    paths are aggregated, so a content that very many files share fills no single task.
    """
    stamped = new.withColumn("indexed_at", F.coalesce(F.col("indexed_at"), F.lit(now)) if "indexed_at" in new.columns else F.lit(now).cast("long"))
    content = F.coalesce("sha256", F.concat(F.lit("path:"), "relpath"))
    known = assets.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.min(F.struct("id", "relpath")).alias("held"))
    firsts = stamped.groupBy(content.alias("content")).agg(F.min("relpath").alias("relpath")).select("relpath", F.lit(True).alias("is_first"))
    least = stamped.filter("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("relpath").alias("first"))
    ranked = stamped.join(known, "sha256", "left").join(firsts, "relpath", "left").join(least, "sha256", "left")
    alias = (F.col("held").isNotNull() & (F.col("held.relpath") != F.col("relpath"))) | (F.col("held").isNull() & F.col("is_first").isNull())
    own = ranked.filter(~alias).select(*new.columns, *([] if "indexed_at" in new.columns else ["indexed_at"]))
    aliases = ranked.filter(alias).select("relpath", F.coalesce("held.relpath", "first").alias("canonical"), "indexed_at")
    stay = delete_matching(assets, aliases, {"relpath": "relpath"})
    merged = upsert_columns(stay, own, ["relpath"])
    numbered = append_with_ids(merged.filter("id IS NOT NULL"), merged.filter("id IS NULL").drop("id"), ["relpath"])
    linked = aliases.join(numbered.select(F.col("id").alias("asset_id"), F.col("relpath").alias("canonical")), "canonical").select("asset_id", "relpath", "indexed_at")
    kept = delete_matching(delete_matching(paths, own, {"relpath": "relpath"}), aliases, {"relpath": "relpath"})
    return numbered, append_with_ids(kept, linked, ["relpath"])


def upsert_scores(scores: DataFrame, rows: DataFrame, scorer_id: str, variant_id: str, version: str | None, now: int) -> DataFrame:
    """rows: asset_id, metric_key, value; stamped and written over what was there."""
    new = rows.select("asset_id", F.lit(scorer_id).alias("scorer_id"), F.lit(variant_id).alias("variant_id"), "metric_key", "value", F.lit(version).cast("string").alias("scorer_version"), F.lit(now).cast("long").alias("scored_at"))
    return upsert(scores, new, KEYS["asset_scores"])


def upsert_presets(presets: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """By name; a preset that was there keeps its id and creation time."""
    known = presets.select("name", "id", "created_at")
    new = changes.drop("id", "created_at", "updated_at").join(known, "name", "left").withColumns({"created_at": F.coalesce("created_at", F.lit(now).cast("long")), "updated_at": F.lit(now).cast("long")})
    old = presets.join(changes.select("name"), "name", "left_anti").select(*presets.columns)
    return append_with_ids(old.unionByName(new.filter("id IS NOT NULL"), allowMissingColumns=True), new.filter("id IS NULL").drop("id"), ["name"])


def insert_tag(tags: DataFrame, term: str, now: int) -> tuple[DataFrame, bool]:
    """The tags with a new one, and whether it is new; blank terms are an error."""
    term = term.strip()
    if not term:
        raise ValueError("a tag needs a name")
    if not tags.filter(F.col("term") == term).isEmpty():
        return tags, False
    row = tags.sparkSession.range(1).select(F.lit(term).alias("term"), F.lit(now).cast("long").alias("created_at"))
    return append_with_ids(tags, row, ["term"]), True


def delete_tag(tags: DataFrame, term: str) -> tuple[DataFrame, bool]:
    """The tags without one, and whether it was there."""
    test = F.col("term") == term.strip()
    return delete_where(tags, test), not tags.filter(test).isEmpty()


def delete_clustering_run(runs: DataFrame, clusters: DataFrame, members: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a run, its clusters and their members."""
    gone = clusters.filter(F.col("run_id") == run_id)
    return delete_where(runs, F.col("id") == run_id), delete_where(clusters, F.col("run_id") == run_id), delete_matching(members, gone, {"cluster_id": "id"})


def delete_clusters(clusters: DataFrame, members: DataFrame, method: str, params_json: str | None) -> tuple[DataFrame, DataFrame]:
    """Clusters of a method and exactly these parameters, null like any value."""
    test = (F.col("method") == method) & F.col("params_json").eqNullSafe(F.lit(params_json))
    return delete_where(clusters, test), delete_matching(members, clusters.filter(test), {"cluster_id": "id"})


def face_run_closure(runs: DataFrame, cluster_runs: DataFrame, clusters: DataFrame, members: DataFrame, faces: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame]:
    """(cluster runs, clusters) that depend on a detection run: by name, or by a face of it."""
    named = cluster_runs.filter(F.col("detection_run_id") == run_id).select("id")
    of_run = faces.filter(F.col("run_id") == run_id).select(F.col("id").alias("face_id"))
    by_face = members.join(of_run, "face_id", "left_semi").select(F.col("cluster_id").alias("id")).distinct()
    by_name = clusters.join(named, clusters.run_id == named.id, "left_semi").select("id")
    hit = by_face.unionByName(by_name).distinct()
    reached = clusters.join(hit, "id", "left_semi").select(F.col("run_id").alias("id"))
    return named.unionByName(reached).distinct(), hit


def delete_face_run(runs: DataFrame, cluster_runs: DataFrame, clusters: DataFrame, members: DataFrame, faces: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """The five face tables without a detection run and all that depends on it."""
    gone_runs, gone = face_run_closure(runs, cluster_runs, clusters, members, faces, run_id)
    return (
        delete_where(runs, F.col("id") == run_id),
        delete_matching(cluster_runs, gone_runs, {"id": "id"}),
        delete_matching(clusters, gone, {"id": "id"}),
        delete_matching(members, gone, {"cluster_id": "id"}),
        delete_where(faces, F.col("run_id") == run_id),
    )


def delete_face_cluster_run(cluster_runs: DataFrame, clusters: DataFrame, members: DataFrame, run_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = clusters.filter(F.col("run_id") == run_id)
    return delete_where(cluster_runs, F.col("id") == run_id), delete_where(clusters, F.col("run_id") == run_id), delete_matching(members, gone, {"cluster_id": "id"})


def rename_face_cluster(clusters: DataFrame, cluster_id: int, label: str) -> DataFrame:
    return set_where(clusters, F.col("id") == cluster_id, {"label": F.lit(label)})


def finish_run(runs: DataFrame, run_id: int, now: int) -> DataFrame:
    return set_where(runs, F.col("id") == run_id, {"finished_at": F.lit(now).cast("long")})


def set_skipped(runs: DataFrame, run_id: int, n: int) -> DataFrame:
    return set_where(runs, F.col("id") == run_id, {"n_skipped": F.lit(n).cast("int")})
