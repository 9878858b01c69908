"""Ingestion: a tree of files to assets, aliases and albums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Library
from ..functions.text import album_of
from ..lineage import checkpoint
from ..operators.dml import append_with_ids, insert_or_ignore, upsert_assets, upsert_columns
from ..schema import INDEXER_VERSION, struct
from ..sources import scan, sidecar


def asset_rows(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """Every image below root with its hash and its sidecar's columns (null where invalid).

    Of the assets in `known`, those whose file has the size it had and was not touched
    since they were indexed keep their hash; only other pictures are opened.
    """
    listed = scan.files(spark, root)
    pictures = scan.images(listed)
    if known is None:
        hashes = scan.content_hashes(spark, root, pictures)
    else:
        touched = listed.select("relpath", F.unix_timestamp("modified").alias("touched"))
        old = known.filter("sha256 IS NOT NULL").select("relpath", "sha256", F.col("size_bytes").alias("size"), "indexed_at")
        same = checkpoint(pictures.join(touched, "relpath").join(old, "relpath").filter("size_bytes = size AND touched < indexed_at").select("relpath", "sha256"))
        hashes = scan.content_hashes(spark, root, pictures.join(same, "relpath", "left_anti")).unionByName(same)
    described = sidecar.parse(scan.sidecar_texts(spark, root)).drop("valid")
    rows = pictures.join(hashes, "relpath", "left").join(described, "sidecar_relpath", "left")
    return rows.withColumn("indexer_version", F.lit(INDEXER_VERSION))


def album_links(assets: DataFrame, paths: DataFrame) -> DataFrame:
    """(relpath of the album, asset_id): the first folder of every path of every asset."""
    every = assets.select("relpath", F.col("id").alias("asset_id")).unionByName(paths.select("relpath", "asset_id"))
    return every.select(album_of(F.col("relpath")).alias("relpath"), "asset_id").filter("relpath IS NOT NULL").distinct()


def index(library: Library, root: str, now: int) -> None:
    """Bring a library up to date with a tree; running it again changes nothing."""
    spark = library.spark
    before = library.read("assets")
    new = checkpoint(asset_rows(spark, root, before))  # the tree is read once, however often the plans below read its rows
    names = {f.name for f in struct("assets")}
    assets, paths = upsert_assets(before, library.read("asset_paths"), new.select(*(c for c in new.columns if c in names)), now)
    paths = checkpoint(paths)  # of the assets before
    library.write("assets", assets)
    library.write("asset_paths", paths)
    links = album_links(library.read("assets"), library.read("asset_paths"))
    found = links.select("relpath").distinct().select("relpath", F.col("relpath").alias("name"), F.lit(now).cast("long").alias("indexed_at"))
    old = library.read("albums")
    merged = upsert_columns(old, found, ["relpath"])
    library.write("albums", append_with_ids(merged.filter("id IS NOT NULL"), merged.filter("id IS NULL").drop("id"), ["relpath"]))
    ids = links.join(library.read("albums").select("relpath", F.col("id").alias("album_id")), "relpath").select("album_id", "asset_id")
    library.write("album_assets", insert_or_ignore(library.read("album_assets"), ids, ["album_id", "asset_id"]))


def rescan(library: Library, root: str, now: int, full: bool = False) -> DataFrame:
    """Read sidecars again for assets of an older version (all, if full); returns the ids."""
    from ..operators.browse import needing_rescan

    assets = library.read("assets")
    todo = needing_rescan(assets, full)
    described = sidecar.parse(scan.sidecar_texts(library.spark, root)).drop("valid")
    names = {f.name for f in struct("assets")}
    rows = todo.join(described, "sidecar_relpath", "left").select("id", *(c for c in described.columns if c in names and c != "sidecar_relpath"))
    stamped = rows.withColumns({"indexer_version": F.lit(INDEXER_VERSION), "indexed_at": F.lit(now).cast("long")})
    ids = [r["id"] for r in todo.select("id").limit(1).collect()]
    if ids:
        library.write("assets", upsert_columns(assets, stamped, ["id"]))
    return todo.select("id")
