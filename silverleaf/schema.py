"""Table schemas, fixed and versioned; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 14
#: The version that ingestion stamps on rows; older or unstamped rows are derived again.
INDEXER_VERSION = 2

#: The tables and columns of the data model.
TABLES: dict[str, str] = {
    "assets": "id BIGINT NOT NULL, relpath STRING NOT NULL, filename STRING NOT NULL, ext STRING NOT NULL, size_bytes BIGINT, sha256 STRING, "
    "taken_at BIGINT, created_at_sidecar BIGINT, width INT, height INT, geo_lat DOUBLE, geo_lon DOUBLE, geo_alt DOUBLE, "
    "geo_exif_lat DOUBLE, geo_exif_lon DOUBLE, geo_exif_alt DOUBLE, title STRING, description STRING, image_views BIGINT, "
    "google_photos_url STRING, favorited BOOLEAN, archived BOOLEAN, trashed BOOLEAN, origin_type STRING, origin_device_type STRING, "
    "origin_device_folder STRING, app_source_package STRING, sidecar_relpath STRING, mime STRING, indexed_at BIGINT NOT NULL, indexer_version INT",
    "asset_paths": "id BIGINT, asset_id BIGINT, relpath STRING, indexed_at BIGINT",
    "albums": "id BIGINT, name STRING, relpath STRING, indexed_at BIGINT",
    "album_assets": "album_id BIGINT, asset_id BIGINT",
    "asset_scores": "asset_id BIGINT, scorer_id STRING, variant_id STRING, metric_key STRING, value DOUBLE, scorer_version STRING, scored_at BIGINT",
    "phash": "asset_id BIGINT, phash_hex STRING, algo STRING, computed_at BIGINT",
    "clustering_runs": "id BIGINT, method STRING, params_json STRING, created_at BIGINT, n_skipped INT",
    "clusters": "id BIGINT, method STRING, params_json STRING, run_id BIGINT, created_at BIGINT, diameter DOUBLE",
    "cluster_members": "cluster_id BIGINT, asset_id BIGINT, distance DOUBLE, is_representative BOOLEAN",
    "view_presets": "id BIGINT, name STRING, sort_by STRING, favorited BOOLEAN, min_score DOUBLE, max_score DOUBLE, created_at BIGINT, updated_at BIGINT",
    "clip_embeddings": "asset_id BIGINT, embedding ARRAY<FLOAT>, model_id STRING, computed_at BIGINT",
    "clip_user_tags": "id BIGINT, term STRING, created_at BIGINT",
    "face_detection_runs": "id BIGINT, model_id STRING, params_json STRING, started_at BIGINT, finished_at BIGINT",
    "face_embeddings": "id BIGINT, asset_id BIGINT, run_id BIGINT, face_index INT, bbox_x1 DOUBLE, bbox_y1 DOUBLE, bbox_x2 DOUBLE, bbox_y2 DOUBLE, "
    "det_score DOUBLE, embedding ARRAY<FLOAT>, computed_at BIGINT",
    "face_cluster_runs": "id BIGINT, method STRING, params_json STRING, detection_run_id BIGINT, created_at BIGINT",
    "face_clusters": "id BIGINT, run_id BIGINT, label STRING, created_at BIGINT",
    "face_cluster_members": "cluster_id BIGINT, face_id BIGINT, distance DOUBLE, is_representative BOOLEAN",
}

#: Natural keys that a write must keep unique.
KEYS: dict[str, list[str]] = {
    "assets": ["relpath"],
    "asset_paths": ["relpath"],
    "albums": ["relpath"],
    "album_assets": ["album_id", "asset_id"],
    "asset_scores": ["asset_id", "scorer_id", "variant_id", "metric_key"],
    "phash": ["asset_id"],
    "clip_embeddings": ["asset_id"],
    "cluster_members": ["cluster_id", "asset_id"],
    "face_cluster_members": ["cluster_id", "face_id"],
    "view_presets": ["name"],
    "clip_user_tags": ["term"],
}

#: Columns that a table is laid out by, so that their predicates prune files.
PARTITIONS: dict[str, list[str]] = {"asset_scores": ["scorer_id", "variant_id"]}


class SchemaMismatch(Exception):
    """A stored table set has a version that can't be brought to this one."""


def struct(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(table: str, df: DataFrame) -> DataFrame:
    """df with exactly the table's columns, cast; columns it lacks are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(table)))


def migrate(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """Bring stored tables to SCHEMA_VERSION: 0 is an empty library, 13 lacks indexer_version."""
    if version == SCHEMA_VERSION:
        return tables
    if version == 13:
        return {name: conform(name, df) for name, df in tables.items()}
    if version == 0 and not tables:
        return {}
    raise SchemaMismatch(f"version {version} can't be brought to {SCHEMA_VERSION}")
