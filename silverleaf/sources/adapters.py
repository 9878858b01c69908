"""The engine's tables made from the general test tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables it is made from, Spark SQL, DuckDB SQL).
VIEWS: dict[str, tuple[list[str], str, str]] = {}


def _view(name: str, tables: str, spark_sql: str, duck_sql: str | None = None) -> None:
    VIEWS[name] = (tables.split(), spark_sql, duck_sql or spark_sql)


_ASSETS = """
SELECT doc_id AS id, concat(source, '/', lang, '/', CAST(doc_id AS {text}), '.txt') AS relpath, concat(CAST(doc_id AS {text}), '.txt') AS filename,
       concat('.', lang) AS ext, n_chars AS size_bytes, {hash} AS sha256,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 1500000000 + doc_id * 7919 % 100000000 END AS taken_at,
       CASE WHEN doc_id % 3 = 0 THEN TRUE WHEN doc_id % 3 = 1 THEN FALSE END AS favorited, doc_id % 5 = 0 AS archived, FALSE AS trashed,
       CASE WHEN doc_id % 2 = 0 THEN concat(CAST(doc_id AS {text}), '.json') END AS sidecar_relpath,
       CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 2 END AS indexer_version, source
FROM documents
"""
_view("assets", "documents", _ASSETS.format(text="STRING", hash="sha2(text, 256)"), _ASSETS.format(text="VARCHAR", hash="sha256(text)"))
_SCORES = """
SELECT doc_id AS asset_id, 'labels' AS scorer_id, 'default' AS variant_id, 'quality' AS metric_key, CAST(quality AS DOUBLE) AS value, '1' AS scorer_version FROM labels
UNION ALL SELECT doc_id, 'labels', 'default', 'toxic', CAST(toxic AS DOUBLE), '2' FROM labels
UNION ALL SELECT doc_id, 'text', 'default', 'length', CAST(n_chars AS DOUBLE), '1' FROM documents
"""
_view("asset_scores", "labels documents", _SCORES)
_view("albums", "documents", "SELECT CAST(row_number() OVER (ORDER BY source) AS BIGINT) AS id, source AS name, source AS relpath FROM (SELECT DISTINCT source FROM documents) s")
_view("album_assets", "documents", "SELECT a.id AS album_id, d.doc_id AS asset_id FROM documents d JOIN (SELECT CAST(row_number() OVER (ORDER BY source) AS BIGINT) AS id, source FROM (SELECT DISTINCT source FROM documents) s) a ON a.source = d.source")
_view("order_assets", "orders", "SELECT o_orderkey AS id, concat(o_orderpriority, '/', CAST(o_orderkey AS STRING)) AS relpath, o_orderpriority AS filename, unix_timestamp(o_orderdate) AS taken_at FROM orders",
      "SELECT o_orderkey AS id, concat(o_orderpriority, '/', CAST(o_orderkey AS VARCHAR)) AS relpath, o_orderpriority AS filename, CAST(epoch(o_orderdate) AS BIGINT) AS taken_at FROM orders")
_view("clustering_runs", "nation", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS method, CAST(NULL AS STRING) AS params_json, CAST(n_regionkey AS BIGINT) AS created_at, CAST(n_nationkey AS INT) AS n_skipped FROM nation",
      "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS method, CAST(NULL AS VARCHAR) AS params_json, CAST(n_regionkey AS BIGINT) AS created_at, CAST(n_nationkey AS INT) AS n_skipped FROM nation")
_CLUSTERS = "SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS method, CASE WHEN c_nationkey < 12 THEN c_mktsegment END AS params_json, CAST(c_nationkey AS BIGINT) AS run_id, CAST(c_acctbal AS DOUBLE) AS diameter FROM customer"
_view("clusters", "customer", _CLUSTERS)
_MEMBERS = """
SELECT CAST(o_custkey AS BIGINT) AS cluster_id, CAST(o_orderkey AS BIGINT) AS asset_id, CAST(o_totalprice AS DOUBLE) AS distance,
       o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AS is_representative
FROM orders
"""
_view("cluster_members", "orders", _MEMBERS)
_ORDER_SCORES = "SELECT CAST(o_orderkey AS BIGINT) AS asset_id, 'price' AS scorer_id, o_orderpriority AS variant_id, 'total' AS metric_key, CAST(o_totalprice AS DOUBLE) AS value FROM orders WHERE o_orderstatus = 'F'"
_view("order_scores", "orders", _ORDER_SCORES)
_view("face_detection_runs", "region", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS model_id, CAST(r_regionkey * 100 AS BIGINT) AS started_at, CASE WHEN r_regionkey <> 4 THEN CAST(1000 - r_regionkey AS BIGINT) END AS finished_at FROM region")
_view("face_embeddings", "embeddings", "SELECT vec_id AS id, vec_id div 3 AS asset_id, CAST(label % 5 AS BIGINT) AS run_id, embedding FROM embeddings",
      "SELECT vec_id AS id, CAST(vec_id // 3 AS BIGINT) AS asset_id, CAST(label % 5 AS BIGINT) AS run_id, embedding FROM embeddings")
_view("face_cluster_runs", "region", "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS method, CAST(4 - r_regionkey AS BIGINT) AS detection_run_id FROM region")
_view("face_clusters", "nation", "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS run_id, n_name AS label FROM nation")
_FACE_MEMBERS = """
SELECT CAST(label AS BIGINT) AS cluster_id, vec_id AS face_id, CAST(embedding{first} AS DOUBLE) AS distance, vec_id = min(vec_id) OVER (PARTITION BY label) AS is_representative
FROM embeddings
"""
_view("face_cluster_members", "embeddings", _FACE_MEMBERS.format(first="[0]"), _FACE_MEMBERS.format(first="[1]"))
_view("clip_embeddings", "embeddings", "SELECT vec_id AS asset_id, embedding FROM embeddings")
#: Bits of rising neighbours stand in for a perceptual hash of 63 bits.
_view("phash", "embeddings",
      "SELECT vec_id AS asset_id, lpad(lower(hex(aggregate(sequence(0, 62), 0L, (a, k) -> a | shiftleft(CAST(embedding[k] > embedding[k + 1] AS BIGINT), k)))), 16, '0') AS phash_hex, CASE WHEN label = 0 THEN 'phash' ELSE 'dhash16' END AS algo FROM embeddings",
      "SELECT vec_id AS asset_id, lpad(lower(to_hex(list_reduce(list_transform(range(63), lambda k: (CASE WHEN embedding[k + 1] > embedding[k + 2] THEN 1::BIGINT << k ELSE 0 END)), lambda a, b: a | b))), 16, '0') AS phash_hex, CASE WHEN label = 0 THEN 'phash' ELSE 'dhash16' END AS algo FROM embeddings")

_RISING = "lpad(lower(hex(aggregate(sequence(0, 63), 0L, (a, k) -> a | shiftleft(CAST(embedding[k] > embedding[(k + {d}) % 64] AS BIGINT), k)))), 16, '0')"
_RISING_DUCK = "lpad(lower(to_hex(list_reduce(list_transform(range(64), lambda k: (CASE WHEN embedding[k + 1] > embedding[(k + {d}) % 64 + 1] THEN 1::UBIGINT << k ELSE 0::UBIGINT END)), lambda a, b: a | b))), 16, '0')"
#: The same over four distances: 256 bits.
_view("phash_full", "embeddings", *(f"SELECT vec_id AS asset_id, concat({', '.join(rising.replace('{d}', str(d)) for d in (1, 2, 3, 5))}) AS phash_hex, 'dhash16' AS algo FROM embeddings" for rising in (_RISING, _RISING_DUCK)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the engine's tables, or a test table as it is."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tables, sql, _ = VIEWS[name]
    return spark.sql(_marked(sql, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _marked(sql: str, tables: list[str]) -> str:
    """The SQL with table names as {parameters} of spark.sql."""
    import re

    out = sql.replace("{", "{{").replace("}", "}}")
    for t in tables:
        out = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", out)
    return out


def duck(sql: str, *names: str) -> str:
    """A DuckDB query with the named engine tables as common tables in front."""
    with_ = ", ".join(f"{n} AS ({VIEWS[n][2]})" for n in names)
    return f"WITH RECURSIVE {with_} {sql}" if with_ else sql
