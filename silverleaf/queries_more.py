"""More registered queries: sources, ingestion, requests, scorers, clusters, progress."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import text, vectors
from .lineage import checkpoint_dir
from .operators import browse, cluster, density, dml, hash_index, projection, reports, scoring, similarity, vector_index
from .plans import ingest, params, progress
from .queries import _COMPONENTS, _DBSCAN, _DOT, _MEAN, _NORM, _SIM, _UNIT, CLUSTER, HAMMING, ORACLE_SQL, WINDOW, query
from .sources import scan, sidecar
from .sources.adapters import duck

# Sources.

_JSON = "concat('{\"title\": \"', source, '\", \"imageViews\": \"', @views, '\", \"photoTakenTime\": {\"timestamp\": \"', doc_id, '\"}', CASE WHEN doc_id % 2 = 0 THEN ', \"geoData\": {\"latitude\": 1.5}' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN ', \"favorited\": true' ELSE '' END, ', \"googlePhotosOrigin\": {\"', CASE WHEN doc_id % 4 = 0 THEN 'webUpload' ELSE 'mobileUpload' END, '\": {\"deviceType\": \"', lang, '\"}}}')"
_VIEWS = "CASE WHEN doc_id % 7 = 0 THEN 'many' ELSE CAST(n_chars AS STRING) END"


@query(
    "sidecars", "documents",
    "SELECT doc_id AS id, doc_id % 7 <> 0 AS valid, CASE WHEN doc_id % 7 <> 0 THEN source END AS title, CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS image_views, CASE WHEN doc_id % 7 <> 0 THEN doc_id END AS taken_at, "
    "CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN 1.5::DOUBLE END AS geo_lat, CASE WHEN doc_id % 7 <> 0 AND doc_id % 2 = 0 THEN 0.0::DOUBLE END AS geo_lon, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN TRUE END AS favorited, "
    "CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'webUpload' ELSE 'mobileUpload' END END AS origin_type, CASE WHEN doc_id % 7 <> 0 THEN lang END AS origin_device_type FROM documents",
)
def _(documents):
    docs = documents.select(F.col("doc_id").alias("id"), F.expr(_JSON.replace("@views", _VIEWS)).alias("json"))
    return sidecar.parse(docs).select("id", "valid", "title", "image_views", "taken_at", "geo_lat", "geo_lon", "favorited", "origin_type", "origin_device_type")


@query(
    "scan_images", "documents",
    "SELECT concat(source, '/', doc_id, '.JPG') AS relpath, concat(doc_id, '.JPG') AS filename, '.jpg' AS ext, 'image/jpeg' AS mime, n_chars AS size_bytes, "
    "CASE doc_id % 3 WHEN 0 THEN concat(source, '/', doc_id, '.JPG.supplemental-metadata.json') WHEN 1 THEN concat(source, '/', doc_id, '.supplemental-metadata.json') END AS sidecar_relpath FROM documents",
)
def _(documents):
    name = F.concat("source", F.lit("/"), "doc_id")
    files = documents.select(F.concat(name, F.lit(".JPG")).alias("relpath"), F.col("n_chars").alias("size_bytes"))
    beside = F.when(F.col("doc_id") % 3 == 0, F.concat(name, F.lit(f".JPG{scan.SIDECAR_SUFFIX}"))).when(F.col("doc_id") % 3 == 1, F.concat(name, F.lit(scan.SIDECAR_SUFFIX))).otherwise(F.concat(name, F.lit(".txt")))
    return scan.images(files.unionByName(documents.select(beside.alias("relpath"), F.lit(1).cast("long").alias("size_bytes")))).select("relpath", "filename", "ext", "mime", "size_bytes", "sidecar_relpath")


# Ingestion and writes.


@query(
    "upsert_assets", "assets",
    ", held AS (SELECT sha256, arg_min(relpath, id) AS c FROM assets WHERE id % 2 = 0 GROUP BY sha256), firsts AS (SELECT sha256, min(relpath) AS c FROM assets GROUP BY sha256) "
    "SELECT relpath, coalesce(h.c, f.c) AS canonical, relpath <> coalesce(h.c, f.c) AS alias FROM assets LEFT JOIN held h USING (sha256) JOIN firsts f USING (sha256)",
)
def _(assets):
    stored = assets.filter("id % 2 = 0").select("id", "relpath", "sha256", F.lit(1).cast("long").alias("indexed_at"))
    paths = assets.sparkSession.createDataFrame([], "id long, asset_id long, relpath string, indexed_at long")
    made, aliases = dml.upsert_assets(stored, paths, assets.select("relpath", "sha256"), 2)
    named = made.select(F.col("id").alias("asset_id"), F.col("relpath").alias("canonical"))
    own = made.select("relpath", F.col("relpath").alias("canonical"), F.lit(False).alias("alias"))
    return own.unionByName(aliases.join(named, "asset_id").select("relpath", "canonical", F.lit(True).alias("alias")))


@query("update_sha256", "assets", "SELECT id, CASE WHEN id = 3 THEN 'new' ELSE sha256 END AS sha256 FROM assets")
def _(assets):
    return dml.set_where(assets, F.col("id") == 3, {"sha256": F.lit("new")}).select("id", "sha256")


@query("ids_without_sha256", "assets", "SELECT id FROM assets WHERE id % 9 = 0")
def _(assets):
    return browse.ids_without_sha256(assets.withColumn("sha256", F.when(F.col("id") % 9 != 0, F.col("sha256"))))


@query("alias_paths", "assets", "SELECT relpath FROM assets WHERE id % 5 = 2")
def _(assets):
    return browse.alias_paths(assets.select((F.col("id") % 5).alias("asset_id"), "relpath"), 2)


@query("upsert_phash", "phash", "SELECT asset_id, CASE WHEN asset_id % 2 = 0 THEN 'ff' ELSE phash_hex END AS phash_hex FROM phash UNION ALL SELECT asset_id + 1000000, 'ff' FROM phash WHERE asset_id % 2 = 0")
def _(phash):
    even = phash.filter("asset_id % 2 = 0").withColumn("phash_hex", F.lit("ff"))
    return dml.upsert(phash, even.unionByName(even.withColumn("asset_id", F.col("asset_id") + 1_000_000)), ["asset_id"]).select("asset_id", "phash_hex")


@query("insert_run", "clustering_runs", "SELECT id, method, CASE WHEN id = 4 THEN 77 ELSE n_skipped END AS n_skipped FROM clustering_runs UNION ALL SELECT (SELECT max(id) FROM clustering_runs) + 1, 'phash', NULL")
def _(runs):
    new = runs.sparkSession.range(1).select(F.lit("phash").alias("method"))
    return dml.set_skipped(dml.append_with_ids(runs, new, ["method"]), 4, 77).select("id", "method", "n_skipped")


@query("delete_all_clusters", "clusters cluster_members", "SELECT count(*) AS before, 0::BIGINT AS after FROM clusters")
def _(clusters, members):
    return clusters.agg(F.count("*").alias("before")).join(F.broadcast(dml.truncate(clusters).agg(F.count("*").alias("after"))))


@query("delete_face_cluster_run", "face_cluster_runs face_clusters face_cluster_members", "SELECT m.cluster_id, m.face_id, CASE WHEN m.cluster_id = 2 THEN 'Ann' ELSE c.label END AS label FROM face_cluster_members m LEFT JOIN face_clusters c ON c.id = m.cluster_id WHERE m.cluster_id NOT IN (SELECT id FROM face_clusters WHERE run_id = 1)")
def _(runs, clusters, members):
    _, kept, left = dml.delete_face_cluster_run(runs, dml.rename_face_cluster(clusters, 2, "Ann"), members, 1)
    return left.join(kept.select(F.col("id").alias("cluster_id"), "label"), "cluster_id", "left").select("cluster_id", "face_id", "label")


@query("album_links", "assets", "SELECT DISTINCT source AS relpath, id AS asset_id FROM assets UNION SELECT 'old', id FROM assets WHERE id % 10 = 1")
def _(assets):
    paths = assets.filter("id % 10 = 1").select(F.lit("old/x.txt").alias("relpath"), F.col("id").alias("asset_id"))
    return ingest.album_links(assets, paths)


@query("upsert_albums", "albums documents", "SELECT relpath, name FROM albums UNION ALL SELECT DISTINCT 'new ' || lang, 'new ' || lang FROM documents")
def _(albums, documents):
    new = documents.select(F.concat(F.lit("new "), "lang").alias("relpath")).distinct().withColumn("name", F.col("relpath"))
    merged = dml.upsert_columns(albums, albums.select("relpath", "name").unionByName(new), ["relpath"])
    every = dml.append_with_ids(merged.filter("id IS NOT NULL"), merged.filter("id IS NULL").drop("id"), ["relpath"])
    return every.filter("id IS NOT NULL").select("relpath", "name")


@query("user_tags", "benchmark", "SELECT term, k FROM (SELECT DISTINCT 'tag ' || item_id % 7 AS term, 9::BIGINT AS k FROM benchmark) WHERE term <> 'tag 3' UNION ALL SELECT 'north', 9")
def _(benchmark):
    tags = benchmark.select(F.concat(F.lit("tag "), F.col("item_id") % 7).alias("term")).distinct().select(F.xxhash64("term").alias("id"), "term", F.lit(9).cast("long").alias("created_at"))
    tags, fresh = dml.insert_tag(tags, " north ", 9)
    tags, again = dml.insert_tag(tags, "north", 10)
    tags, gone = dml.delete_tag(tags, "tag 3")
    return tags.select("term", (F.col("created_at") + (0 if fresh and not again and gone else 1)).alias("k"))


@query("stamped_scores", "asset_scores documents", "SELECT doc_id AS asset_id, value, scored_at FROM (SELECT doc_id, 0.25::DOUBLE AS value, 1234567890::BIGINT AS scored_at FROM documents)")
def _(scores, documents):
    new = documents.select(F.col("doc_id").alias("asset_id"), F.lit("m").alias("metric_key"), F.lit(0.25).alias("value"))
    return dml.upsert_scores(scores, new, "s", "v", None, 1_234_567_890).filter("scorer_id = 's'").select("asset_id", "value", "scored_at")


# Requests.


@query("browse_request", "assets asset_scores", "SELECT id, value AS score_1 FROM assets JOIN asset_scores ON asset_id = id WHERE scorer_id = 'text' AND metric_key = 'length' AND value >= 100 AND favorited = TRUE ORDER BY value DESC, id LIMIT 50 OFFSET 50")
def _(assets, scores):
    levels = params.parse_levels([{"sort_by": "text:default:length", "min_score": " 100 ", "max_score": "much"}, {"sort_by": "no sort"}, {"sort_by": "labels:default:toxic"}])
    asked = params.BrowseQuery(params.Filters(favorited=True), levels, page=2)
    return browse.browse(assets, scores, asked)[0].select("id", "score_1")


@query("browse_pages", "assets", "SELECT n, greatest(1, (n + 49) // 50)::BIGINT AS pages FROM (SELECT count(DISTINCT coalesce(sha256, id::VARCHAR)) AS n FROM assets)")
def _(assets):
    n = browse.count_deduped(assets).first()["n"]
    return assets.sparkSession.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(params.page_count(n)).cast("long").alias("pages"))


@query("scorers_that_ran", "asset_scores", "SELECT scorer_id, count(*) > 0 AS ran FROM asset_scores GROUP BY scorer_id UNION ALL SELECT 'none', FALSE")
def _(scores):
    asked = [r[0] for r in browse.score_metrics(scores).select("scorer_id").distinct().collect()] + ["none"]
    return scores.sparkSession.createDataFrame([(s, browse.has_scores(scores, s, "default")) for s in asked], "scorer_id string, ran boolean")


@query("parsed_params", "events", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (props->>'$.k') END AS k, concat('{\"a\":', event_id, ',\"b\":\"', event_type, '\",\"c\":null}') AS canonical FROM events")
def _(events):
    broken = F.when(F.col("event_id") % 2 == 0, F.col("props")).when(F.col("event_id") % 3 == 0, F.lit("{no json"))
    return events.select("event_id", F.try_element_at(text.parse_params(broken), F.lit("k")).alias("k"), text.canonical_json(b=F.col("event_type"), a=F.col("event_id"), c=F.lit(None).cast("string")).alias("canonical"))


@query("presets_by_name", "nation", "SELECT n_name AS name FROM nation ORDER BY n_name")
def _(nation):
    return reports.view_presets(nation.select(F.col("n_name").alias("name")))


# Scorers.


class TextLength(scoring.Scorer):
    """The length of an item's text, and of its first word."""

    spec = scoring.Spec("labels", "Length", "1", (scoring.Variant("default", "Default", (scoring.Metric("quality", "Length"), scoring.Metric("word", "First word"))),))

    def score_batch(self, items: list[dict]) -> list[dict[str, float]]:
        return [{"quality": float(len(i["text"])), "word": float(len(i["text"].split(" ")[0]))} for i in items]


@query("run_scorer", "assets asset_scores documents", "SELECT asset_id, metric_key, value FROM asset_scores WHERE scorer_id = 'labels' UNION ALL SELECT doc_id, 'quality', length(text)::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'word', length(split_part(text, ' ', 1))::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "asset_scores")
def _(assets, scores, documents):
    inputs = documents.select(F.col("doc_id").alias("asset_id"), "text")
    return scoring.run_by_id({"labels": TextLength}, "labels", assets, scores, inputs, 5)[0].filter("scorer_id = 'labels'").select("asset_id", "metric_key", "value")


@query("model_scores", "embeddings", f"SELECT vec_id, round(greatest(0, least(10, embedding[1]::DOUBLE * 20)), 6) AS aesthetic, CASE WHEN vec_id % 2 = 0 THEN round(abs(embedding[1]::DOUBLE), 6) ELSE 0 END AS nsfw, CASE WHEN vec_id % 2 = 1 THEN round(abs(embedding[1]::DOUBLE), 6) ELSE 0 END AS anime, round(1 / (1 + exp(100 * ({_UNIT.format(v='embedding')}[2] - {_UNIT.format(v='embedding')}[1]))), 6) AS clip_quality FROM embeddings")
def _(embeddings):
    x = F.get("embedding", 0).cast("double")
    said = F.create_map(F.when(F.col("vec_id") % 2 == 0, "nsfw").otherwise("anime"), F.abs(x))
    scores = scoring.label_scores(said, ["nsfw", "anime"])
    good, bad = ([1.0 if k == j else 0.0 for k in range(64)] for j in (0, 1))
    return embeddings.select("vec_id", F.round(scoring.aesthetic(x * 20), 6).alias("aesthetic"), *(F.round(scores[k], 6).alias(k) for k in ("nsfw", "anime")), F.round(scoring.clip_quality(F.col("embedding"), good, bad), 6).alias("clip_quality"))


# Similarity.

@query("similar_detailed", "clip_embeddings phash assets", f"SELECT asset_id, score, a.taken_at, a.filename FROM (SELECT a.asset_id, round({_DOT} / {_NORM}, 4) AS score FROM clip_embeddings a, clip_embeddings q WHERE q.asset_id = 3 AND a.asset_id <> 3) JOIN assets a ON a.id = asset_id WHERE score >= 0.05")
def _(embeddings, phash, assets):
    return similarity.newest_first(similarity.with_details(similarity.find_similar(embeddings, phash, 3, "clip", "unheard of", 0.05), assets)).select("asset_id", "score", "taken_at", "filename")


@query("search_page", "clip_embeddings", f"SELECT a.asset_id, round({_DOT}, 4) AS score, (SELECT count(*) FROM clip_embeddings) AS total FROM clip_embeddings a, clip_embeddings q WHERE q.asset_id = 7 ORDER BY score DESC, a.asset_id LIMIT 20 OFFSET 40")
def _(embeddings):
    vector = embeddings.filter("asset_id = 7").first()["embedding"]
    return similarity.search_page(embeddings, list(vector), 20, 3)


_TERMS = "SELECT 'term ' || label AS term, arg_min(embedding, vec_id) AS embedding, label % 4 = 1 AS user_tag FROM embeddings WHERE label < 6 GROUP BY label UNION ALL SELECT 'tag ' || label, arg_min(embedding, vec_id), TRUE FROM embeddings WHERE label >= 6 GROUP BY label"


@query("words_with_tags", "embeddings", f"SELECT asset_id, term, score, user_tag FROM (SELECT a.vec_id AS asset_id, term, user_tag, {_SIM} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_SIM} DESC, term) AS rn FROM embeddings a, ({_TERMS}) q) WHERE rn <= 4")
def _(embeddings):
    first = embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"))
    vocabulary = first.filter("label < 6").select(F.concat(F.lit("term "), "label").alias("term"), "vector", F.col("label").alias("ord"))
    tags = first.filter("label >= 6 OR label % 4 = 1").select(F.when(F.col("label") >= 6, F.concat(F.lit("tag "), "label")).otherwise(F.concat(F.lit("term "), "label")).alias("term"), "vector")
    return similarity.terms_of_assets(embeddings.select(F.col("vec_id").alias("asset_id"), "embedding"), similarity.vocabulary_with_novel_tags(vocabulary, tags), 4)


@query("words_status", "clip_embeddings", "SELECT * FROM (VALUES (0::BIGINT, 'ok'), (1, 'embedding_corrupt'), (-1, 'no_embedding'), (2, 'clip_unavailable')) t(asset_id, status)", "")
def _(embeddings):
    stored = embeddings.withColumn("embedding", F.when(F.col("asset_id") == 1, F.slice("embedding", 1, 3)).otherwise(F.col("embedding")))
    return embeddings.sparkSession.createDataFrame([(i, similarity.words_status(stored, i, 64, i != 2)) for i in (0, 1, -1, 2)], "asset_id long, status string")


# Clusters.


def _with(name: str, engine: str, tables: str, last: str) -> None:
    """An oracle with further common tables behind the engine's."""
    ORACLE_SQL[name] = duck("SELECT 1", engine).replace(" SELECT 1", f", {tables} {last}")


#: Greedy complete linkage of each component in order k: groups are lists of members, {near} says whether z and the row's member are near.
_GREEDY = (
    "steps AS (SELECT root, 1::BIGINT AS k, [[m]] AS groups FROM ordered WHERE k = 1 UNION ALL "
    "SELECT s.root, s.k + 1, CASE WHEN hit IS NULL THEN list_append(s.groups, [s.m]) ELSE list_concat(s.groups[:hit - 1], [list_append(s.groups[hit], s.m)], s.groups[hit + 1:]) END "
    "FROM (SELECT s.root, s.k, s.groups, o.m, list_filter(range(1, len(s.groups) + 1), lambda g: len(list_filter(s.groups[g], lambda z: NOT ({near}))) = 0)[1] AS hit FROM steps s JOIN ordered o ON o.root = s.root AND o.k = s.k + 1) s), "
    "done AS (SELECT root, unnest(groups) AS g FROM (SELECT root, arg_max(groups, k) AS groups FROM steps GROUP BY root))"
)
_HASH = "('0x' || phash_hex)::BIGINT"
_NEAR_HASH = f"bit_count(xor(z.h, o.m.h)) <= {HAMMING}"
_with(
    "hash_clusters", "phash",
    f"placed AS (SELECT asset_id, {_HASH} AS h, row_number() OVER (ORDER BY phash_hex, asset_id) AS k FROM phash), edges AS (SELECT a.asset_id AS a, b.asset_id AS b FROM placed a JOIN placed b ON b.k > a.k AND b.k - a.k <= {WINDOW} WHERE bit_count(xor(a.h, b.h)) <= {HAMMING}), "
    "both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.seen FROM reach r JOIN both_ways e ON e.a = r.node), comp AS (SELECT node, min(seen) AS root FROM reach GROUP BY node), "
    "ordered AS (SELECT root, {'id': asset_id, 'h': h} AS m, row_number() OVER (PARTITION BY root ORDER BY h, asset_id) AS k FROM comp JOIN placed ON asset_id = node), " + _GREEDY.format(near=_NEAR_HASH),
    "SELECT list_min(list_transform(g, lambda m: m.id)) AS cluster_id, x.id AS asset_id, NULL::DOUBLE AS distance, x.id = list_min(list_transform(g, lambda m: m.id)) AS is_representative, "
    "list_max(list_transform(g, lambda m: list_max(list_transform(g, lambda n: bit_count(xor(m.h, n.h))))))::DOUBLE AS diameter FROM (SELECT g, unnest(g) AS x FROM done WHERE len(g) >= 2)",
)
_UNIT_EMB = _UNIT.format(v="embedding")
_with(
    "complete_linkage", "clip_embeddings",
    f"{_COMPONENTS}, ordered AS (SELECT root, {{'id': node, 'u': {_UNIT_EMB}}} AS m, row_number() OVER (PARTITION BY root ORDER BY node) AS k FROM comp JOIN clip_embeddings ON asset_id = node), " + _GREEDY.format(near=f"list_inner_product(z.u, o.m.u) >= {CLUSTER - 1e-12}"),
    "SELECT list_min(list_transform(g, lambda m: m.id)) AS cluster_id, x.id AS asset_id, round(1 - list_min(list_transform(g, lambda m: list_min(list_transform(g, lambda n: list_inner_product(m.u, n.u))))), 4) AS diameter FROM (SELECT g, unnest(g) AS x FROM done WHERE len(g) >= 2)",
)
_with(
    "face_clusters", "clip_embeddings",
    f"{_DBSCAN.replace('>= 3', '>= 2')}, units AS (SELECT c.root AS g, c.node, {_UNIT_EMB} AS u FROM comp c JOIN embeddings ON vec_id = c.node), centres AS ({_MEAN.format(units='SELECT g, u FROM units')}), near AS (SELECT u.g AS cluster_id, u.node AS face_id, 1 - list_inner_product(u.u, c.c) AS d FROM units u JOIN centres c ON c.g = u.g)",
    "SELECT cluster_id, face_id, round(d, 4) AS distance, row_number() OVER (PARTITION BY cluster_id ORDER BY round(d, 9), face_id) = 1 AS is_representative FROM near",
)


_BITS = " + ".join(f"bit_count(xor(('0x' || substr(a.phash_hex, {16 * k + 1}, 16))::UBIGINT, ('0x' || substr(b.phash_hex, {16 * k + 1}, 16))::UBIGINT))::BIGINT" for k in range(4))


@query("hash_index_search", "phash_full", f"SELECT a.asset_id, ({_BITS})::BIGINT AS score FROM phash_full a, phash_full b WHERE b.asset_id = 1 AND {_BITS} <= 46")
def _(phash):
    path = f"{checkpoint_dir(phash.sparkSession)}/hashes-{uuid.uuid4().hex}"
    hash_index.write(phash, path)
    return hash_index.search(phash.sparkSession, path, phash.filter("asset_id = 1").first()["phash_hex"], 46)


@query("cell_index_search", "clip_embeddings")
def _(embeddings):
    path = f"{checkpoint_dir(embeddings.sparkSession)}/cells-{uuid.uuid4().hex}"
    vector_index.write(embeddings, path)
    asked = list(embeddings.filter("asset_id = 0").first()["embedding"])
    return vector_index.search(embeddings.sparkSession, path, asked, "cosine", 0.1).filter("asset_id <> 0")


ORACLE_SQL["cell_index_search"] = ORACLE_SQL["similar_cosine"]


#: Distances up to which parts of the mutual reachability graph are counted.
_REACH = (0.2, 0.4, 0.6, 0.8, 1.0)


_with(
    "reachability_forest", "clip_embeddings",
    f"u AS (SELECT asset_id AS id, {_UNIT_EMB} AS u FROM clip_embeddings), d AS (SELECT a.id AS a, b.id AS b, round(sqrt(greatest(0, 2 - 2 * list_inner_product(a.u, b.u))), 6) AS d FROM u a JOIN u b ON a.id <> b.id), "
    "core AS (SELECT a, min(d) AS c FROM d GROUP BY a), pairs AS (SELECT d.a, d.b, greatest(d, x.c, y.c) AS w FROM d JOIN core x ON x.a = d.a JOIN core y ON y.a = d.b), "
    f"reached AS (SELECT t, id AS a, id AS b FROM u, (SELECT unnest({list(_REACH)}::DOUBLE[]) AS t) UNION SELECT r.t, r.a, p.b FROM reached r JOIN pairs p ON p.a = r.b AND p.w <= r.t)",
    "SELECT t, count(DISTINCT least) AS parts FROM (SELECT t, a, min(b) AS least FROM reached GROUP BY t, a) GROUP BY t",
)


@query("reachability_forest", "clip_embeddings")
def _(embeddings):
    points = embeddings.filter(vectors.valid(F.col("embedding"))).select(F.lit(0).alias("g"), F.col("asset_id").alias("node"), vectors.unit(F.col("embedding")).alias("v"))
    edges = density.spanning_forest(points, 2).select(F.explode(F.array(*(F.struct(F.lit(t).alias("t"), (F.col("w") <= t).alias("short")) for t in _REACH))).alias("e"))
    short = edges.groupBy("e.t").agg(F.sum(F.col("e.short").cast("long")).alias("short"))
    return short.join(F.broadcast(points.agg(F.count("*").alias("n")))).select("t", (F.col("n") - F.col("short")).alias("parts"))


@query("map_invariants", "clip_embeddings", "SELECT count(*) AS points, 0.0::DOUBLE AS middle, 0.0::DOUBLE AS related, greatest(2, floor(sqrt(count(*))))::BIGINT AS most, count(*) AS in_clusters, 0::BIGINT AS strangers FROM clip_embeddings")
def _(embeddings):
    def first_three(pcs):
        from pyspark.ml.functions import vector_to_array

        return pcs.withColumn("coords", F.slice(vector_to_array("pcs"), 1, 3))

    points, clusters = cluster.embedding_map(embeddings, 1000, projector=first_three)
    around = points.agg(F.count("*").alias("points"), F.abs(F.round(F.avg(F.col("x") + F.col("y") + F.col("z")), 3)).alias("middle"), F.abs(F.round(F.corr("x", "y") + F.corr("x", "z") + F.corr("y", "z"), 2)).alias("related"))
    most = clusters.agg(F.max(F.lit(1)).alias("one"), F.count("*").alias("n"), F.sum("size").alias("in_clusters"))
    strangers = clusters.join(points, (points["asset_id"] == clusters["rep_asset_id"]) & (points["label"] == clusters["label"]), "left_anti").agg(F.count("*").alias("strangers"))
    limit = embeddings.agg(F.greatest(F.lit(2), F.floor(F.sqrt(F.count("*")))).cast("long").alias("most"))
    return around.join(F.broadcast(most)).join(F.broadcast(limit)).join(F.broadcast(strangers)).filter("n <= most").select("points", "middle", "related", "most", "in_clusters", "strangers")


_with(
    "map_neighbours", "clip_embeddings",
    f"u AS (SELECT asset_id AS id, {_UNIT_EMB} AS u FROM clip_embeddings), d AS (SELECT a.id AS asset_id, 1 - list_inner_product(a.u, b.u) AS d FROM u a JOIN u b ON a.id <> b.id)",
    "SELECT asset_id, k, round(d, 6) AS distance FROM (SELECT asset_id, d, row_number() OVER (PARTITION BY asset_id ORDER BY d) AS k FROM d) WHERE k <= 15",
)


@query("map_neighbours", "clip_embeddings")
def _(embeddings):
    lists = projection.neighbours(embeddings.select(F.col("asset_id").alias("node"), F.col("embedding").cast("array<double>").alias("v")))
    return lists.select(F.col("node").alias("asset_id"), F.posexplode("near").alias("k", "e")).select("asset_id", (F.col("k") + 1).cast("long").alias("k"), F.round("e.d", 6).alias("distance"))


_with("map_clusters", "clip_embeddings", "n AS (SELECT count(*) AS n FROM clip_embeddings)", "SELECT n AS points, least(24, greatest(2, floor(sqrt(n))), n)::BIGINT AS most, n AS in_clusters, 0::BIGINT AS strangers FROM n")


@query("map_clusters", "clip_embeddings")
def _(embeddings):
    points, clusters = cluster.embedding_map(embeddings)
    sizes = clusters.agg(F.count("*").alias("n"), F.sum("size").alias("in_clusters"), F.min("size").alias("least"))
    strangers = clusters.join(points, (points["asset_id"] == clusters["rep_asset_id"]) & (points["label"] == clusters["label"]), "left_anti").agg(F.count("*").alias("strangers"))
    apart = points.select("x", "y", "z").distinct().agg(F.count("*").alias("places"))
    limit = embeddings.agg(F.count("*").alias("points")).withColumn("most", F.least(F.lit(24), F.greatest(F.lit(2), F.floor(F.sqrt("points"))), F.col("points")).cast("long"))
    return limit.join(F.broadcast(sizes)).join(F.broadcast(strangers)).join(F.broadcast(apart)).filter("n <= most AND least > 0 AND 2 * places > points").select("points", "most", "in_clusters", "strangers")


@query("kmeans_invariants", "clip_embeddings", "SELECT count(*) AS points, 10::BIGINT AS labels, 0::BIGINT AS lowest, 9::BIGINT AS highest FROM clip_embeddings")
def _(embeddings):
    from pyspark.ml.functions import array_to_vector

    made = cluster.kmeans(embeddings.select("asset_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("f")), "f", 10)
    return made.agg(F.count("*").alias("points"), F.countDistinct("label").alias("labels"), F.min("label").cast("long").alias("lowest"), F.max("label").cast("long").alias("highest"))


_THREE = "[embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE]"


@query("capped_clusters", "embeddings", f"WITH pts AS (SELECT vec_id, label::BIGINT AS label, {_THREE} AS c FROM embeddings), top AS (SELECT label FROM pts GROUP BY label ORDER BY count(*) DESC, label LIMIT 4), mid AS (SELECT label, avg(c[1]) AS x, avg(c[2]) AS y, avg(c[3]) AS z FROM pts WHERE label IN (SELECT label FROM top) GROUP BY label) SELECT vec_id, CASE WHEN label IN (SELECT label FROM top) THEN label ELSE (SELECT arg_min(m.label, (p.c[1] - x) ** 2 + (p.c[2] - y) ** 2 + (p.c[3] - z) ** 2) FROM mid m) END AS label FROM pts p")
def _(embeddings):
    points = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double")).alias("coords"))
    return cluster.cap_clusters(points, 4).select("vec_id", "label")


# Progress.


@query("diagnostics", "events", "SELECT event_type AS stage, count(*) AS runs, sum(user_id)::BIGINT AS items, round(sum(value), 4) AS seconds, max(value) AS slowest, round(sum(value) * 1000 / sum(user_id), 4) AS ms_per_item FROM events GROUP BY event_type")
def _(events):
    measured = events.select(F.col("event_type").alias("stage"), F.col("user_id").cast("long").alias("items"), F.col("value").alias("seconds"))
    made = progress.diagnostics(measured)
    return made.withColumns({c: F.round(c, 4) for c in ("seconds", "ms_per_item")})


@query("progress", "events", "SELECT event_id, round(least(1, event_id / 500.0::DOUBLE) * 5, 6) AS scanning, round(5 + least(1, event_id / 500.0::DOUBLE) * 95, 6) AS processing FROM events")
def _(events):
    done, total = F.col("event_id"), F.lit(500)
    return events.select("event_id", *(F.round(progress.percent(p, done, total), 6).alias(n) for p, n in (("scan", "scanning"), ("process", "processing"))))


@query("softmax", "documents", "SELECT doc_id, round(exp(n_chars / 1000.0::DOUBLE) / (exp(n_chars / 1000.0::DOUBLE) + exp(1)), 9) AS share FROM documents")
def _(documents):
    return documents.select("doc_id", F.round(vectors.softmax_first(F.col("n_chars") / 1000, F.lit(1.0)), 9).alias("share"))
