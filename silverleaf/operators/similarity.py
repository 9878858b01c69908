"""Similarity search: one vector, hash, centroid or vocabulary against a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits, vectors

HAMMING_THRESHOLD = 20


def _literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def similar_to_vector(embeddings: DataFrame, vector: list[float], metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """(asset_id, score) of stored vectors in range, best first; nothing is left out.

    Invalid stored vectors drop out; so does everything if the query is (almost) zero.
    The score is rounded to 4 places and tested as such.
    """
    vectors.check(metric)
    length = sum(x * x for x in vector) ** 0.5
    if length < vectors.MIN_NORM:
        return embeddings.select("asset_id", F.lit(0.0).alias("score")).limit(0)
    limit = vectors.SEARCH_THRESHOLDS[metric] if threshold is None else threshold
    query = _literal([x / length for x in vector])
    v = F.col("embedding")
    rows = embeddings.filter(vectors.valid(v, len(vector)))
    score = F.round(vectors.from_cosine(vectors.dot(v, query) / vectors.norm(v), metric), 4)
    found = rows.select("asset_id", score.alias("score")).filter(vectors.passes(F.col("score"), metric, limit))
    return found.orderBy(F.desc("score") if metric == "cosine" else F.asc("score"), "asset_id")


def similar_to_asset(embeddings: DataFrame, asset_id: int, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """The stored vectors similar to one of them, without itself; an unknown metric counts as cosine."""
    metric = metric if metric in vectors.METRICS else "cosine"
    row = embeddings.filter(F.col("asset_id") == asset_id).select("embedding").first()
    vector = list(row[0]) if row and row[0] is not None else [0.0]
    return similar_to_vector(embeddings, vector, metric, threshold).filter(F.col("asset_id") != asset_id)


def similar_to_hash(phash: DataFrame, phash_hex: str, threshold: float | None = None, algo: str | None = None) -> DataFrame:
    """(asset_id, score): hashes at no more differing bits, fewest first; none for an invalid query."""
    limit = HAMMING_THRESHOLD if threshold is None else int(threshold)
    rows = phash if algo is None else phash.filter(F.col("algo") == algo)
    distance = bits.hamming(bits.hash_words(F.col("phash_hex")), bits.hash_words(F.lit(phash_hex)))
    found = rows.select("asset_id", distance.cast("long").alias("score"))
    return found.filter(F.col("score") <= limit).orderBy("score", "asset_id")


def hash_similar_to_asset(phash: DataFrame, asset_id: int, threshold: float | None = None) -> DataFrame:
    row = phash.filter(F.col("asset_id") == asset_id).select("phash_hex").first()
    return similar_to_hash(phash, row[0] if row and row[0] else "", threshold).filter(F.col("asset_id") != asset_id)


METHODS = ("clip", "phash")


def find_similar(embeddings: DataFrame, phash: DataFrame, asset_id: int, method: str = "clip", metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """(asset_id, score) of assets like one of them, by vector or by hash."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    if method == "phash":
        return hash_similar_to_asset(phash, asset_id, threshold)
    return similar_to_asset(embeddings, asset_id, metric, threshold)


def with_details(found: DataFrame, assets: DataFrame) -> DataFrame:
    """Results with capture time and file name."""
    return found.join(assets.select(F.col("id").alias("asset_id"), "taken_at", "filename"), "asset_id")


def newest_first(detailed: DataFrame) -> DataFrame:
    """Results by capture time, undated ones last."""
    return detailed.orderBy(F.desc(F.coalesce("taken_at", F.lit(0))), "asset_id")


def similarity_status(found: DataFrame, assets: DataFrame, stored: DataFrame, asset_id: int, method: str = "clip") -> str:
    """``unknown_asset``, ``ok``, ``no_match``, or which derivation the asset lacks."""
    if assets.filter(F.col("id") == asset_id).isEmpty():
        return "unknown_asset"
    if not found.isEmpty():
        return "ok"
    lacks = stored.filter(F.col("asset_id") == asset_id).isEmpty()
    return ("no_phash" if method == "phash" else "no_embedding") if lacks else "no_match"


def search(embeddings: DataFrame, vector: list[float], limit: int = 50, page: int = 1) -> DataFrame:
    """(asset_id, score): the largest dot products with vectors as stored, one page of them."""
    size = max(1, min(200, limit))
    score = F.round(vectors.dot(F.col("embedding"), _literal(vector)), 4)
    rows = embeddings.filter(F.size("embedding") == len(vector)).select("asset_id", score.alias("score"))
    return rows.orderBy(F.desc("score"), "asset_id").offset(max(0, (page - 1) * size)).limit(size)


def search_page(embeddings: DataFrame, vector: list[float] | None, limit: int = 50, page: int = 1) -> DataFrame:
    """One page of search() with `total`, the number of stored vectors, on every row.

    A page beyond the last, or no vector (a blank query), gives no rows.
    """
    total = embeddings.agg(F.count("*").alias("total"))
    if vector is None:
        return embeddings.select("asset_id", F.lit(0.0).alias("score")).limit(0).join(F.broadcast(total))
    return search(embeddings, vector, limit, page).join(F.broadcast(total))


def vocabulary_with_novel_tags(vocabulary: DataFrame, tags: DataFrame) -> DataFrame:
    """(term, vector, user_tag): the vocabulary, then the tags that it lacks; a flag says which terms are tags.

    Both have term and vector; a term that stands there twice counts once, at its first place.
    """
    known = vocabulary.groupBy("term").agg(F.min_by("vector", "ord").alias("vector")) if "ord" in vocabulary.columns else vocabulary.dropDuplicates(["term"])
    tagged = tags.select("term").distinct().withColumn("user_tag", F.lit(True))
    base = known.select("term", "vector").join(tagged, "term", "left").select("term", "vector", F.coalesce("user_tag", F.lit(False)).alias("user_tag"))
    novel = tags.dropDuplicates(["term"]).join(known.select("term"), "term", "left_anti").select("term", "vector", F.lit(True).alias("user_tag"))
    return base.unionByName(novel)


def terms_of_assets(embeddings: DataFrame, vocabulary: DataFrame, top_k: int = 20) -> DataFrame:
    """(asset_id, term, score): the best terms of each given asset; vocabulary: term, vector.

    With a column user_tag in the vocabulary the result has it, too. The vocabulary is a
    fixed list (hundreds of terms), sent to every task as one row; an asset's terms are
    ranked inside its own row, so nothing is shuffled.
    """
    k = max(1, min(100, top_k))
    flagged = "user_tag" in vocabulary.columns
    flag = F.col("user_tag") if flagged else F.lit(False)
    terms = vocabulary.agg(F.array_sort(F.collect_list(F.struct("term", vectors.unit(F.col("vector")).alias("v"), flag.alias("tag")))).alias("terms"))
    rows = embeddings.join(F.broadcast(terms)).select("asset_id", vectors.unit(F.col("embedding")).alias("u"), "terms")
    score = lambda t: F.round(vectors.dot(F.col("u"), t["v"]), 4)
    scored = F.transform("terms", lambda t: F.struct((-score(t)).alias("s"), t["term"].alias("term"), t["tag"].alias("tag")))
    best = rows.select("asset_id", F.explode(F.slice(F.array_sort(scored), 1, k)).alias("t"))
    return best.select("asset_id", "t.term", (-F.col("t.s")).alias("score"), *([F.col("t.tag").alias("user_tag")] if flagged else []))


def words_status(embeddings: DataFrame, asset_id: int, dim: int, has_encoder: bool = True) -> str:
    """``ok``, or why an asset's words can't be told: ``no_embedding``, ``embedding_corrupt``, ``clip_unavailable``."""
    if not has_encoder:
        return "clip_unavailable"
    row = embeddings.filter(F.col("asset_id") == asset_id).select(vectors.valid(F.col("embedding"), dim).alias("good")).first()
    return "no_embedding" if row is None else "ok" if row["good"] else "embedding_corrupt"


def centroids(vecs: DataFrame, group: str, dim: int | None = None) -> DataFrame:
    """(group, centroid): the mean of each group's unit vectors, itself made a unit vector.

    Each task keeps one sum a group and adds vectors to it, so vectors are neither taken
    apart nor moved. Of a group whose vectors differ in length the most frequent counts.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    units = vecs.filter(vectors.valid(F.col("embedding"), dim)).select(group, F.size("embedding").alias("length"), array_to_vector(vectors.unit(F.col("embedding"))).alias("u"))
    means = units.groupBy(group, "length").agg(Summarizer.mean(F.col("u")).alias("m"), F.count("*").alias("n"))
    mean = means.groupBy(group).agg(F.max_by(vector_to_array("m"), F.struct("n", "length")).alias("mean"))
    return mean.filter(vectors.norm(F.col("mean")) > vectors.MIN_NORM).select(group, vectors.unit(F.col("mean")).alias("centroid"))


def medoids(vecs: DataFrame, group: str, id_col: str = "asset_id") -> DataFrame:
    """(group, id, distance): the member nearest to its group's centroid, the smallest id of equals (to 9 places)."""
    scored = vecs.filter(vectors.valid(F.col("embedding"))).join(centroids(vecs, group), group).select(group, id_col, F.round(vectors.dot(vectors.unit(F.col("embedding")), F.col("centroid")), 9).alias("sim"))
    best = scored.groupBy(group).agg(F.min_by(F.struct(id_col, "sim"), F.struct((-F.col("sim")).alias("s"), F.col(id_col))).alias("m"))
    return best.select(group, F.col(f"m.{id_col}").alias(id_col), (1 - F.col("m.sim")).alias("distance"))


def similar_to_group(embeddings: DataFrame, asset_ids: DataFrame, threshold: float = 0.80, limit: int = 50) -> DataFrame:
    """(asset_id, score): assets near the centroid of a set of assets, without the set."""
    own = embeddings.join(asset_ids.select("asset_id").distinct(), "asset_id", "left_semi")
    middle = centroids(own.withColumn("g", F.lit(0)), "g").select("centroid").first()
    if middle is None:
        return embeddings.select("asset_id", F.lit(0.0).alias("score")).limit(0)
    others = embeddings.join(asset_ids.select("asset_id").distinct(), "asset_id", "left_anti")
    return similar_to_vector(others, list(middle[0]), "cosine", threshold).limit(limit)
