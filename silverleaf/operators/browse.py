"""Scan, filter, join, sort and page over assets and their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.params import BrowseQuery, Filters, SortCriterion
from ..schema import INDEXER_VERSION

SCORE_KEY = ("scorer_id", "variant_id", "metric_key")


def matching(assets: DataFrame, filters: Filters) -> DataFrame:
    """Rows that meet every given predicate."""
    tests = [F.col(c) == F.lit(v) for c in ("favorited", "archived", "trashed") if (v := getattr(filters, c)) is not None]
    if filters.ext is not None:
        tests.append(F.col("ext") == filters.ext.lower())
    return assets.filter(reduce(Column.__and__, tests)) if tests else assets


def page(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def newest_first() -> list[Column]:
    """Newest first, undated last, ids settle ties."""
    return [F.desc_nulls_last("taken_at"), F.asc("id")]


def content_key() -> Column:
    return F.coalesce("sha256", F.col("id").cast("string"))


# Scans and look-ups.


def by_id(table: DataFrame, value: int, key: str = "id") -> DataFrame:
    return table.filter(F.col(key) == value).limit(1)


def by_relpath(assets: DataFrame, asset_paths: DataFrame, relpath: str) -> DataFrame:
    """The asset at a path; if there is none, the asset that has it as an alias."""
    direct = assets.filter(F.col("relpath") == relpath).withColumn("via", F.lit(0))
    alias = asset_paths.filter(F.col("relpath") == relpath).select(F.col("asset_id").alias("id"))
    other = assets.join(F.broadcast(alias.limit(1)), "id", "left_semi").withColumn("via", F.lit(1))
    return direct.unionByName(other).orderBy("via").limit(1).drop("via")


def by_sha256(assets: DataFrame, sha256: str) -> DataFrame:
    """(id, has_sidecar) of the first asset with a content hash."""
    return assets.filter(F.col("sha256") == sha256).orderBy("id").limit(1).select("id", F.col("sidecar_relpath").isNotNull().alias("has_sidecar"))


def all_ids(assets: DataFrame) -> DataFrame:
    return assets.select("id").orderBy("id")


def ids_without_sha256(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("sha256").isNull()).select("id").orderBy("id")


def duplicates_of(assets: DataFrame, sha256: str) -> DataFrame:
    return assets.filter(F.col("sha256") == sha256).orderBy("id")


def alias_paths(asset_paths: DataFrame, asset_id: int) -> DataFrame:
    return asset_paths.filter(F.col("asset_id") == asset_id).select("relpath").orderBy("relpath")


def phashes(phash: DataFrame, algo: str | None = None) -> DataFrame:
    rows = phash if algo is None else phash.filter(F.col("algo") == algo)
    return rows.select("asset_id", "phash_hex").orderBy("asset_id")


def embeddings_with_paths(embeddings: DataFrame, assets: DataFrame) -> DataFrame:
    return embeddings.join(assets.select(F.col("id").alias("asset_id"), "relpath"), "asset_id").select("asset_id", "embedding", "relpath").orderBy("asset_id")


# Lists and counts.


def list_assets(assets: DataFrame, filters: Filters = Filters(), limit: int | None = 100, offset: int = 0, order: list[Column] | None = None) -> DataFrame:
    return page(matching(assets, filters).orderBy(*(order or newest_first())), limit, offset)


def count_assets(assets: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return matching(assets, filters).agg(F.count("*").alias("n"))


def deduped(assets: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """The smallest id of each content, among the rows that pass the filters."""
    rank = F.row_number().over(Window.partitionBy(content_key()).orderBy("id"))
    return matching(assets, filters).withColumn("rn", rank).filter("rn = 1").drop("rn")


def list_deduped(assets: DataFrame, filters: Filters = Filters(), limit: int | None = 100, offset: int = 0) -> DataFrame:
    return page(deduped(assets, filters).orderBy(*newest_first()), limit, offset)


def count_deduped(assets: DataFrame, filters: Filters = Filters()) -> DataFrame:
    return matching(assets, filters).agg(F.countDistinct(content_key()).alias("n"))


def needing_rescan(assets: DataFrame, full: bool = False) -> DataFrame:
    rows = assets if full else assets.filter(F.col("indexer_version").isNull() | (F.col("indexer_version") < INDEXER_VERSION))
    return rows.select("id", "relpath", "sidecar_relpath").orderBy("id")


# Scores.


def _of(scores: DataFrame, scorer_id: str, variant_id: str, metric_key: str) -> DataFrame:
    return scores.filter((F.col("scorer_id") == scorer_id) & (F.col("variant_id") == variant_id) & (F.col("metric_key") == metric_key))


def _within(value: Column, low: float | None, high: float | None) -> Column:
    tests = [F.lit(True)]
    if low is not None:
        tests.append(value >= F.lit(low))
    if high is not None:
        tests.append(value <= F.lit(high))
    return reduce(Column.__and__, tests)


def scored(assets: DataFrame, scores: DataFrame, by: SortCriterion, filters: Filters = Filters()) -> DataFrame:
    """Assets that have the score, in range, with it as `score`."""
    own = _of(scores, by.scorer_id, by.variant_id, by.metric_key).filter(_within(F.col("value"), by.min_score, by.max_score))
    return matching(assets, filters).join(own.select(F.col("asset_id").alias("id"), F.col("value").alias("score")), "id")


def list_by_score(assets: DataFrame, scores: DataFrame, by: SortCriterion, filters: Filters = Filters(), limit: int | None = 100, offset: int = 0) -> DataFrame:
    first = F.desc("score") if by.descending else F.asc("score")
    return page(scored(assets, scores, by, filters).orderBy(first, "id"), limit, offset)


def count_with_score(assets: DataFrame, scores: DataFrame, by: SortCriterion, filters: Filters = Filters()) -> DataFrame:
    return scored(assets, scores, by, filters).agg(F.count("*").alias("n"))


def multi_scored(assets: DataFrame, scores: DataFrame, criteria: tuple[SortCriterion, ...], filters: Filters = Filters()) -> DataFrame:
    """Assets with score_1 .. score_n; the first must be there, the others may be null.

    One pass over the scores: the criteria's metrics become columns by conditional
    aggregation, so there is one shuffle of scores instead of one join each.
    """
    keys = [(c.scorer_id, c.variant_id, c.metric_key) for c in criteria]
    is_key = [reduce(Column.__and__, [F.col(n) == v for n, v in zip(SCORE_KEY, k)]) for k in keys]
    wide = scores.filter(reduce(Column.__or__, is_key)).groupBy(F.col("asset_id").alias("id")).agg(*(F.max(F.when(k, F.col("value"))).alias(f"score_{n}") for n, k in enumerate(is_key, 1)))
    wide = wide.filter(F.col("score_1").isNotNull())
    for n, c in enumerate(criteria, 1):
        wide = wide.filter(_within(F.col(f"score_{n}"), c.min_score, c.max_score))
    return matching(assets, filters).join(wide, "id")


def list_multi_sort(assets: DataFrame, scores: DataFrame, criteria: tuple[SortCriterion, ...], filters: Filters = Filters(), limit: int | None = 100, offset: int = 0) -> DataFrame:
    """Sorted by each criterion in turn, missing scores last in either direction."""
    order = [(F.desc_nulls_last if c.descending else F.asc_nulls_last)(f"score_{n}") for n, c in enumerate(criteria, 1)]
    return page(multi_scored(assets, scores, criteria, filters).orderBy(*order, "id"), limit, offset)


def count_multi_sort(assets: DataFrame, scores: DataFrame, criteria: tuple[SortCriterion, ...], filters: Filters = Filters()) -> DataFrame:
    return multi_scored(assets, scores, criteria, filters).agg(F.count("*").alias("n"))


def scores_of(scores: DataFrame, asset_id: int) -> DataFrame:
    return scores.filter(F.col("asset_id") == asset_id).orderBy(*SCORE_KEY)


def has_scores(scores: DataFrame, scorer_id: str, variant_id: str) -> bool:
    return not scores.filter((F.col("scorer_id") == scorer_id) & (F.col("variant_id") == variant_id)).limit(1).isEmpty()


def score_metrics(scores: DataFrame) -> DataFrame:
    return scores.select(*SCORE_KEY).distinct()


def score_facets(scores: DataFrame, specs: DataFrame) -> DataFrame:
    """The metrics that occur, with the names of the registered ones; others drop out."""
    return score_metrics(scores).join(F.broadcast(specs), list(SCORE_KEY))


def without_score(assets: DataFrame, scores: DataFrame, scorer_id: str, variant_id: str, metric_key: str, version: str | None = None) -> DataFrame:
    """Ids that lack the score, or have it only from another version."""
    have = _of(scores, scorer_id, variant_id, metric_key)
    have = have if version is None else have.filter(F.col("scorer_version") == version)
    return _lacking(assets, have)


def _lacking(assets: DataFrame, have: DataFrame) -> DataFrame:
    return assets.select("id").join(have.select(F.col("asset_id").alias("id")), "id", "left_anti").orderBy("id")


def without_phash(assets: DataFrame, phash: DataFrame, algo: str | None = None) -> DataFrame:
    """Ids without a perceptual hash, or with one of another algorithm."""
    return _lacking(assets, phash if algo is None else phash.filter(F.col("algo") == algo))


def without_embedding(assets: DataFrame, embeddings: DataFrame) -> DataFrame:
    return _lacking(assets, embeddings)


def without_faces(assets: DataFrame, faces: DataFrame, run_id: int | None = None) -> DataFrame:
    return _lacking(assets, faces if run_id is None else faces.filter(F.col("run_id") == run_id))


# Time.


def taken_range(assets: DataFrame) -> DataFrame:
    return assets.agg(F.min("taken_at").alias("oldest"), F.max("taken_at").alias("newest"))


def timeline_years(assets: DataFrame) -> DataFrame:
    """First and last year (UTC); null without dated assets."""
    year = lambda c: F.year(F.to_utc_timestamp(F.timestamp_seconds(c), F.current_timezone())).cast("long")
    return taken_range(assets).select(year("oldest").alias("first_year"), year("newest").alias("last_year"))


def count_newer(assets: DataFrame, timestamp: int, favorited: bool | None = None, dedupe: bool = False) -> DataFrame:
    """How many assets, or contents among them, are strictly newer."""
    newer = matching(assets, Filters(favorited=favorited)).filter(F.col("taken_at") > timestamp)
    return newer.agg((F.countDistinct(content_key()) if dedupe else F.count("*")).alias("n"))


def seek_page(assets: DataFrame, timestamp: int, favorited: bool | None = None, dedupe: bool = True, size: int = 50) -> DataFrame:
    return count_newer(assets, timestamp, favorited, dedupe).select(F.greatest(F.lit(1), F.floor(F.col("n") / size) + 1).cast("long").alias("page"))


def browse(assets: DataFrame, scores: DataFrame, q: BrowseQuery) -> tuple[DataFrame, DataFrame]:
    """(page, count) for one browse request; a score sort shows duplicates as well."""
    if q.criteria:
        return list_multi_sort(assets, scores, q.criteria, q.filters, q.page_size, q.offset), count_multi_sort(assets, scores, q.criteria, q.filters)
    if q.dedupe:
        return list_deduped(assets, q.filters, q.page_size, q.offset), count_deduped(assets, q.filters)
    return list_assets(assets, q.filters, q.page_size, q.offset), count_assets(assets, q.filters)
