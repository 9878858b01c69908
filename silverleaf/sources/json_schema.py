"""The schema of a set of JSON documents: what stands at each path, how often, how large."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import checkpoint

#: Examples that are kept of each path.
EXAMPLES = 3
_ROW = pa.schema([("path", pa.string()), ("parent", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("example", pa.string())])


def _walk(value, path: str, parent: str | None) -> Iterator[tuple]:
    if isinstance(value, dict):
        yield path, parent, "object", None, None
        for k, v in value.items():
            yield from _walk(v, f"{path}.{k}", path)
    elif isinstance(value, list):
        yield path, parent, "array", len(value), None
        for v in value:
            yield from _walk(v, f"{path}[]", None)
    else:
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "number" if isinstance(value, float) else "string"
        yield path, parent, kind, None, json.dumps(value, ensure_ascii=False)


def profile(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """One row for each path: kinds, how often seen, required or not, array sizes, examples.

    A key is required if every object at its parent's path has it. Documents that do
    not parse stand under the path ``!``. Examples are the three smallest values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                try:
                    out += _walk(json.loads(text or ""), "$", None)
                except ValueError:
                    out.append(("!", None, "invalid", None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ROW)] if out else [pa.array([], f.type) for f in _ROW], schema=_ROW)

    rows = docs.select(F.col(json_col).cast("string")).mapInArrow(run, "path string, parent string, kind string, size long, example string")
    # Each task passes on no more than its own smallest few of a path.
    place = F.row_number().over(Window.partitionBy("path").orderBy("example"))
    few = rows.filter("example IS NOT NULL").select("path", "example").distinct().withColumn("k", place).filter(F.col("k") <= EXAMPLES)
    values = few.groupBy("path").agg(F.array_sort(F.collect_list("example")).alias("examples"))
    stats = rows.groupBy("path").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.count("*").alias("seen"), F.min("size").alias("min_items"), F.max("size").alias("max_items"), F.min("parent").alias("parent"),
        F.count_if(F.col("kind") == "object").alias("objects"),
    )
    above = stats.select(F.col("path").alias("parent"), F.col("objects").alias("parents"))
    named = stats.join(above, "parent", "left").join(values, "path", "left")
    return named.select("path", "kinds", "seen", (F.col("seen") == F.col("parents")).alias("required"), "min_items", "max_items", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def profile_files(spark: SparkSession, root: str, pattern: str = "*.json", limit: int | None = None) -> tuple[DataFrame, int, int]:
    """(profile, files that parse, files that don't) of the JSON files below root, the first `limit` by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    if limit is not None:
        files = files.orderBy("path").limit(limit)
    docs = files.select(F.decode("content", "UTF-8").alias("json"))
    made = checkpoint(profile(docs))
    failed = made.filter("path = '!'").agg(F.sum("seen")).first()[0] or 0
    return made, docs.count() - failed, failed
