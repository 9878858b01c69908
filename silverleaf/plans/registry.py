"""Known libraries and tuning settings, each a log of Parquet rows; the latest row counts.

Nothing is ever rewritten: opening a library or changing a setting adds a row, so two
sessions can do so at once and a job that dies leaves the log as it was.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, slug

#: Accelerators, batch sizes that may be chosen, and defaults.
ACCELERATORS = ("auto", "onnx", "torch", "tensorrt")
BATCH_SIZES = (64, 96, 128, 160)
DEFAULTS = {"accelerator": "torch", "batch_size": 128, "half_precision": True}

OPENED = "id string, name string, root string, tables string, last_opened_at timestamp"
CHANGED = "key string, value string, at timestamp"
#: What a stored value must be, and how it is read.
_READ = {"accelerator": {a: a for a in ACCELERATORS}, "batch_size": {str(n): n for n in BATCH_SIZES}, "half_precision": {"true": True, "false": False}}


class Registry:
    """The two logs under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self, name: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def open(self, root: str, tables: str, now: datetime | None = None) -> None:
        """Remember that a library was opened."""
        name = basename(F.rtrim(F.lit(root), F.lit("/")))
        row = self.spark.range(1).select(slug(name, F.lit(root)).alias("id"), name.alias("name"), F.lit(root).alias("root"), F.lit(tables).alias("tables"), F.lit(now or datetime.now(UTC)).alias("last_opened_at"))
        row.write.mode("append").parquet(f"{self.path}/opened")

    def libraries(self) -> DataFrame:
        """Known libraries by their latest opening, the last opened first; the first is the current one."""
        return latest(self._log("opened", OPENED), "id", "last_opened_at").orderBy(F.desc("last_opened_at"), "id")

    def set(self, **values) -> dict:
        """Change settings; a value that can't be used is an error."""
        stored = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in values.items()}
        if any(v not in _READ.get(k, ()) for k, v in stored.items()):
            raise ValueError(f"not to be set: {values}")
        rows = self.spark.createDataFrame([(k, v, datetime.now(UTC)) for k, v in stored.items()], CHANGED)
        rows.write.mode("append").parquet(f"{self.path}/settings")
        return self.settings()

    def settings(self) -> dict:
        """Tuning settings; what is not set, or can't be used, has its default."""
        held = {r["key"]: r["value"] for r in latest(self._log("settings", CHANGED).filter(F.col("key").isin(*DEFAULTS)), "key", "at").collect()}
        return {k: _READ[k].get(held.get(k), default) for k, default in DEFAULTS.items()}


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*log.columns), at).alias("row")).select("row.*")
