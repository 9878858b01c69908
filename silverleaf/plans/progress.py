"""How far a job is, and where its time goes."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The percent at which each phase of an ingestion begins and ends.
PHASES = {"scan": (0.0, 5.0), "process": (5.0, 100.0)}
SCHEMA = "stage string, items long, seconds double"


def percent(phase: str, done: Column, total: Column) -> Column:
    """Where a phase's count stands on the whole job's scale; the phase's start where there is nothing to do."""
    low, high = PHASES[phase]
    share = F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total))).otherwise(0.0)
    return F.lit(low) + share * (high - low)


def diagnostics(measured: DataFrame) -> DataFrame:
    """(stage, runs, items, seconds, slowest, ms_per_item) of measurements (stage, items, seconds).

    ms_per_item is null for a stage that met no items.
    """
    items, seconds = F.sum("items"), F.sum("seconds")
    per_item = F.when(items > 0, seconds * 1000 / items)
    return measured.groupBy("stage").agg(F.count("*").alias("runs"), items.alias("items"), seconds.alias("seconds"), F.max("seconds").alias("slowest"), per_item.alias("ms_per_item"))


class Progress:
    """Collects a job's phases and measurements; tells a listener the percent."""

    def __init__(self, tell=None):
        self.tell, self.percent, self.measured = tell, 0.0, []

    def at(self, phase: str, done: int, total: int) -> float:
        low, high = PHASES[phase]
        share = min(1.0, max(0.0, done / total)) if total > 0 else 0.0
        self.percent = max(self.percent, low + share * (high - low))  # never goes back
        if self.tell:
            self.tell(phase, self.percent)
        return self.percent

    @contextmanager
    def stage(self, name: str) -> Iterator[list[int]]:
        """Times a block; the block appends the number of items that it dealt with."""
        began, items = time.perf_counter(), []
        try:
            yield items
        finally:
            self.measured.append((name, sum(items), time.perf_counter() - began))

    def report(self, spark: SparkSession) -> DataFrame:
        return diagnostics(spark.createDataFrame(self.measured, SCHEMA))
