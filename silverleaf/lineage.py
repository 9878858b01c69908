"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names.

    Where nothing is set, a local session gets a private folder; on a cluster that is an
    error, as no folder of one machine can be read by the others.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    there = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="silverleaf-")
    if not current.isDefined():
        sc.setCheckpointDir(there)
    return there


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table to the shared folder and read it from there; the table goes when the JVM ends.

    For loops: unlike a checkpoint, the table carries no constraints of the plan that made
    it, which double with each round's joins until planning takes longer than the work.
    """
    spark = df.sparkSession
    there = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(there)
    folder = spark._jvm.org.apache.hadoop.fs.Path(there)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(there)


def ranked(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with each row's place, from 0, in the total order of its columns.

    Rows are range-partitioned and written once, ranked within their range, and moved up
    by the sizes of the ranges before; no task ever sees all rows. `order` must be total.
    """
    held = checkpoint(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = held.groupBy("__part").count()
    before = sizes.select("__part", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return held.withColumn("__at", place).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__at")).cast("long")).drop("__part", "__at", "__before")
