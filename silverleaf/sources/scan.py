"""Scanning a tree of images with JSON sidecars into asset rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, extension

#: What counts as an image, and the sidecar suffix.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif", ".gif", ".bmp", ".tiff", ".tif"]
SIDECAR_SUFFIX = ".supplemental-metadata.json"
MIME_TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".heic": "image/heic",
    ".heif": "image/heif", ".gif": "image/gif", ".bmp": "image/bmp", ".tiff": "image/tiff", ".tif": "image/tiff",
}
DEFAULT_MIME = "application/octet-stream"
#: Files that are opened by name rather than found in the whole tree.
FEW = 20_000
_GLOB, _ESCAPED = re.compile(r"[\[\]{}*?\\]"), r"\\\g<0>"


def files(spark: SparkSession, root: str) -> DataFrame:
    """(relpath, path, size_bytes, modified) of every file below root; contents are not read."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        raise FileNotFoundError(root)
    base = fs.makeQualified(fs_path).toUri().getPath().rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", "")
    return rows.select(F.substr(path, F.lit(len(base) + 2)).alias("relpath"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def images(found: DataFrame) -> DataFrame:
    """Image files with type and sidecar, by path: (relpath, filename, ext, size_bytes, mime, sidecar_relpath).

    A sidecar is named after the file with its extension, or else without it.
    """
    suffix = F.lit(SIDECAR_SUFFIX)
    mimes = F.create_map(*(F.lit(x) for kv in MIME_TYPES.items() for x in kv))
    pictures = found.select("relpath", basename(F.col("relpath")).alias("filename"), extension(F.col("relpath")).alias("ext"), "size_bytes")
    pictures = pictures.filter(F.col("ext").isin(IMAGE_EXTENSIONS) & ~F.col("filename").endswith(SIDECAR_SUFFIX))
    sidecars = found.filter(F.col("relpath").endswith(SIDECAR_SUFFIX)).select(F.col("relpath").alias("s"))
    keyed = pictures.withColumn("full", F.concat("relpath", suffix)).withColumn("stem", F.concat(F.regexp_replace("relpath", r"\.[^./]+$", ""), suffix))
    one = keyed.join(sidecars.withColumnRenamed("s", "s1"), F.col("full") == F.col("s1"), "left")
    two = one.join(sidecars.withColumnRenamed("s", "s2"), F.col("stem") == F.col("s2"), "left")
    mime = F.coalesce(F.try_element_at(mimes, F.col("ext")), F.lit(DEFAULT_MIME))
    return two.select("relpath", "filename", "ext", "size_bytes", mime.alias("mime"), F.coalesce("s1", "s2").alias("sidecar_relpath"))


def opened(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """wanted, which has relpath, with the content of each of these files, and of no others.

    Up to FEW files are opened by name and meet their rows by broadcast, so a small queue
    neither reads nor moves what it does not need; more are read with the whole tree.
    """
    listed = files(spark, root).select("relpath", "path").join(wanted, "relpath")
    names = [r["relpath"] for r in listed.select("relpath").distinct().limit(FEW + 1).collect()]
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not names:
        return listed.drop("path").withColumn("content", F.lit(None).cast("binary"))
    if len(names) > FEW:
        raw = reader.load(root)
    else:
        raw, listed = reader.load([f"{root.rstrip('/')}/{_GLOB.sub(_ESCAPED, n)}" for n in names]), F.broadcast(listed)
    return raw.select("path", "content").join(listed, "path").drop("path")


def content_hashes(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """(relpath, sha256) of the bytes of the files whose relpath is wanted."""
    return opened(spark, root, wanted.select("relpath")).select("relpath", F.sha2("content", 256).alias("sha256"))


def sidecar_texts(spark: SparkSession, root: str) -> DataFrame:
    """(sidecar_relpath, json) of every sidecar below root."""
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{SIDECAR_SUFFIX}").load(root)
    named = files(spark, root).select("relpath", "path")
    return content.select("path", F.decode("content", "UTF-8").alias("json")).join(named, "path").select(F.col("relpath").alias("sidecar_relpath"), "json")
