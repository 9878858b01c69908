"""Sidecar documents as typed columns.

A document is valid or not as a whole: invalid JSON, or a time or view count that is no
integer, makes every column null and `valid` false, as one bad field voids the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a picture may come from, the first that is present counts.
ORIGINS = ["mobileUpload", "driveSync", "fromPartnerSharing", "fromSharedAlbum", "webUpload", "composition"]
_GEO = "STRUCT<latitude: DOUBLE, longitude: DOUBLE, altitude: DOUBLE>"
_TIME = "STRUCT<timestamp: STRING>"
SCHEMA = (
    f"title STRING, description STRING, url STRING, imageViews STRING, creationTime {_TIME}, photoTakenTime {_TIME}, geoData {_GEO}, geoDataExif {_GEO}, "
    f"favorited BOOLEAN, archived BOOLEAN, trashed BOOLEAN, googlePhotosOrigin STRUCT<{', '.join(f'{k}: STRING' for k in ORIGINS)}>, "
    "appSource STRUCT<androidPackageName: STRING>, _bad STRING"
)


def parse(df: DataFrame, json_col: str = "json") -> DataFrame:
    """df with the sidecar's columns and `valid` in place of its JSON."""
    doc = df.withColumn("__d", F.from_json(json_col, SCHEMA, {"columnNameOfCorruptRecord": "_bad"}))
    d = F.col("__d")
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    bad = lambda c: F.expr(f"{c} IS NOT NULL AND try_cast({c} AS BIGINT) IS NULL")
    counts = {"taken_at": "__d.photoTakenTime.timestamp", "created_at_sidecar": "__d.creationTime.timestamp", "image_views": "__d.imageViews"}
    invalid = d.isNull() | d["_bad"].isNotNull() | bad(counts["taken_at"]) | bad(counts["created_at_sidecar"]) | bad(counts["image_views"])
    doc = doc.withColumn("valid", F.coalesce(~invalid, F.lit(False)))

    def geo(name: str, part: str) -> Column:
        return F.when(d[name].isNotNull(), F.coalesce(d[name][part], F.lit(0.0)))

    origin = d["googlePhotosOrigin"]
    kind = F.coalesce(*(F.when(origin[k].isNotNull(), F.lit(k)) for k in ORIGINS))
    body = F.coalesce(*(origin[k] for k in ORIGINS))
    made = {
        "title": F.coalesce(d["title"], F.lit("")),
        "description": F.coalesce(d["description"], F.lit("")),
        "google_photos_url": F.coalesce(d["url"], F.lit("")),
        **{name: number(c) for name, c in counts.items()},
        **{f"{p}_{short}": geo(name, part) for p, name in (("geo", "geoData"), ("geo_exif", "geoDataExif")) for short, part in (("lat", "latitude"), ("lon", "longitude"), ("alt", "altitude"))},
        "favorited": d["favorited"],
        "archived": d["archived"],
        "trashed": d["trashed"],
        "origin_type": kind,
        "origin_device_type": F.get_json_object(body, "$.deviceType"),
        "origin_device_folder": F.get_json_object(body, "$.deviceFolder.localFolderName"),
        "app_source_package": d["appSource"]["androidPackageName"],
    }
    return doc.withColumns({k: F.when(F.col("valid"), v) for k, v in made.items()}).drop("__d", json_col)
