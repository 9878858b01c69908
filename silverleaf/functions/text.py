"""Path, name, date and size expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The lower-case suffix with its dot, empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def album_of(path: Column) -> Column:
    """The first folder of a path that has one, else null."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.get(parts, 0))


def absolute(root: str, path: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), path)


def thumbnail_path(asset_id: Column) -> Column:
    return F.format_string("thumbs/%04d/%d.jpg", F.floor(asset_id / 1000), asset_id)


def slug(name: Column, hashed: Column | None = None) -> Column:
    """A folder name: safe characters of the name, at most 48, and 12 digits of the hash of it or of what is given."""
    safe = F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "-")
    trimmed = F.regexp_replace(safe, r"^[.\-_]+|[.\-_]+$", "")
    return F.concat_ws("-", F.substring(trimmed, 1, 48), F.substring(F.sha2(name if hashed is None else hashed, 256), 1, 12))


def year_utc(seconds: Column) -> Column:
    return F.year(F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(seconds / 86400).cast("int"))).cast("long")


def when_utc(seconds: Column) -> Column:
    """``2023-06-15 13:39 UTC``, a dash where there is no time; whatever the session's zone."""
    day = F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds, F.lit(86400))
    clock = F.format_string("%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60))
    return F.coalesce(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), clock, F.lit(" UTC")), F.lit("—"))


def human_size(size: Column) -> Column:
    """Whole units, rounded down at every step, B to TB."""
    out = F.concat(F.floor(size / 1024**4).cast("string"), F.lit(" TB"))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024 ** (k + 1), F.concat(F.floor(size / 1024**k).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    """Within low..high; null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def rescale(x: Column, low: float, high: float, to_low: float, to_high: float) -> Column:
    """Linear from low..high to to_low..to_high, clamped."""
    return clamp((x - low) / (high - low) * (to_high - to_low) + to_low, to_low, to_high)


def parse_params(params_json: Column) -> Column:
    """A parameter document as a map; empty for null or invalid ones."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.coalesce(F.from_json(params_json, "map<string,string>"), empty)


def canonical_json(**values: Column) -> Column:
    """A document with its keys in order and no spaces."""
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))), {"ignoreNullFields": "false"})
