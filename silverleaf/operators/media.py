"""Derivations from image bytes: hashes, statistics, embeddings, faces, thumbnails.

Each runs as Arrow batches over (asset_id, content) rows; models are made once in each
task. Encoders and detectors are interfaces: the engine ships none, and deals with what
they return (vectors normalised, useless ones dropped).
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exif as exif_blocks
from ..functions import images
from ..functions.vectors import MIN_NORM
from . import scoring

ALGO = "dhash16"
MODEL = "ViT-L-14/openai"


def _each(rows: DataFrame, make: Callable[[bytes], object], name: str, kind: str) -> DataFrame:
    """(asset_id, name): a value of each readable image."""
    arrow = {"string": pa.string(), "binary": pa.binary()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [(i.as_py(), make(c.as_py())) for i, c in zip(b.column(0), b.column(1))]
            made = [m for m in made if m[1] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], arrow)], ["asset_id", name])

    return rows.select(F.col("asset_id").cast("long"), "content").mapInArrow(run, f"asset_id long, {name} {kind}")


def _hash(data: bytes) -> str | None:
    pixels = images.decode(data)
    return None if pixels is None else images.difference_hash(pixels)


def hashes(rows: DataFrame, now: int) -> DataFrame:
    """Rows of the phash table; unreadable images are left out."""
    return _each(rows, _hash, "phash_hex", "string").withColumns({"algo": F.lit(ALGO), "computed_at": F.lit(now).cast("long")})


def thumbnails(rows: DataFrame) -> DataFrame:
    """(asset_id, path, thumbnail) of what can be read."""
    from ..functions.text import thumbnail_path

    return _each(rows, images.thumbnail, "thumbnail", "binary").withColumn("path", thumbnail_path(F.col("asset_id")))


def exif(rows: DataFrame) -> DataFrame:
    """(asset_id, exif): the EXIF fields of images that have any, as JSON."""
    return _each(rows, exif_blocks.document, "exif", "string")


class SimpleScorer(scoring.Scorer):
    """Sharpness, brightness and contrast, or noise, of an item's `content`; 0 if unreadable."""

    spec = replace(scoring.SPECS[0], needs=())  # plain images are read without any module

    def score_batch(self, items: list[dict]) -> list[dict[str, float]]:
        return [self._scores(images.decode(i["content"])) for i in items]

    def _scores(self, pixels: np.ndarray | None) -> dict[str, float]:
        if pixels is None:
            return {m.key: 0.0 for m in self.variant.metrics}
        s = images.pixel_statistics(pixels)
        every = {
            "sharpness": min(s["edge_variance"] / scoring.MAX_EDGE_VARIANCE, 1.0) * 100,
            "brightness": s["mean_luma"] / 255 * 100,
            "contrast": min(s["luma_deviation"] / scoring.MAX_CONTRAST, 1.0) * 100,
            "noise": min(s["residual_rms"] / scoring.MAX_NOISE, 1.0) * 100,
        }
        return {m.key: every[m.key] for m in self.variant.metrics}


class Encoder(ABC):
    """Images, and optionally texts, to vectors of one space."""

    model_id = MODEL

    @abstractmethod
    def images(self, contents: list[bytes]) -> list[np.ndarray | None]: ...

    def text(self, query: str) -> np.ndarray:
        raise NotImplementedError("this encoder reads no text")


def _unit(v: np.ndarray | None) -> np.ndarray | None:
    if v is None:
        return None
    v = np.asarray(v, np.float64)
    length = np.linalg.norm(v)
    return v / length if np.isfinite(length) and length >= MIN_NORM else None


def embeddings(rows: DataFrame, encoder: type[Encoder], now: int, batch: int = 128) -> DataFrame:
    """Rows of the embeddings table: unit vectors of what the encoder can read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = encoder()
        for pdf in frames:
            out = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                out += [(i, u.astype(np.float32)) for i, v in zip(part["asset_id"], made.images(list(part["content"]))) if (u := _unit(v)) is not None]
            yield pd.DataFrame(out, columns=["asset_id", "embedding"])

    made = rows.select("asset_id", "content").mapInPandas(run, "asset_id long, embedding array<float>")
    return made.withColumns({"model_id": F.lit(encoder.model_id), "computed_at": F.lit(now).cast("long")})


class FaceDetector(ABC):
    """Finds faces; each as (x1, y1, x2, y2), a score and a vector."""

    @abstractmethod
    def faces(self, contents: list[bytes]) -> list[list[tuple[tuple[float, float, float, float], float, np.ndarray]]]: ...


def detect_faces(rows: DataFrame, detector: type[FaceDetector], run_id: int, now: int, batch: int = 32) -> DataFrame:
    """Rows of the face table without ids: one for each face with a usable vector."""
    columns = ["asset_id", "face_index", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "det_score", "embedding"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = detector()
        for pdf in frames:
            out = []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                for i, found in zip(part["asset_id"], made.faces(list(part["content"]))):
                    out += [(i, k, *map(float, box), float(score), u.astype(np.float32)) for k, (box, score, v) in enumerate(found) if (u := _unit(v)) is not None]
            yield pd.DataFrame(out, columns=columns)

    schema = "asset_id long, face_index int, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, det_score double, embedding array<float>"
    made = rows.select("asset_id", "content").mapInPandas(run, schema)
    return made.withColumns({"run_id": F.lit(run_id).cast("long"), "computed_at": F.lit(now).cast("long")})
