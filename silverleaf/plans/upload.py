"""Search by a picture that is handed in, and what can be said about it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Library
from ..functions import exif, images
from ..functions.vectors import MIN_NORM
from ..operators import media, similarity

MAX_BYTES = 50 << 20


class UploadError(ValueError):
    """A picture that can't be used; `status` is the code that a service answers with."""

    def __init__(self, status: int, text: str):
        super().__init__(text)
        self.status = status


def checked(content: bytes, max_bytes: int = MAX_BYTES) -> np.ndarray:
    """The pixels of a picture; an error for one that is too large or can't be read."""
    if len(content) > max_bytes:
        raise UploadError(413, f"the picture has more than {max_bytes} bytes")
    pixels = images.decode(content)
    if pixels is None:
        raise UploadError(400, "the picture can't be read")
    return pixels


def vector_of(content: bytes, encoder: media.Encoder) -> list[float]:
    made = encoder.images([content])[0]
    length = 0.0 if made is None else float(np.linalg.norm(made))
    if length < MIN_NORM:
        raise UploadError(400, "the picture has no usable vector")
    return [float(x) / length for x in made]


def search_by_image(library: Library, content: bytes, method: str = "clip", encoder: media.Encoder | None = None, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """(asset_id, score, taken_at, filename) of assets like a picture, by hash or by vector, best first."""
    pixels = checked(content)
    if method == "phash":
        found = similarity.similar_to_hash(library.read("phash"), images.difference_hash(pixels), threshold, media.ALGO)
    else:
        if encoder is None:
            raise UploadError(503, "there is no encoder")
        found = similarity.similar_to_vector(library.read("clip_embeddings"), vector_of(content, encoder), metric, threshold)
    best = F.desc("score") if method != "phash" and metric == "cosine" else F.asc("score")
    return similarity.with_details(found, library.read("assets")).orderBy(best, "asset_id")


def analyze(library: Library, content: bytes, encoder: media.Encoder | None = None, vocabulary: DataFrame | None = None, top_k: int = 20) -> dict:
    """What one picture gives: its size, hash, EXIF fields, vector, and the words nearest to it."""
    pixels = checked(content)
    said: dict = {"rows": pixels.shape[0], "columns": pixels.shape[1], "phash_hex": images.difference_hash(pixels), "exif": exif.document(content), "embedding": None, "words": []}
    if encoder is not None:
        said["embedding"] = vector_of(content, encoder)
        if vocabulary is not None:
            one = library.spark.createDataFrame([(0, said["embedding"])], "asset_id long, embedding array<double>")
            said["words"] = [r.asDict() for r in similarity.terms_of_assets(one, vocabulary, top_k).drop("asset_id").orderBy(F.desc("score"), "term").collect()]
    return said
