"""Scorers: batch functions over assets that give long rows of scores."""

from __future__ import annotations

import importlib.util
import os
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clamp, rescale
from ..functions.vectors import dot, softmax_first, unit
from ..lineage import checkpoint
from .browse import without_score
from .dml import upsert_scores

BATCH_SIZE = 32


@dataclass(frozen=True)
class Metric:
    key: str
    name: str
    low: float = 0.0
    high: float = 1.0
    higher_is_better: bool = True


@dataclass(frozen=True)
class Variant:
    variant_id: str
    name: str
    metrics: tuple[Metric, ...]
    primary: str | None = None

    @property
    def key_metric(self) -> str:
        return self.primary or self.metrics[0].key


@dataclass(frozen=True)
class Spec:
    scorer_id: str
    name: str
    version: str
    variants: tuple[Variant, ...]
    #: Modules without which the scorer can't run.
    needs: tuple[str, ...] = ()

    def variant(self, variant_id: str | None = None) -> Variant:
        for v in self.variants:
            if variant_id in (None, v.variant_id):
                return v
        raise KeyError(f"{self.scorer_id} has no variant {variant_id!r}")

    def metrics(self) -> tuple[Metric, ...]:
        """All metrics, the first of each key."""
        return tuple({m.key: m for v in reversed(self.variants) for m in reversed(v.metrics)}.values())[::-1]

    def available(self) -> bool:
        return all(importlib.util.find_spec(m) for m in self.needs)


def _one(scorer: str, name: str, version: str, needs: tuple[str, ...], *variants: tuple) -> Spec:
    return Spec(scorer, name, version, tuple(Variant(v, n, tuple(Metric(*m) for m in ms), ms[0][0]) for v, n, ms in variants), needs)


#: Scorers, variants and metrics, in the order of registration.
SPECS = (
    _one("simple", "Simple", "1", ("PIL",), ("blur", "Blur / Sharpness", [("sharpness", "Sharpness", 0.0, 100.0)]), ("luminosity", "Luminosity / Contrast", [("brightness", "Brightness", 0.0, 100.0), ("contrast", "Contrast", 0.0, 100.0)]), ("noise", "Noise Level", [("noise", "Noise", 0.0, 100.0, False)])),
    _one("brisque", "BRISQUE Quality", "1", ("PIL", "torch"), ("default", "Default", [("brisque_quality", "BRISQUE Quality", 0.0, 100.0)])),
    _one("aesthetic", "Aesthetic Score", "1", ("torch",), ("laion_v2", "LAION Aesthetic v2", [("aesthetic", "Aesthetic", 0.0, 10.0)])),
    _one("nsfw", "NSFW Detector", "1", ("transformers",), ("falconsai_vit", "Falconsai ViT", [("nsfw", "NSFW Score", 0.0, 1.0, False)])),
    _one("clip_iqa", "CLIP-IQA Quality", "2", ("torch",), ("vit_l14_openai", "CLIP ViT-L/14 (OpenAI)", [("clip_quality", "CLIP Quality")])),
    _one("nima", "NIMA", "4", ("torch",), *((v, n, [("nima_score", "Score", 1.0, 10.0)]) for v, n in (("aesthetic", "Aesthetic (AVA, inception_resnet_v2)"), ("aesthetic-vgg16", "Aesthetic (AVA, VGG-16)"), ("technical", "Technical (KonIQ-10k)"), ("technical-spaq", "Technical (SPAQ)")))),
    _one("pyiqa", "IQA-PyTorch Metrics", "1", ("torch",), *((v, n, [("iqa_quality", "IQA Quality")]) for v, n in (("musiq", "MUSIQ (Google, 2021)"), ("topiq_nr", "TOPIQ-NR (2024)"), ("niqe", "NIQE (2013)")))),
    _one("cafe_style", "Style Classifier", "2", ("transformers",), ("cafeai_v1", "CafeAI v1", [("real_life", "Photo"), ("anime", "Anime"), ("manga_like", "Manga-like"), ("3d", "3D Render"), ("other", "Other")])),
)


def spec_table(spark: SparkSession, specs: tuple[Spec, ...] = SPECS) -> DataFrame:
    """The registered metrics as a small dimension."""
    rows = [(s.scorer_id, v.variant_id, m.key, s.name, v.name, m.name, m.low, m.high, m.higher_is_better) for s in specs for v in s.variants for m in v.metrics]
    return spark.createDataFrame(rows, "scorer_id string, variant_id string, metric_key string, scorer_name string, variant_name string, metric_name string, low double, high double, higher_is_better boolean")


class Scorer(ABC):
    """Scores batches of assets; made once in each task, then fed batch after batch."""

    spec: Spec

    def __init__(self, variant_id: str | None = None):
        self.variant = self.spec.variant(variant_id)

    @abstractmethod
    def score_batch(self, items: list[dict]) -> list[dict[str, float]]:
        """One dict of metric -> value for each item (a row with at least asset_id)."""

    def score_one(self, item: dict) -> dict[str, float]:
        return self.score_batch([item])[0]


class ScoringError(RuntimeError):
    """A batch failed; says which scorer and which assets."""


def score_rows(scorer: type[Scorer], items: DataFrame, variant_id: str | None = None, batch_size: int = BATCH_SIZE) -> DataFrame:
    """(asset_id, metric_key, value): long rows of every item's scores."""
    columns = items.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = scorer(variant_id)
        for pdf in frames:
            out = []
            records = pdf[columns].to_dict("records")
            for at in range(0, len(records), batch_size):
                part = records[at : at + batch_size]
                try:
                    scores = made.score_batch(part)
                    if len(scores) != len(part):
                        raise ValueError(f"{len(scores)} results for {len(part)} items")
                except Exception as e:
                    ids = [r["asset_id"] for r in part]
                    more = f", +{len(ids) - 3} more" if len(ids) > 3 else ""
                    raise ScoringError(f"{scorer.spec.scorer_id}/{made.variant.variant_id} on assets {ids[:3]}{more}: {e}") from e
                out += [(r["asset_id"], k, float(v)) for r, s in zip(part, scores) for k, v in s.items()]
            yield pd.DataFrame(out, columns=["asset_id", "metric_key", "value"])

    return items.mapInPandas(run, "asset_id long, metric_key string, value double")


def run_scorer(scorer: type[Scorer], assets: DataFrame, scores: DataFrame, inputs: DataFrame, now: int, variant_id: str | None = None, batch_size: int = BATCH_SIZE, skip_existing: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new scores table, targets, scored ids).

    Targets lack the variant's key metric in the scorer's version; with skip_existing
    off they are all assets. The model runs once, and its rows are kept in the checkpoint
    folder for the three results. inputs has asset_id and whatever the scorer reads; targets
    without an input are seen but not scored.
    """
    v = scorer.spec.variant(variant_id)
    ids = without_score(assets, scores, scorer.spec.scorer_id, v.variant_id, v.key_metric, scorer.spec.version) if skip_existing else assets.select("id")
    targets = checkpoint(ids.select(F.col("id").alias("asset_id")))
    rows = checkpoint(score_rows(scorer, inputs.join(targets, "asset_id", "left_semi"), v.variant_id, batch_size))
    return upsert_scores(scores, rows, scorer.spec.scorer_id, v.variant_id, scorer.spec.version, now), targets, rows.select("asset_id").distinct()


def by_id(registry: dict[str, type[Scorer]], scorer_id: str) -> type[Scorer]:
    """A registered scorer that can run here."""
    if scorer_id not in registry:
        raise KeyError(f"no scorer {scorer_id!r}")
    scorer = registry[scorer_id]
    if not scorer.spec.available():
        raise RuntimeError(f"{scorer_id} needs {', '.join(scorer.spec.needs)}")
    return scorer


def run_by_id(registry: dict[str, type[Scorer]], scorer_id: str, *args, batch_size: int = BATCH_SIZE, **kwargs):
    """Like run_scorer, by name; SCORE_BATCH_SIZE counts where the batch size is the default."""
    scorer = by_id(registry, scorer_id)
    if batch_size == BATCH_SIZE:
        batch_size = int(os.environ.get("SCORE_BATCH_SIZE", batch_size))
    return run_scorer(scorer, *args, batch_size=batch_size, **kwargs)


# The arithmetic ends of scorers whose models are not at hand.

#: Native ranges of the models, and caps of the pixel statistics.
NIMA_RANGES = {"aesthetic": (1.0, 10.0), "aesthetic-vgg16": (1.0, 10.0), "technical": (0.0, 1.0), "technical-spaq": (1.0, 100.0)}
MAX_EDGE_VARIANCE, MAX_CONTRAST, MAX_NOISE = 2000.0, 127.5, 25.0


def sharpness(edge_variance: Column) -> Column:
    return F.coalesce(F.least(edge_variance / MAX_EDGE_VARIANCE, F.lit(1.0)) * 100, F.lit(0.0))


def brightness(mean_luma: Column) -> Column:
    return F.coalesce(mean_luma / 255 * 100, F.lit(0.0))


def contrast(luma_deviation: Column) -> Column:
    return F.coalesce(F.least(luma_deviation / MAX_CONTRAST, F.lit(1.0)) * 100, F.lit(0.0))


def noise(residual_rms: Column) -> Column:
    return F.coalesce(F.least(residual_rms / MAX_NOISE, F.lit(1.0)) * 100, F.lit(0.0))


def brisque_quality(raw: Column) -> Column:
    return 100.0 - clamp(raw, 0.0, 100.0)


def aesthetic(raw: Column) -> Column:
    return clamp(raw, 0.0, 10.0)


def nima_score(raw: Column, variant_id: str) -> Column:
    low, high = NIMA_RANGES[variant_id]
    return F.coalesce(rescale(raw, low, high, 1.0, 10.0), F.lit(1.0))


def iqa_quality(raw: Column, variant_id: str) -> Column:
    """Higher is better, 0 to 1."""
    if variant_id == "musiq":
        return clamp(raw / 100, 0.0, 1.0)
    return clamp(raw, 0.0, 1.0) if variant_id == "topiq_nr" else 1.0 / (1.0 + F.greatest(F.lit(0.0), raw))


def clip_quality(image: Column, good: list[float], bad: list[float], scale: float = 100.0) -> Column:
    """How much nearer an image vector is to the good prompt than to the bad one."""
    a, b = (dot(unit(image), F.array(*(F.lit(float(x)) for x in p))) * scale for p in (good, bad))
    return clamp(softmax_first(a, b), 0.0, 1.0)


def label_scores(predictions: Column, labels: list[str]) -> Column:
    """A map of every label to its probability, 0 where there is none."""
    return F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*(F.coalesce(F.try_element_at(predictions, F.lit(k)), F.lit(0.0)) for k in labels)))
