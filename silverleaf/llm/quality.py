"""Quality by Bradley-Terry ranking: scores learned from preference pairs.

Every text becomes a short vector of surface statistics over its whole length. A pair
of a good and a poor text says that the first should score higher; the probability is
the logistic function of the difference of their scores, and a score is linear in the
features (and their squares), so fitting is logistic regression on feature differences
without an intercept. Scores only rank; a threshold comes from a quantile: the cut
leaves as large a share of the training texts above it as have label 1, and the logistic
scale is placed so that the cut has score 0.7. Features are worked out in the tasks, over
whole texts; weights are fitted on the features of a bounded sample of rows, and the
quantile is taken over all labelled documents of the training folds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import checkpoint
from .common import bounded_sample, fold_is

#: Training documents of each label, preference pairs drawn.
SAMPLE_DOCS, PAIRS = 2_000, 60_000
STEPS, DECAY, CLIP = 400, 1e-3, 5.0
#: The score of the cut.
THRESHOLD = 0.7
#: Features of a text, bits of a word's number in the key of a run of three words.
SIZE, BITS = 16, 21
#: Parts that the range of ranks is cut into in one step towards a quantile.
BINS = 4_096
_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "mark": b"#*$%&|<>~^_=+@\\/{}[]", "pipe": b"|", "loud": b"!?", "stop": b".,;:", "line": b"\n"}
_TABLE = np.stack([np.isin(np.arange(256), list(v)) for v in _KINDS.values()], 1).astype(np.float64)


def distinct_runs(words: list[str], counts: Counter) -> int:
    """How many different runs of three words there are; the whole text if it is shorter."""
    if len(words) < 3:
        return 1
    number = dict(zip(counts, range(len(counts))))
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    if len(counts) > 1 << BITS:  # too many words for one key: number the pairs first
        ids = np.unique(ids[:-1] << np.uint64(32) | ids[1:], return_inverse=True)[1].astype(np.uint64)
        return len(np.unique(ids[:-1] << np.uint64(32) | ids[1:]))
    return len(np.unique((ids[:-2] << np.uint64(BITS) | ids[1:-1]) << np.uint64(BITS) | ids[2:]))


def features(text: str) -> np.ndarray:
    """Shares and lengths of one text; zeros for an empty one."""
    words = text.split()
    if not words:
        return np.zeros(SIZE)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    upper, lower, digit, high, mark, pipe, loud, stop, line = np.bincount(raw, minlength=256) @ _TABLE
    n, size = len(words), len(raw)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    letters = upper + lower + high + 1
    return np.array([
        np.log1p(n), mark / size, upper / letters, digit / size, loud / n, stop / n, pipe / n, high / size,
        np.log1p(len(counts)) / np.log1p(n), counts.most_common(1)[0][1] / n, 1 - distinct_runs(words, counts) / max(1, n - 2), 1 - len(set(lines)) / max(1, len(lines)),
        np.log(size / n), short / n, line / n, len(counts) / n,
    ])


class QualityModel:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, weight: np.ndarray, cut: float, scale: float):
        self.mean, self.spread, self.weight, self.cut, self.scale = mean, spread, weight, cut, scale

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -CLIP, CLIP)
        return np.concatenate([z, z * z], axis=-1)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weight

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.stack([features(t or "") for t in texts])
        z = (self.rank(x) - self.cut) * self.scale + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(texts: list[str], labels: list[int], seed: int = 7) -> QualityModel:
    """fit_features on the features of whole texts."""
    return fit_features(np.stack([features(t) for t in texts]) if texts else np.zeros((0, SIZE)), labels, seed)


def fit_features(x: np.ndarray, labels: list[int], seed: int = 7) -> QualityModel:
    """Bradley-Terry weights from pairs of a label-1 and a label-0 text.

    Without both labels all texts rank alike and score as the cut does (label 1 alone,
    or none) or below it (label 0 alone).
    """
    x = x if len(x) else np.zeros((1, SIZE))
    model = QualityModel(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(2 * SIZE), 0.0, 1.0)
    good, poor = (np.flatnonzero(np.array(labels, int) == k) for k in (1, 0))
    if not len(good) or not len(poor):
        model.cut = float(len(poor) > 0)
        return model
    z = model.expand(x)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, PAIRS)] - z[rng.choice(poor, PAIRS)]
    lipschitz = 0.25 * np.linalg.norm(d.T @ d / PAIRS, 2) + DECAY
    w = ahead = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(STEPS):
        new = ahead - (-(d.T @ (1 / (1 + np.exp(np.clip(d @ ahead, -50, 50))))) / PAIRS + DECAY * ahead) / lipschitz
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t2 * (new - w), new, t2
    model.weight = w
    ranks = model.rank(x)
    model.cut = float(np.quantile(ranks, len(poor) / len(ranks)))
    return model


def quantile(rows: DataFrame, share: float, bins: int = BINS) -> float:
    """The quantile of column rank over all rows, as numpy has it; at most bins rows are collected at once."""
    total, lo, hi = rows.agg(F.count("rank"), F.min("rank"), F.max("rank")).first()
    place, below = share * (total - 1), 0
    while lo < hi:  # the bin that holds the place becomes the range
        part = F.least(F.floor((F.col("rank") - lo) / (hi - lo) * bins), F.lit(bins - 1))
        found = rows.filter(F.col("rank").between(lo, hi)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
        for r in sorted(found.collect()):
            lo, hi = r["lo"], r["hi"]
            if below + r["n"] > int(place):
                break
            below += r["n"]
    upto, after = rows.agg(F.count_if(F.col("rank") <= lo), F.min(F.when(F.col("rank") > lo, F.col("rank")))).first()
    return lo if upto > int(place) + 1 or after is None else lo + (after - lo) * (place - int(place))


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, h, quality, x): the features of every row of docs with a label in known.

    Features are worked out where the texts are and then joined, so no text is moved. Of
    an id with several rows or labels each distinct pair is one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "h", "x"])

    rows = docs.filter(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~fold_is("doc_id", 4, 2))
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, x array<double>")
    return rows.join(known, "doc_id").dropDuplicates(["doc_id", "h", "quality"])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """Fit on at most about sample_docs labelled documents of each label outside fold 2 of 4.

    Both labels are drawn apart. The quantile is taken over all labelled documents outside
    the fold, at the share of them that is poor. Of an id with several rows or labels each
    distinct pair is one training row; rows without an id, text or label are left out.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").distinct().filter(~fold_is("doc_id", 4, 2))
    every = checkpoint(labelled(docs, known))
    rows = sorted(bounded_sample(every, sample_docs, "quality", ["doc_id", "h"], 7).collect(), key=lambda r: (r["doc_id"], r["h"], r["quality"]))
    model = fit_features(np.array([r["x"] for r in rows], np.float64).reshape(-1, SIZE), [int(r["quality"]) for r in rows])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
            yield pa.RecordBatch.from_arrays([pa.array(model.rank(x), pa.float64())], ["rank"])

    if model.weight.any():
        poor = every.agg(F.avg((F.col("quality") == 0).cast("int"))).first()[0]
        model.cut = quantile(checkpoint(every.select("x").mapInArrow(rank, "rank double")), poor)
    return model


def predict(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text; null counts as empty.

    Repeated rows and null ids stay; an empty table stays empty; other columns of docs
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double")
