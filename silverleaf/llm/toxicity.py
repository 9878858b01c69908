"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly.

A word is the mean of the embeddings of its character n-grams (with word ends marked)
and of the whole word, all hashed into one table; a document is the mean of its words;
a two-class softmax reads the mean. A misspelling that was never seen shares most
n-grams with what was.

Embeddings start at small random values; they, the softmax's two weight vectors and its
two biases are all free and fitted jointly in numpy, with weight decay. As there are far
more n-grams than documents, and plain fitting learns documents by heart, which n-grams
get an embedding is decided by the same joint fit under a penalty on each embedding's
length times the softmax's (a group lasso). The penalty is set from the number of n-grams
and the noise of the labels, not by hand, and is the same for all n-grams once their
shares are brought to one scale. Rounds take in whichever n-grams the gradient would move,
until none is left; then those that are not zero start anew at small random values, and a
last round fits them with hardly any penalty, so that weights are not shrunk.

Executors count the words of the sampled documents; these counts come to the driver,
never a text.

Both steps are linear, so a trained model scores a word by one number and a document
by the mean of its words' numbers; each worker keeps the numbers of words it has met.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_is, labelled_rows

#: Training documents of each label, each with its whole text.
SAMPLE_DOCS = 3_000
BUCKETS, DIM, SHORTEST, LONGEST = 1 << 20, 8, 3, 5
#: An n-gram gets an embedding from so many training texts on, whatever their labels.
MIN_TEXTS = 2
#: The penalty, as a multiple of what noise alone would reach over all n-grams; its bound as
#: a share of the strongest n-gram's pull; the decay that shares weight among n-grams that say
#: the same (a share's own curvature is 0.25); and what the last round keeps of both.
PENALTY, PENALTY_BOUND, DECAY, RELAXED = 0.7, 0.6, 15.0, 1e-3
ROUNDS, STEPS = 12, 60
#: The size of first values of embeddings, and the decay of the softmax's weights.
INITIAL, SOFTMAX_DECAY = 0.05, 1e-3
#: Words that say nothing, added to every text's mean, so that one word of a very short text isn't all of it.
PAD = 30
#: A word is cut into n-grams over its first so many characters; the rest of a longer
#: one goes on as further words, so no text is left out.
WORD_CHARS = 40
#: Word numbers that a worker remembers before it starts anew.
REMEMBERED = 1 << 19
#: From this score on a document counts as toxic.
THRESHOLD = 0.7
_WORD = re.compile(rf"[^\W_]{{1,{WORD_CHARS}}}")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def buckets(word: str) -> list[int]:
    """The hashed n-grams of one word, the whole word first."""
    marked = f"<{word}>".encode()
    out = [zlib.crc32(marked, 7) % BUCKETS]
    marked = f"<{word}>"
    for n in range(SHORTEST, LONGEST + 1):
        out += [zlib.crc32(marked[i : i + n].encode()) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


class ToxicityModel:
    """Embeddings of n-grams and a softmax over them; scores texts.

    weight[b] is the logit of label 1 that n-gram b adds to its word: its embedding times
    the difference of the softmax's two weight vectors.
    """

    def __init__(self, grams: np.ndarray, table: np.ndarray, softmax: np.ndarray, biases: np.ndarray):
        self.table, self.softmax, self.biases = table, softmax, biases
        added = table @ (softmax[:, 1] - softmax[:, 0])
        self.weight = {int(b): float(x) for b, x in zip(grams, added) if x}
        self.bias = float(biases[1] - biases[0])

    @classmethod
    def constant(cls, bias: float) -> ToxicityModel:
        return cls(np.zeros(0, np.int64), np.zeros((0, DIM)), np.zeros((DIM, 2)), np.array([-bias / 2, bias / 2]))

    def word(self, word: str) -> float:
        grams = buckets(word)
        get = self.weight.get
        return sum([get(b, 0.0) for b in grams]) / len(grams)

    def scores(self, texts: list[str | None], memory: dict[str, float]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            ws = words(text or "")
            if len(memory) > REMEMBERED:
                memory.clear()
            for w in set(ws).difference(memory):
                memory[w] = self.word(w)
            out[i] = self.bias + (sum(map(memory.__getitem__, ws)) / (len(ws) + PAD))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


class _Bags:
    """The training texts as sparse counts: texts by words, words by n-grams."""

    def __init__(self, bags: Iterable[Mapping[str, int]], count: int):
        place: dict[str, int] = {}
        rows, cols, shares, self.sizes = [], [], [], np.zeros(count, np.int64)
        for r, bag in enumerate(bags):
            self.sizes[r] = n = sum(bag.values())
            rows.append(np.full(len(bag), r, np.int32))
            cols.append(np.fromiter((place.setdefault(w, len(place)) for w in bag), np.int32, len(bag)))
            shares.append(np.fromiter(bag.values(), np.float64, len(bag)) / (n + PAD))
        self.row, self.col, self.share = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in ((rows, np.int32), (cols, np.int32), (shares, np.float64)))
        self.each = np.fromiter((sum(len(w) + 3 - n for n in range(SHORTEST, LONGEST + 1) if n <= len(w) + 2) + 1 for w in place), np.int64, len(place))
        self.gram = np.fromiter((b for w in place for b in buckets(w)), np.int32, int(self.each.sum()))
        self.word = np.repeat(np.arange(len(place), dtype=np.int32), self.each)
        self.known = BUCKETS  # n-grams are numbered below this

    def moments(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each n-gram: how many texts have it, and the weighted mean square of its share of a text."""
        texts, square = np.zeros(self.known, np.int64), np.zeros(self.known)
        start = np.cumsum(self.each) - self.each
        edges = np.searchsorted(self.row, np.arange(len(self.sizes) + 1))
        for r in np.flatnonzero(weight):
            at = self.col[edges[r] : edges[r + 1]]
            each = self.each[at]
            grams, place = np.unique(self.gram[_spans(start[at], each)], return_inverse=True)
            share = np.bincount(place, np.repeat(self.share[edges[r] : edges[r + 1]] / each, each))
            texts[grams] += 1
            square[grams] += weight[r] * share * share
        return texts, square

    def keep(self, grams: np.ndarray) -> None:
        """Number these n-grams from 0 and forget the others; a word's mean stays over all it has."""
        place = np.full(self.known, -1, np.int32)
        place[grams] = np.arange(len(grams), dtype=np.int32)
        place = place[self.gram]
        kept = place >= 0
        self.gram, self.word, self.known = place[kept], self.word[kept], len(grams)

    def pulls(self, r: np.ndarray) -> np.ndarray:
        """Of each n-gram: the sum of its shares of the texts, each times the text's number."""
        of_word = np.bincount(self.col, r[self.row] * self.share, len(self.each)) / self.each
        return np.bincount(self.gram, of_word[self.word], self.known)

    def entries(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, learned n-gram, share of the text's mean) of the n-grams with a place."""
        gram = place[self.gram]
        kept = np.flatnonzero(gram >= 0)
        word, gram = self.word[kept], gram[kept]
        n = np.bincount(word, minlength=len(self.each))
        lo = np.cumsum(n) - n
        spans = _spans(lo[self.col], n[self.col])
        return np.repeat(self.row, n[self.col]), gram[spans], np.repeat(self.share / self.each[self.col], n[self.col])


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], ..., start[i] + n[i] - 1 of every i, one after another."""
    ends = np.cumsum(n)
    return np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


class _Counted(Sequence):
    """Word counts of texts in Arrow columns; a text's are made into a dictionary when asked for."""

    def __init__(self, table: pa.Table):
        self.words, self.counts = table.column("words"), table.column("counts")

    def __len__(self) -> int:
        return len(self.words)

    def __getitem__(self, k: int) -> dict[str, int]:
        return dict(zip(filter(None, self.words[k].as_py().split(" ")), self.counts[k].as_py()))


def fit(bags: Sequence[Mapping[str, int]], labels: Sequence[int], rounds: int = ROUNDS, steps: int = STEPS, seed: int = 3) -> ToxicityModel:
    """Embeddings and softmax together, by accelerated proximal gradient steps, from texts' word counts.

    Texts without words are left out, and equal counts with one label count once. Without
    texts of both labels the model gives every text the share of label 1 as its score.
    """
    first: dict[bytes, int] = {}
    for k in range(len(bags)):
        first.setdefault(hashlib.sha256(repr((sorted(bags[k].items()), int(labels[k]))).encode()).digest(), k)
    chosen = [first[d] for d in sorted(first)]
    held = _Bags(map(bags.__getitem__, chosen), len(chosen))
    y = np.array([int(labels[k]) for k in chosen], np.float64)
    use = held.sizes > 0
    ones, zeros = int((y[use] == 1).sum()), int((y[use] == 0).sum())
    if not ones or not zeros:
        share = (ones + 0.5) / (ones + zeros + 1)
        return ToxicityModel.constant(float(np.log(share / (1 - share))) if ones else -10.0)
    weight = np.where(y == 1, 0.5 / ones, 0.5 / zeros) * use  # each label weighs as much as the other
    there, square = held.moments(weight)
    kept = np.flatnonzero(there >= min(MIN_TEXTS, ones))
    held.keep(kept)
    scale = 1 / np.sqrt(np.maximum(square[kept], 1e-300))  # embeddings are of shares of one size
    pull = np.abs(held.pulls(weight * (0.5 - y))) * scale
    noise = np.sqrt(0.25 * float((weight**2).sum()) * 2 * np.log(max(2, len(kept))))
    penalty = min(PENALTY * noise, PENALTY_BOUND * float(pull.max(initial=0.0)))

    rng = np.random.default_rng(seed)
    softmax, biases = rng.normal(size=(DIM, 2)) / np.sqrt(2 * DIM), np.zeros(2)
    table = np.zeros((len(kept), DIM))
    active = np.zeros(len(kept), bool)
    r = weight * (0.5 - y)
    for _ in range(rounds):
        fresh = ~active & (np.abs(held.pulls(r)) * scale > penalty * 1.01)
        if not fresh.any():
            break
        active |= fresh
        table[fresh] = INITIAL * rng.normal(size=(int(fresh.sum()), DIM))
        softmax, biases, r = _steps(held, np.flatnonzero(active), scale, table, softmax, biases, weight, y, penalty, DECAY, steps)
    chosen = np.flatnonzero(np.linalg.norm(table, axis=1) > 0)
    table[chosen] = INITIAL * rng.normal(size=(len(chosen), DIM))
    softmax, biases, r = _steps(held, chosen, scale, table, softmax, biases, weight, y, penalty * RELAXED, DECAY * RELAXED, steps * 6)
    return ToxicityModel(kept[chosen], table[chosen] * scale[chosen][:, None], softmax, biases)


class Joint:
    """The weighted cross-entropy of a softmax over texts' mean embeddings, and its gradients."""

    def __init__(self, row: np.ndarray, col: np.ndarray, share: np.ndarray, n: int, p: int, weight: np.ndarray, y: np.ndarray):
        """Entries (text, n-gram, share) of n texts over p n-grams; each text's weight and label."""
        self.row, self.col, self.share, self.n, self.p = row, col, share, n, p
        self.weight, self.y = weight, y

    def mean(self, table: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, table[self.col, k] * self.share, self.n) for k in range(table.shape[1])], 1)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, r[self.row] * self.share, self.p)

    def pull(self, doc: np.ndarray, softmax: np.ndarray, biases: np.ndarray) -> np.ndarray:
        """The gradient of each text's logit of label 1; that of label 0 is its negative."""
        z = np.clip(doc @ (softmax[:, 1] - softmax[:, 0]) + biases[1] - biases[0], -50, 50)
        return self.weight * (1 / (1 + np.exp(-z)) - self.y)

    def loss(self, table: np.ndarray, softmax: np.ndarray, biases: np.ndarray) -> float:
        z = self.mean(table) @ (softmax[:, 1] - softmax[:, 0]) + biases[1] - biases[0]
        return float((self.weight * np.logaddexp(0, np.where(self.y == 1, -z, z))).sum())

    def gradients(self, table: np.ndarray, softmax: np.ndarray, biases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of table, softmax and biases; and the texts' means."""
        doc = self.mean(table)
        r = self.pull(doc, softmax, biases)
        of_softmax, total = doc.T @ r, float(r.sum())
        return np.outer(self.back(r), softmax[:, 1] - softmax[:, 0]), np.stack([-of_softmax, of_softmax], 1), np.array([-total, total]), doc


def _steps(bags: _Bags, learned: np.ndarray, scale: np.ndarray, table: np.ndarray, softmax: np.ndarray, biases: np.ndarray, weight: np.ndarray, y: np.ndarray, penalty: float, decay: float, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fit the learned n-grams' rows of the table, the softmax and its biases; then also each text's pull.

    Steps on the table, the penalty and the decay are in units of the softmax's own length,
    so that how the two share the size of a logit makes no difference.
    """
    place = np.full(len(scale), -1, np.int64)
    place[learned] = np.arange(len(learned))
    row, col, share = bags.entries(place)
    joint = Joint(row, col, share * scale[learned][col], len(y), len(learned), weight, y)
    u = np.ones((len(learned), 1))
    for _ in range(15):
        u = joint.back(weight * joint.mean(u / max(1e-12, np.linalg.norm(u)))[:, 0])[:, None]
    lipschitz = max(1e-9, float(np.linalg.norm(u)) * 0.3)
    emb = ahead = table[learned]
    t = 1.0
    for _ in range(steps):
        size = max(1e-6, float(np.linalg.norm(softmax[:, 1] - softmax[:, 0])))
        of_table, of_softmax, of_biases, doc = joint.gradients(ahead, softmax, biases)
        new = ahead - of_table / (lipschitz * size**2)
        length = np.linalg.norm(new, axis=1, keepdims=True)
        new = new * np.maximum(0, 1 - penalty / (lipschitz * size) / np.maximum(length, 1e-300)) / (1 + decay / lipschitz)
        curved = 0.5 * float((weight[:, None] * doc**2).sum())
        softmax = softmax - 0.2 * (of_softmax + SOFTMAX_DECAY * softmax) / (curved + SOFTMAX_DECAY)
        biases = biases - of_biases
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, emb, t = new + (t - 1) / t2 * (new - emb), new, t2
    table[learned] = emb
    return softmax, biases, joint.pull(joint.mean(emb), softmax, biases)


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Fit on at most about sample_docs labelled documents of each label outside fold 1 of 3.

    Texts are read whole, by the executors, which send word counts: a text's distinct words,
    however often they stand there. Of an id with several rows or labels each distinct pair
    is one training row.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [Counter(words(t)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(x) for x in bags], pa.string()), pa.array([list(x.values()) for x in bags], pa.list_(pa.int32())), b.column(1)], ["words", "counts", "toxic"])

    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic").distinct().filter(~fold_is("doc_id", 3, 1))
    rows = labelled_rows(docs, known, "toxic", sample_docs, 3).select("text", F.col("toxic").cast("int").alias("toxic"))
    found = rows.mapInArrow(counted, "words string, counts array<int>, toxic int").toArrow()
    return fit(_Counted(found), found.column("toxic").to_pylist())


def predict(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text; a text without words gets the model's bias.

    Repeated rows and null ids stay; an empty table stays empty; other columns of docs
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist(), memory))], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold.

    Null and empty texts score the model's bias; a null id changes nothing; repeated rows
    all stay or all go; an empty table stays empty. docs must have a column text; any
    other names may be there.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, float] = {}
        for b in batches:
            yield b.filter(pa.array(model.scores(b.column(at).to_pylist(), memory) < threshold))

    return docs.mapInArrow(run, docs.schema)
