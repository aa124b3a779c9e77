"""Toxicity by bags of subwords: embeddings averaged into a linear softmax, trained jointly."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.llm.samples import labelled_sample

#: Words whose subwords are remembered while bags are made.
_WORDS = 50_000
#: Words: runs of letters, lower-cased.
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Training:
    """How the classifier is fitted; ``max_rows`` and ``max_bytes`` bound the sample of labelled rows.

    ``epochs`` passes over the sample are made, or as many more as give ``steps`` mini-batches. Texts longer than ``max_text`` bytes are left out of the sample (never out of scoring).
    """

    max_rows: int = 8_000
    max_bytes: int = 32 << 20
    max_text: int = 1 << 20
    bits: int = 18
    sizes: tuple[int, ...] = (3, 4, 5, 6)
    min_docs: int = 5
    subwords: int = 4096
    dim: int = 6
    prior: float = 800.0
    epochs: int = 25
    steps: int = 800
    batch: int = 256
    rate: float = 0.05
    decay: float = 4e-6
    keep: float = 0.7
    seed: int = 7


def ngrams(word: str, sizes: tuple[int, ...]) -> list[str]:
    """The character n-grams of a word between brackets."""
    marked = f"<{word}>"
    return [marked[i : i + n] for n in sizes for i in range(len(marked) - n + 1)] or [marked]


def subwords(word: str, sizes: tuple[int, ...], bits: int) -> list[int]:
    """Buckets of the character n-grams of a word."""
    mask = (1 << bits) - 1
    return [zlib.crc32(g.encode()) & mask for g in ngrams(word, sizes)]


@dataclass
class Model:
    """``weight`` of each bucket along the softmax's difference, and the difference of its biases."""

    weight: np.ndarray
    bias: float
    sizes: tuple[int, ...]
    bits: int
    prior: float

    def scorer(self):
        """text -> score. Keeps the sums of words it met, up to a number, as they are needed again."""
        return _Scorer(self).score


class _Grams(dict):
    """The weight of each character n-gram met."""

    def __init__(self, model: Model):
        super().__init__()
        self._weights, self._mask = model.weight.tolist(), (1 << model.bits) - 1

    def __missing__(self, gram: str) -> float:
        if len(self) >= _Scorer.REMEMBERED:
            self.clear()
        out = self[gram] = self._weights[zlib.crc32(gram.encode()) & self._mask]
        return out


class _Scorer(dict):
    """Per word: the sum of its subwords' weights and, as imaginary part, how many they are."""

    REMEMBERED = 300_000

    def __init__(self, model: Model):
        super().__init__()
        self._sizes, self._prior, self._bias, self._grams = model.sizes, model.prior, model.bias, _Grams(model)

    def __missing__(self, word: str) -> complex:
        if len(self) >= self.REMEMBERED:
            self.clear()
        grams = ngrams(word, self._sizes)
        out = complex(sum(map(self._grams.__getitem__, grams)), len(grams))
        if len(word) <= 64:
            self[word] = out
        return out

    def score(self, text: str | None) -> float:
        total = sum(map(self.__getitem__, _WORD.findall((text or "").lower())), 0j)
        z = total.real / (total.imag + self._prior) + self._bias
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _bag(text: str, how: Training, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their share of its subwords."""
    counts = Counter(_WORD.findall(text.lower()))
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    grams = []
    for word in counts:
        own = known.get(word)
        if own is None:
            own = np.array(subwords(word, how.sizes, how.bits), np.int32)
            if len(known) < _WORDS:
                known[word] = own
        grams.append(own)
    weights = np.repeat(np.array(list(counts.values()), float), [len(g) for g in grams])
    buckets, place = np.unique(np.concatenate(grams), return_inverse=True)
    shares = np.bincount(place, weights=weights)
    return buckets, (shares / (shares.sum() + how.prior)).astype(np.float32)


def _telling(bags: list, labels: np.ndarray, how: Training) -> np.ndarray:
    """The buckets whose presence in a text says most about its label (likelihood ratio)."""
    present = np.zeros((2, 1 << how.bits), np.int64)
    for (buckets, _), label in zip(bags, labels.tolist()):
        present[label, buckets] += 1
    ones, total = present[1], present[0] + present[1]
    n, n_ones = len(labels), labels.sum()
    ratio = np.zeros(len(total))
    for seen, label_total in ((ones, n_ones), (total - ones, n - n_ones)):
        for cell, row in ((seen, total), (label_total - seen, n - total)):
            expected = row * (label_total / n)
            ratio += np.where(cell > 0, cell * np.log(np.maximum(cell, 1) / np.maximum(expected, 1e-9)), 0)
    ratio[total < how.min_docs] = -1
    best = np.argsort(-ratio, kind="stable")[: how.subwords]
    return np.sort(best[ratio[best] > 0])


def fit(texts: list[str], labels: np.ndarray, how: Training | None = None) -> Model:
    """Train embeddings and softmax together by Adam on mini-batches; the order of rows does not matter.

    The ``subwords`` buckets that tell most about the label (in ``min_docs`` texts or more) get vectors; the
    others stay at zero. Without both labels the model returns the
    share of ones (0 without rows) for every text.
    """
    how = how or Training()
    size = 1 << how.bits
    share = float(np.mean(labels)) if len(labels) else 0.0
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(size), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), how.sizes, how.bits, how.prior)
    known: dict[str, np.ndarray] = {}
    bags = [_bag(t, how, known) for t in texts]
    labels = np.asarray(labels)
    used = _telling(bags, labels, how)
    number = np.full(size, -1)
    number[used] = np.arange(len(used))
    kept = []
    for i, (buckets, shares) in enumerate(bags):
        own = number[buckets]
        kept.append((own[own >= 0].astype(np.int32), shares[own >= 0]))
        bags[i] = None
    rng = np.random.default_rng(how.seed)
    embedding = (rng.random((len(used), how.dim)) - 0.5) * 0.1
    softmax, bias = (rng.random((how.dim, 2)) - 0.5) * 0.1, np.log(np.array([1 - share, share]))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (embedding, softmax, bias)]
    step = 0
    for _ in range(max(how.epochs, -(-how.steps * how.batch // len(kept)))):
        order = rng.permutation(len(kept))
        for lo in range(0, len(order), how.batch):
            some = order[lo : lo + how.batch]
            n = len(some)
            row = np.repeat(np.arange(n), [len(kept[i][0]) for i in some])
            column = np.concatenate([kept[i][0] for i in some])
            value = np.concatenate([kept[i][1] for i in some]) * (rng.random(len(row)) < how.keep) / how.keep
            mean = np.stack([np.bincount(row, value * embedding[column, k], n) for k in range(how.dim)], 1)
            logits = mean @ softmax + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = odds / odds.sum(axis=1, keepdims=True)
            error[np.arange(n), labels[some]] -= 1
            back = (error @ softmax.T)[row] * value[:, None]
            inner = np.stack([np.bincount(column, back[:, k], len(used)) for k in range(how.dim)], 1)
            step += 1
            slopes = (inner / n + how.decay * embedding, mean.T @ error / n + how.decay * softmax, error.mean(axis=0))
            for parameter, slope, (first, second) in zip((embedding, softmax, bias), slopes, state):
                first += 0.1 * (slope - first)
                second += 0.001 * (slope**2 - second)
                parameter -= how.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weight = np.zeros(size)
    weight[used] = embedding @ (softmax[:, 1] - softmax[:, 0])
    return Model(weight, float(bias[1] - bias[0]), how.sizes, how.bits, how.prior)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text leaves this remainder. A null id is held out: it was never learnt."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, how: Training | None = None, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    how = how or Training()
    texts, ones = labelled_sample(docs, labels, "toxic", id_col, text_col, how.max_rows, how.max_bytes, how.max_text, ~held_out(id_col))
    return fit(texts, ones, how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with score (0 to 1) and predicted (1 from 0.5 on) added; no shuffle.

    Every whole text is scored. A null text counts as empty and gets the score of a text without words,
    about the share of ones among the labels; columns of the two names are replaced; null or repeated
    ids make no difference; an empty table gives an empty result. Words are runs of letters.
    """
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        scorer = shared.value.scorer()
        for batch in batches:
            scores = [scorer(t.as_py()) for t in batch[text_col].cast(pa.string())]
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)
