"""Quality rules: a linear-chain conditional random field marks each line as content or boilerplate."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.arrays import FIRST, PIECE, covered, mix, pieces, utf8, words
from jobtide.llm.samples import labelled_sample

SYMBOLS = "#*$%&|<>"
#: Words of a repeated passage.
REPEAT = 8


@dataclass(frozen=True)
class Training:
    """How the field is fitted; ``max_rows`` and ``max_bytes`` bound the sample of labelled rows.

    Texts longer than ``max_text`` bytes are left out of the sample (never out of the rules).
    """

    max_rows: int = 6_000
    max_bytes: int = 24 << 20
    max_text: int = 1 << 20
    epochs: int = 150
    rate: float = 0.1
    decay: float = 1e-3


def _mask(chars: str) -> np.ndarray:
    mask = np.zeros(256, np.int64)
    mask[list(chars.encode())] = 1
    return mask


_UPPER = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _mask("abcdefghijklmnopqrstuvwxyz") + (np.arange(256) >= 0xC0)
_DIGIT = _mask("0123456789")
_SYMBOL = _mask(SYMBOLS)
_CALL = _mask("!")
_MARK = _mask("()[]{}@/\\_=+~^:;\"'-") + _SYMBOL
_END = _mask(".!?:\"')") > 0
_FOLLOWS = (np.arange(256) & 0xC0) == 0x80
FEATURES = 15


class Lines:
    """Lines with a word of a piece of documents: their documents, words and features; counts by document."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n_docs = len(bounds) - 1
        starts, ends, doc = words(data, bounds)
        self.n_words = np.bincount(doc, minlength=n_docs)
        sizes = np.concatenate([[0], np.cumsum(ends - starts)])
        edges = np.searchsorted(doc, np.arange(n_docs + 1))
        follows = np.concatenate([[0], np.cumsum(_FOLLOWS[data])])
        self.word_chars = np.diff(sizes[edges]) - np.diff(follows[bounds])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        self.n_symbols = np.diff(symbols[bounds])

        hashes = FIRST.spans(FIRST.sums(data), starts, ends)
        windows = FIRST.windows(hashes, REPEAT)
        at = np.flatnonzero(doc[: len(windows)] == doc[REPEAT - 1 :]) if len(windows) else np.zeros(0, np.int64)
        again = _again(windows[at], doc[at])[0]
        repeated = covered(at[again], REPEAT, len(starts))
        self.n_repeat_words = np.bincount(doc[repeated], minlength=n_docs)

        breaks = np.flatnonzero(data == 0x0A)
        heads = np.concatenate([bounds[:-1][np.diff(bounds) > 0], breaks + 1])
        tails = np.concatenate([bounds[1:][np.diff(bounds) > 0], breaks])
        heads, tails = np.sort(heads), np.sort(tails)
        first, last = np.searchsorted(starts, heads), np.searchsorted(starts, tails)
        solid = np.flatnonzero(last > first)
        heads, tails, first, last = heads[solid], tails[solid], first[solid], last[solid]
        self.doc = doc[first] if len(first) else np.zeros(0, np.int64)
        self.words = last - first
        _, later = _again(FIRST.spans(FIRST.sums(data), heads, tails), self.doc)
        self.n_dup_lines = np.bincount(self.doc[later], minlength=n_docs)
        self.again = later

        def total(mask):
            sums = np.concatenate([[0], np.cumsum(mask[data])])
            return sums[tails] - sums[heads]

        upper, lower, digit, mark, call = map(total, (_UPPER, _LOWER, _DIGIT, _MARK, _CALL))
        size = np.maximum(1, sizes[last] - sizes[first])
        many = np.concatenate([[0], np.cumsum(repeated)])
        parts = [
            np.ones(len(heads)), self.words <= 2, self.words <= 5, self.words > 12, size / self.words > 15,
            upper / np.maximum(1, upper + lower) > 0.5, upper / np.maximum(1, upper + lower), digit / size > 0.2,
            np.minimum(1, 5 * mark / size), mark / size > 0.15, np.minimum(1, call / self.words), call / self.words > 0.5,
            later, (many[last] - many[first]) / self.words, _END[data[ends[last - 1] - 1]] if len(last) else np.zeros(0),
        ]
        self.features = np.stack([np.asarray(p, float) for p in parts], axis=1)

    def base_failed(self) -> np.ndarray:
        return (self.n_words < 20) | (100 * self.n_repeat_words > 30 * self.n_words)


def _again(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries occur twice or more in their document, and which of them are not the first."""
    keys = mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


@dataclass
class Field:
    """Weights of a linear-chain field with labels 0 (boilerplate) and 1 (content)."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray

    def decode(self, lines: Lines) -> np.ndarray:
        """The most likely labels of each document's lines (Viterbi; ties to content)."""
        scores = (lines.features @ self.emit).tolist()
        docs = lines.doc.tolist()
        (stay0, to1), (to0, stay1) = self.move.tolist()
        begin0, begin1 = self.begin.tolist()
        came: list[tuple[int, int]] = []
        labels = np.zeros(len(docs), np.int8)
        out = [0] * len(docs)
        a = b = 0.0
        for i, (x, y) in enumerate(scores):
            if i == 0 or docs[i] != docs[i - 1]:
                a, b = begin0 + x, begin1 + y
                came.append((-1, -1))
            else:
                from0, from1 = (0, a + stay0) if a + stay0 > b + to0 else (1, b + to0), (0, a + to1) if a + to1 > b + stay1 else (1, b + stay1)
                a, b = from0[1] + x, from1[1] + y
                came.append((from0[0], from1[0]))
            if i + 1 == len(docs) or docs[i + 1] != docs[i]:
                label, at = (0 if a > b else 1), i
                while True:
                    out[at] = label
                    label = came[at][label]
                    if label < 0:
                        break
                    at -= 1
        labels[:] = out
        return labels

    def content_share(self, lines: Lines) -> np.ndarray:
        """The share of each document's words that stand in content lines (0 without words)."""
        labels = self.decode(lines)
        content = np.bincount(lines.doc, lines.words * (labels == 1), len(lines.n_words))
        return content / np.maximum(1, lines.n_words)


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], how: Training | None = None) -> Field:
    """Maximise the conditional likelihood of whole label sequences (forward-backward, Adam).

    ``sequences`` holds the features of each document's lines, ``labels`` a label (0 or 1) for each line.
    Without both labels every line is content.
    """
    how = how or Training()
    kept = [(s, np.asarray(y, int)) for s, y in zip(sequences, labels) if len(s)]
    emit, move, begin = np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)
    if len({int(label) for _, y in kept for label in np.unique(y)}) < 2:
        return Field(emit, move, begin)
    kept.sort(key=lambda p: len(p[0]))
    groups = []
    at = 0
    while at < len(kept):
        to = at + 1
        while to < len(kept) and (to - at) * len(kept[to][0]) < 1 << 15:
            to += 1
        part, long = kept[at:to], len(kept[to - 1][0])
        x, on, own = np.zeros((len(part), long, FEATURES)), np.zeros((len(part), long), bool), np.zeros((len(part), long), int)
        for i, (s, y) in enumerate(part):
            x[i, : len(s)], on[i, : len(s)], own[i, : len(s)] = s, True, y
        groups.append((x, on, own))
        at = to
    weights = [emit, move, begin]
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    for step in range(1, how.epochs + 1):
        slopes = [how.decay * len(kept) * w for w in weights]
        for x, on, y in groups:
            for slope, part in zip(slopes, _slopes(x, on, y, *weights)):
                slope += part
        for w, slope, (first, second) in zip(weights, slopes, state):
            slope /= len(kept)
            first += 0.1 * (slope - first)
            second += 0.01 * (slope**2 - second)
            w -= how.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(*weights)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-2, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=-2)) + top.squeeze(-2)


def _slopes(x, on, y, emit, move, begin):
    """Expected minus observed counts of features, moves and beginnings."""
    scores = x @ emit
    n, long = on.shape
    forward, backward = np.zeros((n, long, 2)), np.zeros((n, long, 2))
    forward[:, 0] = begin + scores[:, 0]
    for t in range(1, long):
        forward[:, t] = _log_sum(forward[:, t - 1, :, None] + move) + scores[:, t]
    for t in range(long - 2, -1, -1):
        after = _log_sum((scores[:, t + 1] + backward[:, t + 1])[:, :, None] + move.T)
        backward[:, t] = np.where(on[:, t + 1, None], after, 0)
    last = forward[np.arange(n), on.sum(axis=1) - 1]
    total = _log_sum(last[:, :, None])[:, 0]
    share = np.exp(forward + backward - total[:, None, None]) * on[:, :, None]
    seen = np.eye(2)[y] * on[:, :, None]
    apart = share - seen
    between = forward[:, :-1, :, None] + move + (scores + backward)[:, 1:, None, :] - total[:, None, None, None]
    pairs = (np.exp(between) * on[:, 1:, None, None]).sum(axis=(0, 1))
    pairs -= np.einsum("nta,ntb->ab", seen[:, :-1], seen[:, 1:])
    return np.einsum("ntf,ntk->fk", x, apart), pairs, apart[:, 0].sum(axis=0)


def train(docs: DataFrame, labels: DataFrame, how: Training | None = None, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on a bounded sample of documents with a quality label.

    Lines have weak labels of their own: those of a good document stand for content, but for a line that
    repeats an earlier one of its document; those of other documents stand for boilerplate.
    """
    how = how or Training()
    texts, good = labelled_sample(docs, labels, "quality", id_col, text_col, how.max_rows, how.max_bytes, how.max_text)
    data, bounds = utf8(pa.array(texts, pa.string()))
    sequences, marks = [], []
    for lo, hi in pieces(bounds):
        lines = Lines(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
        cuts = np.searchsorted(lines.doc, np.arange(1, hi - lo))
        sequences += np.split(lines.features, cuts)
        marks += np.split((good[lo:hi][lines.doc] == 1) & ~lines.again, cuts)
    return fit(sequences, marks, how)


RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double"
)


def judge(docs: DataFrame, field: Field, least_content: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text and whether the document is kept; a row for each input row, no shuffle.

    Words are ``[^\\x20\\x09-\\x0D]+``. base_failed: fewer than 20 words, or more than 30 % of the words
    in 8-word runs that occur twice or more. kept: not so, and ``least_content`` of the words stand in
    lines the field marks as content. A null text has no words and fails; ids may be null or repeated;
    an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            data, bounds = utf8(batch["text"])
            for lo, hi in pieces(bounds, PIECE):
                lines = Lines(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo])
                failed, share = lines.base_failed(), shared.value.content_share(lines)
                counts = (lines.n_words, lines.word_chars, lines.n_symbols, lines.n_dup_lines, lines.n_repeat_words)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"][lo:hi], *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(~failed & (share >= least_content)), pa.array(share)],
                    [c.split()[0] for c in RESULT.split(", ")],
                )

    return rows.mapInArrow(run, RESULT)
