"""Pre-tokens of byte-level vocabularies, found for many texts at once.

The pattern that these vocabularies split by (a contraction, letters, digits or other signs with one
space in front, white space) depends only on the class of each character and its neighbours, so where
pre-tokens begin is a vector expression over the bytes. What counts as letter, digit or white space is
asked of the library concerned, once for each character met.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from jobtide.llm.arrays import FIRST, PIECE, SECOND, pieces

SPACE, LETTER, DIGIT, SIGN = range(4)
_UNKNOWN = 255


class Classes:
    """The class of each character, by a function that is called once for each code point."""

    def __init__(self, classify: Callable[[str], int]):
        self._classify = classify
        self._table = np.full(0x110000, _UNKNOWN, np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        found = self._table[points]
        if (found == _UNKNOWN).any():
            for point in np.unique(points[found == _UNKNOWN]).tolist():
                self._table[point] = self._classify(chr(point))
            found = self._table[points]
        return found


def tiktoken_classes() -> Classes:
    """Classes by the pattern engine of tiktoken, whose character tables are its own.

    An encoding over single bytes gives ids for what its pattern matches and nothing for the rest.
    """
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    kinds = [
        (tiktoken.Encoding(f"class{kind}", pat_str=pattern, mergeable_ranks=single, special_tokens={}), kind)
        for pattern, kind in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", DIGIT))
    ]
    return Classes(lambda c: next((kind for engine, kind in kinds if engine.encode_ordinary(c)), SIGN))


def library_classes(split: Callable[[str], int]) -> Classes:
    """Classes by a library that tells into how many pieces it splits a text."""
    tests = (("a", LETTER), ("1", DIGIT), ("!", SIGN))
    return Classes(lambda c: next((kind for other, kind in tests if split(other + c) == 1), SPACE))


def code_points(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The characters whose UTF-8 begins at the given places."""
    points = data[places].astype(np.uint32)
    long = np.flatnonzero(points >= 0x80)
    at, lead = places[long], points[long]
    value = np.where(lead < 0xE0, lead & 0x1F, np.where(lead < 0xF0, lead & 0x0F, lead & 0x07))
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        more = lead >= least
        value[more] = (value[more] << np.uint32(6)) | (data[at[more] + k] & 0x3F)
    points[long] = value
    return points


def pretoken_starts(data: np.ndarray, bounds: np.ndarray, classes: Classes) -> np.ndarray:
    """Where pre-tokens begin in UTF-8 texts that lie between ``bounds``. They cover every byte."""
    if not len(data):
        return np.zeros(0, np.int64)
    places = np.flatnonzero((data & 0xC0) != 0x80)
    points = code_points(data, places)
    kind = classes.of(points)
    n = len(places)
    edge = np.zeros(n + 4, bool)
    edge[np.searchsorted(places, bounds)] = True
    edge[n:] = True
    solid, inner = kind != SPACE, ~edge[1:n]
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    start[1:] &= ~(solid[1:] & (points[:-1] == 0x20) & inner)
    start[:-1] |= ~solid[:-1] & solid[1:] & inner
    quotes = np.flatnonzero((points == 0x27) & start)
    if len(quotes):
        after = np.concatenate([points, np.zeros(3, np.uint32)])
        one, two = after[quotes + 1], after[quotes + 2]
        near, far = ~edge[quotes + 1], ~edge[quotes + 1] & ~edge[quotes + 2]
        short = near & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")]
        start = np.concatenate([start, np.zeros(4, bool)])
        for which, size in ((short, 2), (far & np.logical_or.reduce(pairs), 3)):
            start[quotes[which] + 1] = False
            start[quotes[which] + size] = True
        start = start[:n]
    return places[start]


class Pretokens:
    """The pre-tokens of a block of texts: the distinct ones, and for each place which one stands there.

    ``cut`` may give further bounds inside the texts, as two arrays of starts and ends of spans that
    are no pre-tokens.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, classes: Classes, cut: tuple | None = None, size: int = PIECE):
        self.data, self.bounds = data, bounds
        found = []
        for lo, hi in pieces(bounds, size):
            begin, end = bounds[lo], bounds[hi]
            inner = bounds[lo : hi + 1] - begin
            if cut is not None and len(cut[0]):
                own = (cut[0] >= begin) & (cut[1] <= end)
                spans = cut[0][own] - begin, cut[1][own] - begin
                inner = np.unique(np.concatenate([inner, *spans]))
            part = data[begin:end]
            starts = pretoken_starts(part, inner, classes)
            ends = np.append(starts[1:], len(part))[: len(starts)]
            if cut is not None and len(cut[0]) and len(spans[0]):
                outside = np.searchsorted(np.sort(spans[0]), starts, "right") <= np.searchsorted(np.sort(spans[1]), starts, "right")
                starts, ends = starts[outside], ends[outside]
            found.append((starts + begin, ends + begin, *(h.spans(h.sums(part), starts, ends) for h in (FIRST, SECOND))))
        empty = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
        self.starts, self.ends, first, second = (np.concatenate(x) for x in zip(empty, *found))
        self.docs = np.searchsorted(bounds, self.starts, "right") - 1
        order = np.argsort(first)
        new = np.ones(len(order), bool)
        new[1:] = first[order][1:] != first[order][:-1]
        if (second[order][1:] != second[order][:-1])[~new[1:]].any():
            order = np.lexsort((second, first))
            new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
        self.hashes, self.heads = first[order][new], order[new]
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1

    def distinct(self) -> list[bytes]:
        """The distinct pre-tokens, in order of their hash."""
        raw = memoryview(np.ascontiguousarray(self.data))
        return [bytes(raw[a:b]) for a, b in zip(self.starts[self.heads].tolist(), self.ends[self.heads].tolist())]
