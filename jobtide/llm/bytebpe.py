"""Byte-level BPE encoding by longest matches and backtracking, and decoding.

A list of tokens is the encoding of its text exactly if every two neighbours are compatible, that is,
if merging the bytes of both gives the two tokens back. The encoder takes the longest token that is
compatible with the one before and steps back where none is left. The encoding of each prefix is
unique, so a place that was left once is never entered again and the work is linear in the text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.llm.arrays import pieces, utf8
from jobtide.llm.pretokens import Pretokens, tiktoken_classes

#: Bytes, as estimated, of remembered encodings of pre-tokens, and pairs of tokens whose compatibility
#: is remembered. A full store is emptied, and so is each at the end of a task; what is missing is computed anew.
REMEMBERED_BYTES = 96 << 20
REMEMBERED_PAIRS = 600_000
#: Bytes of text looked at together; arrays of some 60 bytes for each are held meanwhile.
TOGETHER = 1 << 20
#: Ids whose bytes are gathered together.
DECODED_TOGETHER = 1 << 18
_NEVER = 1 << 62


class BytePairs:
    """Tokens by rank, from lines of base64 and rank."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        self.matches = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            self.matches.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.matches.make_automaton()
        self.classes = tiktoken_classes()
        self._known: dict[bytes, list[int]] = {}
        self._known_bytes = 0
        self._pairs: dict[int, bool] = {}
        self._prefixes: dict[int, int] = {}
        self._edges: tuple[dict, dict] = ({}, {})
        self._joined: tuple[np.ndarray, np.ndarray] | None = None

    def merge(self, text: bytes) -> list[int]:
        """Plain merging, lowest rank first, leftmost first among equals."""
        return self._merged(text, 1)

    def _merged(self, text: bytes, least: int) -> list[int]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > least:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge while ``token`` is merged, and the rank that ends each."""
        known = self._edges[side].get(token)
        if known is None:
            text = self.tokens[token]
            if len(text) == 1:
                known = [(token, _NEVER)]
            else:
                inner = self._merged(text, 2)[side - 1]
                known = [*self._edge(inner, side)[:-1], (inner, token), (token, _NEVER)]
            self._edges[side][token] = known
        return known

    def _shorter(self, token: int) -> int:
        """The longest token that begins ``token``, -1 if there is none."""
        known = self._prefixes.get(token)
        if known is None:
            text = self.tokens[token]
            known = next((self.ranks[text[:i]] for i in range(len(text) - 1, 0, -1) if text[:i] in self.ranks), -1)
            self._prefixes[token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives both back.

        Follows what stands left and right of the border from single bytes on. The two that face each
        other at some time would merge if their rank comes before either of them is merged away; of
        equal ranks the left one goes first.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            ours, theirs, i, j, known = self._edge(left, 0), self._edge(right, 1), 0, 0, True
            while True:
                (x, x_end), (y, y_end) = ours[i], theirs[j]
                rank = self.ranks.get(self.tokens[x] + self.tokens[y], _NEVER)
                if rank < x_end and rank <= y_end and rank != _NEVER:
                    known = False
                    break
                if x_end == y_end == _NEVER:
                    break
                if x_end <= y_end:
                    i += 1
                else:
                    j += 1
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def encode(self, text: bytes) -> list[int]:
        """The tokens of one pre-token."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        n, tokens, longest = len(text), self.tokens, [0] * len(text)
        for end, (back, rank) in self.matches.iter(text.decode("latin-1")):
            longest[end - back] = rank
        out: list[int] = []
        closed = [False] * (n + 1)
        at, token, pairs = 0, longest[0], self._pairs
        while True:
            end = at + len(tokens[token])
            if not closed[end] and (not out or (self.compatible(out[-1], token) if (fits := pairs.get(out[-1] << 32 | token)) is None else fits)):
                out.append(token)
                if end == n:
                    return out
                at, token = end, longest[end]
                continue
            token = self._shorter(token)
            while token < 0:
                closed[at] = True
                token = out.pop()
                at -= len(tokens[token])
                token = self._shorter(token)

    def encode_all(self, texts: list[bytes]) -> list[list[int]]:
        out = []
        for text in texts:
            ids = self._known.get(text)
            if ids is None:
                ids = self.encode(text)
                if self._known_bytes >= REMEMBERED_BYTES:
                    self._known.clear()
                    self._known_bytes = 0
                if len(text) <= 64:
                    self._known[text] = ids
                    self._known_bytes += 200 + len(text) + 8 * len(ids)  # two objects and their place in the store
            out.append(ids)
        return out

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens by rank, and where each begins (and the last ends)."""
        if self._joined is None:
            starts = np.cumsum([0, *map(len, self.tokens)], dtype=np.int64)
            self._joined = np.frombuffer(b"".join(self.tokens), np.uint8), starts
        return self._joined

    def forget(self) -> None:
        """Give back what was remembered of the texts of a task."""
        self._known, self._known_bytes, self._pairs = {}, 0, {}
        pa.default_memory_pool().release_unused()


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    return BytePairs(path)


def _encoded(text_column: pa.Array, known: BytePairs) -> pa.Array:
    """The ids of each text."""
    data, bounds = utf8(text_column)
    sizes, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for lo, hi in pieces(bounds, TOGETHER):
        found = Pretokens(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], known.classes)
        encodings = known.encode_all(found.distinct())
        lengths = np.fromiter(map(len, encodings), np.int64, len(encodings))
        flat = np.fromiter((i for e in encodings for i in e), np.int32, int(lengths.sum()))
        many = lengths[found.which]
        first = (np.cumsum(lengths) - lengths)[found.which]
        parts.append(flat[np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))])
        size = np.zeros(hi - lo, np.int64)
        np.add.at(size, found.docs, many)
        sizes.append(size)
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(parts), pa.int32())).cast(pa.list_(pa.int32()))


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: str | None = None) -> DataFrame:
    """Token ids of every whole text, as the tiktoken library gives them without special tokens.

    Returns doc_id and ids, a row for each input row, repeated ids included; no shuffle. A null or
    empty text has no ids (an empty array); a null doc_id stays null; an empty table gives an empty
    result; other columns are not read. ``decoded`` names a column for the bytes that the ids decode to, made
    by the same worker. The rank file must exist on every executor.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, ids array<int>" + (f", `{decoded}` binary" if decoded else "")

    def run(batches):
        known = byte_pairs(ranks_path)
        for batch in batches:
            for lo, hi in pieces(utf8(batch["text"])[1], 4 * TOGETHER):
                some = batch.slice(lo, hi - lo)
                columns = {"doc_id": some["doc_id"], "ids": _encoded(some["text"], known)}
                if decoded:
                    columns[decoded] = _decoded(columns["ids"], known)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
        known.forget()

    return rows.mapInArrow(run, schema)


def _decoded(ids_column: pa.Array, known: BytePairs) -> pa.Array:
    """The bytes of each list of ids, read off one array that holds the bytes of all tokens."""
    counts = pc.fill_null(pc.list_value_length(ids_column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = ids_column.flatten()
    if values.null_count:
        raise TypeError("an id is null")
    ids = values.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    bad = np.flatnonzero((ids < 0) | (ids >= len(known.tokens)))
    if len(bad):
        doc = int(np.searchsorted(np.cumsum(counts), bad[0], "right"))
        own = ids[counts[:doc].sum() :][: counts[doc]]
        raise ValueError(f"no token has the id {own.min() if own.min() < 0 else own.max()}")
    data, starts = known.joined()
    sizes = np.zeros(len(ids) + 1, np.int64)
    parts = [np.zeros(0, np.uint8)]
    for lo in range(0, len(ids), DECODED_TOGETHER):
        some = ids[lo : lo + DECODED_TOGETHER]
        many = starts[some + 1] - starts[some]
        sizes[lo + 1 : lo + 1 + len(some)] = many
        parts.append(data[np.repeat(starts[some] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))])
    ends = np.cumsum(sizes)[np.concatenate([[0], np.cumsum(counts)])]
    bounds = pa.array(ends, pa.int32())  # fails beyond 2 GB, as one Arrow column of bytes does
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, bounds.buffers()[1], pa.py_buffer(np.concatenate(parts))])


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; the other columns stay. Null ids decode to no bytes.

    An id without a token raises an error, which names it.
    """
    schema = T.StructType([*encoded.drop(into).schema, T.StructField(into, T.BinaryType())])

    def run(batches):
        known = byte_pairs(ranks_path)
        for batch in batches:
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n != into}
            yield pa.RecordBatch.from_arrays([*columns.values(), _decoded(batch[ids_col], known)], [*columns, into])

    return encoded.mapInArrow(run, schema)
