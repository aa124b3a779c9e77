"""Removal of word windows that an earlier document has too (count-min prefilter, then exact groups)."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm import sketch
from jobtide.llm.arrays import (
    FIRST,
    NO_ID,
    SECOND,
    covered,
    ids,
    pack_longs,
    pieces,
    shard_of,
    unpack_bits,
    unpack_longs,
    utf8,
    words,
)
from jobtide.llm.blocks import into_blocks

#: Bytes of text for each word, to size the sketch; only the share of false positives depends on it.
BYTES_PER_WORD = 6
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def _piece(data, bounds, lo, hi, width):
    """Words and windows of documents lo to hi: starts, ends, documents, window places, two hashes."""
    part, inner = data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
    starts, ends, doc = words(part, inner)
    hashes = [h.windows(h.spans(h.sums(part), starts, ends), width) for h in (FIRST, SECOND)]
    at = np.flatnonzero(doc[: len(hashes[0])] == doc[width - 1 :]) if len(hashes[0]) else np.zeros(0, np.int64)
    return part, starts, ends, doc + lo, at, hashes[0][at], hashes[1][at]


class _Block:
    """All windows of a block: two 64-bit hashes, the document and its id."""

    def __init__(self, table: pa.Table, width: int):
        self.data, self.bounds = utf8(table["text"])
        self.doc_ids = ids(table["doc_id"])
        self.parts = [(lo, hi, _piece(self.data, self.bounds, lo, hi, width)) for lo, hi in pieces(self.bounds)]
        joined = [np.concatenate([p[i] for _, _, p in self.parts] or [np.zeros(0, np.uint64)]) for i in (5, 6)]
        self.hashes = joined
        at = [p[3][p[4]] for _, _, p in self.parts] or [np.zeros(0, np.int64)]
        self.ids = self.doc_ids[np.concatenate(at)]

    def flagged(self, grid: sketch.Sketch, replies: pa.Table) -> None:
        """Keep the windows that may be repeated, and number their distinct sequences."""
        self.found = np.flatnonzero(grid.repeated(self.hashes, replies["shard"].to_pylist(), replies["heavy"].to_pylist()))
        first, second, doc = self.hashes[0][self.found], self.hashes[1][self.found], self.ids[self.found]
        self.order = np.lexsort((doc, second, first))
        first, second, doc = first[self.order], second[self.order], doc[self.order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.keys, self.least, self.number = (first[new], second[new]), doc[new], np.cumsum(new) - 1
        self.sorted_ids = doc


def _exact_answers(requests: pa.Table) -> list[bytes]:
    """For each block, which of its sequences also start in another block's smaller id."""
    counts, parts = [], []
    for keys, least in zip(requests["cells"].to_pylist(), requests["least"].to_pylist()):
        keys = np.frombuffer(keys, "<u8").reshape(2, -1)
        counts.append(keys.shape[1])
        parts.append((keys[0], keys[1], unpack_longs(least)))
    first, second, least = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((least, second, first))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(first[order]) != 0) | (np.diff(second[order]) != 0)
    smaller = np.empty(len(order), bool)
    smaller[order] = least[order][new][np.cumsum(new) - 1] < least[order]
    return [np.packbits(x).tobytes() for x in np.split(smaller, np.cumsum(counts)[:-1])]


def remove_repeated_windows(
    docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None
) -> DataFrame:
    """Remove each word covered by ``width`` words in a row that also start in a smaller-id document.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows lie in one document and are judged on the
    input. Returns doc_id, n_words, n_removed and kept_text (kept words joined by one space), a row for
    each input row. A null text has no words; a null id comes after every other id and is not smaller
    than another null; rows that share an id are not earlier than each other; an empty table gives an
    empty result; other columns are not read.

    The first pass merges the blocks' count-min sketches and drops windows seen once. The second groups
    the rest by two independent 64-bit hashes of the word sequence.
    """
    blocks = into_blocks(docs, id_col, text_col, block_bytes)
    shards, grid = blocks.n, sketch.Sketch.sized(blocks.text_bytes // BYTES_PER_WORD, 2, blocks.n)

    def ask(key, table):
        return pa.Table.from_batches([grid.requests(key[0].as_py(), _Block(table, width).hashes)])

    def add(key, requests):
        return grid.answers(key[0].as_py(), requests)

    def ask_exactly(key, table, replies):
        block = _Block(table, width)
        block.flagged(grid, replies)
        cuts = np.searchsorted(shard_of(block.keys[0], shards), np.arange(shards + 1))
        used = np.flatnonzero(np.diff(cuts))
        ranges = [slice(cuts[s], cuts[s + 1]) for s in used]
        return pa.table({
            "shard": pa.array(used, pa.int32()),
            "block": pa.array([key[0].as_py()] * len(used), pa.int32()),
            "cells": pa.array([b"".join(k[r].tobytes() for k in block.keys) for r in ranges], pa.binary()),
            "least": pa.array([pack_longs(block.least[r]) for r in ranges], pa.binary()),
        })

    def group(key, requests):
        shard = pa.array([key[0].as_py()] * len(requests), pa.int32())
        return pa.table([requests["block"], shard, pa.array(_exact_answers(requests), pa.binary())], names=["block", "shard", "heavy"])

    def remove(key, table, replies):
        block = _Block(table, width)
        exact = replies["exact"].to_numpy(zero_copy_only=False).astype(bool)
        block.flagged(grid, replies.filter(pa.array(~exact)))
        answers = replies.filter(pa.array(exact))
        bits = dict(zip(answers["shard"].to_pylist(), answers["heavy"].to_pylist()))
        smaller = np.zeros(len(block.least), bool)
        cuts = np.searchsorted(shard_of(block.keys[0], shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            smaller[cuts[s] : cuts[s + 1]] = unpack_bits(bits[int(s)], int(cuts[s + 1] - cuts[s]))
        gone = np.zeros(len(block.ids), bool)
        gone[block.found[block.order]] = smaller[block.number] | (block.least[block.number] < block.sorted_ids)
        return _kept(block, gone, width)

    asked = blocks.grouped.applyInArrow(ask, sketch.REQUEST)
    counted = asked.groupBy("shard").applyInArrow(add, sketch.REPLY).repartition("block")
    again = blocks.grouped.cogroup(counted.groupBy("block")).applyInArrow(ask_exactly, sketch.REQUEST + ", least binary")
    grouped = again.groupBy("shard").applyInArrow(group, sketch.REPLY).repartition("block")
    replies = counted.withColumn("exact", F.lit(False)).unionByName(grouped.withColumn("exact", F.lit(True)))
    return blocks.grouped.cogroup(replies.groupBy("block")).applyInArrow(remove, RESULT)


def _kept(block: _Block, gone: np.ndarray, width: int) -> pa.Table:
    counts, removed, texts, at = [], [], [], 0
    for lo, hi, (part, starts, _, doc, places, *_rest) in block.parts:
        cover = covered(places[gone[at : at + len(places)]], width, len(starts))
        at += len(places)
        edges = np.searchsorted(doc, np.arange(lo, hi + 1))
        for i in range(hi - lo):
            start, end = block.bounds[lo + i] - block.bounds[lo], block.bounds[lo + i + 1] - block.bounds[lo]
            own, mask = part[start:end].tobytes().split(), cover[edges[i] : edges[i + 1]]
            lost = int(mask.sum())
            counts.append(len(own))
            removed.append(lost)
            texts.append(b" ".join(compress(own, (~mask).tolist()) if lost else own))
    null = block.doc_ids == NO_ID
    return pa.table({
        "doc_id": pa.array(block.doc_ids, pa.int64(), mask=null),
        "n_words": pa.array(counts, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "kept_text": pa.array(texts, pa.binary()).cast(pa.string()),
    })
