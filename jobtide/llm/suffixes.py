"""Removal of byte passages that an earlier document has too, by deep-shallow suffix sorting.

Passages meet through their minimizer: the smallest hash among the grams of a passage depends on its
bytes alone, so equal passages pick the same gram at the same offset. Neighbouring passages that share
one minimizer travel as one stretch of text. Stretches whose minimizer occurs once are left out (one
row of a count-min sketch, which only overestimates). A line in very many documents gives a stretch for
each of its neighbourhoods, all with one minimizer; blocks report with their sketch how many stretches a
cell holds, and the stretches of crowded cells are split: each passage goes to the shard that owns the
hash of its own bytes. The shard that owns a minimizer sorts the suffixes of all its stretches: level by level over 8-byte characters with numpy's sorts down to a shallow
depth (a radix-like refinement, no three-way partition), then a blind trie for every group of three or
more that still shares its prefix; two are compared directly. Passages are equal where the order puts
them side by side with a common prefix of full width.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobtide.llm import sketch
from jobtide.llm.arrays import (
    FIRST,
    NO_ID,
    PIECE,
    SECOND,
    ids,
    mix,
    pack_longs,
    pieces,
    shard_of,
    unpack_longs,
    utf8,
)
from jobtide.llm.blocks import Blocks, into_blocks

#: Bytes compared by the refinement with library sorts; groups that agree on them go to blind tries.
SHALLOW = 24
#: Bytes of a gram that anchors passages. Passages of 50 bytes hold 31 of them, few enough for 32 bits.
GRAM = 20
#: A cell of the sketch is crowded from so many distinct stretches on, and from so many for each block.
CROWD, CROWD_BLOCK = 2_048, 4
REQUEST = sketch.REQUEST + ", many binary"
REPLY = "block int, shard int, payload binary, crowded binary"
RESULT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
#: Rows of the result that leave a task together, and stretches whose removed passages are listed together.
TOGETHER, STRETCHES = 256, 1 << 14
_PLACE = np.uint64((1 << 24) - 1)


class BlindTrie:
    """Strings of one length in order; inner nodes know a depth and the bytes found there, no text.

    A string is dropped blindly to some leaf, compared once with that leaf's string, and put where the
    first difference belongs.
    """

    def __init__(self):
        self.root = None

    def add(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = (text, [member])
            return
        node = self.root
        while isinstance(node, list):
            kids = node[1]
            node = kids.get(text[node[0]]) or next(iter(kids.values()))
        other, members = node
        if other == text:
            members.append(member)
            return
        apart = int.from_bytes(other, "big") ^ int.from_bytes(text, "big")
        depth = len(text) - (apart.bit_length() + 7) // 8
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        leaf = (text, [member])
        if isinstance(node, list) and node[0] == depth:
            node[1][text[depth]] = leaf
            return
        inner = [depth, {text[depth]: leaf, other[depth]: node}]
        if above is None:
            self.root = inner
        else:
            above[1][text[above[0]]] = inner

    def classes(self):
        """Members of equal strings, smallest string first."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
            else:
                yield node[1]


def sort_suffixes(text: np.ndarray, starts: np.ndarray, depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes by their first ``depth`` bytes, which ``text`` must hold beyond every start.

    Returns the order and, along it, a number that is the same for suffixes equal to that depth.
    """
    n, shallow = len(starts), min(shallow, depth) // 8 * 8
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    order, new = np.arange(n), np.zeros(n, bool)
    new[0] = True
    tied = np.arange(n) if n > 1 else np.zeros(0, np.int64)
    for at in range(0, shallow, 8):
        if not len(tied):
            break
        key = eights[starts[order[tied]] + at].view(">u8").ravel().astype(np.uint64)
        group = np.cumsum(new)[tied]
        by = np.argsort(key) if at == 0 else np.lexsort((key, group))
        order[tied], key, group = order[tied][by], key[by], group[by]
        apart = np.ones(len(tied), bool)
        apart[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[tied] = apart
        tied = _tied(new)
    if len(tied) and depth > shallow:
        heads = np.flatnonzero(new[tied]).tolist()
        members, size = order[tied].tolist(), depth - shallow
        rest = np.lib.stride_tricks.sliding_window_view(text, size)[starts[order[tied]] + shallow].tobytes()
        sorted_, first = [], []
        for lo, hi in zip(heads, [*heads[1:], len(members)]):
            if hi == lo + 2:  # a trie of two leaves
                a, b = rest[lo * size : hi * size - size], rest[hi * size - size : hi * size]
                sorted_ += members[lo:hi] if a <= b else (members[hi - 1], members[lo])
                first += (True, a != b)
                continue
            trie = BlindTrie()
            for i in range(lo, hi):
                trie.add(rest[i * size : (i + 1) * size], members[i])
            for same in trie.classes():
                sorted_ += same
                first += [True] + [False] * (len(same) - 1)
        order[tied], new[tied] = sorted_, first
    return order, np.cumsum(new) - 1


def _tied(new: np.ndarray) -> np.ndarray:
    """Places in groups of two or more, given where groups begin."""
    alone = new & np.append(new[1:], True)
    return np.flatnonzero(~alone)


def _stretches(data: np.ndarray, bounds: np.ndarray, lo: int, hi: int, width: int, gram: int):
    """Runs of passages starting in [lo, hi) that share a minimizer: starts, lengths, minimizers, two hashes."""
    part = data[lo : hi + width - 1]
    n = max(0, len(part) - width + 1)
    if not n:
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 3
    grams = FIRST.windows(part, gram)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span, reach = width - gram + 1, 1
    while reach * 2 <= span:
        least = np.minimum(least[reach:], least[: len(least) - reach])
        reach *= 2
    if reach < span:
        least = np.minimum(least[span - reach :], least[: len(least) - (span - reach)])
    inner = bounds[(bounds > lo) & (bounds < lo + len(part))] - lo
    edge = np.zeros(n + width, np.int64)
    np.add.at(edge, np.maximum(inner - width + 1, 0), 1)
    np.add.at(edge, np.minimum(inner, n), -1)
    at = np.flatnonzero(np.cumsum(edge[:n]) == 0)
    place = (least[at] & _PLACE).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    starts, lengths = at[heads], np.diff(np.append(heads, len(at)))
    hashes = [h.spans(h.sums(part), starts, starts + lengths + width - 1) for h in (FIRST, SECOND)]
    return starts + lo, lengths, mix(grams[place[heads]]), hashes[0], hashes[1]


def _ranges(bounds: np.ndarray):
    """Byte ranges of whole documents; a long document is cut at places counted from its start.

    So the stretches of a document do not depend on what stands around it, in whatever order a block's
    rows arrive.
    """
    for lo, hi in pieces(bounds):
        begin, end = int(bounds[lo]), int(bounds[hi])
        yield from ((at, min(at + PIECE, end)) for at in range(begin, end, PIECE)) if hi == lo + 1 else ((begin, end),)


class _Block:
    """All stretches of a block."""

    def __init__(self, table: pa.Table, width: int, gram: int):
        self.data, self.bounds = utf8(table["text"])
        self.doc_ids = ids(table["doc_id"])
        parts = [_stretches(self.data, self.bounds, lo, hi, width, gram) for lo, hi in _ranges(self.bounds)]
        empty = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 3
        self.starts, self.lengths, self.anchors, self.first, self.second = (np.concatenate(x) for x in zip(empty, *parts))
        self.ids = self.doc_ids[np.searchsorted(self.bounds, self.starts, "right") - 1]

    def requests(self, key: int, grid: sketch.Sketch) -> pa.Table:
        """The sketch of the block's minimizers and, by shard, its cells with several distinct stretches and how many."""
        table = pa.Table.from_batches([grid.requests(key, [self.anchors])])
        cells = grid.cells(self.anchors)
        order = np.argsort(cells)
        ordered = cells[order]
        same = ordered[1:] == ordered[:-1]
        tied = np.append(same, False) | np.insert(same, 0, False) if len(order) else np.zeros(0, bool)
        order = order[tied]
        order = order[np.lexsort((self.first[order], cells[order]))]
        cells, first = cells[order], self.first[order]
        new = np.ones(len(cells), bool)
        new[1:] = (cells[1:] != cells[:-1]) | (first[1:] != first[:-1])
        cells, many = np.unique(cells[new], return_counts=True)
        cells, many = cells[many > 1], many[many > 1]
        bases = grid.bases()
        cuts = np.searchsorted(cells, bases)
        packed = [
            pack_longs(np.concatenate([(cells[cuts[s] : cuts[s + 1]] - bases[s]).astype(np.int64), many[cuts[s] : cuts[s + 1]]]))
            for s in table["shard"].to_pylist()
        ]
        return table.append_column("many", pa.array(packed, pa.binary()))

    def flagged(self, grid: sketch.Sketch, shards: int, replies: pa.Table, width: int) -> None:
        """Keep the stretches whose minimizer may be repeated, split the crowded ones, and number the distinct ones by shard."""
        found = grid.repeated([self.anchors], replies["shard"].to_pylist(), replies["payload"].to_pylist())
        for name in ("starts", "lengths", "anchors", "first", "second", "ids"):
            setattr(self, name, getattr(self, name)[found])
        bases = grid.bases().astype(np.int64)
        crowded = [unpack_longs(c) + bases[s] for s, c in zip(replies["shard"].to_pylist(), replies["crowded"].to_pylist()) if c]
        if crowded:
            self._split(np.isin(grid.cells(self.anchors), np.concatenate(crowded).astype(np.uint64)), width)
        shard = shard_of(self.anchors, shards)
        self.order = np.lexsort((self.ids, self.second, self.first, shard))
        first, second = self.first[self.order], self.second[self.order]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        self.number, self.heads = np.cumsum(new) - 1, self.order[new]
        self.least = self.ids[self.heads]
        self.cuts = np.searchsorted(shard[self.heads], np.arange(shards + 1))
        self.used = np.flatnonzero(np.diff(self.cuts))

    def _split(self, crowded: np.ndarray, width: int) -> None:
        """Make each passage of these stretches a stretch by itself, owned by the hash of its bytes."""
        some = np.flatnonzero(crowded)
        lengths = self.lengths[some]
        owner = np.repeat(some, lengths)
        starts = self.starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        first, second = (h.at(self.data, starts, width) for h in (FIRST, SECOND))
        single = {"starts": starts, "lengths": np.ones(len(owner), np.int64), "anchors": mix(first + second), "first": first, "second": second}
        for name, values in (single | {"ids": self.ids[owner]}).items():
            setattr(self, name, np.concatenate([getattr(self, name)[~crowded], values]))

    def forget(self) -> None:
        """Drop what is known of the stretches; the texts stay."""
        for name in ("starts", "lengths", "anchors", "first", "second", "ids", "order", "number", "heads", "least"):
            delattr(self, name)

    def texts(self, some: np.ndarray, width: int) -> bytes:
        """The bytes of these stretches, one after the other."""
        sizes = self.lengths[some] + width - 1
        skip = np.repeat(self.starts[some] - np.cumsum(sizes) + sizes, sizes)
        return self.data[skip + np.arange(len(skip))].tobytes()


def _crowded(requests: pa.Table, limit: int) -> bytes:
    """The cells of a shard of the sketch that hold more than ``limit`` stretches, cells with one in each block aside."""
    reports = [unpack_longs(many.as_py()).reshape(2, -1) for many in requests["many"]]
    cells, count = np.concatenate(reports, axis=1)
    cells, place = np.unique(cells, return_inverse=True)
    return pack_longs(cells[np.bincount(place, count, len(cells)) > limit])


def _answers(requests: pa.Table, width: int) -> list[bytes]:
    """For each block and stretch, a bit for each passage that also starts in a smaller id."""
    known: dict[bytes, int] = {}
    asked, least = [], []
    for sizes, texts, doc in zip(*(requests[c].to_pylist() for c in ("sizes", "texts", "least"))):
        ends = np.cumsum(np.frombuffer(sizes, np.uint8).astype(np.int64) + width - 1).tolist()
        asked.append([known.setdefault(texts[a:b], len(known)) for a, b in zip([0, *ends], ends)])
        least.append(unpack_longs(doc))
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    text = np.frombuffer(b"".join(known), np.uint8)
    lowest = np.full(len(known), NO_ID)
    for numbers, doc in zip(asked, least):
        np.minimum.at(lowest, numbers, doc)
    windows = sizes - width + 1
    owner = np.repeat(np.arange(len(sizes)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, number = sort_suffixes(text, (np.cumsum(sizes) - sizes)[owner] + inside, width)
    heads = np.flatnonzero(np.diff(number, prepend=-1))
    smallest = np.full((len(sizes), int(windows.max())), NO_ID)
    smallest[owner[order], inside[order]] = np.minimum.reduceat(lowest[owner[order]], heads)[number]
    bits = np.uint32(1) << np.arange(smallest.shape[1], dtype=np.uint32)
    return [((smallest[n] < d[:, None]) * bits).sum(axis=1, dtype=np.uint32).astype("<u4").tobytes() for n, d in zip(asked, least)]


def _gram(width: int) -> int:
    return max(GRAM, width - 31)


def _passages(blocks: Blocks, width: int) -> tuple[DataFrame, DataFrame, sketch.Sketch]:
    """The answers of the sketch, the stretches that go to each shard, and the sketch."""
    gram, shards = _gram(width), blocks.n
    grid = sketch.Sketch.sized(2 * blocks.text_bytes // (width - gram + 2), 1, shards, cells_per_key=8)
    limit = max(CROWD, CROWD_BLOCK * blocks.n)

    def ask(key, table):
        return _Block(table, width, gram).requests(key[0].as_py(), grid)

    def add(key, requests):
        out = grid.answers(key[0].as_py(), requests).rename_columns(["block", "shard", "payload"])
        return out.append_column("crowded", pa.array([_crowded(requests, limit)] * len(out), pa.binary()))

    def ask_exactly(key, table, replies):
        block = _Block(table, width, gram)
        block.flagged(grid, shards, replies, width)
        ranges = [block.heads[block.cuts[s] : block.cuts[s + 1]] for s in block.used]
        return pa.table({
            "shard": pa.array(block.used, pa.int32()),
            "block": pa.array([key[0].as_py()] * len(ranges), pa.int32()),
            "sizes": pa.array([block.lengths[r].astype(np.uint8).tobytes() for r in ranges], pa.binary()),
            "texts": pa.array([block.texts(r, width) for r in ranges], pa.binary()),
            "least": pa.array([pack_longs(block.ids[r]) for r in ranges], pa.binary()),
        })

    asked = blocks.grouped.applyInArrow(ask, REQUEST)
    counted = asked.groupBy("shard").applyInArrow(add, REPLY).repartition("block")
    request = "shard int, block int, sizes binary, texts binary, least binary"
    return counted, blocks.grouped.cogroup(counted.groupBy("block")).applyInArrow(ask_exactly, request), grid


def remove_repeated_passages(
    docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, carry: Sequence[str | Column] = ()
) -> DataFrame:
    """Remove each byte covered by ``width`` bytes (32 to 80) that also start in a smaller-id document.

    Texts are UTF-8 bytes; passages lie in one document, may overlap and are judged on the input.
    Returns doc_id, n_bytes, n_removed, spans (the maximal removed runs) and kept (the remaining
    bytes), a row for each input row; with ``carry`` also kept_text (without the characters that lost some
    of their bytes) and a struct ``rest`` of those columns of the row. A null text is empty; a null id comes after every other id and
    is not smaller than another null; rows that share an id are not earlier than each other; an empty
    table gives an empty result; other columns are not read.

    Stretches of a block are told apart by two independent 64-bit hashes; what a shard sorts and
    compares are the bytes themselves.
    """
    if not 32 <= width <= 80:
        raise ValueError("width must be 32 to 80 bytes")
    blocks = into_blocks(docs, id_col, text_col, block_bytes, carry)
    counted, again, grid = _passages(blocks, width)
    gram, shards, carried = _gram(width), blocks.n, bool(carry)

    def sort(key, requests):
        shard = pa.array([key[0].as_py()] * len(requests), pa.int32())
        return pa.table([requests["block"], shard, pa.array(_answers(requests, width), pa.binary())], names=["block", "shard", "payload"])

    def remove(key, table, replies):
        block = _Block(table, width, gram)
        exact = replies["exact"].to_numpy(zero_copy_only=False).astype(bool)
        block.flagged(grid, shards, replies.filter(pa.array(~exact)), width)
        answers = replies.filter(pa.array(exact))
        masks = dict(zip(answers["shard"].to_pylist(), answers["payload"].to_pylist()))
        bits = np.frombuffer(b"".join(masks[int(s)] for s in block.used), "<u4")
        own = bits[block.number]
        own[block.ids[block.order] > block.least[block.number]] = np.uint32(0xFFFFFFFF)
        cover = _cover(own, block.starts[block.order], block.lengths[block.order], width, len(block.data))
        del answers, masks, bits, own
        block.forget()
        out = _kept(block, cover)
        if carried:
            out = out.append_column("kept_text", _whole(block, cover)).append_column("rest", table["rest"])
        return pa.Table.from_batches(out.to_batches(TOGETHER), out.schema)

    result = StructType.fromDDL(RESULT)
    if carried:
        result = result.add("kept_text", "string").add(blocks.rows.schema["rest"])
    sorted_ = again.groupBy("shard").applyInArrow(sort, "block int, shard int, payload binary").repartition("block")
    sorted_ = sorted_.withColumn("crowded", F.lit(None).cast("binary"))
    replies = counted.withColumn("exact", F.lit(False)).unionByName(sorted_.withColumn("exact", F.lit(True)))
    return blocks.grouped.cogroup(replies.groupBy("block")).applyInArrow(remove, result)


def _cover(bits: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n bytes go, given the stretches of a block and a bit for each of their passages."""
    edge = np.zeros(n + 1, np.int8)
    for lo in range(0, len(bits), STRETCHES):
        some = lengths[lo : lo + STRETCHES]
        owner = np.repeat(np.arange(lo, lo + len(some)), some)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(some) - some, some)
        gone = (bits[owner] >> inside.astype(np.uint32)) & np.uint32(1) == 1
        gone = (starts[owner] + inside)[gone]
        edge[gone] += 1
        edge[gone + width] -= 1
    return np.cumsum(edge[:n], dtype=np.int32) > 0


def _kept(block: _Block, cover: np.ndarray) -> pa.Table:
    """The rows of a block, given which of its bytes go."""
    data, bounds = block.data, block.bounds
    kept, places = data[~cover], np.concatenate([[0], np.cumsum(~cover, dtype=np.int32)])[bounds]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    heads, tails = cover.copy(), cover.copy()
    heads[1:] &= ~cover[:-1] | first[1 : len(data)]
    tails[:-1] &= ~cover[1:] | first[1 : len(data)]
    heads, tails = np.flatnonzero(heads), np.flatnonzero(tails) + 1
    edges = np.searchsorted(heads, bounds)
    doc = np.searchsorted(bounds, heads, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(heads - bounds[doc], pa.int64()), pa.array(tails - bounds[doc], pa.int64())], ["start", "end"])
    return pa.table({
        "doc_id": pa.array(block.doc_ids, pa.int64(), mask=block.doc_ids == NO_ID),
        "n_bytes": pa.array(np.diff(bounds), pa.int64()),
        "n_removed": pa.array(np.diff(bounds) - np.diff(places), pa.int64()),
        "spans": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans),
        "kept": pa.array([kept[a:b].tobytes() for a, b in zip(places[:-1], places[1:])], pa.binary()),
    })


def _whole(block: _Block, cover: np.ndarray) -> pa.Array:
    """What is kept of each document as text; characters that lost some of their bytes go as a whole."""
    texts = []
    for lo, hi in zip(block.bounds[:-1], block.bounds[1:]):
        own, gone = block.data[lo:hi], cover[lo:hi]
        if gone.any():
            character = np.cumsum((own & 0xC0) != 0x80) - 1
            lost = np.bincount(character, gone) > 0
            own = own[~lost[character]]
        texts.append(own.tobytes().decode("utf-8"))
    return pa.array(texts, pa.string())
