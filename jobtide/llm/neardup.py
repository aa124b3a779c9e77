"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard of whole shingle sets, components."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.arrays import FIRST, LOWER, SECOND, mix, pieces, utf8, words
from jobtide.llm.components import connected_components
from jobtide.llm.scratch import Scratch

#: Shingles whose signature rows are gathered at a time.
_TOGETHER = 1 << 13
#: Documents of a tile that are compared with all its others at a time.
LEADERS = 64
#: Rows of two texts looked at together.
TOGETHER = 256
#: Bytes of shingles and members of a chunk of a group, about. A tile holds two chunks, or many small groups.
CHUNK_BYTES, CHUNK_MEMBERS = 2 << 20, 1024


@dataclass(frozen=True)
class Signature:
    """``bands`` times ``rows`` coordinates over a universe of 2**bits places.

    One permutation places a shingle, the other one, shifted circularly by k, gives coordinate k. Two
    sets of similarity s share a band with probability 1 - (1 - s**rows)**bands: 1 - 1e-8 at 0.75.
    """

    bands: int = 48
    rows: int = 4
    bits: int = 22

    def of(self, places: np.ndarray, docs: np.ndarray, n: int) -> np.ndarray:
        """Coordinates of n sets, given the place and set of each shingle (in order of sets)."""
        size = self.bands * self.rows
        shifted = _shifts(self.bits, size)
        out = np.full((n, size), np.iinfo(np.uint32).max, np.uint32)
        for lo in range(0, len(places), _TOGETHER):
            own = docs[lo : lo + _TOGETHER]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            some = np.minimum.reduceat(shifted[places[lo : lo + _TOGETHER]], heads, axis=0)
            out[own[heads]] = np.minimum(out[own[heads]], some)
        return out

    def keys(self, coordinates: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band of each set."""
        parts = coordinates.reshape(len(coordinates), self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
        for row in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, row])
        return key.view(np.int64)


@lru_cache(maxsize=2)
def _shifts(bits: int, size: int) -> np.ndarray:
    """Row x holds the second permutation at x, x + 1, ... (around the end), as a view."""
    order = np.random.default_rng(5).permutation(1 << bits).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: size - 1]]), size)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of lower-cased texts: the document and the hash of each, in order of both."""
    data = LOWER[data]
    starts, ends, doc = words(data, bounds)
    hashes = FIRST.spans(FIRST.sums(data), starts, ends)
    windows = FIRST.windows(hashes, width)
    whole = doc[: len(windows)] == doc[width - 1 :] if len(windows) else np.zeros(0, bool)
    edges = np.searchsorted(doc, np.arange(len(bounds)))
    counts = np.diff(edges)
    short = np.flatnonzero((counts > 0) & (counts < width))
    few = FIRST.spans(FIRST.sums(hashes), edges[short], edges[short + 1])
    docs = np.concatenate([doc[: len(windows)][whole], short])
    values = np.concatenate([windows[whole], few])
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return docs[new], values[new]


def _signatures(batch: pa.RecordBatch, signature: Signature, width: int) -> pa.RecordBatch:
    data, bounds = utf8(batch["text"])
    counts, sums, keys = [], [], []
    for lo, hi in pieces(bounds):
        docs, values = shingle_sets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], width)
        n = hi - lo
        places = mix(values * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - signature.bits)
        both = np.zeros((n, 2), np.uint64)
        for i, seed in enumerate((0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)):
            np.add.at(both[:, i], docs, mix(values ^ np.uint64(seed)))
        counts.append(np.bincount(docs, minlength=n))
        sums.append(both)
        keys.append(signature.keys(signature.of(places, docs, n)))
    n = len(batch)
    counts = np.concatenate(counts or [np.zeros(0, np.int64)])
    sums = np.concatenate(sums or [np.zeros((0, 2), np.uint64)]).view(np.int64)
    keys = np.concatenate(keys or [np.zeros((0, signature.bands), np.int64)])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * signature.bands, pa.int32()), pa.array(keys.ravel()))
    return pa.RecordBatch.from_arrays(
        [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), lists],
        ["doc_id", "n_shingles", "set_a", "set_b", "keys"],
    )


def _residuals(batch: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """For each row the size of the document's set, a hash of its head's set, and the shingles that only one of the two holds."""
    sets = []
    for column in ("text", "head_text"):
        data, bounds = utf8(batch[column])
        own: list[np.ndarray] = []
        for lo, hi in pieces(bounds):
            docs, values = shingle_sets(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], width)
            own += np.split(values, np.searchsorted(docs, np.arange(1, hi - lo)))
        sets.append(own)
    pivots = np.array([mix(h ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) for h in sets[1]], np.uint64)
    packed = [np.setxor1d(x, h, assume_unique=True).tobytes() for x, h in zip(*sets)]
    sizes = pa.array([len(x) for x in sets[0]], pa.int64())
    columns = [batch["doc"], sizes, pa.array(pivots.view(np.int64)), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["doc", "n", "pivot", "residual"])


def _linked(rows: pa.Table, percent: int) -> pa.Table:
    """Edges that tie together what links within a tile, at most one for each document and pivot.

    Sets that differ from one pivot by x and y differ from each other by as much as x does from y.
    """
    rows = rows.sort_by("pivot")
    pivots, own = rows["pivot"].to_numpy(), rows["own"].to_numpy()
    docs, n = rows["doc"].to_numpy(), rows["n"].to_numpy()
    residuals = rows["residual"].to_pylist()
    cuts = np.flatnonzero(np.diff(pivots)) + 1
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(docs)]):
        of = _labels([np.frombuffer(r, np.uint64) for r in residuals[lo:hi]], n[lo:hi], own[lo:hi], percent)
        tied = np.flatnonzero(of != np.arange(hi - lo))
        a.append(docs[lo + of[tied]])
        b.append(docs[lo + tied])
    return pa.table([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])


def _labels(residuals: list[np.ndarray], n: np.ndarray, own: np.ndarray, percent: int) -> np.ndarray:
    """For each set of one pivot the first place that links lead to. Those of the lowest chunk are compared with all."""
    m = len(residuals)
    sizes = np.array([len(r) for r in residuals], np.int64)
    values, column, held = np.unique(np.concatenate(residuals), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    often = held > m // 8
    dense = np.zeros((m, int(often.sum())), np.float32)
    at = often[column]
    dense[row[at], (np.cumsum(often) - 1)[column[at]]] = 1
    few = np.flatnonzero(~at & (held[column] > 1))  # entries of other shingles that several hold
    by_column = few[np.argsort(column[few], kind="stable")]
    first = np.searchsorted(column[by_column], np.arange(len(values)))
    holders, of = row[by_column], np.arange(m)
    leading = np.flatnonzero(own == own.min())
    for block in np.array_split(leading, -(-len(leading) // LEADERS)):
        common = (dense[block] @ dense.T).astype(np.int64)
        place = np.full(m, -1)
        place[block] = np.arange(len(block))
        some = few[place[row[few]] >= 0]
        many = held[column[some]]
        others = np.repeat(first[column[some]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        cells = np.repeat(place[row[some]] * m, many) + holders[others]
        common += np.bincount(cells, minlength=common.size).reshape(common.shape)
        both, apart = n[block, None] + n, sizes[block, None] + sizes - 2 * common
        x, y = np.nonzero((both > apart) & (100 * (both - apart) >= percent * (both + apart)))
        of = _tied(of, block[x], y)
    return of


def _tied(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each place's group, after the groups of a and b have become one."""
    while True:
        x, y = of[a], of[b]
        apart = x != y
        if not apart.any():
            return of
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        root = np.arange(len(of))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        of = root[of]


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 75,
    signature: Signature | None = None,
) -> DataFrame:
    """Components of documents whose shingle sets have 100 * intersection >= percent * union.

    A-Z are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; a set holds the distinct runs of ``width``
    words, or the whole sequence if there are fewer. Returns doc_id, n_shingles, component_id (smallest
    id that links lead to) and kept (doc_id = component_id), a row for each input row. A null text, or one
    without words, has no shingles and no links. Rows that share an id count as linked. A row without
    id has component_id null, links to nothing and is kept. An empty table gives an empty result; other
    columns are not read.

    Equal sets are one class, represented by its smallest id. Classes meet in the buckets of their
    bands. A document weighs as much as its buckets hold, which is most for the text that copies were
    made of; the weightiest of a bucket is its head, and all that meet a head are its group. A member
    goes with the shingles that it or the head holds but not both: these are few, tell the exact
    similarity of every two members, and need the two texts once for each member. Groups are compared
    in tiles of two chunks of bounded size, and a tile gives no more edges than it has members: no pair
    is ever a row, and no bucket or group is collected.
    """
    spark, signature = docs.sparkSession, signature or Signature()
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def sign(batches):
        for batch in batches:
            yield _signatures(batch, signature, width)
        pa.default_memory_pool().release_unused()

    signed = scratch.keep(rows.mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"))
    linkable = signed.filter("doc_id is not null and n_shingles > 0")
    classes = scratch.keep(linkable.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("first"), F.first("keys").alias("keys")))
    members = linkable.join(classes.select("set_a", "set_b", "first"), ["set_a", "set_b"]).select("doc_id", "first")
    one_set = F.xxhash64("set_a", "set_b")
    twice = linkable.groupBy("doc_id").agg(F.min(one_set).alias("low"), F.max(one_set).alias("high")).filter("low <> high")
    twice = scratch.keep(twice.select("doc_id"))
    same_id = None
    if not twice.isEmpty():  # rows that share an id tie their classes together
        own = members.join(twice, "doc_id")
        same_id = own.join(own.groupBy("doc_id").agg(F.min("first").alias("a")), "doc_id").select("a", F.col("first").alias("b"))

    entries = classes.select(F.explode("keys").alias("key"), F.col("first").alias("doc"))
    buckets = entries.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = scratch.keep(entries.join(buckets, "key"))
    weights = shared.groupBy("doc").agg(F.sum("size").alias("weight"))
    bucketed = scratch.keep(shared.select("key", "doc").join(weights, "doc"))
    texts = scratch.keep(rows.join(bucketed.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"))

    best = F.max(F.struct("weight", (-F.col("doc")).alias("minus")))
    heads = bucketed.groupBy("key").agg((-best["minus"]).alias("head"))
    meeting = scratch.keep(bucketed.join(heads, "key").select("head", "doc").distinct())
    edges = _edges(meeting, texts, width, percent, scratch)
    edges = scratch.keep(edges if same_id is None else edges.unionByName(same_id))
    found = scratch.keep(connected_components(edges, scratch))
    scratch.drop(texts, shared, bucketed, meeting, edges)

    to = members.distinct().join(found, F.col("first") == F.col("node"), "left")
    to = to.groupBy("doc_id").agg(F.min(F.coalesce("component", "first")).alias("found"))
    component = F.coalesce("found", "doc_id")
    out = signed.select("doc_id", "n_shingles").join(to, "doc_id", "left")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _edges(meeting: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """a, b: edges that connect the members of each head's group as their links do.

    The text of a hot head is split off by adaptive skew joins. A group of one chunk shares a tile with
    other small groups; one of k chunks has a tile for every two, so each member goes to k tiles.
    """

    def part(batches):
        for batch in batches:
            for lo in range(0, len(batch), TOGETHER):
                yield _residuals(batch.slice(lo, TOGETHER), width)
        pa.default_memory_pool().release_unused()

    def link(rows):
        return _linked(rows, percent)

    own = texts.select(F.col("doc_id").alias("doc"), "text")
    of_head = texts.select(F.col("doc_id").alias("head"), F.col("text").alias("head_text"))
    both = meeting.join(own, "doc").join(of_head, "head").select("doc", "text", "head_text")
    rows = scratch.keep(both.mapInArrow(part, "doc long, n long, pivot long, residual binary"))
    sized = rows.groupBy("pivot").agg(F.sum(F.octet_length("residual")).alias("bytes"), F.count("*").alias("members"))
    sized = sized.withColumn("chunks", F.ceil(F.greatest(F.col("bytes") / CHUNK_BYTES, F.col("members") / CHUNK_MEMBERS, F.lit(1.0))).cast("int"))
    sized = scratch.keep(sized.filter("members > 1"))
    small = sized.filter("chunks = 1").agg(F.sum("bytes"), F.sum("members")).first()
    tiles = 1 + max((small[0] or 0) // CHUNK_BYTES, (small[1] or 0) // CHUNK_MEMBERS)
    alone = F.col("chunks") == 1
    dealt = rows.join(sized.select("pivot", "chunks"), "pivot").withColumn("own", F.pmod(F.xxhash64("doc"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(
        F.when(alone, F.pmod(F.xxhash64("pivot"), F.lit(tiles))).otherwise(F.col("pivot")).alias("tile"),
        F.when(alone, -1).otherwise(F.least("own", "other")).alias("low"), F.when(alone, -1).otherwise(F.greatest("own", "other")).alias("high"),
        "doc", "n", "pivot", "residual", "own",
    )
    return dealt.groupBy("tile", "low", "high").applyInArrow(link, "a long, b long")
