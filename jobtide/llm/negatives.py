"""Hard negatives by a vertical scan (BOND): components are read column by column.

Blocks of vectors are stored by component. For an anchor, components are read in the descending order of
its own magnitudes; what the unread ones can still add lies between the sums of their least and greatest
contributions in the block. A bitmap of candidates shrinks as these bounds close: for positives to what
may be among the best, for negatives to what may be among the best inside a window of scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.scratch import Scratch

#: Rows of a block, anchors that meet it at once, and components read between two looks at the bounds.
BLOCK_ROWS, ANCHOR_ROWS, STEP = 4_096, 256, 8
_NO_ID = np.iinfo(np.int64).max


def _usable(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(_NO_ID))).alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.size(vector_col).alias("dim"),
    )


def _pack(rows: DataFrame, size: int, number: str) -> DataFrame:
    """One row for each block: ids, row numbers, labels, and the components one column after the other."""
    counts = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias("of"))
    placed = rows.join(counts, "dim").withColumn(number, F.pmod(F.xxhash64("row"), "of").cast("int"))

    def pack(table):
        n, dim = len(table), table["dim"][0].as_py()
        order = np.argsort(table["row"].to_numpy())
        values = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(n, dim)[order]
        out = {c: [table[c].to_numpy().astype("<i8")[order].tobytes()] for c in ("id", "row", "label")}
        out |= {"dim": [dim], "of": [table["of"][0].as_py()], number: [table[number][0].as_py()], "v": [np.ascontiguousarray(values.T).tobytes()]}
        return pa.table({c: pa.array(out[c], t) for c, t in fields})

    fields = [("dim", pa.int32()), ("of", pa.int32()), (number, pa.int32()), *((c, pa.binary()) for c in ("id", "row", "label", "v"))]
    return placed.groupBy("dim", number).applyInArrow(pack, f"dim int, of int, {number} int, id binary, row binary, label binary, v binary")


class _Tile:
    """A block of candidates and the anchors that meet it."""

    def __init__(self, row: dict):
        read = lambda name: np.frombuffer(row[name], "<i8")
        self.ids, self.rows, self.labels = read("id"), read("row"), read("label")
        self.columns = read("v").reshape(row["dim"], len(self.rows))
        self.lows, self.highs = (f(self.columns, axis=1) if row["dim"] else np.zeros(0, np.int64) for f in (np.min, np.max))
        self.anchor_ids, self.anchor_rows, self.anchor_labels = read("a_id"), read("a_row"), read("a_label")
        self.anchors = np.ascontiguousarray(read("a_v").reshape(row["dim"], len(self.anchor_rows)).T)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, still) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that are left of the bitmap and their scores. ``still(scores, low, high)`` says what may yet win."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.stack([anchor * self.lows, anchor * self.highs])[:, order]
        rest = lambda ends: np.append(np.cumsum(ends[::-1])[::-1], 0)
        low, high = rest(ends.min(axis=0)), rest(ends.max(axis=0))
        scores = np.zeros(len(alive), np.int64)
        whole = len(alive) == self.columns.shape[1]
        for at in range(0, len(order), STEP):
            for j in order[at : at + STEP]:
                scores += anchor[j] * (self.columns[j] if whole else self.columns[j][alive])
            to = min(at + STEP, len(order))
            if to < len(order) and len(alive):
                left = still(scores, low[to], high[to])
                if not left.all():
                    alive, scores, whole = alive[left], scores[left], False
        return alive, scores

    def best(self, candidates: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Positions of the k best: higher scores first, ties by smaller id, then by row."""
        return np.lexsort((self.rows[candidates], self.ids[candidates], -scores))[:k]


def _positives(k: int):
    """Each anchor's best rows of its label in a block."""

    def still(scores, low, high):
        if len(scores) <= k:
            return np.ones(len(scores), bool)
        return scores + high >= np.partition(scores, len(scores) - k)[len(scores) - k] + low

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tile = _Tile(row)
                out = []
                for i, anchor in enumerate(tile.anchors):
                    alive = np.flatnonzero((tile.labels == tile.anchor_labels[i]) & (tile.rows != tile.anchor_rows[i]))
                    alive, scores = tile.scan(anchor, alive, still)
                    best = tile.best(alive, scores, k)
                    own = np.full(len(best), tile.anchor_rows[i])
                    out.append((own, tile.rows[alive[best]], tile.ids[alive[best]], scores[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["anchor", "row", "id", "score"])

    return run


def _windows(scores: list[int], least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last score of each positive's window: least * s <= 100 * score <= most * s."""
    return np.array([-(-least * s // 100) for s in scores]), np.array([most * s // 100 for s in scores])


def _negatives(k: int, least: int, most: int):
    """Each anchor's best rows of other labels in a block, for the window of each of its positives."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tile, out = _Tile(row), []
                known = {p["anchor"]: p["positives"] for p in row["positives"]}
                for i, anchor in enumerate(tile.anchors):
                    positives = known.get(int(tile.anchor_rows[i]), [])
                    firsts, lasts = _windows([p["score"] for p in positives], least, most)
                    open_ = np.flatnonzero(firsts <= lasts)
                    if not len(open_):
                        continue

                    def still(scores, low, high, windows=sorted({(firsts[w], lasts[w]) for w in open_})):
                        left = np.zeros(len(scores), bool)
                        for first, last in windows:
                            may = (scores + high >= first) & (scores + low <= last)
                            sure = scores[(scores + low >= first) & (scores + high <= last)]
                            if len(sure) > k:
                                may &= scores + high >= np.partition(sure, len(sure) - k)[len(sure) - k] + low
                            left |= may
                        return left

                    alive, scores = tile.scan(anchor, np.flatnonzero(tile.labels != tile.anchor_labels[i]), still)
                    for w in open_:
                        inside = np.flatnonzero((scores >= firsts[w]) & (scores <= lasts[w]))
                        best = inside[tile.best(alive[inside], scores[inside], k)]
                        n, p = len(best), positives[w]
                        same = lambda x, n=n: np.full(n, x, np.int64)
                        out.append((same(tile.anchor_rows[i]), same(tile.anchor_ids[i]), same(p["at"]), same(p["id"]), same(p["score"]),
                                    tile.rows[alive[best]], tile.ids[alive[best]], scores[best]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], list(_FOUND))

    return run


_FOUND = ("anchor", "anchor_id", "at", "positive_id", "positive_score", "row", "negative_id", "negative_score")


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256,
) -> DataFrame:
    """For each anchor and positive the best rows of other labels whose score is least to most percent of the positive's.

    Anchors are rows whose id is divisible by ``every``; their positives are the best other rows of the same
    label by integer inner product of floor(scale * x). Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score and negative_score; ties go to the smaller id. A positive with a negative
    score has an empty window. Rows with a null label or vector, or a null or non-finite component, take no
    part; a row without id is no anchor and comes after every other id. Vectors of different length do not
    meet. Rows that share an id are rows of their own. Sums must fit in 64 bits. Fewer rows give fewer
    results, an empty table none; other columns are not read.

    Every anchor meets every block, as an exact search must; each meeting returns at most ``positives`` rows,
    and then at most ``positives * negatives``.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.keep(_usable(vectors, id_col, label_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()))
    blocks = scratch.keep(_pack(rows, BLOCK_ROWS, "block"))
    asking = _pack(rows.filter((F.col("id") != int(_NO_ID)) & (F.col("id") % every == 0)), ANCHOR_ROWS, "chunk")
    asking = scratch.keep(asking.select("dim", "chunk", *(F.col(c).alias(f"a_{c}") for c in ("id", "row", "label", "v"))))
    numbers = blocks.select("dim", "block")

    first = asking.join(numbers, "dim").join(blocks.drop("of"), ["dim", "block"])
    met = first.drop("chunk").mapInArrow(_positives(positives), "anchor long, row long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    best = met.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= positives)
    best = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("at", "id", "score"))).alias("positives"))
    owners = rows.filter((F.col("id") != int(_NO_ID)) & (F.col("id") % every == 0)).select(F.col("row").alias("anchor"), "dim")
    counts = owners.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / ANCHOR_ROWS)).cast("int").alias("of"))
    owners = owners.join(counts, "dim").withColumn("chunk", F.pmod(F.xxhash64("anchor"), "of").cast("int"))
    known = scratch.keep(owners.join(best, "anchor").groupBy("dim", "chunk").agg(F.collect_list(F.struct("anchor", "positives")).alias("positives")))

    second = asking.join(known, ["dim", "chunk"]).join(numbers, "dim").join(blocks.drop("of"), ["dim", "block"])
    found = second.drop("chunk").mapInArrow(_negatives(negatives, least, most), ", ".join(f"{c} long" for c in _FOUND))
    order = Window.partitionBy("anchor", "at").orderBy(F.desc("negative_score"), "negative_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    known_id = lambda c: F.when(F.col(c) != int(_NO_ID), F.col(c)).alias(c)
    return ranked.select("anchor_id", known_id("positive_id"), "rank", known_id("negative_id"), "positive_score", "negative_score")
