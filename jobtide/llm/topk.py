"""Exact top-k inner products by a three-phase uniform threshold over lists of partial scores.

Components are cut into a few lists; a list scores a vector by its own components only. Scores are
shifted by the smallest score of query and list, so that none is negative. Phase one gathers the k best
of each list; the exact totals of these few rows give a safe cutoff, and a vector that reaches it scores
at least its m-th part in one of the m lists. Phase two sends that cutoff to the lists and keeps all
entries that reach it; phase three resolves the scores they have in the other lists exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.scratch import Scratch

#: Lists that components are cut into, and rows of a block of candidates and of queries.
LISTS, BLOCK_ROWS, QUERY_ROWS = 4, 8_192, 512


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and floor(scale * x) of each component; rows without id, vector or finite components go."""
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(usable, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _pack(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """One row for each block: row numbers, ids, and the components of each list."""
    counts = rows.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int").alias(f"{prefix}_blocks"))
    placed = rows.join(counts, "dim").withColumn("block", F.pmod(F.xxhash64("row"), f"{prefix}_blocks").cast("int"))

    def pack(table):
        n, dim = len(table), table["dim"][0].as_py()
        values = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, dim)
        order = np.argsort(table["row"].to_numpy())
        parts = [np.ascontiguousarray(values[order][:, p]).tobytes() for p in np.array_split(np.arange(dim), LISTS)]
        return pa.table({
            "dim": pa.array([dim], pa.int32()),
            f"{prefix}_blocks": pa.array([table[f"{prefix}_blocks"][0].as_py()], pa.int32()),
            f"{prefix}_block": pa.array([table["block"][0].as_py()], pa.int32()),
            f"{prefix}_rows": pa.array([table["row"].to_numpy()[order].tobytes()], pa.binary()),
            f"{prefix}_ids": pa.array([table["vec_id"].to_numpy()[order].tobytes()], pa.binary()),
            f"{prefix}_lists": pa.array([parts], pa.list_(pa.binary())),
        })

    schema = f"dim int, {prefix}_blocks int, {prefix}_block int, {prefix}_rows binary, {prefix}_ids binary, {prefix}_lists array<binary>"
    return placed.groupBy("dim", "block").applyInArrow(pack, schema)


def _local(row: dict, at: int) -> np.ndarray:
    """The scores of one list: a row for each query, a column for each candidate."""
    ours, theirs = (np.frombuffer(row[f"{p}_lists"][at], float).reshape(len(row[f"{p}_rows"]) // 8, -1) for p in "cq")
    return np.rint(theirs @ ours.T).astype(np.int64)


def _rows(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["c_rows"], "<i8"), np.frombuffer(row["q_rows"], "<i8")


def _gather(k: int):
    """Phase one: for each query and list of a block the k best rows and the smallest score."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                candidates, queries = _rows(row)
                size = min(k, len(candidates))
                for number in range(LISTS):
                    scores = _local(row, number)
                    low = scores.min(axis=1)
                    masked = np.where(candidates[None, :] == queries[:, None], np.iinfo(np.int64).min + 1, scores)  # can be negated
                    best = np.argpartition(-masked, size - 1, axis=1)[:, :size]
                    query, at = np.repeat(np.arange(len(queries)), size), best.ravel()
                    own = candidates[at] == queries[query]  # its row tells the low only
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(queries[query]), pa.array(np.full(len(at), number, np.int32)), pa.array(low[query]),
                         pa.array(candidates[at], mask=own), pa.array(scores[query, at])],
                        ["query", "list", "low", "row", "local"],
                    )

    return run


def _reached(gains: np.ndarray, bound: int) -> np.ndarray:
    """Which shifted scores are enough: a vector whose lists all stay below scores less than the bound."""
    return gains * LISTS >= bound


def _resolve(k: int):
    """Phases two and three: entries that reach the cutoff in some list, their exact scores, the block's k best of them."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                candidates, queries = _rows(row)
                ids, query_ids = np.frombuffer(row["c_ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
                lists = [_local(row, number) for number in range(LISTS)]
                cuts = {c["query"]: c for c in row["cuts"]}
                for i, query in enumerate(queries.tolist()):
                    if query not in cuts:
                        continue
                    bound, lows = cuts[query]["bound"], cuts[query]["lows"]
                    enough = np.logical_or.reduce([_reached(scores[i] - low, bound) for scores, low in zip(lists, lows)])
                    at = np.flatnonzero(enough & (candidates != query))
                    total = sum(scores[i, at] for scores in lists)
                    at, total = at[total - sum(lows) >= bound], total[total - sum(lows) >= bound]
                    best = np.lexsort((candidates[at], ids[at], -total))[:k]
                    n, at, total = len(best), at[best], total[best]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, query)), pa.array(np.full(n, query_ids[i])), pa.array(ids[at]), pa.array(candidates[at]), pa.array(total)],
                        ["query", "query_id", "vec_id", "row", "score"],
                    )

    return run


def _cutoffs(gathered: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query, lows (of its lists), bound: what at least k rows score beyond the lows.

    The rows gathered for a query, at most k for each list, are scored exactly; the k-th best of them is a bound
    that nothing better can miss. A query that has seen fewer rows keeps all (bound 0).
    """
    lows = gathered.groupBy("query", "list").agg(F.min("low").alias("low"))
    lows = lows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("list", "low"))).alias("lows"))
    best = Window.partitionBy("query", "list").orderBy(F.desc("local"), "row")
    seen = gathered.filter("row is not null").withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k)
    left, right = rows.select(F.col("row").alias("query"), F.col("v").alias("q")), rows.select("row", "v")
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)
    exact = seen.select("query", "row").distinct().join(left, "query").join(right, "row").select("query", "row", product.alias("score"))
    cuts = lows.join(_kth(exact, k), "query", "left")
    total = F.aggregate("lows", F.lit(0).cast("long"), lambda s, x: s + x["low"])
    return cuts.select("query", F.col("lows.low").alias("lows"), F.coalesce(F.col("bound") - total, F.lit(0)).alias("bound"))


def exact_top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256
) -> DataFrame:
    """The k best other rows of each row whose id is divisible by ``every``, by integer inner product.

    Components x become floor(scale * x). Returns query_id, rank (from 1), vec_id and score; ties go to
    the smaller id. Fewer other rows give fewer results. Rows that have no id or vector, or a null or
    non-finite component, take no part; vectors of different length do not meet. Rows that share an id
    are rows of their own: each is ranked, and asks if its id does. Sums must stay below 2**53. An empty
    table gives an empty result; other columns are not read.

    A block holds all lists of its rows, so an entry that reaches the cutoff is resolved where it is, and of each
    block and query k rows at most are sent on.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = quantized(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v"))
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()))
    lists = scratch.keep(_pack(rows, BLOCK_ROWS, "c"))
    queries = scratch.keep(_pack(rows.filter(F.col("vec_id") % every == 0), QUERY_ROWS, "q"))
    asking = queries.join(lists.select("dim", "c_block"), "dim")

    met = lists.drop("c_blocks").join(asking, ["dim", "c_block"])
    gathered = scratch.keep(met.mapInArrow(_gather(k), "query long, list int, low long, row long, local long"))
    owners = rows.filter(F.col("vec_id") % every == 0).join(queries.groupBy("dim").agg(F.max("q_blocks").alias("n")), "dim")
    owners = owners.select(F.col("row").alias("query"), "dim", F.pmod(F.xxhash64("row"), "n").cast("int").alias("q_block"))
    cuts = owners.join(_cutoffs(gathered, rows, k), "query").groupBy("dim", "q_block").agg(F.collect_list(F.struct("query", "lows", "bound")).alias("cuts"))
    met = lists.drop("c_blocks").join(asking.join(scratch.keep(cuts), ["dim", "q_block"]), ["dim", "c_block"])
    scored = met.mapInArrow(_resolve(k), "query long, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """query, bound: the k-th largest score of each query that has so many."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    return scores.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k).groupBy("query").agg(
        F.max("at").alias("n"), F.min("score").alias("bound")
    ).filter(F.col("n") == k).drop("n")
