"""Blocks of documents that ask shards of a key space.

Some operators must know, for every key of a document (a window, a piece of text), what other
documents hold. Blocks of a few megabytes of whole documents put each of their keys once, packed,
into a request to the shard that owns the key's hash range; the shard answers all blocks; each block
meets its answers again. A key that a third of all documents hold costs one entry for each block, a
shard owns an even range of hashes, and the texts are shuffled once: every pass over the blocks reuses
the same exchange. Blocks depend on row content only, so a recomputed task agrees with the lost one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a block: at least, and at most (a longer document is a block by itself).
SMALL_BLOCK, LARGE_BLOCK = 4 << 20, 32 << 20
#: Blocks grow with the input until one holds this many bytes for each shard it asks.
ROW_BYTES = 1 << 10


@dataclass(frozen=True)
class Blocks:
    """``rows``: block, doc_id, text, placed by block. ``n`` blocks ask as many shards."""

    rows: DataFrame
    n: int
    text_bytes: int

    @property
    def grouped(self):
        return self.rows.groupBy("block")


def into_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, carry: Sequence[str | Column] = ()
) -> Blocks:
    """Deal documents to blocks by a hash of id and text. Of other columns only ``carry`` is read, into a struct ``rest``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    total = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    size = block_bytes or min(LARGE_BLOCK, max(SMALL_BLOCK, int(math.sqrt(total * ROW_BYTES))))
    n = max(1, -(-total // size))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return Blocks(rows.withColumn("block", block).repartition("block"), n, total)
