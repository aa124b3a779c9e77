"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_rows: int, max_bytes: int, max_text: int, where: Column | None = None
) -> tuple[list[str], np.ndarray]:
    """Texts and labels (0 or 1) of about ``max_rows`` rows and ``max_bytes`` bytes at most.

    A hash of id and text picks them, so they do not depend on order or partitions; all rows are taken
    while they stay within 95 % of both bounds. Rows beyond ``max_text`` bytes, without label or without id are left
    out. Ids and sizes are joined first; texts are fetched for the picked rows only.
    """
    known = labels.select(F.col(id_col).alias("labelled"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").distinct()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    some = docs if where is None else docs.filter(where)
    rows = some.select(F.col(id_col).alias("labelled"), text.alias("text")).withColumn("pick", F.xxhash64("labelled", "text"))
    sizes = rows.select("labelled", "pick", F.octet_length("text").alias("size")).filter(F.col("size") <= max_text).join(known, "labelled")
    n, total = sizes.agg(F.count("*"), F.sum("size")).first()
    part = min(1.0, 0.95 * max_rows / max(1, n), 0.95 * max_bytes / max(1, total or 0))
    chosen = sizes.filter(F.pmod("pick", F.lit(_RANGE)) < F.lit(int(part * _RANGE))).select("labelled", "pick", "label").distinct()
    sample = rows.join(F.broadcast(chosen), ["labelled", "pick"]).select("labelled", "text", "label").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["labelled"], r["text"], r["label"]))
    return [r["text"] for r in sample], np.array([r["label"] for r in sample], int)
