"""A corpus from raw documents to token ids: each stage works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import bytebpe, mixing, neardup, suffixes, toxicity
from jobtide.llm.scratch import Scratch

#: SQL cannot express the toxicity classifier.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled rows of what it is given."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest")  # whatever its columns are called
    kept = toxicity.score(docs.select("text", others), model).filter("predicted = 0")
    return kept.select("text", "rest.*").select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows that share an id are one group; one of them stays. Rows without id stay.
    """
    rows = neardup.near_duplicates(docs)
    gone = rows.filter("not kept").select("doc_id")
    kept = docs.join(gone.distinct(), "doc_id", "left_anti").select(docs.columns)
    twice = Scratch(spark).keep(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    several = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(several)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes that a smaller id has too are cut out; n_chars counts what is left.

    A character that lost some of its bytes goes as a whole.
    """
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("others")
    rows = suffixes.remove_repeated_passages(docs, carry=[others, F.col("text").isNull().alias("no_text")])  # each text goes along once
    own = {c: F.col("rest.others")[c] for c in docs.columns} | {"text": F.when(~F.col("rest.no_text"), F.col("kept_text"))}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length(own["text"])).otherwise(own["n_chars"]).cast("long")
    return rows.select([own[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of whole documents at calibrated probabilities."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the hash of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bytebpe.encode(docs, path, decoded="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("suffix_dedup", remove_repeated_passages),
    ("mix_sources", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and read back."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES[:-1]:
        rows = scratch.keep(stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
