"""The corpus pipeline: quality, line dedup, near dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it
returns is written as Parquet and read again as the next stage's docs. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.llm import bpe, decontaminate, line_dedup, near_dup, op9_byte_bpe, op10_line_crf, quality_crf
from cosmolake.llm._shared import bounded, stored
from cosmolake.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model scores at the threshold or above; trained on ``labels`` outside the held-out quarter."""
    ship(spark)
    bounded(spark)
    every = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = op10_line_crf.model(every, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.score(docs, "text", model).where(F.col("score") >= op10_line_crf.THRESHOLD).select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; a document of which no word is left goes. ``n_chars`` follows the text."""
    x = line_dedup.dedup(docs)
    x = x.where((F.col("n_removed") == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    return x.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    ship(spark)
    bounded(spark)
    return near_dup.kept_docs(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    x = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return x.where(F.size("items") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and digests of the ids and of the bytes that they decode to."""
    ship(spark)
    bounded(spark)
    path = public_tokenizers.path(op9_byte_bpe.FILE)
    x = bpe.encode_decode(docs.select("doc_id", "text"), "text", path, public_tokenizers.PATTERN)
    return x.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "ids",
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The quality stage is a trained model, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
