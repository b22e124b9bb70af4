"""Query op9: ids and decoded bytes of every document, as digests."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.llm import bpe

FILE = "byte_bpe_multi_50k.tiktoken"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (null text: empty)."""
    path = public_tokenizers.path(FILE)
    x = bpe.encode_decode(docs.select("doc_id", "text"), "text", path, public_tokenizers.PATTERN)
    return x.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(bpe.ids_text("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
