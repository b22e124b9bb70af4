"""Query op10: the quality of every document from a linear-chain CRF over its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.llm import quality_crf

THRESHOLD = 0.7


def held_out(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string")) % 4 == 2


def model(docs: DataFrame, labels: DataFrame) -> quality_crf.Model:
    """Trained on labels outside the held-out quarter."""
    return quality_crf.train(docs, labels.select("doc_id", "quality").where(~held_out()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fitted = model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.score(docs, "text", fitted).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
