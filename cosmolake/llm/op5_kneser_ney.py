"""Query op5: the language of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.llm import langid


def held_out(col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out()), "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), "text", model)
    return found.select("doc_id", held_out().alias("held_out"), F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score"), "lang_id.cross_entropy", "lang_id.rejected")
