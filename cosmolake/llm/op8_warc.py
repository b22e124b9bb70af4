"""Query op8: pages written as monolithic WARC archives, normalised, and read back by index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cosmolake.llm import warc

LEAST_BYTES = 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.first_payloads(spark.read.parquet(f"{sf_dir}/pages.parquet"), LEAST_BYTES)
    return warc.read(warc.normalise(warc.write(rows))).drop("payload")


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
     f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
     h AS (SELECT p.page_id, p.url, octet_length(encode(p.html)) AS payload_bytes, first_id, sha1(p.html) AS hex
           FROM p JOIN f ON p.html = f.html),
     b AS (SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', hex[i + 1]) - 1) AS n FROM h),
     d AS (SELECT *, array_to_string(list_transform(range(32), lambda j: (
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[(
               (((n[(5*j)//4 + 1] << 8) | (coalesce(n[(5*j)//4 + 2], 0) << 4) | coalesce(n[(5*j)//4 + 3], 0)) >> (7 - (5*j) % 4)) & 31) + 1]), '') AS payload_digest FROM b)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
