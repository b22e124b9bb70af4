"""Query op7: every document without the passages of 50 words or more that stand earlier in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.llm import line_dedup


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text")


#: Runs are compared as lists of whole lines, every start with every earlier one of equal content.
SQL = r"""
WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
     l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS raw FROM t),
     n AS (SELECT doc_id, i, trim(raw, ' ') AS line, len(regexp_extract_all(raw, '[^ \t\n\x0b\f\r]+')) AS w
           FROM l WHERE regexp_matches(raw, '[^ \t\n\x0b\f\r]')),
     c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM n),
     s AS (SELECT *, e - w AS s FROM c),
     f AS (SELECT doc_id, i, list(line) OVER fw AS fl, sum(w) OVER fw AS fs, max(i) OVER fw AS fi,
                  list(line) OVER bw AS bl, sum(w) OVER bw AS bs, min(i) OVER bw AS bi
           FROM s WINDOW fw AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
                         bw AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
     r AS (SELECT doc_id, i AS a, fi AS b, 0 AS kind, fl AS run FROM f WHERE fs >= 50
           UNION ALL SELECT doc_id, bi, i, 1, bl FROM f WHERE bs >= 50),
     o AS (SELECT *, row_number() OVER (PARTITION BY kind, run ORDER BY doc_id, a) AS k FROM r),
     g AS (SELECT DISTINCT l.doc_id, l.i FROM o JOIN l ON l.doc_id = o.doc_id AND l.i BETWEEN o.a AND o.b WHERE k > 1),
     k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
                  coalesce(string_agg(raw, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
           FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT t.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, k.text AS text,
       sha256(coalesce(k.text, '')) AS text_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id
"""
