"""Query op6: which benchmark items each document holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.llm import decontaminate


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    x = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return x.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), ",").alias("item_ids"))


#: Templates token by token; an alignment is a set of equal windows at one offset.
_UNITS = decontaminate.UNITS
SQL = rf"""
WITH src AS (SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
             UNION ALL SELECT 'b', item_id, text FROM benchmark WHERE text IS NOT NULL),
     raw AS (SELECT side, id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM src),
     nam AS (SELECT side, id, list_transform(w, lambda x, i: CASE
               WHEN i > 1 AND NOT regexp_matches(w[i - 1], '[.!?:]$') THEN regexp_replace(x, '^(\p{{Lu}}[\p{{L}}''’-]*)', chr(1) || 'p')
               ELSE x END) AS t,
               list_transform(w, lambda x, i: CASE
               WHEN i > 1 AND NOT regexp_matches(w[i - 1], '[.!?:]$') THEN regexp_replace(x, '^(\p{{Lu}}[\p{{L}}''’-]*)', chr(1) || 'p\1')
               ELSE x END) AS v FROM raw),
     num AS (SELECT side, id, regexp_replace(array_to_string(t, ' '), '[0-9]+([.,:/][0-9]+)*', chr(1) || 'n', 'g') AS t,
                    regexp_replace(array_to_string(v, ' '), '([0-9]+([.,:/][0-9]+)*)', chr(1) || 'n\1' || chr(2), 'g') AS v FROM nam),
     uni AS (SELECT side, id, regexp_replace(t, '(?i)(\x01n)([\s-]?)({_UNITS})($|[^\p{{L}}\p{{N}}\x01])', '\1\2' || chr(1) || 'u\4', 'g') AS t,
                    regexp_replace(v, '(?i)(\x02)([\s-]?)({_UNITS})($|[^\p{{L}}\p{{N}}\x01])', '\1\2' || chr(1) || 'u\3\4', 'g') AS v FROM num),
     tok AS (SELECT side, id, list_filter(regexp_split_to_array(regexp_replace(lower(t), '[^\p{{L}}\p{{M}}\p{{N}}\s\x01\x02]+', '', 'g'), '\s+'), lambda x: x <> '') AS t,
                    list_filter(regexp_split_to_array(regexp_replace(lower(v), '[^\p{{L}}\p{{M}}\p{{N}}\s\x01\x02]+', '', 'g'), '\s+'), lambda x: x <> '') AS v FROM uni),
     win AS (SELECT side, id, v, len(t) AS n, unnest(range(len(t) - 7)) AS p0, t FROM tok WHERE len(t) >= 8),
     key AS (SELECT side, id, n, p0, t[p0 + 1:p0 + 8] AS k FROM win),
     ali AS (SELECT d.id AS doc_id, b.id AS item_id, d.p0 - b.p0 AS off, min(b.p0) AS first, max(b.p0) - min(b.p0) + 8 AS size
             FROM key d JOIN key b ON d.side = 'd' AND b.side = 'b' AND d.k = b.k
             WHERE len(list_filter(b.k, lambda x: NOT contains(x, chr(1)))) >= 5
             GROUP BY d.id, b.id, b.n, d.p0 - b.p0 HAVING count(DISTINCT b.p0) + 7 >= least(13, b.n)),
     slo AS (SELECT doc_id, item_id, off, unnest(range(first, first + size)) AS i FROM ali),
     val AS (SELECT s.doc_id, s.item_id, s.off, q.v[i + 1] AS q, d.v[i + off + 1] AS d
             FROM slo s JOIN tok q ON q.side = 'b' AND q.id = s.item_id JOIN tok d ON d.side = 'd' AND d.id = s.doc_id),
     con AS (SELECT doc_id, item_id FROM val GROUP BY doc_id, item_id, off
             HAVING count(DISTINCT q || chr(3) || d) FILTER (WHERE contains(q, chr(1))) = count(DISTINCT q) FILTER (WHERE contains(q, chr(1)))
                AND count(DISTINCT q || chr(3) || d) FILTER (WHERE contains(q, chr(1))) = count(DISTINCT d) FILTER (WHERE contains(q, chr(1)))),
     agg AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, 
                    array_to_string(list_sort(list(DISTINCT item_id)), ',') AS item_ids FROM con GROUP BY doc_id)
SELECT d.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids
FROM documents d LEFT JOIN agg USING (doc_id)
"""
