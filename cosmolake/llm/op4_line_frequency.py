"""Query op4: base counts of every document and the verdict of cross-document line frequency, with source as host."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cosmolake.llm import line_rules


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return line_rules.rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lost_lines", "n_lost_words", "kept")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
     w AS (SELECT *, regexp_extract_all(text, '[^ \t\n\x0b\f\r]+') AS ws,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS ls FROM d),
     p AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS five
           FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
     r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1),
     c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, range(0, 5) AS x(k) GROUP BY doc_id),
     l AS (SELECT doc_id, host, unnest(ls) AS line FROM w),
     n AS (SELECT doc_id, host, regexp_replace(lower(trim(line, ' ')), '[0-9]+', '0', 'g') AS line,
                  len(regexp_extract_all(line, '[^ \t\n\x0b\f\r]+')) AS words FROM l),
     h AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
     f AS (SELECT n.host, line FROM n JOIN h ON h.host = n.host GROUP BY n.host, line, h.docs
           HAVING count(DISTINCT doc_id) > greatest(10, 0.02 * h.docs)),
     o AS (SELECT doc_id, count(*) AS n_lost_lines, sum(words)::BIGINT AS n_lost_words
           FROM n JOIN f ON f.host = n.host AND f.line = n.line GROUP BY doc_id),
     b AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
                  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                  coalesce(n_lost_lines, 0) AS n_lost_lines, coalesce(n_lost_words, 0) AS n_lost_words
           FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN o ON o.doc_id = w.doc_id)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_lost_words <= 0.5 * n_words AS kept
FROM b
"""
