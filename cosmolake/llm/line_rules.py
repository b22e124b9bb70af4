"""Quality rules with cross-document line frequency, by DataFrame functions only.

Base counts describe a text alone. The method looks across documents: lines
are normalised (outer blanks off, lower case, runs of digits folded to 0),
hashed, and the distinct documents of a host that hold a line are counted.
Lines over the limit, the larger of ``min_docs`` and ``share`` of the host's
documents, are removed, and a document that loses more than ``depleted`` of
its words to that is rejected.

Null texts count as empty; a null host is a host of its own. A document is a
distinct doc_id of a host: rows that repeat it count once, and those without a
doc_id are told apart by their texts. Base counts are exact for texts of any
length. Other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosmolake.llm._shared import fresh, stored

BLANKS = "[ \\t-\\r]+"
MIN_DOCS, SHARE, DEPLETED = 10, 0.02, 0.5
BROADCAST_ROWS = 200_000  #: Hosts and lines over the limit are broadcast up to so many, joined by a shuffle beyond.


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, rows, wins, marked, starts = fresh(docs, "words", "lines", "wins", "tagged", "starts")
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    x = docs.withColumns({words: word_array(t), rows: lines})
    n = F.size(words)
    five = F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))
    x = x.withColumn(wins, F.when(n >= 5, five).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct(wins)) < F.size(wins)
    tagged = F.sort_array(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    x = x.withColumn(marked, F.when(twice, tagged))
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    before = F.concat(F.array(none), F.col(marked))
    after = F.concat(F.slice(marked, 2, F.greatest(F.size(marked), F.lit(1))), F.array(none))
    mark = F.arrays_zip(F.col(marked).alias("x"), F.slice(before, 1, F.size(marked)).alias("b"), after.alias("a"))
    same = F.filter(mark, lambda m: (m["x"]["h"] == m["b"]["h"]) | (m["x"]["h"] == m["a"]["h"]))
    x = x.withColumn(starts, F.when(F.col(marked).isNotNull(), F.sort_array(F.transform(same, lambda m: m["x"]["i"]))))
    gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    covered = F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)
    return x.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(rows) - F.size(F.array_distinct(rows))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop(words, rows, wins, marked, starts)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def normal(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(line)), "[0-9]+", "0")


def _sized(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small; else a join of its exchange, whose large partitions can be split."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _lines(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(_d, _t, _host, _i, _h, _n): lines with a word."""
    x = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_d"), F.xxhash64(text).alias("_t"), F.coalesce(F.col(host), F.lit("")).alias("_host"), F.posexplode(F.split(F.col(text), "\n")).alias("_i", "_line"))
    x = x.where(F.col("_line").rlike("[^ \\t-\\r]"))
    return x.select("_d", "_t", "_host", "_i", F.xxhash64(normal(F.col("_line"))).alias("_h"), F.size(word_array(F.col("_line"))).alias("_n"))


def frequent_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(_host, _h, _docs): normalised lines over the host's limit."""
    ident = F.xxhash64(F.coalesce(F.concat(F.lit("d"), F.col(key).cast("string")), F.concat(F.lit("t"), F.coalesce(F.col(text), F.lit("")))))
    x = docs.select(ident.alias("_doc"), F.coalesce(F.col(host), F.lit("")).alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # Rows of one doc_id come down to one before anything is counted; only those ids that repeat take part.
    twice = _sized(stored(x.groupBy("_host", "_doc").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"), "twice"))
    per_host = x.groupBy("_host").agg(F.count(F.lit(1)).alias("_all"))
    more = twice.groupBy("_host").agg(F.sum(F.col("_rows") - 1).alias("_more"))
    per_host = _sized(stored(per_host.join(more, "_host", "left").select("_host", (F.col("_all") - F.coalesce("_more", F.lit(0))).alias("_all")), "hosts"))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda line: line.rlike("[^ \\t-\\r]"))
    hashes = F.array_distinct(F.transform(lines, lambda line: F.xxhash64(normal(line))))
    again = twice.select(F.col("_host").alias("_th"), F.col("_doc").alias("_td"))
    marked = x.join(again, (F.col("_host") == F.col("_th")) & (F.col("_doc") == F.col("_td")), "left")
    seen = marked.select("_host", "_td", F.explode(hashes).alias("_h"))
    once = seen.where("_td is null").groupBy("_host", "_h").agg(F.count(F.lit(1)).alias("_c"))
    rest = seen.where("_td is not null").distinct().groupBy("_host", "_h").agg(F.count(F.lit(1)).alias("_c"))
    counts = once.union(rest).groupBy("_host", "_h").agg(F.sum("_c").alias("_docs")).where(F.col("_docs") > min_docs)
    return counts.join(per_host, "_host").where(F.col("_docs") > F.greatest(F.lit(float(min_docs)), share * F.col("_all"))).select("_host", "_h", "_docs")


def lost_words(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """(_d, _t, n_lost_words, n_lost_lines) of documents that hold a line over the limit."""
    over = _sized(stored(frequent_lines(docs, key, text, host, min_docs, share), "lines").drop("_docs"))
    hit = _lines(docs, key, text, host).join(over, ["_host", "_h"], "left_semi")
    return hit.groupBy("_d", "_t", "_i").agg(F.first("_n").alias("_n")).groupBy("_d", "_t").agg(F.sum("_n").alias("n_lost_words"), F.count(F.lit(1)).alias("n_lost_lines"))


def rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """Base counts of every row, the words and lines that it loses, ``base_failed`` and ``kept``."""
    lost = lost_words(docs, key, text, host, min_docs, share).withColumnsRenamed({"_d": "_ld", "_t": "_lt"})
    base = base_counts(docs.select(F.col(key), F.col(text), F.xxhash64(text).alias("_t")), text).drop(text)
    x = base.join(lost, F.col(key).eqNullSafe(F.col("_ld")) & (F.col("_t") == F.col("_lt")), "left").drop("_ld", "_lt", "_t")
    x = x.fillna(0, ["n_lost_words", "n_lost_lines"]).withColumn("base_failed", base_failed())
    return x.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= depleted * F.col("n_words")))


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """``docs`` with ``text`` less the lines over its host's limit."""
    d, t, lost = fresh(docs, "d", "t", "gone")
    over = _sized(stored(frequent_lines(docs, key, text, host, min_docs, share), "lines").drop("_docs"))
    gone = _lines(docs, key, text, host).join(over, ["_host", "_h"], "left_semi").groupBy("_d", "_t").agg(F.collect_set("_i").alias(lost)).withColumnsRenamed({"_d": d, "_t": t})
    x = docs.join(gone, F.col(key).eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left")
    lines = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    new = F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return x.withColumn(text, new).drop(d, t, lost)
