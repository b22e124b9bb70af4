"""Removing passages that repeat across a corpus, by winnowing over line hashes.

A text is its lines that have a word (``[^\\x20\\x09-\\x0D]+``); outer blanks
of a line don't count. A passage is a run of lines of at least ``min_words``
words. For each line the shortest run of that size that starts there is a
window, and its smallest line hash (the last one on ties) a fingerprint:
two occurrences of a passage share every window inside it, so they share a
fingerprint for certain. Fingerprints that stand at one position only are
dropped; positions of the others are joined by fingerprint, and a match is
extended from its position both ways, line by line to the window's start and
to its end: the lines on either side have to be the same. Besides the windows
that start at a line there are the shortest runs that end at one: together
they cover every maximal run of that size, whichever earlier place it came
from, with no pairs of positions. Of equal runs the first in the order
(doc_id, text hash, line) stays, the lines of later ones go.

Only DataFrame functions. Rows with the same doc_id and text are one document
and keep one result each. Null texts stay null, empty ones empty; a null
doc_id is a value that sorts first. Other columns stay as they are, whatever
their names; a column of ``docs`` named n_lines or n_removed is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cosmolake.llm._shared import fresh, stored

MIN_WORDS = 50


def n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, "[ \\t-\\r]+"), ""))


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_d, _t, _i, _n, _h, _g): lines with a word of each document, numbered as in the text, with two hashes."""
    x = docs.select(F.col(key).alias("_d"), F.xxhash64(text).alias("_t"), F.posexplode(F.split(F.col(text), "\n")).alias("_i", "_line"))
    x = x.where(F.col("_line").rlike("[^ \\t-\\r]")).withColumn("_line", F.trim("_line"))
    return x.select("_d", "_t", "_i", n_words(F.col("_line")).alias("_n"), F.xxhash64("_line").alias("_h"), F.xxhash64(F.lit(7), "_line").alias("_g"))


def windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(_d, _t, _kind, _from, _to, _fp, _at, _l, _r): shortest runs of ``min_words`` that start (kind 0) or end (kind 1) at a line, with their fingerprint, where it stands, and the lines to its left and right."""
    doc = W.partitionBy("_d", "_t")
    order = doc.orderBy("_i")
    x = lines.withColumn("_same", F.lag("_i").over(order)).where("_same is null or _same <> _i").drop("_same")
    x = x.withColumn("_e", F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("_s", F.col("_e") - F.col("_n"))
    ahead, behind = doc.orderBy("_s").rangeBetween(0, min_words - 1), doc.orderBy("_e").rangeBetween(1 - min_words, 0)
    low = F.min(F.struct("_h", (-F.col("_i")).alias("_i")))
    for name, frame in (("f", ahead), ("b", behind)):
        x = x.withColumns({
            f"_{name}h": F.collect_list("_h").over(frame),
            f"_{name}g": F.collect_list("_g").over(frame),
            f"_{name}w": F.sum("_n").over(frame),
            f"_{name}p": low.over(frame),
            f"_{name}i": (F.max if name == "f" else F.min)("_i").over(frame),
        })

    def run(name: str, kind: int, first: str, last: str) -> Column:
        h, g, n = F.col(f"_{name}h"), F.col(f"_{name}g"), F.size(f"_{name}h")
        at = (n - F.array_position(F.reverse(h), F.col(f"_{name}p._h")) + 1).cast("int")  # the last of the smallest, as in its position
        left, right = (F.xxhash64(F.slice(h, *part), F.slice(g, *part)) for part in ((F.lit(1), at), (at, n - at + 1)))
        return F.struct(F.lit(kind).alias("_kind"), F.col(first).alias("_from"), F.col(last).alias("_to"), F.col(f"_{name}p._h").alias("_fp"), (-F.col(f"_{name}p._i")).alias("_at"), left.alias("_l"), right.alias("_r"))

    forward, backward = run("f", 0, "_i", "_fi"), run("b", 1, "_bi", "_i")
    # A run that is shortest both ways is a forward window already.
    both = F.array_compact(F.array(F.when(F.col("_fw") >= min_words, forward), F.when(F.col("_bw") - F.col("_n") >= min_words, backward)))
    return x.select("_d", "_t", F.inline(both))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_d, _t, _gone): numbers of the lines to delete, sorted, for each document that has some."""
    found = windows(line_rows(docs, key, text), min_words)
    place = F.struct("_d", "_t", "_at")
    twice = found.groupBy("_fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("_fp")
    candidates = stored(found.join(stored(twice, "fingerprints"), "_fp", "left_semi").select("_d", "_t", "_kind", "_from", "_to", "_fp", "_l", "_r"), "windows")
    start = F.struct("_d", "_t", "_from")
    first = (
        candidates.groupBy("_kind", "_fp", "_l", "_r").agg(F.min(start).alias("_first"), F.count(F.lit(1)).alias("_c"))
        .where("_c > 1").drop("_c")
    )
    later = candidates.join(stored(first, "runs"), ["_kind", "_fp", "_l", "_r"]).where(start > F.col("_first")).select("_d", "_t", "_from", "_to")
    order = W.partitionBy("_d", "_t").orderBy("_from", "_to").rowsBetween(W.unboundedPreceding, -1)
    new = F.greatest(F.col("_from"), F.coalesce(F.max("_to").over(order) + 1, F.lit(0)))
    cover = later.withColumn("_new", new).where("_new <= _to").select("_d", "_t", F.sequence("_new", "_to").alias("_r"))
    return cover.groupBy("_d", "_t").agg(F.sort_array(F.flatten(F.collect_list("_r"))).alias("_gone"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text`` less its later repeated runs, and ``n_lines``, ``n_removed`` (long)."""
    d, t, lost, new = fresh(docs, "gd", "gt", "gone", "left")
    gone = repeated_lines(docs, key, text, min_words).withColumnsRenamed({"_d": d, "_t": t, "_gone": lost})
    x = docs.join(gone, F.col(key).eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left")
    lines = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    kept = F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    return x.withColumns({
        "n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": F.coalesce(F.size(lost), F.lit(0)).cast("long"),
        new: F.when(F.col(lost).isNull(), F.col(text)).otherwise(kept),
    }).drop(text, d, t, lost).withColumnRenamed(new, text)
