"""Benchmark decontamination by canonical templates, with DataFrame functions only.

A text becomes tokens in which what a re-parameterised question changes is a
typed slot: numbers, units after a number, and names (a capitalised word after
a word that doesn't end a sentence). Case and punctuation go. Windows of
``width`` template tokens are hashed; a document's windows are hash-joined
with those of the benchmark; hits of one item at one offset make an alignment.
An alignment counts if it covers ``run`` tokens, or the whole item where that
is shorter, and if its slots are consistent: equal benchmark values stand for
equal values of the document and the other way round. So "3 boxes at 3 kg"
matches "7 boxes at 7 kg" and not "7 boxes at 9 kg".

A capitalised word that opens a sentence may be a name or not. Documents are
hashed with all such words as names and with none, the benchmark's windows
under every reading.

Every window of the benchmark counts, and coverage is that of all windows
found at an offset. Windows without an ordinary token are hashed by their own
words. An alignment needs ``plain`` ordinary tokens or equal words throughout;
so do items shorter than a window, which are matched whole. An item's exact
copy always matches, however short. The windows with ``plain`` ordinary tokens
in the plain reading also count by themselves, whatever the others say.
Null texts have no tokens. Rows with the same key and text share one result;
any number of documents may hold an item. Other columns stay, whatever their
names; a column named items is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosmolake.llm._shared import fresh, stored

WIDTH, RUN, PLAIN = 8, 13, 5
BROADCAST_ROWS = 500_000  #: Rows of benchmark windows or alignments that are broadcast; more are joined by a shuffle.

# Unit words and signs.
UNITS = "percent|kilograms?|kilometers?|kilometres?|centimeters?|centimetres?|millimeters?|meters?|metres?|grams?|liters?|litres?|pounds?|ounces?|miles?|inches|inch|feet|foot|yards?|hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|degrees?|kg|km|cm|mm|ml|mph|kph|lbs?|oz|ft|hrs?|mins?|secs?|usd|eur|g|m|l"
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
NAME = r"(?<=[^.!?:\s]\s)\p{Lu}[\p{L}'’-]*"
OPEN = r"\p{Lu}(?<![\p{L}\p{M}\p{N}'’-]\p{Lu})[\p{L}'’-]*"  #: A name wherever it stands, at the start of a sentence too.
NOISE = r"[^\p{L}\p{M}\p{N}\s\x01\x02]+"
BLANK = r"\s+"
SLOT = "\x01"


def template(text: Column) -> Column:
    """Template tokens: slots are ``\\x01n``, ``\\x01u`` and ``\\x01p``."""
    return _tokens(_marked(text))


def _marked(text: Column) -> Column:
    t = F.regexp_replace(text, NAME, SLOT + "p")
    t = F.regexp_replace(t, NUMBER, SLOT + "n")
    return F.regexp_replace(t, rf"(?i)(?<=\x01n)([\s-]?)(?:{UNITS})(?![\p{{L}}\p{{N}}\x01])", "$1" + SLOT + "u")


def _templated(df: DataFrame, text: str) -> DataFrame:
    """``df`` with template tokens ``_a``, and ``_b`` in which words that open a sentence are names too, instead of ``text``."""
    x = df.withColumn("_marked", _marked(F.col(text)))
    return x.withColumns({"_a": _tokens(F.col("_marked")), "_b": _tokens(F.regexp_replace("_marked", OPEN, SLOT + "p"))}).drop("_marked", text)


def values(text: Column, name: str = NAME) -> Column:
    """The same tokens with their own words after the slot's mark."""
    t = F.regexp_replace(text, rf"({name})", SLOT + "p$1")
    t = F.regexp_replace(t, rf"({NUMBER})", SLOT + "n$1" + "\x02")
    t = F.regexp_replace(t, rf"(?i)(?<=\x02)([\s-]?)({UNITS})(?![\p{{L}}\p{{N}}\x01])", "$1" + SLOT + "u$2")
    return _tokens(t)


def _tokens(t: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(t), NOISE, ""), BLANK), "")


def _word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def _hashes(hashed: Column, width: int) -> Column:
    """Window hashes of tokens that are hashed already."""
    n = F.size(hashed)
    w = F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(hashed, i, width)))
    return F.when(n >= width, w).otherwise(F.array().cast("array<bigint>"))


def _ordinary(tokens: Column) -> Column:
    return F.size(F.filter(tokens, lambda w: ~F.contains(w, F.lit(SLOT))))


def _readings(zipped: Column) -> Column:
    """All readings of a window in which each word that may be a name is one or not."""
    none = F.array(F.array().cast("array<string>"))
    put = lambda some, w: F.transform(some, lambda x: F.concat(x, F.array(w)))
    return F.aggregate(zipped, none, lambda some, t: F.when(t["a"] == t["b"], put(some, t["a"])).otherwise(F.concat(put(some, t["a"]), put(some, t["b"]))))


def benchmark_windows(items: DataFrame, item: str, text: str, width: int, plain: int) -> DataFrame:
    """(_item, _size, _width, _at, _w, _exact, _rich): hashed windows of the items, every one of them; a short item is one window."""
    x = items.where(F.col(text).isNotNull()).select(F.col(item).alias("_item"), F.col(text).alias("_text"), _tokens(F.col(text)).alias("_words"))
    x = _templated(x, "_text").where(F.size("_a") > 0)
    x = x.select("_item", F.size("_a").alias("_size"), F.arrays_zip(F.col("_a").alias("a"), F.col("_b").alias("b")).alias("_zipped"), "_words", F.least(F.size("_a"), F.lit(width)).alias("_width"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.col("_size") - F.col("_width"))).alias("_at"))
    cut = lambda c: F.slice(c, F.col("_at") + 1, F.col("_width"))
    x = x.select("_item", "_size", "_width", "_at", cut("_words").alias("_words"), F.posexplode(_readings(cut("_zipped"))).alias("_k", "_slice"))
    x = x.withColumn("_n", _ordinary(F.col("_slice"))).withColumn("_exact", F.col("_n") < F.when(F.col("_width") < width, F.lit(plain)).otherwise(F.lit(1)))
    w = F.xxhash64(_word_hashes(F.when(F.col("_exact"), F.col("_words")).otherwise(F.col("_slice"))))
    return x.select("_item", "_size", "_width", "_at", w.alias("_w"), "_exact", ((F.col("_k") == 0) & (F.col("_n") >= plain)).alias("_rich"))


def _sized(df: DataFrame, most: int) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def alignments(docs: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, width: int, run: int, plain: int) -> DataFrame:
    """(_d, _t, _item, _offset, _strict, _first, _len): alignments that cover enough of an item, slots not yet checked."""
    bench = stored(benchmark_windows(items, item, item_text, width, plain), "bench")
    lengths = {r["_width"]: r["_e"] for r in bench.groupBy("_width").agg(F.max("_exact").alias("_e")).collect()}  # no more than ``width`` of them
    kinds = ["_a", "_b"] + ["_words"] * any(lengths.values())
    x = docs.select(F.col(key).alias("_d"), F.col(text).alias("_text")).where(F.col("_text").isNotNull()).withColumn("_t", F.xxhash64("_text"))
    x = _templated(x.withColumn("_words", _tokens(F.col("_text"))), "_text")
    x = x.select("_d", "_t", F.size("_a").alias("_length"), *(_word_hashes(F.col(c)).alias(c) for c in kinds))
    if not lengths:
        none = {"_item": F.lit(None).cast("long"), "_offset": F.lit(0), "_strict": F.lit(True), "_first": F.lit(0), "_len": F.lit(0)}
        return stored(x.select("_d", "_t").withColumns(none).limit(0), "alignments")
    # One projection hashes the windows of all widths, width after width, those of one kind after those of another.
    windows = F.concat(*(_hashes(F.col(c), n) for n in sorted(lengths) for c in kinds[: 2 + lengths[n]]))
    hashed = x.select("_d", "_t", "_length", F.posexplode(windows).alias("_k", "_w"))
    each = lambda n: F.greatest(F.col("_length") - (n - 1), F.lit(0))
    start, begin, block = F.lit(0), F.lit(None).cast("int"), F.lit(None).cast("int")
    for n in sorted(lengths):
        begin, block = F.when(F.col("_width") == n, start).otherwise(begin), F.when(F.col("_width") == n, (2 + int(lengths[n])) * each(n)).otherwise(block)
        start = start + (2 + int(lengths[n])) * each(n)
    hits = hashed.join(_sized(bench, BROADCAST_ROWS), "_w").withColumn("_k", F.col("_k") - begin).where((F.col("_k") >= 0) & (F.col("_k") < block))
    hits = hits.withColumns({"_pos": F.col("_k") % each(F.col("_width")), "_plain": F.col("_k") < each(F.col("_width"))})
    at = lambda only: F.array_sort(F.collect_set(F.when(only, F.col("_at"))))
    part = hits.groupBy("_d", "_t", "_item", "_size", "_width", (F.col("_pos") - F.col("_at")).alias("_offset")).agg(
        at(F.lit(True)).alias("_all"), at(F.col("_rich") & F.col("_plain")).alias("_own")
    )
    n, need = F.col("_width"), F.least(F.lit(run), F.col("_size"))
    covered = F.aggregate(F.sequence(F.lit(2), F.greatest(F.size("_all"), F.lit(2))), n, lambda c, i: c + F.least(F.coalesce(F.get("_all", i - 1) - F.get("_all", i - 2), F.lit(0)), n))
    span = lambda c, strict, enough: F.when(enough, F.struct(F.lit(strict).alias("_strict"), F.get(c, F.lit(0)).alias("_first"), (F.array_max(c) - F.get(c, F.lit(0)) + n).alias("_len")))
    spans = F.array_compact(F.array(span("_own", True, F.size("_own") + (n - 1) >= need), span("_all", False, covered >= need)))
    found = part.where((F.size("_own") > 0) | (covered >= need)).select("_d", "_t", "_item", "_offset", F.inline(spans))
    return stored(found, "alignments")


def _consistent(pairs: Column) -> Column:
    return (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["q"])))) & (F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["d"]))))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, run: int = RUN, plain: int = PLAIN) -> DataFrame:
    """(_d, _t, _item): documents that hold a benchmark item, with consistent slots."""
    found = alignments(docs, items, key, text, item, item_text, width, run, plain)
    q = F.col(item_text)
    asked = items.select(F.col(item).alias("_item"), values(q).alias("_asked"), values(q, OPEN).alias("_open"), _tokens(q).alias("_item_words"))
    told = docs.select(F.col(key).alias("_kd"), F.xxhash64(text).alias("_kt"), F.col(text).alias("_text")).where("_text is not null")
    x = told.join(_sized(found, BROADCAST_ROWS), F.col("_kd").eqNullSafe(F.col("_d")) & (F.col("_kt") == F.col("_t")))
    here = lambda c: F.slice(c, F.col("_first") + F.col("_offset") + 1, F.col("_len"))
    x = x.withColumns({"_told": F.when(F.col("_strict"), here(values(F.col("_text")))), "_words": here(_tokens(F.col("_text")))}).drop("_text", "_kd", "_kt")
    x = x.join(asked, "_item").withColumns({c: F.slice(c, F.col("_first") + 1, F.col("_len")) for c in ("_asked", "_open", "_item_words")})
    slots = lambda q, d: F.array_distinct(F.filter(F.arrays_zip(F.col(q).alias("q"), F.col(d).alias("d")), lambda p: F.contains(p["q"], F.lit(SLOT))))
    typed = F.transform(slots("_open", "_words"), lambda p: F.struct(p["q"].alias("q"), F.concat(F.substring(p["q"], 1, 2), p["d"]).alias("d")))
    x = x.withColumn("_slots", F.when(F.col("_strict"), slots("_asked", "_told")).otherwise(typed))
    enough = F.col("_strict") | (_ordinary(F.col("_open")) >= plain) | (F.col("_item_words") == F.col("_words"))
    return x.where(enough & _consistent(F.col("_slots"))).select("_d", "_t", "_item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, run: int = RUN, plain: int = PLAIN) -> DataFrame:
    """``docs`` with ``items`` (array of item ids, sorted, empty for a clean document)."""
    d, t, hit = fresh(docs, "d", "t", "items")
    held = matches(docs, items, key, text, item, item_text, width, run, plain).groupBy("_d", "_t").agg(F.sort_array(F.collect_set("_item")).alias(hit))
    held = _sized(stored(held.withColumnsRenamed({"_d": d, "_t": t}), "held"), BROADCAST_ROWS)
    x = docs.join(held, F.col(key).eqNullSafe(F.col(d)) & (F.xxhash64(text) == F.col(t)), "left")
    return x.withColumn("items", F.coalesce(hit, F.array().cast("array<bigint>"))).drop(d, t, hit)
