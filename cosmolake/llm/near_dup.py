"""Near-duplicate groups by MinHash bands and odd sketches, with exact links.

Texts are sets of distinct 5-word shingles. Equal sets collapse to their
smallest doc_id first. MinHash samples are cut into bands; sets that share a
band are candidates, and the samples, folded into a parity bitmap (an odd
sketch), estimate by the population count of an XOR whether a candidate is
worth reading. Links are confirmed on the full sets.

No bucket is expanded into pairs. Each bucket has one leader, the member whose
buckets are the fullest (the one most like all others); every member is
compared with it, which connects a group of copies through its centre. What
that may miss are links between members of different components, and those
are found exactly. Buckets whose members are one component are done. The
shingles of all other members are counted and put in one order, rarest first;
a link's rarest common shingle lies in both members' prefixes (as many
shingles as a partner may lack, and one). Copies of one text differ from its
other copies by rare shingles, so few of a large group meet at one.

Components are smallest reachable doc_ids, from rounds of minimum labels.

Null and empty texts, and texts of blanks, are empty sets: linked with
nothing, a component each. Equal rows fall together. Rows with the same doc_id
and different texts are one node that has the links of both. A row without a
doc_id has no component of its own; it is not kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosmolake.llm import shingles
from cosmolake.llm._shared import components, fresh, releasing, stored

PERCENT = 80
BROADCAST_ROWS = 400_000  #: Node lists are broadcast up to so many rows, joined by a shuffle beyond.
PROFILE = "doc_id long, n_shingles long, a long, b long, bands array<long>, s0 long, s1 long, s2 long, s3 long"


def profiles(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, a, b, bands, s0..s3): each row's set size, identity, band keys and odd sketch."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with releasing():
            for batch in batches:
                n, ident, keys, marks = [], [], [], []
                for s in shingles.sets(batch.column(1)):
                    n.append(len(s))
                    ident.append(shingles.identity(s))
                    if len(s):
                        sig = shingles.samples(s)
                        keys.append(shingles.bands(sig).view(np.int64))
                        marks.append(shingles.odd_sketch(sig).view(np.int64))
                    else:
                        keys.append(np.zeros(0, np.int64))
                        marks.append(np.zeros(4, np.int64))
                off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                mark = np.array(marks, np.int64).reshape(-1, 4)
                flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
                cols = [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), *(pa.array([i[k] for i in ident], pa.int64()) for k in (0, 1)), pa.ListArray.from_arrays(off, flat), *(pa.array(mark[:, k]) for k in range(4))]
                yield pa.record_batch(cols, ["doc_id", "n_shingles", "a", "b", "bands", "s0", "s1", "s2", "s3"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, PROFILE)


def shingle_sets(docs: DataFrame, key: str, text: str, nodes: DataFrame) -> DataFrame:
    """(node, size, set, shingles): the sets of the rows whose doc_id is in ``nodes``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with releasing():
            for batch in batches:
                found = list(shingles.sets(batch.column(1)))
                off = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                flat = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(off, flat)], ["node", "shingles"])

    rows = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).join(sized(nodes), "node", "left_semi")
    sets = rows.mapInArrow(task, "node long, shingles array<long>").where(F.size("shingles") > 0)
    return sets.withColumn("size", F.size("shingles")).withColumn("set", F.xxhash64("shingles"))


def sized(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def least_odd(percent: int) -> int:
    """The largest population count of two sketches' XOR that a link may show: 4.5 standard deviations of the samples and 3 of the bits beyond its mean."""
    k, n, j = shingles.SAMPLES, shingles.SKETCH_BITS, percent / 100
    apart = k * (1 - j) + 4.5 * math.sqrt(k * j * (1 - j))
    odd = n / 2 * (1 - (1 - 2 / n) ** (2 * apart))
    return math.ceil(odd + 3 * math.sqrt(odd))


def sketch_distance(x: str, y: str) -> Column:
    total = F.lit(0)
    for k in range(4):
        total = total + F.bit_count(F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}")))
    return total


def linked(common: Column, x: Column, y: Column, percent: int) -> Column:
    return 100 * common >= percent * (x + y - common)


def stars(reps: DataFrame) -> DataFrame:
    """(leader, node): every member of a bucket of two or more with its leader, each pair once."""
    rows = reps.select("node", F.explode("bands").alias("bucket"))
    full = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "buckets")
    member = stored(rows.join(full, "bucket"), "members")
    weight = member.groupBy("node").agg(F.sum("c").alias("w"))
    leader = member.join(stored(weight, "weights"), "node").groupBy("bucket").agg(F.max(F.struct("w", (-F.col("node")).alias("m"))).alias("top"))
    leader = stored(leader.select("bucket", (-F.col("top.m")).alias("leader")), "leaders")
    return member.join(leader, "bucket").where("node <> leader").select("leader", "node").distinct()


def prefix(size: Column, percent: int) -> Column:
    return size - F.ceil(percent * size / 100) + 1


def confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs (x, y) that the sketches let through and the full sets confirm."""
    sketch = reps.select("node", "s0", "s1", "s2", "s3")
    one, two = (sketch.select(F.col("node").alias(p), *(F.col(f"s{k}").alias(f"{p}s{k}") for k in range(4))) for p in "xy")
    likely = pairs.join(one, "x").join(two, "y").where(sketch_distance("x", "y") <= least_odd(percent)).select("x", "y")
    left = sets.select(F.col("node").alias("x"), F.col("shingles").alias("xs"))
    right = sets.select(F.col("node").alias("y"), F.col("shingles").alias("ys"))
    both = likely.join(right, "y").join(left, "x")
    return both.where(linked(F.size(F.array_intersect("xs", "ys")), F.size("xs"), F.size("ys"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))


def undecided(star: DataFrame, label: DataFrame) -> DataFrame:
    """(node, root): leaders and members of buckets whose members are not all of one component yet."""
    own = label.select(F.col("node").alias("leader"), F.col("root").alias("home"))
    rooted = stored(star.join(label, "node", "left").select("leader", "node", F.coalesce("root", "node").alias("root")), "rooted")
    held = rooted.groupBy("leader").agg(F.min("root").alias("p"), F.max("root").alias("q")).join(own, "leader", "left")
    mixed = held.select("leader", F.coalesce("home", "leader").alias("home"), "p", "q").where("p <> q or p <> home").select("leader", "home")
    mixed = stored(mixed, "mixed")
    members = rooted.join(sized(mixed), "leader").select("node", "root")
    return members.union(mixed.select("leader", "home")).distinct()


def rare_first(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(t, node, root, size, rest): each node's prefix shingles that another component holds too, in the order rarest first.

    Shingles of one component only come first in that order and need no row.
    ``rest`` is how many of the node's shingles stand at or after this one.
    """
    token = sets.join(nodes, "node").select("node", "set", "root", "size", F.explode("shingles").alias("t"))
    held = token.groupBy("t").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count(F.lit(1)).alias("n")).where("p <> q")
    shared = token.join(stored(held.select("t", "n"), "held"), "t")
    mine = shared.groupBy("node", "set").agg(F.first("root").alias("root"), F.first("size").alias("size"), F.sort_array(F.collect_set(F.struct("n", "t"))).alias("ts"))
    mine = mine.withColumn("own", F.col("size") - F.size("ts"))
    mine = mine.withColumn("ts", F.slice("ts", F.lit(1), F.greatest(F.lit(0), prefix(F.col("size"), percent) - F.col("own")).cast("int")))
    return mine.select("node", "root", "size", "own", F.posexplode("ts").alias("k", "e")).select("e.t", "node", "root", "size", (F.col("size") - F.col("own") - F.col("k")).alias("rest"))


def reach(common: Column, x: Column, y: Column, percent: int) -> Column:
    """Whether sets of these sizes with at most ``common`` shingles in common can be linked."""
    return (100 + percent) * common >= percent * (x + y)


def more_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of different components that may still be linked.

    A link's rarest common shingle stands in both prefixes, and what stands
    from there on bounds the intersection. Rows that no other component of
    their shingle can reach go before any rows meet.
    """
    token = stored(rare_first(nodes, sets, percent), "tokens")
    for _ in range(2):
        group = token.groupBy("t").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.min("size").alias("least")).where("p <> q")
        able = token.join(sized(stored(group, "groups")), "t").where(reach(F.col("rest"), F.col("size"), F.greatest(F.col("least"), F.ceil(percent * F.col("size") / 100)), percent))
        token = stored(able.select(token.columns), "tokens")
    x, y = token.alias("x"), token.alias("y")
    enough = reach(F.least("x.rest", "y.rest"), F.col("x.size"), F.col("y.size"), percent)
    return x.join(y, "t").where((F.col("x.root") != F.col("y.root")) & (F.col("x.node") < F.col("y.node")) & enough).select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).distinct()


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, a, b, component_id) of every row."""
    every = stored(profiles(docs, key, text), "profiles")
    some = every.where("n_shingles > 0 and doc_id is not null")
    top = some.groupBy("a", "b").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "s0", "s1", "s2", "s3")).alias("r"))
    reps = stored(top.select("a", "b", F.col("r.doc_id").alias("node"), "r.bands", "r.s0", "r.s1", "r.s2", "r.s3"), "reps")
    star = stored(stars(reps), "stars")
    sets = stored(shingle_sets(docs, key, text, stored(star.select("node").union(star.select("leader")).distinct(), "nodes")), "sets")
    edge = stored(confirmed(star.select(F.col("leader").alias("x"), F.col("node").alias("y")), reps, sets, percent), "links")
    # Texts of one doc_id are one node.
    twice = some.groupBy("doc_id").agg(F.min(F.struct("a", "b")).alias("p"), F.max(F.struct("a", "b")).alias("q")).where("p <> q").select("doc_id")
    same = some.select("doc_id", "a", "b").join(stored(twice, "twice"), "doc_id", "left_semi").join(reps.select("a", "b", "node"), ["a", "b"])
    same = stored(same.select("doc_id", "node").distinct(), "same")
    same = stored(same.join(same.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("node <> a").select("a", F.col("node").alias("b")), "same")
    label = components(edge)
    open_ = stored(undecided(star, label), "undecided")
    more = stored(confirmed(stored(more_pairs(open_, sets, percent), "pairs"), reps, sets, percent), "links")
    if not more.isEmpty() or not same.isEmpty():
        label = components(edge.union(more).union(same))
    rooted = reps.select("a", "b", "node").join(label, "node", "left").select("a", "b", F.coalesce("root", "node").alias("root"))
    x = every.select("doc_id", "n_shingles", "a", "b").join(stored(rooted, "roots"), ["a", "b"], "left")
    return x.select("doc_id", "n_shingles", "a", "b", F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def kept_docs(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group: the row whose doc_id is the group's id. Rows without words stay."""
    (name,) = fresh(docs, "gone")
    gone = groups(docs, key, text, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    gone = sized(stored(gone, "gone"))
    return docs.join(gone, F.col(key) == F.col(name), "left_anti")
