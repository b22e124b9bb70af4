"""Rounds of iterative operators: tables between rounds live in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 400_000
SALTS = 32
_OWN: list[str] = []


def folder(spark: SparkSession, what: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset, under one of our own, which only a local master can share.

    Our own folder goes when the process ends; what stands in a shared one is its owner's to clear.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="cosmolake-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = f"file://{_OWN[0]}"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet and read again: a cut in the lineage that outlives executors."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(low: DataFrame, jump: DataFrame) -> DataFrame:
    """``low`` with ``up`` of its label from ``jump`` (l, up): broadcast if small, else each label's nodes are dealt over ``SALTS`` keys."""
    jump = stored(jump, "jumps")
    if jump.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return low.join(F.broadcast(jump), F.col("low") == F.col("l"), "left")
    many = jump.withColumn("js", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return low.withColumn("ls", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(many, (F.col("low") == F.col("l")) & (F.col("ls") == F.col("js")), "left")


def min_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over undirected edges (a, b); isolated nodes label themselves.

    Rounds of minimum labels with pointer jumping, each written to the shared
    folder: their number follows the logarithm of a component's diameter.
    Messages are pre-aggregated, so a hub's edges meet as partial minima.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b"))
    label = stored(nodes.select("node").distinct().join(least, "node", "left").select("node", F.least("node", "_b").alias("label")), "labels")
    while True:
        near = both.join(label, both.a == label.node).groupBy("b").agg(F.min("label").alias("near"))
        low = label.join(near, label.node == near.b, "left").select("node", "label", F.least("label", "near").alias("low"))
        low = stored(low, "labels")
        top = low.select(F.col("node").alias("p"), F.col("low").alias("up"))
        # One row a label looks up where it points now; only where that moved do the label's nodes follow.
        jump = low.select("low").distinct().join(top, F.col("low") == F.col("p")).where("up < low").select(F.col("low").alias("l"), "up")
        new = stored(spread(low, jump).select("node", F.coalesce("up", "low").alias("label"), F.col("label").alias("was")), "labels")
        label = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return label
