"""The engine's tables as views of the driver's tables, and the same in SQL.

Snapshots are years of shipping, objects are nations, particles are parts;
points of the periodic unit box come from embeddings; objects with radii and
hosts come from suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.session import table


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snap, halo_id, pid), distinct."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    x = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return x.select(F.year("l_shipdate").alias("snap"), F.col("c_nationkey").cast("long").alias("halo_id"), F.col("l_partkey").alias("pid")).distinct()


MEMBERSHIP = """mem AS (SELECT DISTINCT year(l_shipdate) AS snap, c_nationkey::BIGINT AS halo_id, l_partkey AS pid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, x, y, z, vx, vy, vz, mass, ptype) in the periodic unit box."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return e.select(
        F.col("vec_id").alias("pid"), *(((at(k) + 1) / 2).alias(c) for k, c in enumerate("xyz")), *(at(k + 3).alias(f"v{c}") for k, c in enumerate("xyz")),
        (F.col("label") % 3 + 1).cast("double").alias("mass"), (F.col("label") % 5).cast("int").alias("ptype"),
    )


POINTS = """pts AS (SELECT vec_id AS pid, (embedding[1]::DOUBLE + 1) / 2 AS x, (embedding[2]::DOUBLE + 1) / 2 AS y, (embedding[3]::DOUBLE + 1) / 2 AS z,
  embedding[4]::DOUBLE AS vx, embedding[5]::DOUBLE AS vy, embedding[6]::DOUBLE AS vz, (label % 3 + 1)::DOUBLE AS mass, (label % 5)::INT AS ptype FROM embeddings)"""


def halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(halo_id, host_id, npart, mass, radius, x, y, z, vx, vy, vz): every point is an object; hosts come before their subs."""
    p = points(spark, sf_dir)
    idx = F.col("pid").cast("long")
    host = F.when(idx % 4 == 0, F.lit(-1)).otherwise(F.floor(idx / 2).cast("long"))
    return p.select(
        idx.alias("halo_id"), host.alias("host_id"), ((F.lit(7919) * (idx + 1)) % 1000 + 20).cast("long").alias("npart"),
        (((F.lit(7919) * (idx + 1)) % 1000 + 20) * F.col("mass")).alias("mass"), (F.lit(0.02) + F.lit(0.005) * (idx % 10)).alias("radius"), "x", "y", "z", "vx", "vy", "vz",
    )


HALOS = """halos AS (SELECT pid::BIGINT AS halo_id, CASE WHEN pid % 4 = 0 THEN -1 ELSE pid // 2 END AS host_id,
  (7919 * (pid + 1)) % 1000 + 20 AS npart, ((7919 * (pid + 1)) % 1000 + 20) * mass AS mass, 0.02::DOUBLE + 0.005::DOUBLE * (pid % 10) AS radius,
  x, y, z, vx, vy, vz FROM pts)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(halo_id, pid, d, m, ptype): particles of an object by radius, one row per pid."""
    line = table(spark, sf_dir, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax")
    return line.select(
        F.col("l_suppkey").alias("halo_id"), F.col("l_orderkey").alias("oid"), F.col("l_linenumber").alias("lno"), F.col("l_partkey").alias("part"),
        (F.col("l_quantity") + (F.col("l_partkey") % 997) / 1000.0).alias("d"), F.col("l_extendedprice").alias("m"), F.col("l_returnflag").alias("species"), key.alias("k"),
    ).drop("k")


MEMBERS = """memb AS (SELECT l_suppkey AS halo_id, l_orderkey AS oid, l_linenumber AS lno, l_partkey AS part,
  l_quantity + (l_partkey % 997) / 1000.0::DOUBLE AS d, l_extendedprice AS m, l_returnflag AS species FROM lineitem)"""
