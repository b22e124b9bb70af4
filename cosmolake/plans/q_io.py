"""Queries: tables written in the text and binary forms and read back, the finder, and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.operators import tree
from cosmolake.operators.rounds import folder
from cosmolake.plans.finder import Settings, find_halos
from cosmolake.plans.q_catalogue import PH
from cosmolake.plans.q_tree import EDGES, edges
from cosmolake.plans.registry import query
from cosmolake.plans.views import MEMBERSHIP, POINTS, halos, membership, points
from cosmolake.session import table
from cosmolake.sources import binary, sinks, text
from cosmolake.streaming import track


@query("halos_round_trip", f"{PH} SELECT halo_id, host_id, npart, round(x, 12) AS x FROM halos WHERE npart >= 100")
def _halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "halos-text")
    sinks.halos_text(halos(spark, sf_dir), path, ["halo_id", "host_id", "npart", "x", "y", "z"], min_npart=100)
    return text.catalogue_text(spark, path, ["halo_id", "host_id", "npart", "x"], ("halo_id", "host_id", "npart")).withColumn("x", F.round("x", 12))


@query("particles_round_trip", f"WITH {MEMBERSHIP}, m AS (SELECT snap * 100 + halo_id AS halo_id, pid FROM mem) SELECT halo_id, count(*) OVER (PARTITION BY halo_id) AS npart, pid, 1 AS ptype FROM m")
def _particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "particles-text")
    sinks.particles_text(membership(spark, sf_dir).select((F.col("snap") * 100 + F.col("halo_id")).alias("halo_id"), "pid", F.lit(1).alias("ptype")), path)
    return text.memberships(spark, path, whole=True).drop("file")


@query("stars_round_trip", f"WITH {POINTS} SELECT pid % 10 AS halo_id, pid, mass, round(vx, 9) AS age FROM pts WHERE ptype = 4")
def _stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "stars-text")
    p = points(spark, sf_dir).where("ptype = 4").select((F.col("pid") % 10).alias("halo_id"), "pid", "mass", F.col("vx").alias("age"), F.col("vy").alias("metal"))
    sinks.stars_text(p, path)
    return text.star_particles(spark, path, whole=True).select("halo_id", "pid", "mass", F.round("age", 9).alias("age"))


def _serial(e: DataFrame) -> DataFrame:
    """Ranked edges of all snapshots, with ids that say their snapshot."""
    r = tree.ranked(e)
    return r.withColumns({"haloid": F.col("snap") * 100 + F.col("haloid"), "progid": (F.col("snap") - 1) * 100 + F.col("progid")})


@query("tree_round_trip", f"WITH {EDGES} SELECT snap * 100 + haloid AS haloid, npart, rank::INT AS rank, (snap - 1) * 100 + progid AS progid, npart_prog, common, round(merit, 9) AS merit FROM ranked")
def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tree-text")
    sinks.tree_text(_serial(edges(spark, sf_dir)), path)
    return text.tree_croco(spark, f"{path}/croco", whole=True).drop("file").withColumn("merit", F.round("merit", 9))


@query("tree_index_round_trip", f"WITH {EDGES} SELECT snap * 100 + haloid AS haloid, (snap - 1) * 100 + progid AS progid FROM best")
def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tree-text")
    sinks.tree_text(_serial(edges(spark, sf_dir)), path)
    return text.tree_index(spark, f"{path}/mtree_idx")


@query("merged_tree_round_trip", f"WITH {EDGES} SELECT snap * 1000000000000 + haloid + 1 AS haloid, (snap - 1) * 1000000000000 + progid + 1 AS progid FROM best")
def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "merged-text")
    r = tree.ranked(edges(spark, sf_dir))
    serial = r.select((F.col("snap") * F.lit(10**12) + F.col("haloid") + 1).alias("haloid"), "rank", ((F.col("snap") - 1) * F.lit(10**12) + F.col("progid") + 1).alias("progid"))
    sinks.merged_tree_text(serial, path)
    return text.best_progenitors(text.tree_merged(spark, path, whole=True))


@query("ascii_snapshot_round_trip", f"WITH {POINTS} SELECT row_number() OVER (ORDER BY pid) - 1 AS pid, round(x, 10) AS x, round(vz, 10) AS vz, mass, CASE WHEN ptype = 0 THEN 0 ELSE ptype END AS ptype FROM pts")
def _ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "snapshot-text")
    p = points(spark, sf_dir).withColumn("u", F.when(F.col("ptype") == 0, F.lit(1.5)).otherwise(-F.col("ptype").cast("double")))
    sinks.ascii_snapshot_text(p, path, {"Header": "12", "PMass": "1.0"})
    x = text.ascii_snapshot(spark, path, whole=True)
    return x.select("pid", F.round("x", 10).alias("x"), F.round("vz", 10).alias("vz"), "mass", "ptype")


@query("gadget_round_trip", f"WITH {POINTS} SELECT pid, round(x::FLOAT::DOUBLE, 6) AS x, round(vy::FLOAT::DOUBLE, 6) AS vy, mass, CASE WHEN ptype = 0 THEN 2.5 END::DOUBLE AS u, ptype FROM pts")
def _gadget(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "gadget")
    sinks.gadget_files(points(spark, sf_dir).withColumn("u", F.when(F.col("ptype") == 0, F.lit(2.5))), path, 1.0, files=3).write.format("noop").mode("overwrite").save()
    return binary.gadget(spark, path).select("pid", F.round("x", 6).alias("x"), F.round("vy", 6).alias("vy"), "mass", F.when(~F.isnan("u"), F.col("u")).alias("u"), "ptype")


@query("tipsy_round_trip", f"WITH {POINTS}, k AS (SELECT *, CASE WHEN ptype = 0 THEN 0 WHEN ptype = 4 THEN 4 ELSE 1 END AS kind FROM pts) SELECT (row_number() OVER (ORDER BY CASE kind WHEN 1 THEN 0 WHEN 4 THEN 1 ELSE 2 END, pid) - 1)::BIGINT AS pid, round((2 * x)::FLOAT::DOUBLE, 6) AS x, round(vy::FLOAT::DOUBLE, 6) AS vy, mass, CASE WHEN kind = 0 THEN 2.5 END::DOUBLE AS u, kind::INT AS ptype FROM k")
def _tipsy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "tipsy")
    sinks.tipsy_files(points(spark, sf_dir).withColumn("u", F.when(F.col("ptype") == 0, F.lit(2.5))), path, x_unit=2.0).write.format("noop").mode("overwrite").save()
    return binary.tipsy(spark, path).select("pid", F.round("x", 6).alias("x"), F.round("vy", 6).alias("vy"), "mass", F.when(~F.isnan("u"), F.col("u")).alias("u"), "ptype")


@query("find_halos")
def _finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole finder on clumps made of the points: each point shrinks towards its label's corner."""
    p = points(spark, sf_dir)
    c = F.xxhash64(F.col("pid") % 6)
    corner = {k: F.pmod(F.shiftright(c, 11 * i), F.lit(100)) / 100.0 for i, k in enumerate("xyz")}
    p = p.withColumns({k: F.pmod(corner[k] + (F.col(k) - 0.5) * 0.08, F.lit(1.0)) for k in "xyz"} | {f"v{k}": F.col(f"v{k}") * 0.01 for k in "xyz"})
    found, _, _ = find_halos(p, Settings(grid=8, per_cell=4, gravity=1.0))
    return found.select("idx", "halo_id", "host_id", "npart", F.round("radius", 9).alias("radius"), F.round("mass", 6).alias("mass"))


@query("stream_window_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windowed counts in batch form; the same function takes a stream."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return track.windowed_counts(e, "ts", "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))
