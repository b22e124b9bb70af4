"""Queries: merger trees over the membership view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.operators import tree
from cosmolake.plans.registry import query
from cosmolake.plans.views import MEMBERSHIP, membership

MIN_COMMON = 10
SNAPS = list(range(1994, 2003))

EDGES = f"""{MEMBERSHIP},
 sz AS (SELECT snap, halo_id, count(*) AS n FROM mem GROUP BY ALL),
 ed AS (SELECT a.snap, a.halo_id AS haloid, s0.n AS npart, b.halo_id AS progid, s1.n AS npart_prog, count(*) AS common
        FROM mem a JOIN mem b ON b.snap = a.snap - 1 AND b.pid = a.pid
        JOIN sz s0 ON s0.snap = a.snap AND s0.halo_id = a.halo_id JOIN sz s1 ON s1.snap = b.snap AND s1.halo_id = b.halo_id
        GROUP BY ALL HAVING count(*) > {MIN_COMMON}),
 edges AS (SELECT *, common::DOUBLE * common / (npart::DOUBLE * npart_prog) AS merit FROM ed),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY snap, haloid ORDER BY merit DESC, progid) AS rank,
                   row_number() OVER (PARTITION BY snap, progid ORDER BY merit DESC, haloid) AS back FROM edges),
 best AS (SELECT snap, haloid, progid FROM ranked WHERE rank = 1)"""

TRACE = f"""WITH RECURSIVE {EDGES},
 tr AS (SELECT DISTINCT halo_id AS haloid, snap, halo_id AS progid FROM mem WHERE snap = 2001
        UNION ALL SELECT tr.haloid, tr.snap - 1, best.progid FROM tr JOIN best ON best.snap = tr.snap AND best.haloid = tr.progid)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.overlaps(membership(spark, sf_dir), MIN_COMMON)


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    branch = tree.main_branch(edges(spark, sf_dir))
    start = membership(spark, sf_dir).where("snap = 2001").select("snap", F.col("halo_id").alias("haloid")).distinct()
    return tree.trace(branch, start, 9)


@query("tree_edges", f"WITH {EDGES} SELECT snap, haloid, npart, progid, npart_prog, common, round(merit, 9) AS merit FROM edges")
def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("merit", F.round("merit", 9))


@query("tree_ranked", f"WITH {EDGES} SELECT snap, haloid, progid, common, rank FROM ranked")
def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.ranked(edges(spark, sf_dir)).select("snap", "haloid", "progid", "common", F.col("rank").cast("long").alias("rank"))


@query("tree_best_progenitor", f"WITH {EDGES} SELECT snap, haloid, progid FROM best")
def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.main_branch(edges(spark, sf_dir))


@query("tree_mutual_best", f"WITH {EDGES} SELECT snap, haloid, progid, common, row_number() OVER (PARTITION BY snap, haloid ORDER BY merit DESC, progid) AS rank FROM ranked WHERE back = 1")
def _mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.mutual_best(edges(spark, sf_dir)).select("snap", "haloid", "progid", "common", F.col("rank").cast("long").alias("rank"))


@query("tree_progenitor_ids", f"WITH {EDGES}, h AS (SELECT DISTINCT snap, halo_id AS haloid FROM mem) SELECT h.snap, h.haloid, coalesce(progid, 0) AS progid FROM h LEFT JOIN best USING (snap, haloid)")
def _progids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = membership(spark, sf_dir).select("snap", F.col("halo_id").alias("haloid")).distinct()
    return tree.progenitor_ids(tree.main_branch(edges(spark, sf_dir)), ids)


@query("tree_descendant_ids", f"WITH {EDGES}, h AS (SELECT DISTINCT snap, halo_id AS haloid FROM mem), d AS (SELECT snap - 1 AS snap, progid AS haloid, min(haloid) AS descid FROM best GROUP BY ALL) SELECT h.snap, h.haloid, coalesce(descid, 0) AS descid FROM h LEFT JOIN d USING (snap, haloid)")
def _descids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = membership(spark, sf_dir).select("snap", F.col("halo_id").alias("haloid")).distinct()
    return tree.descendant_ids(tree.main_branch(edges(spark, sf_dir)), ids)


@query("main_branch_trace", f"{TRACE} SELECT haloid, snap, progid FROM tr")
def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traced(spark, sf_dir)


@query("progenitor_at_snapshot", f"{TRACE}, h AS (SELECT DISTINCT halo_id AS haloid FROM mem WHERE snap = 2001) SELECT h.haloid, coalesce(t.progid, 0) AS progid FROM h LEFT JOIN (SELECT * FROM tr WHERE snap = 1997) t USING (haloid)")
def _at(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = membership(spark, sf_dir).where("snap = 2001").select("snap", F.col("halo_id").alias("haloid")).distinct()
    return tree.progenitors_at(tree.main_branch(edges(spark, sf_dir)), start, 1997, 9)


@query("last_progenitor", f"{TRACE} SELECT haloid, min(snap) AS last_snap, arg_min(progid, snap) AS last_progid FROM tr GROUP BY haloid")
def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.last_progenitors(traced(spark, sf_dir))


@query("tree_matrix", f"{TRACE} SELECT haloid, " + ", ".join(f"coalesce(max(progid) FILTER (WHERE snap = {s}), 0) AS snap_{s}" for s in SNAPS) + " FROM tr GROUP BY haloid")
def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree_matrix(traced(spark, sf_dir), SNAPS)


@query("halo_history", f"{TRACE} SELECT haloid, tr.snap, progid, n AS npart, round((2001 - tr.snap) * 0.1::DOUBLE, 6) AS zred FROM tr JOIN sz ON sz.snap = tr.snap AND sz.halo_id = progid")
def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = membership(spark, sf_dir)
    halos = m.groupBy("snap", "halo_id").agg(F.count(F.lit(1)).alias("npart"))
    snaps = spark.createDataFrame([(s, round((2001 - s) * 0.1, 6)) for s in SNAPS], "snap int, zred double")
    return tree.history(traced(spark, sf_dir), halos, F.broadcast(snaps)).select("haloid", "snap", "progid", "npart", F.round("zred", 6).alias("zred"))


@query("merger_count_ratio", f"WITH {EDGES}, b AS (SELECT * FROM ranked WHERE npart > 200), h AS (SELECT snap, haloid, max(CASE WHEN rank = 1 AND 1 - least(npart_prog / npart, npart / npart_prog) > 0.05 THEN 1 ELSE 0 END) AS hit FROM b GROUP BY ALL) SELECT snap, count(*) AS n_halos, sum(hit)::BIGINT AS n_mergers FROM h GROUP BY snap")
def _merger_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.merger_count(edges(spark, sf_dir), "ratio", min_npart=200, limit=0.05)


@query("merger_count_secondary", f"WITH {EDGES}, b AS (SELECT *, first_value(npart_prog) OVER (PARTITION BY snap, haloid ORDER BY rank) AS n0 FROM ranked WHERE npart > 200), h AS (SELECT snap, haloid, max(CASE WHEN rank > 1 AND npart_prog > 40 AND least(npart_prog / n0, n0 / npart_prog) > 0.25 THEN 1 ELSE 0 END) AS hit FROM b GROUP BY ALL) SELECT snap, count(*) AS n_halos, sum(hit)::BIGINT AS n_mergers FROM h GROUP BY snap")
def _merger_secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.merger_count(edges(spark, sf_dir), "secondary", min_npart=200)


@query("accretion_fraction", f"WITH {EDGES} SELECT snap, haloid, count(*) AS n_progs, round((first(npart) - arg_min(npart_prog, rank)) / first(npart), 9) AS fraction FROM ranked GROUP BY ALL")
def _accretion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.accretion_fraction(edges(spark, sf_dir)).withColumn("fraction", F.round("fraction", 9))


@query("followed_merger_count", f"{TRACE}, b AS (SELECT r.*, tr.haloid AS followed FROM ranked r JOIN tr ON tr.snap = r.snap AND tr.progid = r.haloid), h AS (SELECT followed, snap, max(CASE WHEN rank = 1 AND 1 - least(npart_prog / npart, npart / npart_prog) > 0.05 THEN 1 ELSE 0 END) AS hit FROM b GROUP BY ALL) SELECT followed AS haloid, count(*) AS n_snaps, sum(hit)::BIGINT AS n_mergers FROM h GROUP BY followed")
def _followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traced(spark, sf_dir).select(F.col("haloid").alias("followed"), "snap", F.col("progid").alias("haloid"))
    r = tree.ranked(edges(spark, sf_dir)).join(t, ["snap", "haloid"])
    hit = (F.col("rank") == 1) & (1 - F.least(F.col("npart_prog") / F.col("npart"), F.col("npart") / F.col("npart_prog")) > 0.05)
    h = r.groupBy("followed", "snap").agg(F.max(hit.cast("int")).alias("hit"))
    return h.groupBy(F.col("followed").alias("haloid")).agg(F.count(F.lit(1)).alias("n_snaps"), F.sum("hit").alias("n_mergers"))


@query("tree_totals", f"WITH {EDGES} SELECT snap, count(DISTINCT haloid) AS n_halos, count(*) AS n_edges, sum(common)::BIGINT AS n_common FROM edges GROUP BY snap")
def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("snap").agg(F.count_distinct("haloid").alias("n_halos"), F.count(F.lit(1)).alias("n_edges"), F.sum("common").alias("n_common"))


@query("tree_snap_skipping")
def _skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.skip_snapshots(membership(spark, sf_dir), SNAPS[::-1], MIN_COMMON)


@query("tree_croco", f"WITH {EDGES} SELECT snap, haloid, first(npart) AS npart, count(*) AS n_progs, string_agg(progid || ':' || common, ',' ORDER BY rank) AS progs FROM ranked GROUP BY snap, haloid")
def _croco(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.array_join(F.transform("progs", lambda p: F.concat(p["progid"].cast("string"), F.lit(":"), p["common"].cast("string"))), ",")
    return tree.croco(edges(spark, sf_dir)).withColumn("progs", text)


TRACKED = f"""{TRACE}, pos AS (SELECT DISTINCT snap, halo_id, (halo_id * 37 + snap * 11) % 100 / 100.0::DOUBLE AS x, (halo_id * 17 + snap * 7) % 100 / 100.0::DOUBLE AS y, (halo_id * 53 + snap * 3) % 100 / 100.0::DOUBLE AS z, 0.1::DOUBLE + (halo_id % 5) * 0.02::DOUBLE AS radius FROM mem),
 ob AS (SELECT haloid AS halo, (haloid + 1) % 25 AS host, snap, progid AS id FROM tr), ht AS (SELECT haloid AS host, snap, progid AS host_prog FROM tr),
 dd AS (SELECT halo, ob.host, ob.snap, id, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, b.radius FROM ob JOIN ht ON ht.host = ob.host AND ht.snap = ob.snap JOIN pos a ON a.snap = ob.snap AND a.halo_id = id JOIN pos b ON b.snap = ob.snap AND b.halo_id = host_prog)"""


@query("host_distance_track", f"{TRACKED} SELECT halo, host, snap, id, round(sqrt((dx - floor(dx + 0.5)) * (dx - floor(dx + 0.5)) + (dy - floor(dy + 0.5)) * (dy - floor(dy + 0.5)) + (dz - floor(dz + 0.5)) * (dz - floor(dz + 0.5))) / radius, 6) AS dist FROM dd")
def _host_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = traced(spark, sf_dir)
    place = lambda a, b: ((F.col("halo_id") * a + F.col("snap") * b) % 100) / 100.0
    pos = membership(spark, sf_dir).select("snap", "halo_id").distinct().select("snap", "halo_id", place(37, 11).alias("x"), place(17, 7).alias("y"), place(53, 3).alias("z"), (0.1 + (F.col("halo_id") % 5) * 0.02).alias("radius"))
    objects = t.select(F.col("haloid").alias("halo"), ((F.col("haloid") + 1) % 25).alias("host"), "snap", F.col("progid").alias("id"))
    hosts = t.select(F.col("haloid").alias("host"), "snap", F.col("progid").alias("host_prog"))
    return tree.host_distances(objects, hosts, pos).withColumn("dist", F.round("dist", 6))
