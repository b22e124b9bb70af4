"""Queries: distance joins in the periodic unit box."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.operators import spatial as s
from cosmolake.plans.q_catalogue import PH, d2
from cosmolake.plans.registry import query
from cosmolake.plans.views import HALOS, POINTS, halos, points


@query("gather_particles", f"{PH}, p AS (SELECT pid, x AS b_x, y AS b_y, z AS b_z FROM pts) SELECT halo_id, pid FROM halos, p WHERE {d2('', 'b_')} <= radius * radius")
def _gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.gather(halos(spark, sf_dir), points(spark, sf_dir)).select("halo_id", F.col("b_pid").alias("pid"))


@query("pair_search", f"WITH {POINTS}, p AS (SELECT pid AS b_pid, x AS b_x, y AS b_y, z AS b_z FROM pts) SELECT pid, b_pid FROM pts, p WHERE pid < b_pid AND {d2('', 'b_')} <= 0.0009::DOUBLE")
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("pid", "x", "y", "z")
    return s.within(p, p, 0.03).where("pid < b_pid").select("pid", "b_pid")


@query("similar_pairs", f"""{PH}, a AS (SELECT halo_id, npart, radius, floor(x * 16)::BIGINT AS ax, floor(y * 16)::BIGINT AS ay, floor(z * 16)::BIGINT AS az, ceil(1.5::DOUBLE * radius / 0.0625)::BIGINT AS k FROM halos),
 b AS (SELECT halo_id AS other, npart AS other_npart, ax AS bx, ay AS b_y, az AS bz FROM a)
 SELECT halo_id, other, npart, other_npart FROM a, b WHERE halo_id <> other AND npart > 200 AND abs(npart - other_npart) / npart < 0.2
  AND least(abs(ax - bx), 16 - abs(ax - bx)) <= k AND least(abs(ay - b_y), 16 - abs(ay - b_y)) <= k AND least(abs(az - bz), 16 - abs(az - bz)) <= k""")
def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.similar_pairs(halos(spark, sf_dir), 1.5, 0.2, 200, 16)


@query("cross_pairs", f"""{PH}, a AS (SELECT * REPLACE (radius * 2 AS radius) FROM halos WHERE halo_id % 2 = 0 AND npart > 100), b AS (SELECT halo_id AS bid, mass AS bm, radius * 2 AS br, x AS b_x, y AS b_y, z AS b_z, vx AS bvx, vy AS bvy, vz AS bvz FROM halos WHERE halo_id % 2 = 1 AND npart > 100),
 c AS (SELECT halo_id, bid, abs(radius - br) AS dr FROM a, b WHERE {d2('', 'b_')} < radius * radius AND vx * bvx + vy * bvy + vz * bvz > 0 AND abs(radius - br) / radius < 1 AND abs(mass - bm) / mass < 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY halo_id ORDER BY dr, bid) AS k, count(*) OVER (PARTITION BY halo_id) AS n_candidates FROM c) SELECT halo_id, bid AS match_id, n_candidates FROM r WHERE k = 1""")
def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = halos(spark, sf_dir).withColumn("radius", F.col("radius") * 2)
    return s.cross_pairs(h.where("halo_id % 2 = 0"), h.where("halo_id % 2 = 1"), 0.14)


@query("nearest_object", f"{PH}, q AS (SELECT *, 0.9::DOUBLE AS qx, 0.1::DOUBLE AS qy, 0.6::DOUBLE AS qz FROM halos) SELECT halo_id, round(sqrt({d2('', 'q')}), 9) AS dist FROM q ORDER BY dist, halo_id LIMIT 1")
def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.nearest_to(halos(spark, sf_dir), (0.9, 0.1, 0.6)).select("halo_id", F.round(F.sqrt("d2"), 9).alias("dist"))


MASSIVE = f"{PH}, o AS (SELECT halo_id AS other, npart AS on_, x AS o_x, y AS o_y, z AS o_z FROM halos), c AS (SELECT halo_id, other, sqrt({d2('', 'o_')}) AS dist FROM halos, o WHERE on_ > npart), r AS (SELECT *, row_number() OVER (PARTITION BY halo_id ORDER BY dist, other) AS k FROM c)"


@query("nearest_more_massive", f"{MASSIVE} SELECT h.halo_id, other, round(dist, 9) AS dist FROM halos h LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (halo_id)")
def _massive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.nearest_more_massive(halos(spark, sf_dir)).withColumn("dist", F.round("dist", 9))


@query("gather_radius", f"{MASSIVE} SELECT h.halo_id, round(least(0.2::DOUBLE, greatest(radius, coalesce(dist / 2, 0.2::DOUBLE))), 9) AS gather_rad FROM halos h LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (halo_id)")
def _gather_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.gather_radius(halos(spark, sf_dir), 0.2).withColumn("gather_rad", F.round("gather_rad", 9))


EDGE = "power(10, log10(0.01::DOUBLE) + {0} * (log10(0.1::DOUBLE) - log10(0.01::DOUBLE)) / 8)"


@query("pair_histogram", f"WITH {POINTS}, p AS (SELECT pid AS b_pid, x AS b_x, y AS b_y, z AS b_z FROM pts), c AS (SELECT {d2('', 'b_')} AS q FROM pts, p WHERE pid < b_pid), e AS (SELECT unnest(range(8))::INT AS bin), b AS (SELECT bin, {EDGE.format('bin')} AS lo, {EDGE.format('(bin + 1)')} AS hi FROM e) SELECT bin, count(*) AS n_pairs FROM c JOIN b ON q > lo * lo AND q < hi * hi GROUP BY bin")
def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.pair_histogram(points(spark, sf_dir), 0.01, 0.1, 8)


@query("correlation_function", f"WITH {POINTS}, p AS (SELECT pid AS b_pid, x AS b_x, y AS b_y, z AS b_z FROM pts), c AS (SELECT {d2('', 'b_')} AS q FROM pts, p WHERE pid < b_pid), e AS (SELECT unnest(range(8))::INT AS bin), b AS (SELECT bin, {EDGE.format('bin')} AS lo, {EDGE.format('(bin + 1)')} AS hi FROM e), h AS (SELECT bin, any_value(lo) AS lo, any_value(hi) AS hi, count(q) AS n_pairs FROM b LEFT JOIN c ON q > lo * lo AND q < hi * hi GROUP BY bin), n AS (SELECT count(*) AS n FROM pts) SELECT bin, round(sqrt(lo * hi), 9) AS r, n_pairs, round(n_pairs / (4.1887902047863905 * (hi * hi * hi - lo * lo * lo) * n * (n - 1) / 2) - 1, 6) AS xi FROM h, n")
def _xi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.correlation(points(spark, sf_dir), 0.01, 0.1, 8).select("bin", F.round("r", 9).alias("r"), "n_pairs", F.round("xi", 6).alias("xi"))


SPHERES = "sp AS (SELECT halo_id AS sphere_id, x AS s_x, y AS s_y, z AS s_z FROM halos)"


@query("sigma_r", f"WITH {POINTS}, {HALOS}, {SPHERES}, m AS (SELECT sphere_id, coalesce(sum(mass) FILTER (WHERE {d2('', 's_')} <= 0.04::DOUBLE), 0) AS mass FROM sp, pts GROUP BY sphere_id) SELECT count(*) AS n, round(avg(mass), 6) AS mean, round(stddev_pop(mass) / avg(mass), 9) AS sigma FROM m")
def _sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    spheres = halos(spark, sf_dir).select(F.col("halo_id").alias("sphere_id"), "x", "y", "z")
    cells = points(spark, sf_dir).select("x", "y", "z", "mass")
    return s.rms_fluctuation(s.sphere_statistic(cells, spheres, 0.2)).select("n", F.round("mean", 6).alias("mean"), F.round("sigma", 9).alias("sigma"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of three levels; half extents shrink with the level."""
    h = halos(spark, sf_dir)
    level = (F.col("halo_id") % 3).cast("int")
    size = F.lit(0.3) / F.pow(F.lit(2.0), level)
    return h.select(F.col("halo_id").alias("patch_id"), level.alias("level"), "x", "y", "z", F.col("npart").alias("n_parts"), (F.col("npart") % 37).alias("n_nodes"), size.alias("hx"), (size * 0.8).alias("hy"), (size * 1.2).alias("hz"))


PATCHES = f"""{PH}, pt AS (SELECT halo_id AS patch_id, (halo_id % 3)::INT AS level, x, y, z, npart AS n_parts, npart % 37 AS n_nodes, 0.3::DOUBLE / power(2, halo_id % 3) AS hx FROM halos),
 up AS (SELECT patch_id AS parent_id, level + 1 AS level, x AS u_x, y AS u_y, z AS u_z, hx, hx * 0.8::DOUBLE AS hy, hx * 1.2::DOUBLE AS hz FROM pt),
 al AS (SELECT patch_id, parent_id, {d2('', 'u_')} AS q, abs((x - u_x) - floor((x - u_x) + 0.5)) <= up.hx AND abs((y - u_y) - floor((y - u_y) + 0.5)) <= hy AND abs((z - u_z) - floor((z - u_z) + 0.5)) <= hz AS inside FROM pt JOIN up USING (level)),
 ne AS (SELECT patch_id, parent_id, row_number() OVER (PARTITION BY patch_id ORDER BY q, parent_id) AS k FROM al WHERE inside),
 orp AS (SELECT patch_id, parent_id, row_number() OVER (PARTITION BY patch_id ORDER BY q, parent_id) AS k FROM al WHERE patch_id NOT IN (SELECT patch_id FROM ne)),
 li AS (SELECT patch_id, parent_id FROM ne WHERE k = 1 UNION ALL SELECT patch_id, parent_id FROM orp WHERE k = 1)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patches(spark, sf_dir)
    inside = s.holding_parents(p, p)
    lost = p.where("level > 0").join(inside, "patch_id", "left_anti")
    return inside.union(s.orphan_parents(lost, p))


@query("patch_box_parents", f"{PATCHES} SELECT patch_id, parent_id FROM al WHERE inside")
def _parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = patches(spark, sf_dir)
    return s.box_parents(p, p).select("patch_id", "parent_id")


@query("patch_links", f"{PATCHES} SELECT patch_id, parent_id FROM li")
def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir)


@query("patch_main_daughter", f"{PATCHES}, m AS (SELECT parent_id, patch_id, row_number() OVER (PARTITION BY parent_id ORDER BY n_parts DESC, patch_id) AS k FROM li JOIN pt USING (patch_id)) SELECT parent_id, patch_id AS main_id FROM m WHERE k = 1")
def _main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.main_daughters(links(spark, sf_dir), patches(spark, sf_dir))


@query("patch_sibling_distance", f"{PATCHES}, m AS (SELECT parent_id, patch_id, row_number() OVER (PARTITION BY parent_id ORDER BY n_parts DESC, patch_id) AS k FROM li JOIN pt USING (patch_id)), sb AS (SELECT parent_id, patch_id, x, y, z FROM m JOIN pt USING (patch_id) WHERE k > 1), o AS (SELECT parent_id, patch_id AS other, x AS o_x, y AS o_y, z AS o_z FROM sb) SELECT patch_id, round(0.5 * sqrt(min({d2('', 'o_')})), 9) AS close FROM sb JOIN o USING (parent_id) WHERE patch_id <> other GROUP BY patch_id")
def _sibling(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, l = patches(spark, sf_dir), links(spark, sf_dir)  # noqa: E741
    return s.sibling_distance(l, p, s.main_daughters(l, p)).withColumn("close", F.round("close", 9))
