"""Queries: grids, refinement, field statistics, cosmology tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.functions import cosmology, expr
from cosmolake.operators import catalogue, grid, stats
from cosmolake.plans.q_catalogue import PH, d2
from cosmolake.plans.registry import query
from cosmolake.plans.views import HALOS, POINTS, halos, points
from cosmolake.session import table


@query("cell_deposit", f"WITH {POINTS} SELECT floor(x * 8)::BIGINT AS ix, floor(y * 8)::BIGINT AS iy, floor(z * 8)::BIGINT AS iz, count(*) AS n_part FROM pts GROUP BY ALL")
def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.cell_counts(points(spark, sf_dir), 8)


CIC = f"""{POINTS}, g AS (SELECT mass, x * 8 AS u, y * 8 AS v, z * 8 AS w FROM pts),
 o AS (SELECT mass, floor(u)::BIGINT AS i, floor(v)::BIGINT AS j, floor(w)::BIGINT AS k, u - floor(u) - 0.5 AS a, v - floor(v) - 0.5 AS b, w - floor(w) - 0.5 AS c FROM g),
 s AS (SELECT unnest([0, 1]) AS p), t AS (SELECT unnest([0, 1]) AS q), r AS (SELECT unnest([0, 1]) AS r),
 n AS (SELECT (i + p * (CASE WHEN a >= 0 THEN 1 ELSE -1 END) + 8) % 8 AS ix, (j + q * (CASE WHEN b >= 0 THEN 1 ELSE -1 END) + 8) % 8 AS iy, (k + r * (CASE WHEN c >= 0 THEN 1 ELSE -1 END) + 8) % 8 AS iz,
       mass * (CASE WHEN p = 0 THEN 1 - abs(a) ELSE abs(a) END) * (CASE WHEN q = 0 THEN 1 - abs(b) ELSE abs(b) END) * (CASE WHEN r = 0 THEN 1 - abs(c) ELSE abs(c) END) AS m FROM o, s, t, r)"""


@query("cic_deposit", f"WITH {CIC} SELECT ix, iy, iz, round(sum(m), 9) AS dens FROM n GROUP BY ALL")
def _cic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.deposit(points(spark, sf_dir), 8, kernel="cic").withColumn("dens", F.round("dens", 9))


TSC = f"""{POINTS}, g AS (SELECT pid, mass, x * 8 AS u, y * 8 AS v, z * 8 AS w FROM pts),
 o AS (SELECT pid, mass, floor(u)::BIGINT AS i, floor(v)::BIGINT AS j, floor(w)::BIGINT AS k, u - floor(u) - 0.5 AS a, v - floor(v) - 0.5 AS b, w - floor(w) - 0.5 AS c FROM g),
 s AS (SELECT unnest([-1, 0, 1]) AS p), t AS (SELECT unnest([-1, 0, 1]) AS q), r AS (SELECT unnest([-1, 0, 1]) AS r),
 n AS (SELECT pid, mass, (i + p + 8) % 8 AS ix, (j + q + 8) % 8 AS iy, (k + r + 8) % 8 AS iz,
       (CASE p WHEN 0 THEN 0.75::DOUBLE - a * a WHEN 1 THEN 0.5 * (0.5 + a) * (0.5 + a) ELSE 0.5 * (0.5 - a) * (0.5 - a) END)
     * (CASE q WHEN 0 THEN 0.75::DOUBLE - b * b WHEN 1 THEN 0.5 * (0.5 + b) * (0.5 + b) ELSE 0.5 * (0.5 - b) * (0.5 - b) END)
     * (CASE r WHEN 0 THEN 0.75::DOUBLE - c * c WHEN 1 THEN 0.5 * (0.5 + c) * (0.5 + c) ELSE 0.5 * (0.5 - c) * (0.5 - c) END) AS wt FROM o, s, t, r),
 d AS (SELECT ix, iy, iz, sum(mass * wt) AS dens FROM n GROUP BY ALL)"""


@query("tsc_deposit", f"WITH {TSC} SELECT ix, iy, iz, round(dens, 9) AS dens FROM d")
def _tsc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.deposit(points(spark, sf_dir), 8).withColumn("dens", F.round("dens", 9))


@query("density_at_particles", f"WITH {TSC} SELECT pid, round(sum(wt * dens) / ((SELECT sum(mass) FROM pts) / 512), 8) AS dens FROM n JOIN d USING (ix, iy, iz) GROUP BY pid")
def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.density_at(points(spark, sf_dir), 8).withColumn("dens", F.round("dens", 8))


@query("halo_particle_densities", f"WITH {TSC}, q AS (SELECT pid, round(sum(wt * dens) / ((SELECT sum(mass) FROM pts) / 512), 8) AS dens FROM n JOIN d USING (ix, iy, iz) GROUP BY pid) SELECT pid % 10 AS halo_id, pid, dens FROM q")
def _halo_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    m = p.select((F.col("pid") % 10).alias("halo_id"), "pid")
    return catalogue.with_densities(m, grid.density_at(p, 8).withColumn("dens", F.round("dens", 8))).select("halo_id", "pid", "dens")


@query("hilbert_keys")
def _hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("pid", grid.hilbert_key(F.col("x"), F.col("y"), F.col("z"), 6).alias("key"))


CELLS_64 = f"{POINTS}, c AS (SELECT pid, floor(x * 64)::BIGINT AS ix, floor(y * 64)::BIGINT AS iy, floor(z * 64)::BIGINT AS iz FROM pts)"


@query("hilbert_cells", f"WITH {CELLS_64} SELECT pid, ix, iy, iz, ix // 4 AS px, iy // 4 AS py, iz // 4 AS pz, true AS within FROM c")
def _hilbert_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys back to cells, and to the cells two levels above, whose range of keys holds them."""
    key = grid.hilbert_key(F.col("x"), F.col("y"), F.col("z"), 6)
    x = points(spark, sf_dir).select("pid", key.alias("key")).withColumn("up", grid.hilbert_parent(F.col("key"), 2))
    x = x.withColumns({"c": grid.hilbert_cell(F.col("key"), 6), "p": grid.hilbert_cell(F.col("up"), 4)})
    return x.select("pid", "c.ix", "c.iy", "c.iz", *(F.col(f"p.i{k}").alias(f"p{k}") for k in "xyz"), F.col("key").between(*grid.hilbert_children(F.col("up"), 2)).alias("within"))


@query("hilbert_shell", f"WITH {CELLS_64}, o AS (SELECT a, b, d FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS d)) SELECT pid, (ix + a + 64) % 64 AS ix, (iy + b + 64) % 64 AS iy, (iz + d + 64) % 64 AS iz FROM c, o")
def _hilbert_shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = grid.hilbert_key(F.col("x"), F.col("y"), F.col("z"), 6)
    x = points(spark, sf_dir).select("pid", key.alias("key"))
    x = x.select("pid", F.explode(grid.hilbert_shell(F.col("key"), 6)).alias("near"))
    return x.select("pid", grid.hilbert_cell(F.col("near"), 6).alias("c")).select("pid", "c.*")


#: The contrast of density on all nodes; the potential's seven-point Laplacian has to give it back.
CONTRAST = f"{TSC}, s0 AS (SELECT unnest(range(8)) AS ix), s1 AS (SELECT unnest(range(8)) AS iy), s2 AS (SELECT unnest(range(8)) AS iz), f AS (SELECT ix, iy, iz, coalesce(dens, 0) / ((SELECT sum(mass) FROM pts) / 512) - 1 AS delta FROM (SELECT * FROM s0, s1, s2) LEFT JOIN d USING (ix, iy, iz))"


@query("grid_potential", f"WITH {CONTRAST} SELECT ix, iy, iz, round(delta, 7) AS delta, round(delta, 7) AS laplacian FROM f")
def _grid_potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrast and the potential's seven-point Laplacian: each node gives its value to six neighbours and takes it six times off itself."""
    pot = grid.potential(points(spark, sf_dir), 8)
    moves = [(0, 0, 0, -6), (1, 0, 0, 1), (-1, 0, 0, 1), (0, 1, 0, 1), (0, -1, 0, 1), (0, 0, 1, 1), (0, 0, -1, 1)]
    to = lambda k, o: F.pmod(F.col(f"i{k}") + o, F.lit(8)).alias(f"i{k}")
    parts = F.array(*(F.struct(*(to(k, o) for k, o in zip("xyz", move, strict=False)), (F.lit(float(move[3])) * F.col("pot") * 64).alias("part"), F.col("delta").alias("own") if move[3] < 0 else F.lit(None).cast("double").alias("own")) for move in moves))
    x = pot.select(F.inline(parts)).groupBy("ix", "iy", "iz").agg(F.max("own").alias("delta"), F.sum("part").alias("laplacian"))
    # A node without mass may come out as -0.0.
    return x.select("ix", "iy", "iz", *((F.round(c, 7) + 0.0).alias(c) for c in ("delta", "laplacian")))


@query("density_order", f"WITH {TSC}, q AS (SELECT pid, round(sum(wt * dens) / ((SELECT sum(mass) FROM pts) / 512), 8) AS dens FROM n JOIN d USING (ix, iy, iz) GROUP BY pid) SELECT pid, dens FROM q")
def _density_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.density_at(points(spark, sf_dir), 8).withColumn("dens", F.round("dens", 8)).orderBy(F.desc("dens"), "pid")


REFINE = f"""{POINTS}, c0 AS (SELECT floor(x * 8)::BIGINT AS ix, floor(y * 8)::BIGINT AS iy, floor(z * 8)::BIGINT AS iz FROM pts GROUP BY ALL HAVING count(*) >= 4),
 s AS (SELECT unnest([0, 1]) AS p), t AS (SELECT unnest([-1, 0, 1]) AS q), r AS (SELECT unnest([-1, 0, 1]) AS r)"""


@query("refinement_mask", f"WITH {REFINE} SELECT DISTINCT (ix - p + 8) % 8 AS ix, (iy - q + 8) % 8 AS iy, (iz - r + 8) % 8 AS iz FROM c0, s, t, r")
def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.to_refine(grid.cell_counts(points(spark, sf_dir), 8), 8, 4)


def _levels_sql(n: int, threshold: int, levels: int) -> str:
    """Levels of refined cells, each from the particles of the one above."""
    parts = [POINTS, "p0 AS (SELECT pid, x, y, z FROM pts)", "off AS (SELECT a, b, c FROM (SELECT unnest([0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS c))"]
    for k in range(levels):
        size = n << k
        wrap = lambda i, o: f"(i{i} - {o} + {size}) % {size} AS i{i}"  # noqa: E731, B023
        parts.append(f"c{k} AS MATERIALIZED (SELECT pid, x, y, z, floor(x * {size})::BIGINT AS ix, floor(y * {size})::BIGINT AS iy, floor(z * {size})::BIGINT AS iz FROM p{k})")
        parts.append(f"h{k} AS (SELECT DISTINCT {wrap('x', 'a')}, {wrap('y', 'b')}, {wrap('z', 'c')} FROM (SELECT ix, iy, iz FROM c{k} GROUP BY ALL HAVING count(*) >= {threshold}), off)")
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT c{k}.* FROM c{k} JOIN h{k} USING (ix, iy, iz))")
    each = " UNION ALL ".join(f"SELECT {k}::INT AS level, count(DISTINCT (ix, iy, iz)) AS n_cells, count(*) AS n_parts FROM p{k + 1} HAVING count(*) > 0" for k in range(levels))
    return f"WITH {', '.join(parts)} {each}"


@query("refinement_hierarchy", _levels_sql(8, 4, 12))
def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.hierarchy(points(spark, sf_dir), 8, 4).groupBy("level").agg(F.count_distinct("ix", "iy", "iz").alias("n_cells"), F.count(F.lit(1)).alias("n_parts"))


@query("refinement_patches")
def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = grid.patches(grid.hierarchy(points(spark, sf_dir), 8, 4), 8)
    return grid.patch_table(placed, 8).select("patch_id", "level", "n_nodes", "n_parts", *(F.round(k, 9).alias(k) for k in "xyz"))


@query("weighted_patch_centres")
def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of patches by their cells' particles and by the depth of the potential."""
    p = points(spark, sf_dir)
    placed = grid.patches(grid.hierarchy(p, 8, 4), 8)
    depth = grid.depth_weights(placed, grid.potential(p, 16), 8, 16)
    a = grid.patch_table(placed, 8, "dens").select("patch_id", *(F.round(k, 9).alias(f"dens_{k}") for k in "xyz"))
    b = grid.patch_table(placed, 8, "weighted", weights=depth).select("patch_id", *(F.round(k, 9).alias(f"pot_{k}") for k in "xyz"))
    return a.join(b, "patch_id")


@query("level_histogram")
def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = grid.patches(grid.hierarchy(points(spark, sf_dir), 8, 4), 8)
    return grid.level_histogram(grid.patch_table(placed, 8))


@query("power_spectrum")
def _power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.power_spectrum(points(spark, sf_dir), 16).withColumn("power", F.round("power", 10))


@query("folded_power_spectrum")
def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.smoothed_power(grid.power_spectrum(points(spark, sf_dir), 16, fold=1)).select("k", "n_modes", F.round("power", 10).alias("power"), F.round("smooth", 10).alias("smooth"))


SPEED = "sqrt(vx * vx + vy * vy + vz * vz)"


@query("velocity_moments", f"WITH {POINTS} SELECT count(*) AS n, round(avg(vx), 9) AS mean_vx, round(avg({SPEED}), 9) AS mean_speed, round(sqrt(var_pop(vx) + var_pop(vy) + var_pop(vz)), 9) AS sigma, round(min({SPEED}), 9) AS min_speed, round(max({SPEED}), 9) AS max_speed, round(avg(x * vy - y * vx), 9) AS mean_lz FROM pts")
def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = stats.velocity_moments(points(spark, sf_dir))
    return x.select("n", *(F.round(c, 9).alias(c) for c in ("mean_vx", "mean_speed", "sigma", "min_speed", "max_speed", "mean_lz")))


@query("speed_histogram", f"WITH {POINTS}, s AS (SELECT {SPEED} AS s FROM pts), b AS (SELECT floor(s / 0.05::DOUBLE)::INT AS bin FROM s WHERE s < 0.5), n AS (SELECT count(*) AS al FROM s) SELECT bin, count(*) AS n, round(count(*) / any_value(al) / 0.05::DOUBLE, 9) AS density FROM b, n GROUP BY bin")
def _speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.speed_histogram(points(spark, sf_dir), 0.0, 0.5, 10).select("bin", "n", F.round("density", 9).alias("density"))


SIGMA_H = f"""{POINTS}, {HALOS}, ob AS (SELECT halo_id AS observer, x, y, z, vx, vy, vz FROM halos), b AS (SELECT x AS b_x, y AS b_y, z AS b_z, vx AS b_vx, vy AS b_vy, vz AS b_vz FROM halos),
 c AS (SELECT observer, {d2('', 'b_')} AS q, (b_vx - vx) * ((b_x - x) - floor((b_x - x) + 0.5)) + (b_vy - vy) * ((b_y - y) - floor((b_y - y) + 0.5)) + (b_vz - vz) * ((b_z - z) - floor((b_z - z) + 0.5)) AS l FROM ob, b),
 sp AS (SELECT unnest([1, 2]) AS sphere),
 h AS (SELECT observer, sphere, avg(100 + l / q) AS h_los, count(*) AS n FROM c, sp WHERE q > 0 AND q <= (0.1::DOUBLE * sphere) * (0.1::DOUBLE * sphere) GROUP BY ALL)"""


def _scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = halos(spark, sf_dir)
    observers = h.select(F.col("halo_id").alias("observer"), "x", "y", "z", "vx", "vy", "vz")
    return stats.expansion_scatter(observers, h.select("x", "y", "z", "vx", "vy", "vz"), 0.2, spheres=2)


@query("expansion_scatter", f"WITH {SIGMA_H} SELECT observer, sphere, round(h_los, 7) AS h_los, n FROM h")
def _expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scatter(spark, sf_dir).withColumn("h_los", F.round("h_los", 7))


@query("expansion_variance", f"WITH {SIGMA_H} SELECT sphere, round(avg(h_los), 7) AS mean_h, round(stddev_pop(h_los) / abs(avg(h_los)), 9) AS sigma_h, count(*) AS n_observers FROM h GROUP BY sphere")
def _variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.expansion_variance(_scatter(spark, sf_dir)).select("sphere", F.round("mean_h", 7).alias("mean_h"), F.round("sigma_h", 9).alias("sigma_h"), "n_observers")


@query("weight_classes", f"WITH {POINTS} SELECT mass AS weight, sum(mass) AS total, count(*) AS n FROM pts GROUP BY mass")
def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(stats.weight_classes(points(spark, sf_dir)), "weight double, total double, n long")


@query("position_extent", f"WITH {POINTS} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM pts")
def _extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.extent(points(spark, sf_dir))


@query("scaled_units", f"WITH {POINTS} SELECT pid, round(x * 50, 8) AS x, round(vx * 3, 8) AS vx, mass * 2 AS mass FROM pts")
def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.scaled(points(spark, sf_dir), 50.0, 3.0, 2.0).select("pid", F.round("x", 8).alias("x"), F.round("vx", 8).alias("vx"), "mass")


@query("near_host", f"{PH}, o AS (SELECT x AS h_x, y AS h_y, z AS h_z, radius * 6 AS hr FROM halos WHERE halo_id = 3) SELECT halo_id FROM halos, o WHERE {d2('', 'h_')} < hr * hr")
def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.near_host(halos(spark, sf_dir).withColumn("radius", F.col("radius") * 6), 3).select("halo_id")


CRIT = f"{PH}, o AS (SELECT x AS h_x, y AS h_y, z AS h_z, radius AS hr, mass AS hm FROM halos WHERE halo_id = 3), c AS (SELECT halo_id, host_id, mass, hm, sqrt({d2('', 'h_')}) + 0.5 * radius <= 7 * hr AS near FROM halos, o WHERE halo_id <> 3 AND npart >= 20)"


@query("criteria_counts", f"{CRIT} SELECT 'radius' AS criterion, count(*) AS n, round(sum(mass), 4) AS mass, round(sum(mass) / any_value(hm), 8) AS mass_fraction FROM c WHERE near HAVING count(*) > 0 UNION ALL SELECT 'pointer', count(*), round(sum(mass), 4), round(sum(mass) / any_value(hm), 8) FROM c WHERE host_id = 3 HAVING count(*) > 0")
def _criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.criteria_counts(halos(spark, sf_dir), 3, 7.0).select("criterion", "n", F.round("mass", 4).alias("mass"), F.round("mass_fraction", 8).alias("mass_fraction"))


@query("criteria_difference", f"{CRIT} SELECT halo_id, CASE WHEN host_id < 0 THEN 'free' ELSE 'elsewhere' END AS kind FROM c WHERE near AND host_id <> 3")
def _criteria_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.criteria_difference(halos(spark, sf_dir), 3, 7.0)


@query("draw_without_replacement")
def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.drawn(points(spark, sf_dir).select("pid", "mass"), 100, "pid")


@query("sample_with_replacement")
def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.with_replacement(points(spark, sf_dir).select("pid", "mass"), 0.5)


@query("lattice_index", f"WITH {POINTS} SELECT pid, pid % 8 AS i, (pid // 8) % 8 AS j, pid // 64 AS k FROM pts")
def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j, k = expr.grid_index(F.col("pid"), 8)
    return points(spark, sf_dir).select("pid", i.alias("i"), j.alias("j"), k.alias("k"))


@query("model_functions", "SELECT p_partkey, round(2 * exp(-((p_size - 25) * (p_size - 25)) / 50.0::DOUBLE), 10) AS gaussian, round(2.0::DOUBLE / p_size * exp(-((ln(p_size) - 1) * (ln(p_size) - 1)) / 0.5::DOUBLE), 10) AS lognormal, round(3 * power(p_size, -1.5::DOUBLE), 10) AS powerlaw FROM part")
def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(expr.gaussian(x, 2, 25, 5), 10).alias("gaussian"), F.round(expr.lognormal(x, 2, 1, 0.5), 10).alias("lognormal"), F.round(expr.powerlaw(x, 3, -1.5), 10).alias("powerlaw"))


@query("cosmology_timeline", "WITH a AS (SELECT 0.01::DOUBLE + unnest(range(100)) * (0.99::DOUBLE / 99) AS a), e AS (SELECT a, sqrt(0.3::DOUBLE / (a * a * a) + 0.7::DOUBLE) AS e FROM a) SELECT round(a, 9) AS a, round(1 / a - 1, 7) AS z, round(100 * e, 5) AS hubble, round(0.3::DOUBLE / (a * a * a) / (e * e), 9) AS omega FROM e")
def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = cosmology.timeline(spark, cosmology.Cosmology(), 100)
    return t.select(F.round("a", 9).alias("a"), F.round("z", 7).alias("z"), F.round("hubble", 5).alias("hubble"), F.round("omega", 9).alias("omega"))


@query("age_list")
def _ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosmology.age_list(spark, cosmology.Cosmology(), [0.0, 0.5, 1.0, 2.0, 5.0, 10.0])


@query("virial_overdensity")
def _virial(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cosmology.Cosmology()
    return spark.createDataFrame([(a, cosmology.virial_overdensity(c, a), cosmology.virial_overdensity(c, a, True)) for a in (0.2, 0.4, 0.6, 0.8, 1.0)], "a double, over_mean double, over_critical double")


@query("particle_mass", f"WITH {POINTS} SELECT round(0.3::DOUBLE * 2.7755397e11::DOUBLE * 125000 / count(*), 1) AS pmass FROM pts")
def _pmass(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = points(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.round(F.lit(0.3 * cosmology.RHO_C0 * 50.0**3) / F.col("n"), 1).alias("pmass"))
