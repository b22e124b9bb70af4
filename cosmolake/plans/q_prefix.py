"""Queries: ordered prefixes of an object's particles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.functions import halo_math
from cosmolake.operators import prefix as p
from cosmolake.operators.catalogue import keep_ids
from cosmolake.plans.registry import query
from cosmolake.plans.views import MEMBERS, members
from cosmolake.session import table

KEYS = ["oid", "lno", "part", "m"]
ORDER = "PARTITION BY halo_id ORDER BY d, oid, lno, part, m"
PI43 = repr(4 * math.pi / 3)

#: Enclosed mass, potential and density in SQL.
RUN = f"""{MEMBERS},
 a AS (SELECT *, row_number() OVER w AS rn, sum(m) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m_in FROM memb WINDOW w AS ({ORDER})),
 b AS (SELECT *, m_in / (d * d) AS i FROM a),
 c AS (SELECT *, 0.5 * (i + coalesce(lag(i) OVER (PARTITION BY halo_id ORDER BY rn), 0)) * (d - coalesce(lag(d) OVER (PARTITION BY halo_id ORDER BY rn), 0)) AS step FROM b),
 run AS (SELECT *, sum(step) OVER (PARTITION BY halo_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS phi, m_in / ({PI43} * d * d * d) AS ovdens FROM c),
 fin AS (SELECT *, last_value(phi) OVER e + last_value(m_in / d) OVER e AS phi0 FROM run WINDOW e AS (PARTITION BY halo_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir)


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with an offset of length d and a velocity."""
    x = members(spark, sf_dir)
    t, f = (F.col("oid") % 628) / 100.0, (F.col("part") % 314) / 100.0
    x = x.withColumns({"dx": F.col("d") * F.sin(f) * F.cos(t), "dy": F.col("d") * F.sin(f) * F.sin(t), "dz": F.col("d") * F.cos(f)})
    return x.withColumns({"vx": (F.col("oid") % 101) / 10.0 - 5, "vy": (F.col("part") % 97) / 10.0 - 5, "vz": (F.col("oid") % 89) / 10.0 - 4})


MOVING = f"""{MEMBERS}, mv0 AS (SELECT *, (oid % 628) / 100.0::DOUBLE AS t, (part % 314) / 100.0::DOUBLE AS f FROM memb),
 mv AS (SELECT halo_id, oid, lno, part, d, m, species, d * sin(f) * cos(t) AS dx, d * sin(f) * sin(t) AS dy, d * cos(f) AS dz,
  (oid % 101) / 10.0::DOUBLE - 5 AS vx, (part % 97) / 10.0::DOUBLE - 5 AS vy, (oid % 89) / 10.0::DOUBLE - 4 AS vz FROM mv0),
 pv AS (SELECT *, vx - sum(m * vx) OVER w / sum(m) OVER w AS ux, vy - sum(m * vy) OVER w / sum(m) OVER w AS uy, vz - sum(m * vz) OVER w / sum(m) OVER w AS uz
  FROM mv WINDOW w AS ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("prefix_mass", f"WITH {RUN} SELECT halo_id, rn, round(m_in, 2) AS m_in FROM run")
def _mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.enclosed(sized(spark, sf_dir), KEYS).select("halo_id", F.col("rn").cast("long").alias("rn"), F.round("m_in", 2).alias("m_in"))


@query("prefix_potential", f"WITH {RUN} SELECT halo_id, rn, round(phi / 1000, 4) AS phi, round(phi0 / 1000, 4) AS phi0 FROM fin")
def _potential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.potential(sized(spark, sf_dir), KEYS).select("halo_id", F.col("rn").cast("long").alias("rn"), F.round(F.col("phi") / 1000, 4).alias("phi"), F.round(F.col("phi0") / 1000, 4).alias("phi0"))


@query("potential_samples", f"WITH {RUN} SELECT halo_id, rn, round(phi / 1000, 4) AS phi FROM fin WHERE rn % 20 = 0")
def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.every_nth(sized(spark, sf_dir), KEYS, 20).select("halo_id", F.col("rn").cast("long").alias("rn"), F.round(F.col("phi") / 1000, 4).alias("phi"))


@query("escape_velocity", f"WITH {RUN} SELECT halo_id, rn, round(sqrt(2 * abs(phi - phi0)), 3) AS v_esc FROM fin")
def _escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.escape_velocity(sized(spark, sf_dir), KEYS).select("halo_id", F.col("rn").cast("long").alias("rn"), F.round("v_esc", 3).alias("v_esc"))


CUT = f"{RUN}, k AS (SELECT *, min(rn) FILTER (WHERE ovdens < 200.5) OVER (PARTITION BY halo_id) AS cut FROM run), kept AS (SELECT * FROM k WHERE cut IS NULL OR rn <= cut)"


@query("virial_cut", f"WITH {CUT} SELECT halo_id, rn, round(ovdens, 4) AS ovdens FROM kept")
def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.virial_cut(sized(spark, sf_dir), KEYS, 200.5).select("halo_id", F.col("rn").cast("long").alias("rn"), F.round("ovdens", 4).alias("ovdens"))


@query("virial_radius", f"WITH {CUT} SELECT halo_id, count(*) AS npart, round(arg_max(d, rn), 6) AS r_vir, round(arg_max(m_in, rn), 2) AS m_vir FROM kept GROUP BY halo_id")
def _radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.virial_radius(sized(spark, sf_dir), KEYS, 200.5).select("halo_id", "npart", F.round("r_vir", 6).alias("r_vir"), F.round("m_vir", 2).alias("m_vir"))


BINS = f"""{RUN},
 g AS (SELECT *, greatest(2, floor(6.2 * log10(count(*) OVER (PARTITION BY halo_id)) - 3.5))::INT AS nbins,
       min(CASE WHEN rn > 2 AND d > 0 THEN d END) OVER (PARTITION BY halo_id) AS lo, max(d) OVER (PARTITION BY halo_id) AS hi FROM run),
 h AS (SELECT *, (log10(hi) - log10(lo)) / (nbins - 1) AS w FROM g),
 bn AS (SELECT *, least(CASE WHEN d < lo THEN 0 WHEN d >= hi THEN nbins - 1 ELSE floor((log10(d) - log10(lo)) / w) + 1 END, nbins - 1)::INT AS bin FROM h),
 pb AS (SELECT halo_id, bin, power(10, log10(any_value(lo)) + bin * any_value(w)) AS r, count(*) AS n, sum(m) AS mass FROM bn GROUP BY halo_id, bin),
 prof AS (SELECT halo_id, bin, r, sum(n) OVER q AS npart, sum(mass) OVER q AS m_in_r, mass, coalesce(lag(r) OVER (PARTITION BY halo_id ORDER BY bin), 0) AS r0
          FROM pb WINDOW q AS (PARTITION BY halo_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("radial_profile", f"WITH {BINS} SELECT halo_id, bin, round(r, 6) AS r, npart::BIGINT AS npart, round(m_in_r, 2) AS m_in_r, round(mass / ({PI43} * (r * r * r - r0 * r0 * r0)), 4) AS dens, round(sqrt(m_in_r / r), 5) AS v_circ FROM prof")
def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.profile(sized(spark, sf_dir), KEYS).select("halo_id", "bin", F.round("r", 6).alias("r"), "npart", F.round("m_in_r", 2).alias("m_in_r"), F.round("dens", 4).alias("dens"), F.round("v_circ", 5).alias("v_circ"))


@query("convergence_radius", f"WITH {BINS}, v AS (SELECT *, sqrt(m_in_r / r) AS vc FROM prof), l AS (SELECT *, last_value(r) OVER e AS rl, last_value(vc) OVER e AS vl FROM v WINDOW e AS (PARTITION BY halo_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), u AS (SELECT *, max(CASE WHEN npart <= 1 OR npart / ln(npart) / 8 * r / vc < 0.6 * rl / vl THEN bin END) OVER (PARTITION BY halo_id) AS last_bad FROM l) SELECT halo_id, bin, round(CASE WHEN bin <= last_bad THEN -r ELSE r END, 6) AS r FROM u")
def _convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.convergence_radius(p.profile(sized(spark, sf_dir), KEYS)).select("halo_id", "bin", F.round("r", 6).alias("r"))


#: The same bins and potential over moving members.
KINEMATICS = MOVING + BINS.removeprefix(MEMBERS).replace("FROM memb", "FROM pv") + """,
 kin AS (SELECT *, last_value(phi) OVER e + last_value(m_in / d) OVER e AS phi0 FROM bn WINDOW e AS (PARTITION BY halo_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""
RUNNING = "WINDOW q AS (PARTITION BY halo_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("full_radial_profile", f"WITH {KINEMATICS}, kb AS (SELECT halo_id, bin, any_value(r) AS r, count(*) AS n, sum(m) AS mass, arg_max(phi - phi0, rn) AS up, sum(m * (ux * ux + uy * uy + uz * uz)) AS t, sum(m * (phi - phi0)) AS w, sum(m * (dy * uz - dz * uy)) AS lx, sum(m * (dz * ux - dx * uz)) AS ly, sum(m * (dx * uy - dy * ux)) AS lz, sum(CASE WHEN species = 'R' THEN m ELSE 0 END) AS mr FROM (SELECT *, power(10, log10(lo) + bin * w) AS r FROM kin) GROUP BY halo_id, bin) SELECT halo_id, bin, round(r, 6) AS r, (sum(n) OVER q)::BIGINT AS npart, round(sum(mass) OVER q, 2) AS m_in_r, round(sqrt(2 * abs(up)), 3) AS v_esc, round(sqrt(sum(t) OVER q / sum(mass) OVER q), 7) AS sig_v, round(sum(lx) OVER q / sum(mass) OVER q, 6) AS l_x, round(sum(ly) OVER q / sum(mass) OVER q, 6) AS l_y, round(sum(lz) OVER q / sum(mass) OVER q, 6) AS l_z, round(0.5 * sum(t) OVER q / sum(mass) OVER q, 7) AS e_kin, round(0.5 * sum(w) OVER q / sum(mass) OVER q / 1000, 4) AS e_pot, round(sum(mr) OVER q, 2) AS m_r FROM kb {RUNNING}")
def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = p.full_profile(moving(spark, sf_dir), KEYS, sums={"m_r": F.when(F.col("species") == "R", F.col("m")).otherwise(0.0)})
    per = lambda c: F.col(c) / F.col("m_in_r")
    return x.select(
        "halo_id", "bin", F.round("r", 6).alias("r"), "npart", F.round("m_in_r", 2).alias("m_in_r"), F.round("v_esc", 3).alias("v_esc"), F.round("sig_v", 7).alias("sig_v"),
        *(F.round(per(f"l_{k}"), 6).alias(f"l_{k}") for k in "xyz"), F.round(per("e_kin"), 7).alias("e_kin"), F.round(per("e_pot") / 1000, 4).alias("e_pot"), F.round("m_r", 2).alias("m_r"),
    )


@query("halo_integrals", f"WITH {MOVING} SELECT halo_id, count(*) AS n, round(sum(m), 2) AS mass, round(sum(m * vx) / sum(m), 8) AS vel_x, round(sum(m * dz) / sum(m), 7) AS com_z, round(sum(m * (dx * uy - dy * ux)) / sum(m), 6) AS l_z, round(sum(m * dx * dy) / sum(m), 5) AS t_xy, round(0.5 * sum(m * (ux * ux + uy * uy + uz * uz)) / sum(m), 7) AS e_kin, round(sqrt(sum(m * (ux * ux + uy * uy + uz * uz)) / sum(m)), 7) AS sig_v FROM pv GROUP BY halo_id")
def _integrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = p.integrals(moving(spark, sf_dir), KEYS)
    per = lambda c: F.col(c) / F.col("mass")
    return x.select("halo_id", "n", F.round("mass", 2).alias("mass"), F.round("vel_x", 8).alias("vel_x"), F.round("com_z", 7).alias("com_z"), F.round(per("l_z"), 6).alias("l_z"), F.round(per("t_xy"), 5).alias("t_xy"), F.round(per("e_kin"), 7).alias("e_kin"), F.round("sig_v", 7).alias("sig_v"))


@query("species_integrals", f"WITH {MOVING} SELECT halo_id, species, count(*) AS n, round(sum(m), 2) AS mass, round(sum(m * vx) / sum(m), 8) AS vel_x, round(avg(d), 7) AS mean_d FROM mv GROUP BY halo_id, species")
def _species(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("m")
    return moving(spark, sf_dir).groupBy("halo_id", "species").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(m), 2).alias("mass"), F.round(F.sum(m * F.col("vx")) / F.sum(m), 8).alias("vel_x"), F.round(F.avg("d"), 7).alias("mean_d"))


@query("most_bound_particle", f"WITH {KINEMATICS}, e AS (SELECT *, m * (0.5 * (ux * ux + uy * uy + uz * uz) + phi - phi0) AS energy FROM kin) SELECT halo_id, oid, lno, part, m FROM e QUALIFY row_number() OVER (PARTITION BY halo_id ORDER BY energy, oid, lno, part, m) = 1")
def _bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.most_bound(moving(spark, sf_dir), KEYS)


@query("species_most_bound", f"WITH {KINEMATICS}, e AS (SELECT *, 0.5 * m * (ux * ux + uy * uy + uz * uz) + m * (phi - phi0) AS energy FROM kin) SELECT halo_id, species, count(*) AS n, round(sum(m * (dx * uy - dy * ux)) / sum(m), 6) AS l_z, round(0.5 * sum(m * (ux * ux + uy * uy + uz * uz)) / sum(m), 7) AS e_kin, round(0.5 * sum(m * (phi - phi0)) / sum(m) / 1000, 4) AS e_pot, round(sum(m * (part % 7)) / sum(m), 8) AS metallicity, arg_min(oid, (energy, oid, lno, part, m)) AS mbp_oid, arg_min(lno, (energy, oid, lno, part, m)) AS mbp_lno, round(arg_min(dx, (energy, oid, lno, part, m)), 7) AS mbp_dx FROM e GROUP BY halo_id, species")
def _species_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = p.species_integrals(moving(spark, sf_dir), KEYS, metals=F.col("part") % 7)
    per = lambda c: F.col(c) / F.col("mass")
    return x.select("halo_id", "species", "n", F.round(per("l_z"), 6).alias("l_z"), F.round(per("e_kin"), 7).alias("e_kin"), F.round(per("e_pot") / 1000, 4).alias("e_pot"), F.round("metallicity", 8).alias("metallicity"), "mbp_oid", "mbp_lno", F.round("mbp_dx", 7).alias("mbp_dx"))


@query("shell_dispersions", f"WITH {KINEMATICS}, v AS (SELECT *, (dx * vx + dy * vy + dz * vz) / d AS vr, vx * vx + vy * vy + vz * vz AS v2 FROM bn WHERE d > 0) SELECT halo_id, bin, count(*) AS n, round(avg(vr), 7) AS mean_r, round(stddev_samp(vr), 6) AS sig_r, round(stddev_samp(sqrt(greatest(v2 - vr * vr, 0))), 6) AS sig_t FROM v GROUP BY halo_id, bin")
def _shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = p.shell_dispersions(moving(spark, sf_dir), KEYS)
    return x.select("halo_id", "bin", "n", F.round("mean_r", 7).alias("mean_r"), F.round("sig_r", 6).alias("sig_r"), F.round("sig_t", 6).alias("sig_t"))


@query("disk_kappa", f"WITH {KINEMATICS}, j AS (SELECT *, dy * vz - dz * vy AS jx, dz * vx - dx * vz AS jy, dx * vy - dy * vx AS jz FROM bn WHERE d > 0), per AS (SELECT halo_id, bin, sum(m * jx) AS lx, sum(m * jy) AS ly, sum(m * jz) AS lz FROM j GROUP BY halo_id, bin), ax AS (SELECT halo_id, bin, sum(lx) OVER q AS lx, sum(ly) OVER q AS ly, sum(lz) OVER q AS lz FROM per {RUNNING}), k AS (SELECT halo_id, bin, sum(0.5 * m * power((jx * lx + jy * ly + jz * lz) / sqrt(lx * lx + ly * ly + lz * lz) / d, 2)) AS rot, sum(0.5 * m * (vx * vx + vy * vy + vz * vz)) AS kin FROM j JOIN ax USING (halo_id, bin) GROUP BY halo_id, bin) SELECT halo_id, bin, round(sum(rot) OVER q / sum(kin) OVER q, 8) AS kappa FROM k {RUNNING}")
def _kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.disk_kappa(moving(spark, sf_dir), KEYS).withColumn("kappa", F.round("kappa", 8))


@query("density_upturn", f"WITH {BINS}, u AS (SELECT *, coalesce(mass / (r * r * r - r0 * r0 * r0) > lag(mass / (r * r * r - r0 * r0 * r0)) OVER (PARTITION BY halo_id ORDER BY bin), false) AS up FROM prof), gr AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY halo_id ORDER BY bin) AS run FROM u), k AS (SELECT *, sum(up::INT) OVER (PARTITION BY halo_id, run ORDER BY bin) AS k FROM gr) SELECT halo_id, round(min(r) FILTER (WHERE k > 1), 6) AS r_edge FROM k GROUP BY halo_id")
def _upturn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.density_upturn(p.profile(sized(spark, sf_dir), KEYS), most=1).select("halo_id", F.round("r_edge", 6).alias("r_edge"))


@query("unbinding")
def _unbinding(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = moving(spark, sf_dir).withColumns({"u": F.lit(None).cast("double"), **{f"v{k}": F.col(f"v{k}") * 60 for k in "xyz"}})
    return p.unbind(x, KEYS).groupBy("halo_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("m"), 2).alias("mass"))


#: Smoothed curves by idx; the last maximum up to the middle between the first one and the end is the one from the right.
PEAKS = f"""{MEMBERS},
 a AS (SELECT *, row_number() OVER w AS rn, sum(m::DOUBLE) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m_in, coalesce(lag(d) OVER w, 0) AS b FROM memb WINDOW w AS ({ORDER})),
 c AS (SELECT halo_id, row_number() OVER (PARTITION BY halo_id ORDER BY rn) - 6 AS idx, d, m_in / d AS v2, CASE WHEN d > b THEN m / ({PI43} * (d * d * d - b * b * b)) * d * d ELSE 0 END AS q FROM a WHERE d > 0),
 e AS (SELECT *, count(*) OVER (PARTITION BY halo_id) AS n FROM c WHERE idx >= 0),
 s1 AS (SELECT *, CASE WHEN n < 3 THEN v2 ELSE avg(v2) OVER z END AS sv, CASE WHEN n < 3 THEN q ELSE avg(q) OVER z END AS q1 FROM e WINDOW z AS (PARTITION BY halo_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 s2 AS (SELECT *, CASE WHEN n < 3 THEN q1 ELSE avg(q1) OVER z END AS q2 FROM s1 WINDOW z AS (PARTITION BY halo_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 s3 AS (SELECT *, CASE WHEN n < 3 THEN q2 ELSE avg(q2) OVER z END AS q3 FROM s2 WINDOW z AS (PARTITION BY halo_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 l AS (SELECT *, first_value(idx) OVER (PARTITION BY halo_id ORDER BY sv DESC, idx) AS lv, first_value(idx) OVER (PARTITION BY halo_id ORDER BY q3 DESC, idx) AS lq FROM s3),
 r AS (SELECT *, row_number() OVER (PARTITION BY halo_id ORDER BY CASE WHEN idx <= (lv + n) // 2 THEN 0 ELSE 1 END, sv DESC, idx DESC) AS kv,
              row_number() OVER (PARTITION BY halo_id ORDER BY CASE WHEN idx <= (lq + n) // 2 THEN 0 ELSE 1 END, q3 DESC, idx DESC) AS kq FROM l)"""


@query("profile_peaks", f"WITH {PEAKS} SELECT halo_id, round((max(d) FILTER (WHERE idx = lv) + max(d) FILTER (WHERE kv = 1)) / 2, 6) AS r_max, round(sqrt((max(v2) FILTER (WHERE idx = lv) + max(v2) FILTER (WHERE kv = 1)) / 2), 6) AS v_max, round((max(d) FILTER (WHERE idx = lq) + max(d) FILTER (WHERE kq = 1)) / 2, 6) AS r2 FROM r GROUP BY halo_id")
def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p.peaks(sized(spark, sf_dir), KEYS).select("halo_id", *(F.round(c, 6).alias(c) for c in ("r_max", "v_max", "r2")))


@query("halo_shapes")
def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = p.integrals(moving(spark, sf_dir), KEYS)
    s = halo_math.shape(*(F.col(f"t_{k}") for k in ("xx", "yy", "zz", "xy", "yz", "xz")), F.col("n"))
    x = x.withColumn("s", s)
    l = F.sqrt(F.col("l_x") ** 2 + F.col("l_y") ** 2 + F.col("l_z") ** 2)  # noqa: E741
    return x.select("halo_id", F.round("s.b", 8).alias("b"), F.round("s.c", 8).alias("c"), F.round(halo_math.spin(l, F.col("mass"), F.lit(51.0)), 10).alias("spin"), F.round(halo_math.energy_spin(l, F.col("mass"), F.col("e_kin")), 12).alias("spin_e"))


@query("shape_profile")
def _shape_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative tensors of each species by bin, standard and reduced."""
    x = p.binned(moving(spark, sf_dir), KEYS).where("d > 0")
    pairs = ("xx", "yy", "zz", "xy", "yz", "xz")
    for name, weight in (("s", F.col("m")), ("r", F.col("m") / (F.col("d") * F.col("d")))):
        x = x.withColumns({f"{name}_{q}": weight * F.col(f"d{q[0]}") * F.col(f"d{q[1]}") for q in pairs})
    g = x.groupBy("halo_id", "species", "bin").agg(F.count(F.lit(1)).alias("n"), *(F.sum(f"{t}_{q}").alias(f"{t}_{q}") for t in "sr" for q in pairs))
    run = p.Window.partitionBy("halo_id", "species").orderBy("bin").rowsBetween(p.Window.unboundedPreceding, 0)
    g = g.select("halo_id", "species", "bin", F.sum("n").over(run).alias("n"), *(F.sum(f"{t}_{q}").over(run).alias(f"{t}_{q}") for t in "sr" for q in pairs))
    for t in "sr":
        g = g.withColumn(t, halo_math.shape(*(F.col(f"{t}_{q}") for q in pairs), F.col("n")))
    return g.select("halo_id", "species", "bin", "n", *(F.round(f"{t}.{k}", 7).alias(f"{t}_{k}") for t in "sr" for k in "bc"))


@query("nfw_concentration")
def _nfw(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = p.peaks(sized(spark, sf_dir), KEYS).join(p.virial_radius(sized(spark, sf_dir), KEYS, 200.5), "halo_id")
    ratio = F.col("v_max") * F.col("v_max") / (F.col("m_vir") / F.col("r_vir"))
    return x.select("halo_id", F.round(halo_math.c_nfw(ratio), 6).alias("c_nfw"))


@query("r1_concentration")
def _r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-moment radius of each profile and its concentration."""
    x = p.profile(sized(spark, sf_dir), KEYS)
    w = p.Window.partitionBy("halo_id").orderBy("bin")
    dr = F.col("r") - F.coalesce(F.lag("r").over(w), F.lit(0.0))
    x = x.withColumn("_w", 4 * math.pi * F.pow("r", F.lit(3)) * F.col("dens") * dr)
    r1 = x.groupBy("halo_id").agg(F.sum("_w").alias("_w"), F.max("m_in_r").alias("m"), F.max("r").alias("rv"))
    return r1.select("halo_id", F.round(F.col("_w") / F.col("m"), 8).alias("r1"), F.round(halo_math.c_r1(F.col("_w") / F.col("m") / F.col("rv")), 6).alias("c_r1"))


@query("smoothed_profile", f"WITH {BINS} SELECT halo_id, bin, round(avg(m_in_r) OVER (PARTITION BY halo_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 5) AS smooth3, round(avg(m_in_r) OVER (PARTITION BY halo_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS smooth5 FROM prof")
def _smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = p.smoothed(p.profile(sized(spark, sf_dir), KEYS), ["halo_id"], "bin", "m_in_r", "smooth3")
    x = p.smoothed(x, ["halo_id"], "bin", "m_in_r", "smooth5", half=2)
    return x.select("halo_id", "bin", *(F.round(c, 5).alias(c) for c in ("smooth3", "smooth5")))


@query("profiles_of_listed_halos", f"WITH {BINS} SELECT halo_id, bin, round(r, 6) AS r, npart::BIGINT AS npart FROM prof WHERE halo_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("halo_id"))
    return keep_ids(p.profile(sized(spark, sf_dir), KEYS), ids).select("halo_id", "bin", F.round("r", 6).alias("r"), "npart")
