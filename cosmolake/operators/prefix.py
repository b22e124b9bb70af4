"""Ordered-prefix operators: an object's particles by distance, and everything that runs along them.

Windows partition by object and order by distance, then by the particle's
keys, so that every result has one defined order. Per-object sequential
steps (unbinding, tensors) are grouped Arrow functions over one
object's particles; each reads a struct of plain columns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cosmolake.functions import halo_math
from cosmolake.operators.rounds import stored


def by_distance(keys: list[str], halo: str = "halo_id"):
    return Window.partitionBy(halo).orderBy("d", *keys)


def so_far(keys: list[str], halo: str = "halo_id"):
    return by_distance(keys, halo).rowsBetween(Window.unboundedPreceding, 0)


def ranked(members: DataFrame, keys: list[str]) -> DataFrame:
    """``rn``: 1-based place by distance."""
    return members.withColumn("rn", F.row_number().over(by_distance(keys)))


def enclosed(members: DataFrame, keys: list[str]) -> DataFrame:
    """``rn`` and ``m_in``: mass up to and including each particle."""
    return ranked(members, keys).withColumn("m_in", F.sum("m").over(so_far(keys)))


def potential(members: DataFrame, keys: list[str], tiny: float = 5e-16) -> DataFrame:
    """``phi``: the trapezoidal integral of M/d**2 outwards, and ``phi0``: its end plus M/d of the last particle.

    A particle at the centre adds nothing.
    """
    x = enclosed(members, keys)
    w = by_distance(keys)
    x = x.withColumn("_i", F.when(F.col("d") > tiny, F.try_divide("m_in", F.col("d") * F.col("d"))))
    before = F.coalesce(F.last("_i", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    x = x.withColumn("_step", F.when(F.col("d") > tiny, 0.5 * (F.col("_i") + before) * (F.col("d") - F.coalesce(F.lag("d").over(w), F.lit(0.0)))).otherwise(F.lit(0.0)))
    x = x.withColumn("phi", F.sum("_step").over(so_far(keys)))
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return x.withColumn("phi0", F.last("phi").over(every) + F.last(F.coalesce(F.try_divide("m_in", "d"), F.lit(0.0))).over(every)).drop("_i", "_step")


def escape_velocity(members: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    return potential(members, keys).withColumn("v_esc", F.sqrt(2 * F.abs(F.col("phi") - F.col("phi0")) * factor))


def overdensity(m_in: Column, d: Column, factor: float = 1.0) -> Column:
    return F.try_divide(m_in, 4 * math.pi / 3 * d * d * d) * factor


def virial_cut(members: DataFrame, keys: list[str], delta: float, factor: float = 1.0) -> DataFrame:
    """Particles up to the first one at which the enclosed density falls below ``delta``, that one included; all if none does."""
    x = enclosed(members, keys).withColumn("ovdens", overdensity(F.col("m_in"), F.col("d"), factor))
    cut = F.min(F.when(F.col("ovdens") < delta, F.col("rn"))).over(Window.partitionBy("halo_id"))
    return x.withColumn("_cut", cut).where("_cut is null or rn <= _cut").drop("_cut")


def virial_radius(members: DataFrame, keys: list[str], delta: float, factor: float = 1.0) -> DataFrame:
    """(halo_id, npart, r_vir, m_vir, ovdens) of the cut."""
    c = virial_cut(members, keys, delta, factor)
    top = F.max_by(F.struct("d", "m_in", "ovdens"), "rn")
    return c.groupBy("halo_id").agg(F.count(F.lit(1)).alias("npart"), top.alias("t")).select("halo_id", "npart", F.col("t.d").alias("r_vir"), F.col("t.m_in").alias("m_vir"), F.col("t.ovdens").alias("ovdens"))


def bin_count(n: Column) -> Column:
    """Number of logarithmic radial bins for n particles."""
    return F.greatest(F.lit(2), F.floor(6.2 * F.log10(n.cast("double")) - 3.5)).cast("int")


def binned(members: DataFrame, keys: list[str], min_part: int = 20) -> DataFrame:
    """``bin`` (0-based) and ``nbins``: logarithmic bins from the particle at place min_part/10 (the first off the centre) to the last; a particle on an edge goes to the bin above, the outermost to the last."""
    all_ = Window.partitionBy("halo_id")
    x = ranked(members, keys).withColumn("_n", F.count(F.lit(1)).over(all_))
    lo = F.min(F.when((F.col("rn") > min_part // 10) & (F.col("d") > 0), F.col("d"))).over(all_)
    x = x.withColumns({"nbins": bin_count(F.col("_n")), "_lo": F.coalesce(lo, F.max("d").over(all_)), "_hi": F.max("d").over(all_)})
    step = F.try_divide(F.log10("_hi") - F.log10("_lo"), F.col("nbins") - 1)
    k = F.when(F.col("d") < F.col("_lo"), F.lit(0)).when((F.col("d") >= F.col("_hi")) | (F.col("_hi") <= F.col("_lo")), F.col("nbins") - 1).otherwise(F.floor(F.try_divide(F.log10("d") - F.log10("_lo"), step)) + 1)
    x = x.withColumn("bin", F.least(k, F.col("nbins") - 1).cast("int"))
    return x.withColumn("r_edge", F.pow(F.lit(10.0), F.log10("_lo") + F.col("bin") * F.when(F.col("nbins") > 1, step).otherwise(F.lit(0.0)))).drop("_n", "_lo", "_hi")


def profile(members: DataFrame, keys: list[str], min_part: int = 20, g: float = 1.0) -> DataFrame:
    """(halo_id, bin, r, npart, m_in_r, ovdens, dens, v_circ): cumulative over bins, ``dens`` of the shell; empty bins are left out."""
    b = binned(members, keys, min_part).groupBy("halo_id", "bin").agg(F.first("r_edge").alias("r"), F.count(F.lit(1)).alias("n"), F.sum("m").alias("mass"))
    w = Window.partitionBy("halo_id").orderBy("bin")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = b.withColumns({"npart": F.sum("n").over(run), "m_in_r": F.sum("mass").over(run), "_r": F.coalesce(F.lag("r").over(w), F.lit(0.0))})
    volume = lambda r: 4 * math.pi / 3 * r * r * r
    return x.select("halo_id", "bin", "r", "npart", "m_in_r", F.try_divide("m_in_r", volume(F.col("r"))).alias("ovdens"), F.try_divide("mass", volume(F.col("r")) - volume(F.col("_r"))).alias("dens"), F.sqrt(F.try_divide(g * F.col("m_in_r"), "r")).alias("v_circ"))


def convergence_radius(prof: DataFrame) -> DataFrame:
    """Profiles with ``r`` negated up to the last unconverged bin: N/ln N/8 r/v < 0.6 of the outermost r/v."""
    all_ = Window.partitionBy("halo_id")
    last = F.max(F.struct("bin", "r", "v_circ")).over(all_)
    x = prof.withColumns({"_rl": last["r"], "_vl": last["v_circ"]})
    bad = (F.col("npart") <= 1) | (F.try_divide(F.col("npart") * F.col("r"), F.log(F.col("npart").cast("double")) * 8 * F.col("v_circ")) < F.try_divide(0.6 * F.col("_rl"), F.col("_vl")))
    x = x.withColumn("_last", F.max(F.when(bad, F.col("bin"))).over(all_))
    return x.withColumn("r", F.when(F.col("bin") <= F.col("_last"), -F.col("r")).otherwise(F.col("r"))).drop("_rl", "_vl", "_last")


def prefix_velocity(members: DataFrame, keys: list[str]) -> DataFrame:
    """``u_x, u_y, u_z``: velocity against the running mean of the prefix that ends at the particle."""
    w = so_far(keys)
    return members.withColumns({f"u_{k}": F.col(f"v{k}") - F.sum(F.col("m") * F.col(f"v{k}")).over(w) / F.sum("m").over(w) for k in "xyz"})


def integrals(members: DataFrame, keys: list[str]) -> DataFrame:
    """Per object: n, mass, mean velocity, centre of mass offset, angular momentum, tensor sums, kinetic energy, dispersion.

    Members carry m, d, the offset dx, dy, dz and the velocity vx, vy, vz; L,
    energy and dispersion take velocities against the prefix mean.
    """
    x = prefix_velocity(members, keys)
    m = F.col("m")
    u2 = F.col("u_x") * F.col("u_x") + F.col("u_y") * F.col("u_y") + F.col("u_z") * F.col("u_z")
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    cols = [F.count(F.lit(1)).alias("n"), F.sum(m).alias("mass")]
    cols += [(F.sum(m * F.col(f"v{k}")) / F.sum(m)).alias(f"vel_{k}") for k in "xyz"]
    cols += [(F.sum(m * F.col(f"d{k}")) / F.sum(m)).alias(f"com_{k}") for k in "xyz"]
    cols += [F.sum(m * (F.col(f"d{p}") * F.col(f"u_{q}") - F.col(f"d{q}") * F.col(f"u_{p}"))).alias(f"l_{k}") for k, (p, q) in cross.items()]
    cols += [F.sum(m * F.col(f"d{p}") * F.col(f"d{q}")).alias(f"t_{p}{q}") for p, q in ("xx", "yy", "zz", "xy", "yz", "xz")]
    cols += [(0.5 * F.sum(m * u2)).alias("e_kin"), F.sqrt(F.sum(m * u2) / F.sum(m)).alias("sig_v")]
    return x.groupBy("halo_id").agg(*cols)


PAIRS = ("xx", "yy", "zz", "xy", "yz", "xz")


def full_profile(members: DataFrame, keys: list[str], min_part: int = 20, g: float = 1.0, hubble: float = 0.0, sums: dict[str, Column] | None = None) -> DataFrame:
    """:func:`profile` with escape velocity, dispersion, angular momentum, axes and energies of each bin's sphere.

    ``v_esc`` is the outermost particle's. Energies are halved sums of mass
    times u**2 and of mass times phi - phi0 (times ``g``), u being the velocity
    against the prefix mean plus ``hubble`` times the offset; angular momentum
    goes without the latter. ``b``, ``c`` and the axes ``e1`` to ``e3`` are of
    the mass tensor. ``sums`` names further columns, sums of an expression over
    each sphere's particles (mass of one species, say).
    """
    x = binned(prefix_velocity(potential(members, keys), keys), keys, min_part)
    m, depth = F.col("m"), g * (F.col("phi") - F.col("phi0"))
    u2 = sum(((F.col(f"u_{k}") + hubble * F.col(f"d{k}")) ** 2 for k in "xyz"), F.lit(0.0))
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    total = {"npart": F.lit(1), "m_in_r": m, "_t": m * u2, "_w": m * depth}
    total |= {f"l_{k}": m * (F.col(f"d{p}") * F.col(f"u_{q}") - F.col(f"d{q}") * F.col(f"u_{p}")) for k, (p, q) in cross.items()}
    total |= {f"_t_{q}": m * F.col(f"d{q[0]}") * F.col(f"d{q[1]}") for q in PAIRS} | (sums or {})
    b = x.groupBy("halo_id", "bin").agg(F.first("r_edge").alias("r"), F.sum("m").alias("_m"), F.sqrt(2 * F.abs(F.max_by(depth, "rn"))).alias("v_esc"), *(F.sum(c).alias(k) for k, c in total.items()))
    w = Window.partitionBy("halo_id").orderBy("bin")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = b.withColumns({"_r": F.coalesce(F.lag("r").over(w), F.lit(0.0)), **{k: F.sum(k).over(run) for k in total}})
    x = x.withColumn("_s", halo_math.shape(*(F.col(f"_t_{q}") for q in PAIRS), F.col("npart")))
    volume = lambda r: 4 * math.pi / 3 * r * r * r
    return x.select(
        "halo_id", "bin", "r", "npart", "m_in_r", F.try_divide("m_in_r", volume(F.col("r"))).alias("ovdens"), F.try_divide("_m", volume(F.col("r")) - volume(F.col("_r"))).alias("dens"),
        F.sqrt(F.try_divide(g * F.col("m_in_r"), "r")).alias("v_circ"), "v_esc", F.sqrt(F.try_divide("_t", "m_in_r")).alias("sig_v"), "l_x", "l_y", "l_z",
        "_s.b", "_s.c", "_s.e1", "_s.e2", "_s.e3", (0.5 * F.col("_t")).alias("e_kin"), (0.5 * F.col("_w")).alias("e_pot"), *(sums or {}),
    )


def most_bound(members: DataFrame, keys: list[str]) -> DataFrame:
    """(halo_id, and the keys of the particle of least energy): mass times kinetic energy against the prefix mean plus phi - phi0."""
    x = prefix_velocity(potential(members, keys), keys)
    e = F.col("m") * (0.5 * (F.col("u_x") ** 2 + F.col("u_y") ** 2 + F.col("u_z") ** 2) + F.col("phi") - F.col("phi0"))
    return x.withColumn("_e", e).groupBy("halo_id").agg(F.min_by(F.struct(*keys), F.struct("_e", *keys)).alias("mbp")).select("halo_id", "mbp.*")


def species_integrals(members: DataFrame, keys: list[str], species: str = "species", metals: Column | None = None, g: float = 1.0) -> DataFrame:
    """:func:`integrals` of each species of an object, in the whole object's potential and against its prefix velocities.

    Further: potential energy, offset and keys of the species' most bound
    particle (``mbp_``), and its mean of ``metals`` by mass.
    """
    x = prefix_velocity(potential(members, keys), keys)
    m = F.col("m")
    depth = m * g * (F.col("phi") - F.col("phi0"))
    u2 = F.col("u_x") * F.col("u_x") + F.col("u_y") * F.col("u_y") + F.col("u_z") * F.col("u_z")
    cross = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}
    cols = [F.count(F.lit(1)).alias("n"), F.sum(m).alias("mass")]
    cols += [(F.sum(m * F.col(f"v{k}")) / F.sum(m)).alias(f"vel_{k}") for k in "xyz"]
    cols += [(F.sum(m * F.col(f"d{k}")) / F.sum(m)).alias(f"com_{k}") for k in "xyz"]
    cols += [F.sum(m * (F.col(f"d{p}") * F.col(f"u_{q}") - F.col(f"d{q}") * F.col(f"u_{p}"))).alias(f"l_{k}") for k, (p, q) in cross.items()]
    cols += [F.sum(m * F.col(f"d{p}") * F.col(f"d{q}")).alias(f"t_{p}{q}") for p, q in PAIRS]
    cols += [(0.5 * F.sum(m * u2)).alias("e_kin"), (0.5 * F.sum(depth)).alias("e_pot")]
    place = F.struct(*(F.col(f"d{k}").alias(f"mbp_d{k}") for k in "xyz"), *(F.col(k).alias(f"mbp_{k}") for k in keys))
    cols.append(F.min_by(place, F.struct(0.5 * m * u2 + depth, *keys)).alias("_p"))
    if metals is not None:
        cols.append((F.sum(m * metals) / F.sum(m)).alias("metallicity"))
    got = x.groupBy("halo_id", F.col(species).alias("species")).agg(*cols)
    return got.select(*(c for c in got.columns if c != "_p"), "_p.*")


# Sequential steps ---------------------------------------------------------------------


def unbind_once(m: np.ndarray, d: np.ndarray, v: np.ndarray, u2: np.ndarray, seed: int, v_tune: float, phi_factor: float, tiny: float = 5e-16) -> np.ndarray:
    """Which particles (by distance) one pass keeps: |v - bulk|**2 + u2 <= v_tune**2 v_esc**2, bulk being that of the kept ones so far."""
    inside = np.cumsum(m)
    off = d > tiny
    pull = np.where(off, inside / np.where(off, d, 1.0) ** 2, 0.0)
    phi = np.zeros(len(d))
    last_i = last_d = total = 0.0
    for k in range(len(d)):
        if off[k]:
            total += 0.5 * (pull[k] + last_i) * (d[k] - last_d)
            last_i = pull[k]
        last_d = d[k]
        phi[k] = total
    phi0 = total + inside[-1] / d[-1] if d[-1] > tiny else total
    escape = np.where(off, 2 * np.abs(phi - phi0) * phi_factor, 1e30)
    keep = np.zeros(len(d), bool)
    px, py, pz, mass = *(m[seed] * v[seed]), m[seed]
    started = False
    for k in range(len(d)):
        wx, wy, wz = v[k, 0] - px / mass, v[k, 1] - py / mass, v[k, 2] - pz / mass
        if wx * wx + wy * wy + wz * wz + u2[k] <= v_tune * v_tune * escape[k]:
            keep[k] = True
            if not started:
                px = py = pz = mass = 0.0
                started = True
            px += m[k] * v[k, 0]
            py += m[k] * v[k, 1]
            pz += m[k] * v[k, 2]
            mass += m[k]
    return keep


def unbound_removed(m: np.ndarray, d: np.ndarray, v: np.ndarray, u2: np.ndarray, min_part: int = 20, v_tune: float = 1.5, phi_factor: float = 1.0, max_removed: int = 3) -> np.ndarray:
    """Places of the particles left when a pass removes no more than ``max_removed``, or fewer than ``min_part`` are left."""
    at = np.arange(len(d))
    first = True
    while len(at) >= min_part:
        if first:
            inner = at[: max(1, min_part // 2)]
            speed = np.argsort((v[inner] ** 2).sum(axis=1), kind="stable")
            seed = int(speed[min(len(inner) - 1, min_part // 4)])
        else:
            seed = 0
        keep = unbind_once(m[at], d[at], v[at], u2[at], seed, v_tune, phi_factor)
        removed = len(at) - int(keep.sum())
        at, first = at[keep], False
        if removed <= max_removed:
            break
    return at


def unbind(members: DataFrame, keys: list[str], min_part: int = 20, v_tune: float = 1.5, phi_factor: float = 1.0, hubble: float = 0.0) -> DataFrame:
    """Members (halo_id, keys, d, m, dx, dy, dz, vx, vy, vz, u) without the unbound ones; ``u`` below 0 or null adds no thermal term."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["d", *keys], kind="stable")
        v = pdf[["vx", "vy", "vz"]].to_numpy(float) + hubble * pdf[["dx", "dy", "dz"]].to_numpy(float)
        u2 = 2 * np.maximum(pdf["u"].fillna(0).to_numpy(float), 0)
        return pdf.iloc[unbound_removed(pdf["m"].to_numpy(float), pdf["d"].to_numpy(float), v, u2, min_part, v_tune, phi_factor)]

    return members.groupBy("halo_id").applyInPandas(one, members.schema)


def smooth(y: np.ndarray, half: int = 1) -> np.ndarray:
    """Running means over 2*half+1 points; the ends take what there is, and fewer than three points stay as they are."""
    if len(y) < 3:
        return y
    c = np.concatenate([[0.0], np.cumsum(y)])
    k = np.arange(len(y))
    lo, hi = np.maximum(k - half, 0), np.minimum(k + half + 1, len(y))
    return (c[hi] - c[lo]) / (hi - lo)


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, out: str, half: int = 1, rounds: int = 1) -> DataFrame:
    """``df`` with ``out``: running means of ``value`` along ``order`` within ``keys``, ``rounds`` times, as :func:`smooth`."""
    w = Window.partitionBy(*keys)
    near = w.orderBy(order).rowsBetween(-half, half)
    x = df.withColumn(out, F.col(value).cast("double"))
    for _ in range(rounds):
        x = x.withColumn(out, F.when(F.count(F.lit(1)).over(w) < 3, F.col(out)).otherwise(F.avg(out).over(near)))
    return x


def peak(x: np.ndarray, y: np.ndarray, rounds: int) -> tuple[float, float]:
    """Place and height of a curve's maximum: the mean of the raw points at the maxima of the smoothed curve found from the left and, past its middle, from the right."""
    if not len(x):
        return float("nan"), float("nan")
    raw = y
    for _ in range(rounds):
        y = smooth(y)
    left = int(y.argmax())
    half = y[(left + len(y)) // 2 :: -1]
    right = (left + len(y)) // 2 - int(half.argmax())
    return float((x[left] + x[right]) / 2), float((raw[left] + raw[right]) / 2)


def _peak(df: DataFrame, value: str, rounds: int, place: str, height: str) -> DataFrame:
    """(halo_id, place, height): :func:`peak` of ``value`` along the rows (halo_id, idx, d)."""
    x = smoothed(df, ["halo_id"], "idx", value, "_s", rounds=rounds)
    w = Window.partitionBy("halo_id")
    x = x.withColumns({"_n": F.count(F.lit(1)).over(w), "_left": F.max(F.struct("_s", (-F.col("idx")).alias("i"))).over(w)})
    left = -F.col("_left.i")
    g = x.groupBy("halo_id").agg(
        F.max(F.when(F.col("idx") == left, F.struct("d", value))).alias("a"),
        F.max(F.when(F.col("idx") <= F.floor((left + F.col("_n")) / 2), F.struct("_s", "idx", "d", value))).alias("b"),
    )
    return g.select("halo_id", ((F.col("a.d") + F.col("b.d")) / 2).alias(place), ((F.col("a")[value] + F.col("b")[value]) / 2).alias(height))


def peaks(members: DataFrame, keys: list[str], ignore: int = 5, g: float = 1.0) -> DataFrame:
    """(halo_id, r_max, v_max, r2): peaks of the circular velocity and of r**2 times the local density, without the innermost particles; NaN where none are left."""
    order = Window.partitionBy("halo_id").orderBy("d", *keys)
    x = members.select(*dict.fromkeys(["halo_id", "d", "m", *keys])).withColumns({
        "_in": F.sum(F.col("m").cast("double")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        "_before": F.coalesce(F.lag("d").over(order), F.lit(0)),
    })
    d = F.col("d").cast("double")
    shell = 4 * math.pi / 3 * (F.pow(d, F.lit(3)) - F.pow(F.col("_before").cast("double"), F.lit(3)))
    x = x.where("d > 0").withColumn("idx", F.row_number().over(order) - 1 - ignore).where("idx >= 0")
    x = x.select("halo_id", "idx", d.alias("d"), (g * F.col("_in") / d).alias("v2"), F.when(shell > 0, F.col("m") / shell * d * d).otherwise(0.0).alias("q"))
    x = stored(x, "curves")
    every = members.select("halo_id").distinct()
    found = every.join(_peak(x, "v2", 1, "r_max", "_top"), "halo_id", "left").join(_peak(x, "q", 3, "r2", "_q"), "halo_id", "left")
    nan = F.lit(float("nan"))
    return found.select("halo_id", F.coalesce("r_max", nan).alias("r_max"), F.coalesce(F.when(F.col("_top") >= 0, F.sqrt("_top")), nan).alias("v_max"), F.coalesce("r2", nan).alias("r2"))


def shell_dispersions(members: DataFrame, keys: list[str], min_part: int = 20) -> DataFrame:
    """(halo_id, bin, n, mean_r, sig_r, sig_t): means and sample dispersions of radial and tangential velocity per shell."""
    x = binned(members, keys, min_part)
    vr = (F.col("dx") * F.col("vx") + F.col("dy") * F.col("vy") + F.col("dz") * F.col("vz")) / F.col("d")
    v2 = F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2
    x = x.where("d > 0").withColumn("_vr", vr).withColumn("_vt", F.sqrt(F.greatest(v2 - F.col("_vr") ** 2, F.lit(0.0))))
    return x.groupBy("halo_id", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_vr").alias("mean_r"), F.stddev_samp("_vr").alias("sig_r"), F.stddev_samp("_vt").alias("sig_t"))


def disk_kappa(members: DataFrame, keys: list[str], min_part: int = 20) -> DataFrame:
    """(halo_id, bin, kappa): share of rotation about the cumulative angular momentum in the kinetic energy inside each bin's edge."""
    x = binned(members, keys, min_part).where("d > 0")
    j = {"x": "dy * vz - dz * vy", "y": "dz * vx - dx * vz", "z": "dx * vy - dy * vx"}
    x = x.withColumns({f"_j{k}": F.expr(e) for k, e in j.items()})
    per = x.groupBy("halo_id", "bin").agg(*(F.sum(F.col("m") * F.col(f"_j{k}")).alias(f"_l{k}") for k in "xyz"))
    run = Window.partitionBy("halo_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    axis = per.select("halo_id", "bin", *(F.sum(f"_l{k}").over(run).alias(f"_l{k}") for k in "xyz"))
    x = x.join(axis, ["halo_id", "bin"])
    norm = F.sqrt(F.col("_lx") ** 2 + F.col("_ly") ** 2 + F.col("_lz") ** 2)
    spin = (F.col("_jx") * F.col("_lx") + F.col("_jy") * F.col("_ly") + F.col("_jz") * F.col("_lz")) / norm
    x = x.withColumns({"_rot": 0.5 * F.col("m") * F.pow(spin / F.col("d"), 2), "_kin": 0.5 * F.col("m") * (F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)})
    sums = x.groupBy("halo_id", "bin").agg(F.sum("_rot").alias("_rot"), F.sum("_kin").alias("_kin"))
    return sums.select("halo_id", "bin", (F.sum("_rot").over(run) / F.sum("_kin").over(run)).alias("kappa"))


def density_upturn(prof: DataFrame, rise: float = 1.0, most: int = 2) -> DataFrame:
    """(halo_id, r_edge): where a profile's shell density has risen by ``rise`` for more than ``most`` bins running; null if nowhere."""
    w = Window.partitionBy("halo_id").orderBy("bin")
    x = prof.withColumn("_up", F.col("dens") > rise * F.lag("dens").over(w))
    run = x.withColumn("_g", F.sum(F.when(F.col("_up"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("_k", F.sum(F.when(F.col("_up"), 1).otherwise(0)).over(Window.partitionBy("halo_id", "_g").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("halo_id").agg(F.min(F.when(F.col("_k") > most, F.col("r"))).alias("r_edge"))


def every_nth(members: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """The potential at every n-th particle."""
    return potential(members, keys).where(F.col("rn") % n == 0)
