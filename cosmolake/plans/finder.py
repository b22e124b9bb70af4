"""From particles to a catalogue: refinement, patches, object tree, gathering, cuts, unbinding, profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cosmolake.functions import halo_math
from cosmolake.functions.expr import pbc
from cosmolake.operators import grid, prefix, spatial
from cosmolake.operators.catalogue import credible_hosts, ordered
from cosmolake.operators.rounds import stored
from cosmolake.operators.spatial import AXES


@dataclass(frozen=True)
class Settings:
    """Thresholds of a run in a unit box; ``gravity`` turns mass over length into a squared velocity."""

    grid: int = 8
    per_cell: float = 4.0
    max_level: int = 8
    min_part: int = 20
    delta: float = 200.0
    max_gather: float = 0.25
    v_tune: float = 1.5
    gravity: float = 1.0
    centre: str = "com"
    main_daughter: str = "parts"
    unbind: bool = True
    overlap: float = 0.5
    hubble: float = 0.0


def patch_tree(placed: DataFrame, n: int, s: Settings) -> tuple[DataFrame, DataFrame]:
    """Patches with their objects: (patch rows with ``halo_id``, links (patch_id, parent_id)).

    A patch's main daughter goes on with its object, other daughters open new
    ones whose host is the parent's object. An object is named by the patch
    that opened it.
    """
    table = stored(grid.patch_table(placed, n, s.centre), "patches")
    inside = spatial.nearest_parent(spatial.box_parents(table, table))
    lost = table.where("level > 0").join(inside, "patch_id", "left_anti")
    links = stored(inside.union(spatial.orphan_parents(lost, table)), "links")
    mains = stored(spatial.main_daughters(links, table, s.main_daughter), "mains")
    named = table.join(links, "patch_id", "left").join(mains.select(F.col("main_id").alias("patch_id"), F.lit(True).alias("is_main")), "patch_id", "left")
    named = stored(named.withColumn("opens", F.col("parent_id").isNull() | F.col("is_main").isNull()), "named")
    at = stored(named.where("opens").select("patch_id", F.col("patch_id").alias("halo_id")), "objects")
    down = named.where("not opens").select("patch_id", "parent_id")
    frontier = at
    while True:  # one round a level: main daughters take their parent's object
        step = down.join(frontier.select(F.col("patch_id").alias("parent_id"), "halo_id"), "parent_id").select("patch_id", "halo_id")
        frontier = stored(step, "objects")
        if frontier.isEmpty():
            return named.join(at, "patch_id"), links
        at = at.union(frontier)


def find_halos(particles: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(halos, members, profiles) of particles (pid, x, y, z, vx, vy, vz, mass, ptype, u) in the periodic unit box.

    halos: idx by size, halo_id, host_id, num_sub, npart, n_bins, mass, radius,
    centre, mean velocity, r_max, v_max, r2, offsets of the most bound particle
    and of the centre of mass, overdensity, escape velocity, dispersion, angular
    momentum and its two spins, axis ratios and axes, energies, surface
    pressure, phi0, c_nfw, and number and mass of gas and stars. members:
    (halo_id, pid, d, m, ptype). profiles: :func:`prefix.full_profile`, radii
    negated up to the last unconverged one.
    """
    p = particles if "u" in particles.columns else particles.withColumn("u", F.lit(None).cast("double"))
    placed = stored(grid.patches(grid.hierarchy(p, s.grid, s.per_cell, s.max_level), s.grid), "placed")
    patch, links = patch_tree(placed, s.grid, s)
    patch = stored(patch, "tree")
    # An object's centre is its deepest patch's; its host the object of the patch above the one that opened it.
    deepest = patch.groupBy("halo_id").agg(F.max_by(F.struct(*AXES, "n_parts", "hx", "hy", "hz"), F.struct("level", "n_parts", "patch_id")).alias("c"), F.max("n_parts").alias("npart"))
    owner = patch.select(F.col("patch_id").alias("parent_id"), F.col("halo_id").alias("host_id"))
    host = patch.where("patch_id = halo_id").select("halo_id", "parent_id").join(owner, "parent_id", "left").select("halo_id", F.coalesce("host_id", F.lit(-1)).alias("host_id"))
    centre = deepest.join(host, "halo_id").select("halo_id", "host_id", "npart", *(F.col(f"c.{k}").alias(k) for k in AXES), F.greatest("c.hx", "c.hy", "c.hz").alias("radius"))
    centre = stored(centre, "centres")
    reach = spatial.gather_radius(centre, s.max_gather)
    near = spatial.gather(centre.drop("radius").join(reach, "halo_id"), p.select("pid", *AXES, "vx", "vy", "vz", "mass", "ptype", "u"), "gather_rad")
    m = near.select(
        "halo_id", F.col("b_pid").alias("pid"), F.sqrt("d2").alias("d"), F.col("b_mass").alias("m"), *(pbc(F.col(f"b_{k}") - F.col(k)).alias(f"d{k}") for k in AXES),
        *(F.col(f"b_v{k}").alias(f"v{k}") for k in AXES), F.col("b_ptype").alias("ptype"), F.col("b_u").alias("u"),
    )
    columns = m.columns
    total = p.agg(F.sum("mass").alias("_all"))
    factor = p.sparkSession.createDataFrame([(1,)], "one int").crossJoin(F.broadcast(total)).first()["_all"] or 1.0  # the mean density of the unit box
    cut = lambda x: prefix.virial_cut(x, ["pid"], s.delta, 1.0 / factor).select(*columns)
    m = stored(cut(m), "members")
    if s.unbind:
        m = stored(cut(prefix.unbind(m, ["pid"], s.min_part, s.v_tune, s.gravity, s.hubble)), "bound")
    size = m.groupBy("halo_id").agg(F.count(F.lit(1)).alias("npart"), F.max("d").alias("radius"))
    size = stored(size.where(F.col("npart") >= s.min_part), "sizes")
    m = m.join(size.select("halo_id"), "halo_id", "left_semi")
    kinds = {"gas": F.col("ptype") == 0, "star": F.col("ptype") == 4}
    by_kind = {f"{a}_{k}": F.when(is_, v).otherwise(0) for k, is_ in kinds.items() for a, v in (("n", F.lit(1)), ("m", F.col("m")))}
    prof = stored(prefix.full_profile(m, ["pid"], s.min_part, s.gravity, s.hubble, by_kind), "profiles")
    pos = centre.select("halo_id", "host_id", *AXES).join(size, "halo_id")
    hosts = stored(credible_hosts(pos, s.min_part, s.overlap), "hosts")
    subs = hosts.where("host_id >= 0").groupBy(F.col("host_id").alias("halo_id")).agg(F.count(F.lit(1)).alias("num_sub"))
    x = pos.drop("host_id").join(hosts, "halo_id").join(subs, "halo_id", "left").withColumn("num_sub", F.coalesce("num_sub", F.lit(0).cast("long")))
    x = x.join(whole_objects(m, prof, s), "halo_id").join(prefix.peaks(m, ["pid"], g=s.gravity), "halo_id")
    x = x.withColumn("c_nfw", halo_math.c_nfw(F.try_divide(F.col("v_max") * F.col("v_max") * F.col("radius"), s.gravity * F.col("mass"))))
    return ordered(x, "npart"), m, prefix.convergence_radius(prof)


def whole_objects(m: DataFrame, prof: DataFrame, s: Settings) -> DataFrame:
    """(halo_id, and what members and the outermost sphere of the profile say about an object as a whole)."""
    w = Window.partitionBy("halo_id").orderBy("bin")
    inner = {"_k": F.lag("e_kin").over(w), "_r": F.lag("r").over(w)}
    outer = [c for c in prof.columns if c not in ("halo_id", "bin", "npart", "m_in_r", "dens", "v_circ")]
    last = prof.withColumns(inner).groupBy("halo_id").agg(F.count(F.lit(1)).alias("n_bins"), F.max_by(F.struct(*outer, "_k", "_r"), "bin").alias("e"))
    last = last.select("halo_id", "n_bins", "e.*")
    y = prefix.prefix_velocity(prefix.potential(m, ["pid"]), ["pid"])
    energy = F.col("m") * (0.5 * sum((F.col(f"u_{k}") ** 2 for k in AXES), F.lit(0.0)) + F.col("phi") - F.col("phi0"))
    mean = lambda c: F.sum(F.col("m") * F.col(c)) / F.sum("m")
    whole = y.groupBy("halo_id").agg(
        F.sum("m").alias("mass"), *(mean(f"v{k}").alias(f"vel_{k}") for k in AXES), F.sqrt(sum((mean(f"d{k}") ** 2 for k in AXES), F.lit(0.0))).alias("com_offset"),
        F.min_by("d", F.struct(energy, "pid")).alias("mbp_offset"), (s.gravity * F.first("phi0")).alias("phi0"),
    )
    x = last.join(whole, "halo_id")
    l = F.sqrt(F.col("l_x") ** 2 + F.col("l_y") ** 2 + F.col("l_z") ** 2)  # noqa: E741
    x = x.withColumns({
        "spin": halo_math.spin(l, F.col("mass"), F.col("r"), s.gravity**-0.5),
        "spin_e": halo_math.energy_spin(l, F.col("mass"), F.col("e_kin") + F.col("e_pot"), s.gravity),
        "surf_p": halo_math.surface_pressure(F.col("e_kin"), F.col("_k"), F.col("r"), F.col("_r")),
    })
    return x.drop("r", "_k", "_r")
