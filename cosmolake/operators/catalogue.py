"""Catalogue operators: selections, joins by id and host, checks, set operations, orders, histories along time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cosmolake.functions.expr import distance2, serial_id
from cosmolake.operators.rounds import stored

# Selections ---------------------------------------------------------------


def one_species(particles: DataFrame, ptype: int) -> DataFrame:
    return particles.where(F.col("ptype") == ptype)


def high_resolution(particles: DataFrame) -> DataFrame:
    """Gas (0), the finest dark matter (1) and stars (4)."""
    return particles.where(F.col("ptype").isin(0, 1, 4))


def clean_ptype(particles: DataFrame) -> DataFrame:
    """A missing species, or one outside 0 to 5, becomes 1."""
    return particles.withColumn("ptype", F.when(F.col("ptype").between(0, 5), F.col("ptype")).otherwise(F.lit(1)))


def in_sphere(rows: DataFrame, centre: tuple[float, float, float], radius: float, box: float | None = 1.0, closed: bool = False) -> DataFrame:
    """Rows in a sphere; ``box`` None ignores periodicity, ``closed`` takes the surface too."""
    d2 = distance2([F.col(c) for c in "xyz"], [F.lit(float(c)) for c in centre], box)
    return rows.where(d2 <= radius * radius if closed else d2 < radius * radius)


def at_least(halos: DataFrame, npart: int) -> DataFrame:
    return halos.where(F.col("npart") >= npart)


def mass_window(halos: DataFrame, low: float, high: float) -> DataFrame:
    return halos.where((F.col("mass") >= low) & (F.col("mass") < high))


def first_n(halos: DataFrame, n: int) -> DataFrame:
    """The first n objects of the catalogue order: npart down, then id."""
    return halos.orderBy(F.desc("npart"), "halo_id").limit(n)


def keep_ids(rows: DataFrame, ids: DataFrame, key: str = "halo_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def remove_ids(rows: DataFrame, ids: DataFrame, key: str = "halo_id") -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def random_share(particles: DataFrame, share: float, seed: int = 42, key: str = "pid") -> DataFrame:
    """A reproducible share of the particles, by a hash of their id."""
    return particles.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def unit_cube(particles: DataFrame) -> DataFrame:
    """Positions scaled into [0, 1) by the common extent of all three axes."""
    lo, hi = F.least(*(F.min(c) for c in "xyz")).alias("_lo"), F.greatest(*(F.max(c) for c in "xyz")).alias("_hi")
    x = particles.crossJoin(F.broadcast(particles.agg(lo, hi)))  # one row by construction
    scaled = {c: F.coalesce((F.col(c) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0)) for c in "xyz"}
    return x.withColumns({c: v - F.floor(v) for c, v in scaled.items()}).drop("_lo", "_hi")


def unique_ids(halos: DataFrame, snap: Column) -> DataFrame:
    """Serial ids; a host of -1 becomes 0."""
    return halos.withColumns({"haloid": serial_id(snap, F.col("halo_id")), "hostid": F.when(F.col("host_id") < 0, F.lit(0)).otherwise(serial_id(snap, F.col("host_id")))})


def rows_by_id(wanted: DataFrame, halos: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The named columns for each wanted (snap, halo_id), 0 where the catalogue lacks it."""
    return wanted.join(halos.select(*keys, *columns), keys, "left").fillna(0, columns)


def sub_halos(halos: DataFrame, host: int, inner: float | None = None, outer: float | None = None) -> DataFrame:
    """Objects that point at a host, or that lie between multiples of its radius (no periodicity)."""
    if inner is None:
        return halos.where(F.col("host_id") == host)
    h = halos.where(F.col("halo_id") == host).select(*(F.col(c).alias(f"_{c}") for c in ("x", "y", "z", "radius")))
    d2 = distance2([F.col(c) for c in "xyz"], [F.col(f"_{c}") for c in "xyz"], None)
    near = halos.where(F.col("halo_id") != host).join(F.broadcast(h), F.lit(True))  # one host row by construction
    return near.where((d2 >= F.pow(inner * F.col("_radius"), 2)) & (d2 <= F.pow(outer * F.col("_radius"), 2))).drop("_x", "_y", "_z", "_radius")


def species_counts(particles: DataFrame, key: str) -> DataFrame:
    return particles.groupBy(key).agg(F.count_if(F.col("ptype") == 0).alias("n_gas"), F.count_if(F.col("ptype") == 4).alias("n_star"), F.count(F.lit(1)).alias("n_all"))


# Aggregations and checks ------------------------------------------------------


def species_mass(members: DataFrame, species: list[str], key: str = "halo_id") -> DataFrame:
    """Mass of each species and the number of particles of none of them."""
    cols = [F.coalesce(F.sum(F.when(F.col("species") == s, F.col("m"))), F.lit(0.0)).alias(f"m_{s.lower()}") for s in species]
    return members.groupBy(key).agg(*cols, F.count_if(~F.col("species").isin(*species)).alias("n_other"))


def host_sub_counts(halos: DataFrame) -> DataFrame:
    """(halo_id, n_sub): objects that point at each object."""
    n = halos.where("host_id >= 0").groupBy(F.col("host_id").alias("halo_id")).agg(F.count(F.lit(1)).alias("n"))
    return halos.select("halo_id").join(n, "halo_id", "left").select("halo_id", F.coalesce("n", F.lit(0)).alias("n_sub"))


def wrong_sub_counts(halos: DataFrame, stated: str) -> DataFrame:
    """Objects whose stated number of subs isn't the number that point at them."""
    return halos.select("halo_id", stated).join(host_sub_counts(halos), "halo_id").where(F.col(stated) != F.col("n_sub"))


def dangling_hosts(halos: DataFrame) -> DataFrame:
    ids = halos.select(F.col("halo_id").alias("host_id"))
    return halos.where("host_id >= 0").join(ids, "host_id", "left_anti").select("halo_id", "host_id")


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def substructure(halos: DataFrame) -> DataFrame:
    """(host_id, n_sub, subs): the sorted list of each host's subs."""
    return halos.where("host_id >= 0").groupBy("host_id").agg(F.count(F.lit(1)).alias("n_sub"), F.sort_array(F.collect_list("halo_id")).alias("subs"))


def ordered(halos: DataFrame, by: str = "npart", parts: int | None = None) -> DataFrame:
    """Objects with ``idx``, their 0-based place in the order of ``by`` down, ties by id.

    Ranges are sorted in parallel and counted; each row's place is its place
    in its range after the sizes of the ranges before, so no task holds all rows.
    """
    n = parts or halos.sparkSession.sparkContext.defaultParallelism
    ranged = stored(halos.repartitionByRange(n, F.desc(by), "halo_id").withColumn("_part", F.spark_partition_id()), "ranges")
    size = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # as many rows as ranges
    before = size.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    row = F.row_number().over(W.partitionBy("_part").orderBy(F.desc(by), "halo_id"))
    return ranged.join(F.broadcast(before), "_part").withColumn("idx", F.col("_before") + row - 1).drop("_part", "_before")


def cumulative_mass_function(halos: DataFrame, parts: int | None = None) -> DataFrame:
    """(halo_id, mass, n_above): how many objects are at least as massive, ties by id."""
    return ordered(halos.select("halo_id", "mass"), "mass", parts).select("halo_id", "mass", (F.col("idx") + 1).alias("n_above"))


def top_k(halos: DataFrame, by: str, k: int) -> DataFrame:
    return halos.orderBy(F.desc(by), "halo_id").limit(k)


def positions_of(values: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Where each value stands in a table (key, pos), -1 if it doesn't."""
    return values.join(table.select(key, "pos"), key, "left").withColumn("pos", F.coalesce("pos", F.lit(-1)))


# Set operations ------------------------------------------------------------------


def first_owner(members: DataFrame) -> DataFrame:
    """Each particle of (halo_id, pid) stays in its smallest object only, ties to the smaller id."""
    size = members.groupBy("halo_id").agg(F.count(F.lit(1)).alias("_n"))
    own = members.join(size, "halo_id").groupBy("pid").agg(F.min(F.struct("_n", "halo_id")).alias("_o"))
    return own.select(F.col("_o.halo_id").alias("halo_id"), "pid")


def exclude_others(members: DataFrame, halo: int) -> DataFrame:
    """Particles of one object that no other object has."""
    return members.where(F.col("halo_id") == halo).select("pid").join(members.where(F.col("halo_id") != halo).select("pid"), "pid", "left_anti")


def without_duplicates(members: DataFrame, halo: int) -> DataFrame:
    """Particles of one object that stand in the whole list once."""
    many = members.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("pid")
    return members.where(F.col("halo_id") == halo).select("pid").join(many, "pid", "left_anti")


def difference_by_halo(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members (halo_id, pid) of ``a`` that ``b`` hasn't in the same object."""
    return a.join(b, ["halo_id", "pid"], "left_anti")


def closure(halos: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(host, sub, depth): all nested subs of every object, each pair at its least depth, however deep.

    Paths double in length each round, so a hierarchy needs as many rounds as
    the logarithm of its depth, and a cycle ends when a round finds no new
    pair. With ``max_depth`` every path of up to so many levels is a row.
    """
    paths = stored(halos.where("host_id >= 0").select(F.col("host_id").alias("host"), F.col("halo_id").alias("sub"), F.lit(1).alias("depth")), "paths")
    reach = 1
    while max_depth is None or reach < max_depth:
        far = paths.where(F.col("depth") == reach).select("host", F.col("sub").alias("via"))
        on = paths.select(F.col("host").alias("via"), "sub", (F.col("depth") + reach).alias("depth"))
        new = far.join(on, "via").select("host", "sub", "depth")
        if max_depth is None:
            new = new.groupBy("host", "sub").agg(F.min("depth").alias("depth")).join(paths, ["host", "sub"], "left_anti")
        else:
            new = new.where(F.col("depth") <= max_depth)
        new = stored(new, "paths")
        if new.isEmpty():
            break
        paths = stored(paths.union(new), "paths")
        reach *= 2
    return paths


def excise_substructure(members: DataFrame, halos: DataFrame) -> DataFrame:
    """Members (halo_id, pid, ...) of each object less those of all its nested subs."""
    c = closure(halos).select("host", "sub").distinct()
    gone = c.join(members.select(F.col("halo_id").alias("sub"), "pid"), "sub").select(F.col("host").alias("halo_id"), "pid").distinct()
    return members.join(gone, ["halo_id", "pid"], "left_anti")


def credible_hosts(halos: DataFrame, min_npart: int = 20, overlap: float = 0.5, box: float = 1.0) -> DataFrame:
    """(halo_id, host_id): the nearest ancestor that credibly hosts each object, -1 if none.

    Credible: within R_host + ``overlap`` R_sub, and both of ``min_npart`` particles at least.
    """
    anc = closure(halos)
    h = halos.select(F.col("halo_id").alias("host"), *(F.col(c).alias(f"h_{c}") for c in ("x", "y", "z", "radius", "npart")))
    x = anc.join(halos.select(F.col("halo_id").alias("sub"), "x", "y", "z", "radius", "npart"), "sub").join(h, "host")
    d2 = distance2([F.col(c) for c in "xyz"], [F.col(f"h_{c}") for c in "xyz"], box)
    ok = (d2 < F.pow(F.col("h_radius") + overlap * F.col("radius"), 2)) & (F.least("npart", "h_npart") >= min_npart)
    best = x.where(ok).groupBy("sub").agg(F.min_by("host", F.struct("depth", "host")).alias("best"))
    return halos.select("halo_id").join(best, halos.halo_id == best["sub"], "left").select("halo_id", F.coalesce("best", F.lit(-1)).alias("host_id"))


# Time along tracks --------------------------------------------------------------------


def transitions(states: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """Rows at which a key's state differs from the one before it."""
    w = W.partitionBy(key).orderBy(time)
    return states.withColumn("before", F.lag(state).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))


def host_changes(track: DataFrame) -> DataFrame:
    """Accretion events of tracks (halo, snap, host): ``h`` the object stops being a sub going back, ``s`` it becomes one of a new host, ``b`` of a host on its own main branch."""
    w = W.partitionBy("halo").orderBy(F.desc("snap"))
    x = track.withColumn("later", F.lag("host").over(w)).withColumn("seen", F.collect_set("host").over(w.rowsBetween(W.unboundedPreceding, -1)))
    kind = F.when((F.col("later") > 0) & (F.col("host") <= 0), "h").when((F.col("later") <= 0) & (F.col("host") > 0), F.when(F.array_contains("seen", F.col("host")), "b").otherwise("s"))
    return x.withColumn("event", kind).where("event is not null").select("halo", "snap", "host", "event")


def infall(track: DataFrame, inside: float = 1.0) -> DataFrame:
    """(halo, infall_snap, infall_id) of tracks (halo, snap, id, dist): the snapshot before the earliest one inside ``dist`` <= 1.

    If the track has none before it, the earliest one itself; an object never
    inside has its last snapshot and the id 0.
    """
    w = W.partitionBy("halo").orderBy("snap")
    x = track.withColumns({"_in": (F.col("dist") > 0) & (F.col("dist") <= inside), "_ps": F.lag("snap").over(w), "_pi": F.lag("id").over(w), "_pd": F.lag("dist").over(w)})
    x = x.withColumns({"_at": F.when(F.col("_pd") > inside, F.col("_ps")).otherwise(F.col("snap")), "_id": F.when(F.col("_pd") > inside, F.col("_pi")).otherwise(F.col("id"))})
    return x.groupBy("halo").agg(
        F.coalesce(F.min_by(F.when(F.col("_in"), F.col("_at")), F.when(F.col("_in"), F.col("snap"))), F.max("snap")).alias("infall_snap"),
        F.coalesce(F.min_by(F.when(F.col("_in"), F.col("_id")), F.when(F.col("_in"), F.col("snap"))), F.lit(0)).alias("infall_id"),
    )


def least_distance(track: DataFrame) -> DataFrame:
    """(halo, min_dist, min_snap): where each track comes nearest, ties to the earliest."""
    return track.groupBy("halo").agg(F.min("dist").alias("min_dist"), F.min_by("snap", F.struct("dist", "snap")).alias("min_snap"))


def backsplash(track: DataFrame) -> DataFrame:
    """Objects outside now that were inside before."""
    now = track.groupBy("halo").agg(F.max_by("dist", "snap").alias("now"), F.min("dist").alias("least"))
    return now.where("now > 1 and least < 1").select("halo", "now", "least")


def accreted_subs(branch: DataFrame, halos: DataFrame) -> DataFrame:
    """(snap, host, sub): subs whose progenitor was a field object other than the host's progenitor."""
    b = branch.select("snap", F.col("haloid").alias("_id"), "progid")
    subs = halos.where("host_id >= 0").select("snap", F.col("halo_id").alias("sub"), F.col("host_id").alias("host"))
    x = subs.join(b.select("snap", F.col("_id").alias("sub"), F.col("progid").alias("sub_prog")), ["snap", "sub"])
    x = x.join(b.select("snap", F.col("_id").alias("host"), F.col("progid").alias("host_prog")), ["snap", "host"])
    was = halos.select((F.col("snap") + 1).alias("snap"), F.col("halo_id").alias("sub_prog"), F.col("host_id").alias("was_host"))
    return x.join(was, ["snap", "sub_prog"]).where("was_host < 0 and sub_prog <> host_prog").select("snap", "host", "sub")


def displacement(first: DataFrame, second: DataFrame, n: int, box: float = 1.0) -> DataFrame:
    """(pid, d12, d_lattice): how far each particle moved between snapshots and from its lattice place."""
    from cosmolake.functions.expr import grid_index

    a = first.select("pid", *(F.col(c).alias(f"a_{c}") for c in "xyz"))
    b = second.select("pid", *(F.col(c).alias(f"b_{c}") for c in "xyz"))
    place = [(i + 0.5) * (box / n) for i in grid_index(F.col("pid"), n)]
    d = lambda p, q: F.sqrt(distance2(p, q, box))
    one, two = [F.col(f"a_{c}") for c in "xyz"], [F.col(f"b_{c}") for c in "xyz"]
    return a.join(b, "pid").select("pid", d(one, two).alias("d12"), d(two, place).alias("d_lattice"))


def farthest_star(members: DataFrame, species: str) -> DataFrame:
    """(halo_id, r_star, m_enclosed): radius of the outermost particle of a species and the mass within it."""
    r = members.groupBy("halo_id").agg(F.max(F.when(F.col("species") == species, F.col("d"))).alias("r_star"))
    return members.join(r, "halo_id").where("d <= r_star").groupBy("halo_id").agg(F.first("r_star").alias("r_star"), F.sum("m").alias("m_enclosed"))


def with_densities(members: DataFrame, densities: DataFrame, key: str = "pid") -> DataFrame:
    """Members with what another table knows of their particles; particles it lacks are left out."""
    return members.join(densities, key)
