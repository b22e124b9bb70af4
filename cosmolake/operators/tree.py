"""Merger trees: overlap of memberships between snapshots, mutual best matches, traces, skipping, merger counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cosmolake.functions.expr import distance2, frac, merit
from cosmolake.operators.rounds import stored

MIN_COMMON = 10


def overlap(later: DataFrame, earlier: DataFrame, min_common: int = MIN_COMMON) -> DataFrame:
    """Edges (haloid, npart, progid, npart_prog, common, merit) between two memberships (halo_id, pid).

    Common particles count by occurrence; an edge needs more than ``min_common``.
    """
    size = lambda m: m.groupBy("halo_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = later.select(F.col("halo_id").alias("haloid"), "pid"), earlier.select(F.col("halo_id").alias("progid"), "pid")
    pairs = a.join(b, "pid").groupBy("haloid", "progid").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") > min_common)
    x = pairs.join(size(later).select(F.col("halo_id").alias("haloid"), F.col("n").alias("npart")), "haloid")
    x = x.join(size(earlier).select(F.col("halo_id").alias("progid"), F.col("n").alias("npart_prog")), "progid")
    return x.select("haloid", "npart", "progid", "npart_prog", "common", merit(F.col("common"), F.col("npart"), F.col("npart_prog")).alias("merit"))


def overlaps(members: DataFrame, min_common: int = MIN_COMMON) -> DataFrame:
    """Edges of all pairs of adjacent snapshots of (snap, halo_id, pid) in one plan; ``snap`` is the later one's."""
    size = members.groupBy("snap", "halo_id").agg(F.count(F.lit(1)).alias("n"))
    a = members.select("snap", F.col("halo_id").alias("haloid"), "pid")
    b = members.select((F.col("snap") + 1).alias("snap"), F.col("halo_id").alias("progid"), "pid")
    x = a.join(b, ["snap", "pid"]).groupBy("snap", "haloid", "progid").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") > min_common)
    x = x.join(size.select("snap", F.col("halo_id").alias("haloid"), F.col("n").alias("npart")), ["snap", "haloid"])
    x = x.join(size.select((F.col("snap") + 1).alias("snap"), F.col("halo_id").alias("progid"), F.col("n").alias("npart_prog")), ["snap", "progid"])
    return x.select("snap", "haloid", "npart", "progid", "npart_prog", "common", merit(F.col("common"), F.col("npart"), F.col("npart_prog")).alias("merit"))


def ranked(edges: DataFrame, by: tuple[str, ...] = ("snap",)) -> DataFrame:
    """Edges with ``rank``, progenitors by merit, ties by id."""
    keys = [c for c in by if c in edges.columns]
    return edges.withColumn("rank", F.row_number().over(W.partitionBy(*keys, "haloid").orderBy(F.desc("merit"), "progid")))


def mutual_best(edges: DataFrame, by: tuple[str, ...] = ("snap",)) -> DataFrame:
    """Edges whose object is also its progenitor's best match, ranked anew."""
    keys = [c for c in by if c in edges.columns]
    back = F.row_number().over(W.partitionBy(*keys, "progid").orderBy(F.desc("merit"), "haloid"))
    return ranked(edges.withColumn("back", back).where("back = 1").drop("back"), by)


def main_branch(edges: DataFrame) -> DataFrame:
    """(snap, haloid, progid) of the best progenitors."""
    return (edges if "rank" in edges.columns else ranked(edges)).where("rank = 1").select("snap", "haloid", "progid")


def progenitor_ids(branch: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (snap, haloid) with ``progid``, 0 where there is none."""
    return ids.join(branch, ["snap", "haloid"], "left").withColumn("progid", F.coalesce("progid", F.lit(0)))


def descendant_ids(branch: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (snap, haloid) with ``descid``, the object of the next snapshot whose best progenitor it is, 0 where there is none."""
    down = branch.groupBy((F.col("snap") - 1).alias("snap"), F.col("progid").alias("haloid")).agg(F.min("haloid").alias("descid"))
    return ids.join(down, ["snap", "haloid"], "left").withColumn("descid", F.coalesce("descid", F.lit(0)))


def trace(branch: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """(haloid, snap, progid): main branches of ``start`` (snap, haloid) back through ``steps`` snapshots, the start included.

    Steps double: each round the branches found so far are carried on by a
    stored table of jumps as long as they are, so their number is the
    logarithm of ``steps``. A branch that ends adds no more rows.
    """
    out = start.select("haloid", "snap", F.col("haloid").alias("progid"), F.lit(0).alias("step"))
    jump = stored(branch.select(F.col("snap").alias("js"), F.col("haloid").alias("at"), F.col("progid").alias("next")), "jumps")
    width = 1
    while width <= steps:
        on = out.where(F.col("step") + width <= steps).join(jump, (F.col("snap") == F.col("js")) & (F.col("progid") == F.col("at")))
        out = stored(out.union(on.select("haloid", (F.col("snap") - width).alias("snap"), F.col("next").alias("progid"), (F.col("step") + width).alias("step"))), "branches")
        width *= 2
        if width <= steps:
            more = jump.select((F.col("js") + width // 2).alias("ms"), F.col("at").alias("via"), F.col("next").alias("end"))
            jump = stored(jump.join(more, (F.col("js") == F.col("ms")) & (F.col("next") == F.col("via"))).select("js", "at", F.col("end").alias("next")), "jumps")
    return out.drop("step")


def progenitors_at(branch: DataFrame, start: DataFrame, snap: int, steps: int) -> DataFrame:
    """(haloid, progid): the progenitor at a given snapshot, 0 where the branch ends before."""
    hit = trace(branch, start, steps).where(F.col("snap") == snap).select("haloid", "progid")
    return start.select("haloid").join(hit, "haloid", "left").withColumn("progid", F.coalesce("progid", F.lit(0)))


def last_progenitors(traced: DataFrame) -> DataFrame:
    """(haloid, last_snap, last_progid): where each branch ends."""
    return traced.groupBy("haloid").agg(F.min("snap").alias("last_snap"), F.min_by("progid", "snap").alias("last_progid"))


def tree_matrix(traced: DataFrame, snaps: list[int]) -> DataFrame:
    """One row an object, one column a snapshot, 0 where it is missing."""
    m = traced.groupBy("haloid").pivot("snap", snaps).agg(F.first("progid"))
    return m.select("haloid", *(F.coalesce(F.col(str(s)), F.lit(0)).alias(f"snap_{s}") for s in snaps))


def history(traced: DataFrame, halos: DataFrame, snap_map: DataFrame) -> DataFrame:
    """Catalogue rows along branches, with their redshift: halos (snap, halo_id, ...), snap_map (snap, zred)."""
    x = traced.join(halos.withColumnRenamed("halo_id", "progid"), ["snap", "progid"])
    return x.join(snap_map, "snap", "left")


def skip_snapshots(members: DataFrame, snaps: list[int], min_common: int = MIN_COMMON, min_part: int = 10, max_skip: int | None = None, ratio: float | None = None) -> DataFrame:
    """Edges (snap, haloid, from_snap, progid, common, merit, rank) when objects without a progenitor are carried back and tried again.

    ``snaps`` go from late to early. An object that finds no accepted
    progenitor in a snapshot and has more than ``min_part`` particles is tried
    against the next earlier one, keeping its id, without limit or for
    ``max_skip`` snapshots. ``ratio`` rejects edges between sizes further apart.
    """
    carried, out = None, None
    for k in range(len(snaps) - 1):
        own = members.where(F.col("snap") == snaps[k]).select(F.col("snap").alias("origin"), "halo_id", "pid")
        waiting = own if carried is None else own.union(carried)
        waiting = waiting.withColumn("halo", F.struct("origin", "halo_id"))
        target = members.where(F.col("snap") == snaps[k + 1])
        e = overlap(waiting.select(F.col("halo").alias("halo_id"), "pid"), target.select("halo_id", "pid"), min_common)
        if ratio is not None:
            e = e.where(F.greatest(F.col("npart") / F.col("npart_prog"), F.col("npart_prog") / F.col("npart")) <= ratio)
        e = mutual_best(e, ())
        e = stored(e.select(F.lit(snaps[k + 1]).alias("from_snap"), F.col("haloid.origin").alias("snap"), F.col("haloid.halo_id").alias("haloid"), "progid", "common", "merit", "rank"), "edges")
        out = e if out is None else out.union(e)
        found = e.select(F.col("snap").alias("origin"), F.col("haloid").alias("halo_id")).distinct()
        left = waiting.join(found, ["origin", "halo_id"], "left_anti")
        big = left.groupBy("origin", "halo_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_part).select("origin", "halo_id")
        if max_skip is not None:
            big = big.where(F.col("origin") - F.lit(snaps[k + 1]) <= max_skip)
        carried = stored(left.join(big, ["origin", "halo_id"], "left_semi").select("origin", "halo_id", "pid"), "carried")
    return out


def merger_count(edges: DataFrame, rule: str = "ratio", min_npart: int = 1000, min_prog: int = 40, limit: float = 0.25) -> DataFrame:
    """(snap, n_halos, n_mergers) of objects over ``min_npart``.

    ``ratio``: the object and its best progenitor differ by more than ``limit``;
    ``secondary``: another progenitor over ``min_prog`` reaches more than
    ``limit`` of the best one. An object counts once.
    """
    r = edges if "rank" in edges.columns else ranked(edges)
    r = r.where(F.col("npart") > min_npart).withColumn("n0", F.first("npart_prog").over(W.partitionBy("snap", "haloid").orderBy("rank")))
    if rule == "ratio":
        hit = (F.col("rank") == 1) & (1 - frac(F.col("npart_prog") / F.col("npart")) > limit)
    else:
        hit = (F.col("rank") > 1) & (F.col("npart_prog") > min_prog) & (frac(F.col("npart_prog") / F.col("n0")) > limit)
    per = r.groupBy("snap", "haloid").agg(F.max(hit.cast("int")).alias("hit"))
    return per.groupBy("snap").agg(F.count(F.lit(1)).alias("n_halos"), F.sum("hit").alias("n_mergers"))


def accretion_fraction(edges: DataFrame) -> DataFrame:
    """(snap, haloid, n_progs, fraction): growth since the best progenitor as a share of the object."""
    r = edges if "rank" in edges.columns else ranked(edges)
    return r.groupBy("snap", "haloid").agg(
        F.count(F.lit(1)).alias("n_progs"),
        ((F.first("npart") - F.min_by("npart_prog", "rank")).cast("double") / F.first("npart")).alias("fraction"),
    )


def croco(edges: DataFrame) -> DataFrame:
    """Objects with their ranked progenitors as one nested row each."""
    r = edges if "rank" in edges.columns else ranked(edges)
    progs = F.sort_array(F.collect_list(F.struct("rank", "progid", "npart_prog", "common", "merit")))
    return r.groupBy("snap", "haloid").agg(F.first("npart").alias("npart"), F.count(F.lit(1)).alias("n_progs"), progs.alias("progs"))


def host_distances(objects: DataFrame, hosts: DataFrame, halos: DataFrame, box: float = 1.0) -> DataFrame:
    """(halo, host, snap, id, dist): distance to the host along both main branches, in radii of the host's progenitor.

    ``objects`` (halo, host, snap, id) are traced objects with the host of the
    start; ``hosts`` (host, snap, host_prog) traced hosts; halos (snap,
    halo_id, x, y, z, radius). Snapshots at which either is missing are left out.
    """
    own = halos.select("snap", F.col("halo_id").alias("id"), *(F.col(k).alias(f"o_{k}") for k in "xyz"))
    its = halos.select("snap", F.col("halo_id").alias("host_prog"), *(F.col(k).alias(f"h_{k}") for k in "xyz"), "radius")
    x = objects.join(hosts, ["host", "snap"]).join(own, ["snap", "id"]).join(its, ["snap", "host_prog"])
    d = F.sqrt(distance2([F.col(f"o_{k}") for k in "xyz"], [F.col(f"h_{k}") for k in "xyz"], box))
    return x.select("halo", "host", "snap", "id", F.try_divide(d, "radius").alias("dist"))
