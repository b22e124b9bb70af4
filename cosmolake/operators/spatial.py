"""Distance joins in a periodic box, by cells.

A join within radius r buckets both sides into cells no smaller than r and
joins each point with the 27 cells around it, wrapped and without repeats,
then tests the exact distance. Radii that vary are handled by levels of
doubling cell size. No side is broadcast for its own sake and nothing is
compared outside neighbouring cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cosmolake.functions.expr import distance2, pbc
from cosmolake.operators.rounds import stored

AXES = ("x", "y", "z")


def cells_across(radius: float, box: float, most: int = 1 << 20) -> int:
    """How many cells of at least ``radius`` fit along the box."""
    return max(1, min(most, int(box / radius))) if radius > 0 else most


def cell(c: str | Column, n: Column | int, box: float) -> Column:
    """Cell number of a coordinate along an axis, 0 to n-1."""
    x = F.col(c) if isinstance(c, str) else c
    return F.pmod(F.floor(x / box * n).cast("long"), F.lit(n) if isinstance(n, int) else n)


def around(n: Column | int, box: float, prefix: str = "") -> Column:
    """Distinct wrapped cells around a point, each a struct (cx, cy, cz)."""
    m = F.lit(n).cast("long") if isinstance(n, int) else n
    own = [cell(f"{prefix}{a}", m, box) for a in AXES]
    shifted = [F.struct(*(F.pmod(own[k] + F.lit(o), m).alias(f"c{a}") for k, (a, o) in enumerate(zip(AXES, offset, strict=True)))) for offset in product((-1, 0, 1), repeat=3)]
    return F.array_distinct(F.array(*shifted))


def within(a: DataFrame, b: DataFrame, radius: float, box: float = 1.0, closed: bool = True, same: str | None = None) -> DataFrame:
    """Pairs of a row of ``a`` and one of ``b`` at most ``radius`` apart, with ``d2``; b's columns come out with ``b_`` before their names. With ``same``, only those equal in that column."""
    n = cells_across(radius, box)
    left = a.select("*", F.explode(around(n, box)).alias("_c")).select("*", "_c.*").drop("_c")
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    right = right.select("*", *(cell(f"b_{k}", n, box).alias(f"c{k}") for k in AXES))
    keys = ["cx", "cy", "cz"]
    if same is not None:
        right, keys = right.withColumn(same, F.col(f"b_{same}")), [*keys, same]
    x = left.join(right, keys).drop("cx", "cy", "cz")
    x = x.withColumn("d2", distance2([F.col(k) for k in AXES], [F.col(f"b_{k}") for k in AXES], box))
    return x.where(F.col("d2") <= radius * radius if closed else F.col("d2") < radius * radius)


def gather(halos: DataFrame, particles: DataFrame, radius: str = "radius", box: float = 1.0, finest: int = 10, same: str | None = None) -> DataFrame:
    """Particles within each object's own radius: (object columns, ``b_`` particle columns, ``d2``); with ``same``, only those equal in that column.

    Objects go to the finest level whose cells, ``box / 2**level``, are no
    smaller than their radius; a particle is keyed once for each level in use,
    at most ``finest`` of them.
    """
    level = F.least(F.lit(finest), F.greatest(F.lit(0), F.floor(-F.log2(F.greatest(F.col(radius), F.lit(1e-12)) / box)))).cast("int")
    h = halos.withColumn("_l", level).withColumn("_n", F.pow(F.lit(2.0), F.col("_l")).cast("long"))
    h = h.select("*", F.explode(around(F.col("_n"), box)).alias("_c")).select("*", "_c.*").drop("_c", "_n")
    levels = h.select("_l").distinct()
    p = particles.select(*(F.col(c).alias(f"b_{c}") for c in particles.columns)).join(F.broadcast(levels), F.lit(True))  # no more than finest + 1 rows
    n = F.pow(F.lit(2.0), F.col("_l")).cast("long")
    p = p.select("*", *(cell(f"b_{k}", n, box).alias(f"c{k}") for k in AXES))
    keys = ["_l", "cx", "cy", "cz"]
    if same is not None:
        p, keys = p.withColumn(same, F.col(f"b_{same}")), [*keys, same]
    x = h.join(p, keys).drop("_l", "cx", "cy", "cz")
    x = x.withColumn("d2", distance2([F.col(k) for k in AXES], [F.col(f"b_{k}") for k in AXES], box))
    return x.where(F.col("d2") <= F.col(radius) * F.col(radius))


def similar_pairs(halos: DataFrame, reach: float, mass_share: float, min_npart: int, n: int, box: float = 1.0) -> DataFrame:
    """Pairs of objects of like size in nearby cells: within ``reach`` radii, rounded up to cells of an n-cell grid; no distance test.

    Both orders come out; the first has more than ``min_npart`` particles.
    """
    side = box / n
    span = F.ceil(reach * F.col("radius") / side).cast("int")
    steps = F.sequence(-span, span)
    a = halos.where(F.col("npart") > min_npart).select("halo_id", "npart", "radius", *AXES)
    for k in AXES:
        a = a.select("*", F.explode(_near(k, n, box, steps)).alias(f"c{k}"))
    b = halos.select(F.col("halo_id").alias("other"), F.col("npart").alias("other_npart"), *(cell(k, n, box).alias(f"c{k}") for k in AXES))
    x = a.join(b, ["cx", "cy", "cz"]).where("halo_id <> other")
    return x.where(F.abs(F.col("npart") - F.col("other_npart")) / F.col("npart") < mass_share).select("halo_id", "other", "npart", "other_npart")


def _near(axis: str, n: int, box: float, steps: Column) -> Column:
    return F.array_distinct(F.transform(steps, lambda o: F.pmod(cell(axis, n, box) + o, F.lit(n))))


def cross_pairs(a: DataFrame, b: DataFrame, max_radius: float, min_npart: int = 100, d_radius: float = 1.0, d_mass: float = 2.0, box: float = 1.0) -> DataFrame:
    """The best match in catalogue ``b`` of each object of ``a``: nearer than its radius, moving alike, of like radius and mass; least radius difference first.

    ``max_radius`` bounds the radii of ``a``; it sets the cell size.
    """
    big = lambda h: h.where(F.col("npart") > min_npart)
    x = within(big(a), big(b), max_radius, box, closed=False)
    ok = (F.col("d2") < F.col("radius") * F.col("radius")) & (F.col("vx") * F.col("b_vx") + F.col("vy") * F.col("b_vy") + F.col("vz") * F.col("b_vz") > 0)
    dr = F.abs(F.col("radius") - F.col("b_radius")) / F.col("radius")
    x = x.where(ok & (dr < d_radius) & (F.abs(F.col("mass") - F.col("b_mass")) / F.col("mass") < d_mass))
    best = F.min_by(F.struct("b_halo_id", "d2"), F.struct(F.abs(F.col("radius") - F.col("b_radius")).alias("dr"), "b_halo_id"))
    return x.groupBy("halo_id").agg(best.alias("m"), F.count(F.lit(1)).alias("n_candidates")).select("halo_id", F.col("m.b_halo_id").alias("match_id"), "n_candidates")


def nearest_to(halos: DataFrame, point: tuple[float, float, float], box: float = 1.0) -> DataFrame:
    """The object nearest to a point, ties to the smaller id."""
    d2 = distance2([F.col(k) for k in AXES], [F.lit(float(v)) for v in point], box)
    return halos.withColumn("d2", d2).orderBy("d2", "halo_id").limit(1)


def spacing(points: DataFrame, box: float = 1.0) -> float:
    """The mean distance of as many points in the box, within a thousandth of it and a quarter."""
    return min(box / 4, max(box / 1000, box * max(1, points.count()) ** (-1 / 3)))


def nearest_more_massive(halos: DataFrame, box: float = 1.0, first: float | None = None) -> DataFrame:
    """(halo_id, other, dist): the nearest object with strictly more particles; null for the largest.

    Rounds of doubling radius from the mean spacing, so that the pairs of a
    cell don't grow with the density: an object is done once a round finds one
    within its radius; those left at half the box diagonal have none.
    """
    rows = stored(halos.select("halo_id", "npart", *AXES), "objects")
    left, out, radius = rows, None, first or spacing(rows, box)
    while True:
        last = radius >= box * math.sqrt(3) / 2
        x = within(left, rows, radius, box).where("b_npart > npart")
        near = x.groupBy("halo_id").agg(F.min(F.struct("d2", F.col("b_halo_id").alias("other"))).alias("m"))
        near = stored(near.select("halo_id", F.col("m.other").alias("other"), F.sqrt("m.d2").alias("dist")), "nearest")
        out = near if out is None else out.union(near)
        left = stored(left.join(near, "halo_id", "left_anti"), "left")
        if last or left.isEmpty():
            break
        radius = min(2 * radius, box * math.sqrt(3) / 2 * 1.0000001)
    return halos.select("halo_id").join(out, "halo_id", "left")


def gather_radius(halos: DataFrame, most: float, box: float = 1.0) -> DataFrame:
    """(halo_id, gather_rad): half the distance to the nearest more massive object, between the object's own radius and min(most, box/4)."""
    x = nearest_more_massive(halos, box).join(halos.select("halo_id", "radius"), "halo_id")
    top = min(most, box / 4)
    return x.select("halo_id", F.least(F.lit(top), F.greatest(F.col("radius"), F.coalesce(F.col("dist") / 2, F.lit(top)))).alias("gather_rad"))


CHUNK = 1_024  #: Points of one cell that stand in one row, about.


def _chunks(points: DataFrame, n: int, box: float, key: str) -> DataFrame:
    """(cx, cy, cz, part, xs, ys, zs): the points of each cell, in rows of about ``CHUNK``."""
    x = points.select(key, *AXES, *(cell(k, n, box).alias(f"c{k}") for k in AXES))
    size = x.groupBy("cx", "cy", "cz").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("long").alias("parts")).where("parts > 1")
    x = x.join(size, ["cx", "cy", "cz"], "left").withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64(key), F.col("parts"))).otherwise(0).cast("int"))
    row = F.collect_list(F.struct(*AXES))
    return x.groupBy("cx", "cy", "cz", "part").agg(row.alias("p")).select("cx", "cy", "cz", "part", *(F.col(f"p.{k}").alias(f"{k}s") for k in AXES))


def pair_histogram(points: DataFrame, r_min: float, r_max: float, bins: int, box: float = 1.0, key: str = "pid") -> DataFrame:
    """(bin, n_pairs): unordered pairs by logarithmic separation, bins open on both sides.

    Cells meet half of the cells around them, as rows of many points, and
    separations are counted block by block in Arrow: no row is ever a pair of
    points. With fewer than three cells along the box all lie in one another's
    neighbourhood and each unordered pair of cells meets once.
    """
    n = cells_across(r_max, box, 1 << 20)
    edges = [10 ** (math.log10(r_min) + k * (math.log10(r_max) - math.log10(r_min)) / bins) for k in range(bins + 1)]
    squares = np.array([e**2 for e in edges])
    rows = stored(_chunks(points, n, box, key), "cells")
    place = lambda p: F.struct(*(F.col(f"{p}c{k}") for k in AXES), F.col(f"{p}part"))
    a = rows.select("*", F.explode(around_cells(n)).alias("_o")).select(*(F.col(c).alias(f"a_{c}") for c in rows.columns), *(F.col(f"_o.c{k}").alias(f"c{k}") for k in AXES))
    b = rows.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns), *(F.col(f"c{k}") for k in AXES))
    x = a.join(b, ["cx", "cy", "cz"]).where(place("a_") <= place("b_")).select(*(f"{p}_{k}s" for p in "ab" for k in AXES), (place("a_") == place("b_")).alias("same"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(bins, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                p, q = (np.stack([batch.column(j + o)[k].values.to_numpy() for j in range(3)]) for o in (0, 3))
                step = max(1, (1 << 20) // max(1, q.shape[1]))
                for at in range(0, p.shape[1], step):
                    d2 = np.zeros((min(step, p.shape[1] - at), q.shape[1]))
                    for axis in range(3):
                        d = p[axis, at : at + step, None] - q[axis][None, :]
                        d -= box * np.floor(d / box + 0.5)
                        d2 += d * d
                    if batch.column(6)[k].as_py():
                        d2 = d2[np.triu(np.ones(d2.shape, bool), at + 1)]
                    d2 = d2[(d2 > squares[0]) & (d2 < squares[-1])]
                    which = np.searchsorted(squares, d2, side="left") - 1
                    total += np.bincount(which[d2 < squares[which + 1]], minlength=bins)
        yield pa.record_batch([pa.array(range(bins), pa.int32()), pa.array(total)], ["bin", "n_pairs"])

    return x.mapInArrow(task, "bin int, n_pairs long").groupBy("bin").agg(F.sum("n_pairs").alias("n_pairs")).where("n_pairs > 0")


def around_cells(n: int) -> Column:
    """The distinct wrapped cells around (cx, cy, cz)."""
    m = F.lit(n).cast("long")
    shifted = [F.struct(*(F.pmod(F.col(f"c{a}") + F.lit(o), m).alias(f"c{a}") for a, o in zip(AXES, offset, strict=True))) for offset in product((-1, 0, 1), repeat=3)]
    return F.array_distinct(F.array(*shifted))


def correlation(points: DataFrame, r_min: float, r_max: float, bins: int, box: float = 1.0, key: str = "pid") -> DataFrame:
    """(bin, r, n_pairs, xi): pairs over those of a uniform box, less one; empty bins have -1."""
    h = pair_histogram(points, r_min, r_max, bins, box, key)
    spark = points.sparkSession
    edges = [10 ** (math.log10(r_min) + k * (math.log10(r_max) - math.log10(r_min)) / bins) for k in range(bins + 1)]
    table = spark.createDataFrame([(k, math.sqrt(edges[k] * edges[k + 1]), 4 * math.pi / 3 * (edges[k + 1] ** 3 - edges[k] ** 3) / box**3) for k in range(bins)], "bin int, r double, share double")
    n = points.agg(F.count(F.lit(1)).alias("n"))
    x = F.broadcast(table).join(F.broadcast(n), F.lit(True)).join(h, "bin", "left")  # ``bins`` rows and one row
    return x.select("bin", "r", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), (F.coalesce("n_pairs", F.lit(0)) / (F.col("share") * F.col("n") * (F.col("n") - 1) / 2) - 1).alias("xi"))


def box_parents(daughters: DataFrame, parents: DataFrame, box: float = 1.0) -> DataFrame:
    """(patch_id, parent_id, d2): parents of the next coarser level whose periodic bounding box holds the daughter's centre.

    Parents carry a centre (x, y, z) and half extents (hx, hy, hz); they are
    bucketed by their largest half extent.
    """
    p = parents.select(F.col("patch_id").alias("parent_id"), (F.col("level") + 1).alias("level"), *AXES, *(f"h{k}" for k in AXES), F.greatest("hx", "hy", "hz").alias("radius"))
    x = gather(p.withColumn("radius", F.col("radius") * math.sqrt(3)), daughters, "radius", box).where("level = b_level")
    inside = [F.abs(pbc(F.col(k) - F.col(f"b_{k}"), box)) <= F.col(f"h{k}") for k in AXES]
    return x.where(inside[0] & inside[1] & inside[2]).select(F.col("b_patch_id").alias("patch_id"), "parent_id", "d2")


def nearest_parent(found: DataFrame) -> DataFrame:
    """One parent for each daughter: the nearest, ties to the smaller id."""
    return found.groupBy("patch_id").agg(F.min(F.struct("d2", "parent_id")).alias("m")).select("patch_id", F.col("m.parent_id").alias("parent_id"))


def holding_parents(daughters: DataFrame, parents: DataFrame, box: float = 1.0, first: float | None = None) -> DataFrame:
    """(patch_id, parent_id): the nearest of a daughter's :func:`box_parents`, ties to the smaller id, without all of them.

    Rounds of fourfold radius from a quarter of the mean spacing: a daughter
    leaves once a parent within the radius holds it, and so do parents whose
    whole box lies within it. Daughters that no box holds don't come out.
    """
    up = parents.select("patch_id", (F.col("level") + 1).alias("level"), *AXES, *(f"h{k}" for k in AXES), F.sqrt(sum((F.col(f"h{k}") * F.col(f"h{k}") for k in AXES), F.lit(0.0))).alias("reach"))
    up = stored(up, "parents")
    left = stored(daughters.select("patch_id", "level", *AXES).join(up.select("level").distinct(), "level", "left_semi"), "left")
    out, radius, last = None, first or spacing(up, box) / 4, min(up.agg(F.max("reach")).first()[0] or 0.0, box * math.sqrt(3) / 2) * 1.0000001
    while True:
        x = within(left, up, radius, box, same="level")
        inside = [F.abs(pbc(F.col(f"b_{k}") - F.col(k), box)) <= F.col(f"b_h{k}") for k in AXES]
        x = x.where(inside[0] & inside[1] & inside[2])
        near = stored(x.groupBy("patch_id").agg(F.min(F.struct("d2", "b_patch_id")).alias("m")).select("patch_id", F.col("m.b_patch_id").alias("parent_id")), "holders")
        out = near if out is None else out.union(near)
        left = stored(left.join(near, "patch_id", "left_anti"), "left")
        if radius >= last or left.isEmpty():
            return out
        up = up.where(F.col("reach") * 1.0000001 > radius)
        radius = min(4 * radius, last)


def orphan_parents(daughters: DataFrame, parents: DataFrame, box: float = 1.0, first: float | None = None) -> DataFrame:
    """(patch_id, parent_id): the nearest patch of the next coarser level, by rounds of doubling radius from the mean spacing."""
    left, out, radius = daughters, None, first or spacing(parents, box)
    up = parents.withColumn("level", F.col("level") + 1)
    while True:
        x = within(left, up, radius, box, same="level")
        near = stored(x.groupBy("patch_id").agg(F.min(F.struct("d2", "b_patch_id")).alias("m")).select("patch_id", F.col("m.b_patch_id").alias("parent_id")), "orphans")
        out = near if out is None else out.union(near)
        left = stored(left.join(near, "patch_id", "left_anti"), "left")
        if radius >= box * math.sqrt(3) / 2 or left.isEmpty():
            return out
        radius = min(2 * radius, box * math.sqrt(3) / 2 * 1.0000001)


def main_daughters(links: DataFrame, patches: DataFrame, rule: str = "parts") -> DataFrame:
    """(parent_id, main_id): the daughter with most particles, most nodes, or nearest the parent."""
    d = patches.select("patch_id", "n_parts", "n_nodes", *AXES)
    p = patches.select(F.col("patch_id").alias("parent_id"), *(F.col(k).alias(f"p_{k}") for k in AXES))
    x = links.join(d, "patch_id").join(p, "parent_id")
    score = {"parts": -F.col("n_parts"), "nodes": -F.col("n_nodes"), "distance": distance2([F.col(k) for k in AXES], [F.col(f"p_{k}") for k in AXES])}[rule]
    return x.groupBy("parent_id").agg(F.min_by("patch_id", F.struct(score.alias("s"), "patch_id")).alias("main_id"))


def sibling_distance(links: DataFrame, patches: DataFrame, mains: DataFrame, box: float = 1.0, finest: int = 16) -> DataFrame:
    """(patch_id, close): half the distance to the nearest other sub-patch of the same parent, main daughters left out.

    Rounds of doubling radius within a parent's patches, from their mean
    spacing there: a patch meets those of neighbouring cells, not all of its
    parent's, and leaves once its nearest is found.
    """
    s = links.join(mains.select(F.col("main_id").alias("patch_id")), "patch_id", "left_anti").join(patches.select("patch_id", *AXES), "patch_id").select("patch_id", "parent_id", *AXES)
    s = stored(s, "siblings")
    first = s.groupBy("parent_id").agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(*AXES), "patch_id").alias("_a")).where("_n > 1")
    off = {k: pbc(F.col(k) - F.col(f"_a.{k}"), box) for k in AXES}
    extent = F.greatest(*(F.max(c) - F.min(c) for c in off.values()))
    reach = s.join(first, "parent_id").groupBy("parent_id").agg((extent * F.pow(F.first("_n"), F.lit(-1 / 3))).alias("radius"))
    left, out = stored(s.join(reach, "parent_id"), "left"), None
    while True:
        x = gather(left, s, "radius", box, finest, same="parent_id").where("patch_id <> b_patch_id")
        near = stored(x.groupBy("patch_id").agg((0.5 * F.sqrt(F.min("d2"))).alias("close")), "nearest")
        out = near if out is None else out.union(near)
        left = stored(left.join(near, "patch_id", "left_anti").withColumn("radius", F.greatest(2 * F.col("radius"), F.lit(box * 2.0**-finest))), "left")
        if left.isEmpty():
            return out


def sphere_statistic(cells: DataFrame, spheres: DataFrame, radius: float, box: float = 1.0) -> DataFrame:
    """Mass in each sphere from cells (x, y, z, mass) whose centres lie within it: (sphere_id, mass); empty spheres have 0."""
    x = within(spheres, cells, radius, box)
    got = x.groupBy("sphere_id").agg(F.sum("b_mass").alias("mass"))
    return spheres.select("sphere_id").join(got, "sphere_id", "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)))


def rms_fluctuation(masses: DataFrame) -> DataFrame:
    """One row: n, mean, and the rms relative fluctuation."""
    m = masses.agg(F.count(F.lit(1)).alias("n"), F.avg("mass").alias("mean"), F.stddev_pop("mass").alias("sd"))
    return m.select("n", "mean", (F.col("sd") / F.col("mean")).alias("sigma"))

