"""Grids: counts and mass on cells, refinement, connected patches, density at particles, power."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cosmolake.functions.expr import pbc
from cosmolake.operators.rounds import min_labels, stored
from cosmolake.operators.spatial import AXES, cell

KERNELS = ("ngp", "cic", "tsc")


def cell_counts(particles: DataFrame, n: int, box: float = 1.0) -> DataFrame:
    """(ix, iy, iz, n_part) of an n**3 grid; empty cells are left out."""
    return particles.groupBy(*(cell(k, n, box).alias(f"i{k}") for k in AXES)).agg(F.count(F.lit(1)).alias("n_part"))


def axis_weights(x: Column, n: int, box: float, kernel: str) -> list[tuple[Column, Column]]:
    """(node, weight) pairs of a coordinate along one axis; nodes sit at cell centres."""
    u = x / box * n
    own = F.floor(u).cast("long")
    off = u - own - 0.5
    wrapped = lambda k: F.pmod(own + k, F.lit(n))
    if kernel == "ngp":
        return [(wrapped(0), F.lit(1.0))]
    if kernel == "cic":
        side = F.when(off >= 0, F.lit(1)).otherwise(F.lit(-1)).cast("long")
        return [(wrapped(0), 1 - F.abs(off)), (F.pmod(own + side, F.lit(n)), F.abs(off))]
    if kernel == "tsc":
        return [(wrapped(-1), 0.5 * (0.5 - off) * (0.5 - off)), (wrapped(0), 0.75 - off * off), (wrapped(1), 0.5 * (0.5 + off) * (0.5 + off))]
    raise ValueError(f"kernel {kernel!r} isn't one of {KERNELS}")


def spread(particles: DataFrame, n: int, box: float = 1.0, kernel: str = "tsc") -> DataFrame:
    """Each particle on its nodes: all columns, ``ix, iy, iz`` and ``w``."""
    x = particles.withColumns({f"_{k}": F.array(*(F.struct(node.alias(f"i{k}"), w.alias(f"_w{k}")) for node, w in axis_weights(F.col(k), n, box, kernel))) for k in AXES})
    for k in AXES:  # axis by axis: all nodes in one expression would be too much code to compile
        x = x.select("*", F.inline(f"_{k}")).drop(f"_{k}")
    return x.withColumn("w", F.col("_wx") * F.col("_wy") * F.col("_wz")).drop("_wx", "_wy", "_wz")


def deposit(particles: DataFrame, n: int, box: float = 1.0, kernel: str = "tsc", mass: str = "mass") -> DataFrame:
    """(ix, iy, iz, dens): mass on the nodes of an n**3 grid, periodic."""
    return spread(particles.select(*AXES, mass), n, box, kernel).groupBy("ix", "iy", "iz").agg(F.sum(F.col("w") * F.col(mass)).alias("dens"))


def density_at(particles: DataFrame, n: int, box: float = 1.0, kernel: str = "tsc", mass: str = "mass", key: str = "pid") -> DataFrame:
    """(key, dens): density over its mean, interpolated back with the kernel that deposited it."""
    mean = particles.agg((F.sum(mass) / n**3).alias("_mean"))
    grid = deposit(particles, n, box, kernel, mass)
    x = spread(particles.select(key, *AXES), n, box, kernel).join(grid, ["ix", "iy", "iz"])
    x = x.groupBy(key).agg(F.sum(F.col("w") * F.col("dens")).alias("_d"))
    return x.join(F.broadcast(mean), F.lit(True)).select(key, (F.col("_d") / F.col("_mean")).alias("dens"))  # one row


def _offsets_ahead() -> list[tuple[int, int, int]]:
    """The 17 neighbours at x-offset 0 or +1."""
    return [o for o in product((0, 1), (-1, 0, 1), (-1, 0, 1)) if o != (0, 0, 0)]


def to_refine(cells: DataFrame, n: int, threshold: float, periodic: bool = True) -> DataFrame:
    """(ix, iy, iz): cells that reach the threshold themselves or through one of the 17 neighbours at x-offset 0 or +1."""
    hot = cells.where(F.col("n_part") >= threshold).select("ix", "iy", "iz")
    shift = lambda k, o: F.pmod(F.col(f"i{k}") - o, F.lit(n)) if periodic else F.col(f"i{k}") - o
    spots = [F.struct(*(shift(k, o).cast("long").alias(f"i{k}") for k, o in zip(AXES, off, strict=True))) for off in [(0, 0, 0), *_offsets_ahead()]]
    x = hot.select(F.inline(F.array(*spots))).distinct()
    return x if periodic else x.where(" and ".join(f"i{k} between 0 and {n - 1}" for k in AXES))


def hierarchy(particles: DataFrame, n: int, threshold: float, max_level: int = 12, box: float = 1.0, key: str = "pid") -> DataFrame:
    """(level, ix, iy, iz, key): particles in refined cells by level.

    Level 0 is the n**3 grid; a cell of level k that is to be refined passes
    its particles to the cells of half size below it. Stops when none is.
    """
    here, out = particles.select(key, *AXES), None
    for level in range(max_level):
        size = n << level
        placed = here.select(key, *AXES, *(cell(k, size, box).alias(f"i{k}") for k in AXES))
        cells = placed.groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n_part"))
        marked = placed.join(to_refine(cells, size, threshold), ["ix", "iy", "iz"], "left_semi")
        marked = stored(marked.withColumn("level", F.lit(level)), f"level-{level}")
        if marked.isEmpty():
            break
        part = marked.select("level", "ix", "iy", "iz", key, *AXES)
        out = part if out is None else out.union(part)
        here = part.select(key, *AXES)
    if out is None:
        out = particles.select(F.lit(0).alias("level"), *(F.lit(0).cast("long").alias(f"i{k}") for k in AXES), key, *AXES).limit(0)
    return out


def patches(cells: DataFrame, n: int) -> DataFrame:
    """Cells (level, ix, iy, iz, ...) with ``patch_id``: connected by faces within their level, periodic.

    A patch's id is the smallest cell number in it. Numbers have 19 bits an
    axis: a level with more cells a side raises.
    """
    deepest = cells.agg(F.max("level")).first()[0] or 0
    if n << deepest > 1 << 19 or deepest > 62:
        raise ValueError(f"level {deepest} of a grid of {n} has more than {1 << 19} cells a side")
    side = F.lit(n).cast("long") * F.pow(F.lit(2.0), F.col("level")).cast("long")
    number = lambda x, y, z: F.shiftleft(F.col("level").cast("long"), 57) + F.shiftleft(x, 38) + F.shiftleft(y, 19) + z
    own = cells.select("level", "ix", "iy", "iz").distinct().withColumn("node", number(F.col("ix"), F.col("iy"), F.col("iz")))
    own = stored(own, "cells")
    ahead = [("ix", F.pmod(F.col("ix") + 1, side), F.col("iy"), F.col("iz")), ("iy", F.col("ix"), F.pmod(F.col("iy") + 1, side), F.col("iz")), ("iz", F.col("ix"), F.col("iy"), F.pmod(F.col("iz") + 1, side))]
    pairs = own.select(F.col("node").alias("a"), F.explode(F.array(*(number(x, y, z) for _, x, y, z in ahead))).alias("b"))
    pairs = pairs.join(own.select(F.col("node").alias("b")), "b")
    label = min_labels(own, pairs)
    found = own.join(label, "node").select("level", "ix", "iy", "iz", F.col("label").alias("patch_id"))
    return cells.join(found, ["level", "ix", "iy", "iz"])


def patch_table(placed: DataFrame, n: int, centre: str = "com", box: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """One row a patch: level, centre, half extents, n_nodes, n_parts, of rows (level, cells, patch_id, x, y, z).

    A patch over the border is measured around its first cell, so that no mean
    mixes both ends of the box. ``centre``: com (mean of particles), geom (mean
    of cells), maxdens (the fullest cell), dens (mean of cells by their
    particles) or weighted: mean of cells by ``weights`` (level, ix, iy, iz,
    weight), such as :func:`depth_weights`; negative and missing weights count
    nothing, and a patch without any has its geom.
    """
    if centre == "weighted" and weights is None:
        raise ValueError("a weighted centre needs weights")
    side = F.lit(box) / (F.lit(float(n)) * F.pow(F.lit(2.0), F.col("level")))
    anchor = placed.groupBy("patch_id").agg(F.min(F.struct("ix", "iy", "iz")).alias("_a"))
    x = placed.join(anchor, "patch_id")
    x = x.withColumns({f"_a{k}": (F.col(f"_a.i{k}") + 0.5) * side for k in AXES})
    x = x.withColumns({f"_p{k}": pbc(F.col(k) - F.col(f"_a{k}"), box) for k in AXES} | {f"_c{k}": pbc((F.col(f"i{k}") + 0.5) * side - F.col(f"_a{k}"), box) for k in AXES})
    cells = x.groupBy("patch_id", "level", "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("_n"), *(F.first(f"_c{k}").alias(f"_c{k}") for k in AXES), *(F.sum(f"_p{k}").alias(f"_s{k}") for k in AXES), *(F.first(f"_a{k}").alias(f"_a{k}") for k in AXES))
    if weights is None:
        cells = cells.withColumn("_w", F.lit(0.0))
    else:
        given = weights.select("level", "ix", "iy", "iz", F.greatest(F.col("weight"), F.lit(0.0)).alias("_w"))
        cells = cells.join(given, ["level", "ix", "iy", "iz"], "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    full = F.struct("_n", (-F.col("ix")).alias("a"), (-F.col("iy")).alias("b"), (-F.col("iz")).alias("c"))
    g = cells.groupBy("patch_id", "level").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("_n").alias("n_parts"),
        *(F.first(f"_a{k}").alias(f"_a{k}") for k in AXES), *((F.sum(f"_s{k}") / F.sum("_n")).alias(f"com_{k}") for k in AXES),
        *(F.avg(f"_c{k}").alias(f"geom_{k}") for k in AXES), *((F.sum(F.col(f"_c{k}") * F.col("_n")) / F.sum("_n")).alias(f"dens_{k}") for k in AXES),
        *(F.coalesce(F.try_divide(F.sum(F.col(f"_c{k}") * F.col("_w")), F.sum("_w")), F.avg(f"_c{k}")).alias(f"weighted_{k}") for k in AXES), *(F.max_by(f"_c{k}", full).alias(f"maxdens_{k}") for k in AXES),
        *(((F.max(f"_c{k}") - F.min(f"_c{k}")) / 2).alias(f"_e{k}") for k in AXES),
    )
    wrapped = lambda v: v - box * F.floor(v / box)
    return g.select("patch_id", "level", *(wrapped(F.col(f"_a{k}") + F.col(f"{centre}_{k}")).alias(k) for k in AXES), "n_nodes", "n_parts", *((F.col(f"_e{k}") + side / 2).alias(f"h{k}") for k in AXES))


def level_histogram(table: DataFrame) -> DataFrame:
    return table.groupBy("level").agg(F.count(F.lit(1)).alias("n_patches"), F.sum("n_nodes").alias("n_nodes"), F.sum("n_parts").alias("n_parts"))


def power_spectrum(particles: DataFrame, n: int, box: float = 1.0, kernel: str = "tsc", fold: int = 0, mass: str = "mass") -> DataFrame:
    """(k, n_modes, power, shot): power by whole wave number of the folded box.

    The grid has n**3 nodes, whatever the number of particles: its size is the
    parameter's, so one task takes it for the Fourier transform. ``fold`` maps
    2**fold sub-cubes a side on each other.
    """
    if n > 512:
        raise ValueError("the transform runs in one task: n is 512 at most")
    small = box / 2**fold
    p = particles.withColumns({k: F.col(k) - small * F.floor(F.col(k) / small) for k in AXES})
    grid = deposit(p, n, small, kernel, mass)
    number = particles.agg(F.count(F.lit(1)).alias("count")).first()["count"]

    def transform(batches):
        rho = np.zeros((n, n, n))
        for b in batches:
            i = [b.column(k).to_numpy() for k in range(3)]
            np.add.at(rho, tuple(i), b.column(3).to_numpy())
        mean = rho.mean()
        delta = np.fft.fftn(rho / mean - 1 if mean else rho) / n**3
        f = np.rint(np.fft.fftfreq(n) * n)
        k = np.rint(np.sqrt(f[:, None, None] ** 2 + f[None, :, None] ** 2 + f[None, None, :] ** 2)).astype(int).ravel()
        modes = np.bincount(k)
        total = np.bincount(k, (np.abs(delta) ** 2).ravel())
        at = np.arange(1, n // 2 + 1)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(modes[at], pa.int64()), pa.array(total[at] / modes[at] * small**3)], ["k", "n_modes", "power"])

    out = grid.select("ix", "iy", "iz", "dens").coalesce(1).mapInArrow(transform, "k long, n_modes long, power double")
    return out.withColumn("shot", F.lit(small**3 / max(1, number)))


def potential(particles: DataFrame, n: int, box: float = 1.0, kernel: str = "tsc", mass: str = "mass") -> DataFrame:
    """(ix, iy, iz, delta, pot): density contrast on the nodes and the potential whose seven-point Laplacian it is, periodic, of mean 0.

    As in :func:`power_spectrum` one task transforms the grid, whose size is
    the parameter's.
    """
    if n > 512:
        raise ValueError("the transform runs in one task: n is 512 at most")
    grid = deposit(particles, n, box, kernel, mass)

    def solve(batches):
        rho = np.zeros((n, n, n))
        for b in batches:
            i = [b.column(k).to_numpy() for k in range(3)]
            np.add.at(rho, tuple(i), b.column(3).to_numpy())
        mean = rho.mean()
        delta = rho / mean - 1 if mean else rho
        wave = np.sin(np.pi * np.arange(n) / n) ** 2
        square = 4 * (n / box) ** 2 * (wave[:, None, None] + wave[None, :, None] + wave[None, None, :])
        square[0, 0, 0] = np.inf
        pot = np.fft.ifftn(np.fft.fftn(delta) / -square).real
        for plane in range(n):
            iy, iz = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n), indexing="ij"))
            yield pa.record_batch([pa.array(np.full(n * n, plane), pa.int64()), pa.array(iy, pa.int64()), pa.array(iz, pa.int64()), pa.array(delta[plane].ravel()), pa.array(pot[plane].ravel())], ["ix", "iy", "iz", "delta", "pot"])

    return grid.select("ix", "iy", "iz", "dens").coalesce(1).mapInArrow(solve, "ix long, iy long, iz long, delta double, pot double")


def depth_weights(cells: DataFrame, pot: DataFrame, n: int, size: int) -> DataFrame:
    """(level, ix, iy, iz, weight): depth of the potential (of ``size`` nodes a side) at each cell of a grid of ``n`` and its levels; heights weigh nothing."""
    own = cells.select("level", "ix", "iy", "iz").distinct()
    side = F.lit(float(n)) * F.pow(F.lit(2.0), F.col("level"))
    node = lambda k: F.floor((F.col(f"i{k}") + 0.5) / side * size).cast("long").alias(f"_{k}")
    depth = pot.select(*(F.col(f"i{k}").alias(f"_{k}") for k in AXES), F.greatest(-F.col("pot"), F.lit(0.0)).alias("weight"))
    return own.select("*", *(node(k) for k in AXES)).join(depth, [f"_{k}" for k in AXES]).select("level", "ix", "iy", "iz", "weight")


def smoothed_power(power: DataFrame) -> DataFrame:
    """Power with the mean over neighbouring wave numbers; the table has as many rows as the grid has numbers."""
    w = W.orderBy("k").rowsBetween(-1, 1)
    return power.withColumn("smooth", F.avg("power").over(w))


def hilbert_key(x: Column, y: Column, z: Column, bits: int = 10, box: float = 1.0) -> Column:
    """Place of a point on a Hilbert curve through 2**bits cells a side, by bit operations in one aggregate over the levels.

    The state is the walk's: an axis permutation and a flip, kept as three
    axis numbers and three signs; each level adds three bits to the key.
    """
    n = 1 << bits
    return hilbert_of_cell(*(F.least(F.greatest(F.floor(c / box * n), F.lit(0)), F.lit(n - 1)) for c in (x, y, z)), bits)


def hilbert_of_cell(ix: Column, iy: Column, iz: Column, bits: int) -> Column:
    """Key of a cell of 2**bits a side; keys of a level are compared as numbers."""
    level = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    start = F.struct(ix.cast("int").alias("a"), iy.cast("int").alias("b"), iz.cast("int").alias("c"))

    def undo(s: Column, bit: Column) -> Column:
        # Inverse undo of Skilling's transform at one level: for each axis, invert the low bits of the first axis or exchange them.
        one = F.expr("1")
        high = F.call_function("shiftleft", one, bit)
        low = high - 1
        v = [s["a"], s["b"], s["c"]]
        for i in range(3):
            t = v[0].bitwiseXOR(v[i]).bitwiseAND(low)
            hit = v[i].bitwiseAND(high) != 0
            first = F.when(hit, v[0].bitwiseXOR(low)).otherwise(v[0].bitwiseXOR(t))
            if i:
                v[i] = F.when(hit, v[i]).otherwise(v[i].bitwiseXOR(t))
            v[0] = first
        return F.struct(v[0].alias("a"), v[1].alias("b"), v[2].alias("c"))

    upper = F.filter(level, lambda b: b > 0)
    s = F.aggregate(upper, start, undo)
    return F.aggregate(F.array(s), F.lit(0).cast("long"), lambda acc, v: acc + _curve(v, bits))


def _curve(v: Column, bits: int) -> Column:
    """Gray decoding and interleaving of the transformed coordinates."""
    down = lambda last: F.sequence(F.lit(bits - 1), F.lit(last), F.lit(-1)) if bits > last else F.array().cast("array<int>")
    shift = lambda k: F.call_function("shiftleft", F.expr("1"), k)
    flip = F.aggregate(down(1), F.lit(0), lambda t, k: F.when(v["a"].bitwiseXOR(v["b"]).bitwiseXOR(v["c"]).bitwiseAND(shift(k)) != 0, t.bitwiseXOR(shift(k) - 1)).otherwise(t))
    start = F.struct(v["a"].alias("a"), v["a"].bitwiseXOR(v["b"]).alias("b"), v["a"].bitwiseXOR(v["b"]).bitwiseXOR(v["c"]).alias("c"), flip.alias("t"))
    bit = lambda x, t, k: F.call_function("shiftright", x.bitwiseXOR(t), k).bitwiseAND(F.expr("1")).cast("long")
    place = lambda s: F.aggregate(down(0), F.lit(0).cast("long"), lambda key, k: key * 8 + bit(s["a"], s["t"], k) * 4 + bit(s["b"], s["t"], k) * 2 + bit(s["c"], s["t"], k))
    return F.aggregate(F.array(start), F.lit(0).cast("long"), lambda acc, s: acc + place(s))


def hilbert_cell(key: Column, bits: int) -> Column:
    """(ix, iy, iz) of the cell that a key of ``bits`` levels names: the walk of :func:`hilbert_of_cell` backwards."""
    right = lambda x, k: F.call_function("shiftright", x, k)
    left = lambda x, k: F.call_function("shiftleft", x, k)
    bit = lambda k, axis: left(right(key, k * 3 + axis).bitwiseAND(F.lit(1).cast("long")).cast("int"), k)
    named = lambda a, b, c: F.struct(a.alias("a"), b.alias("b"), c.alias("c"))
    zero = F.lit(0)
    spread_out = F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), named(zero, zero, zero), lambda s, k: named(s["a"] + bit(k, 2), s["b"] + bit(k, 1), s["c"] + bit(k, 0)))
    plain = F.transform(F.array(spread_out), lambda s: F.array(s["a"].bitwiseXOR(right(s["c"], F.lit(1))), s["b"].bitwiseXOR(s["a"]), s["c"].bitwiseXOR(s["b"])))

    def redo(s: Column, step: Column) -> Column:
        # One axis at one level, the last axis first.
        axis, high = F.lit(2) - step % 3, left(F.expr("1"), F.floor(step / 3).cast("int") + 1)
        mine, first = F.get(s, axis), F.get(s, F.lit(0))
        hit = mine.bitwiseAND(high) != 0
        t = F.when(hit, F.lit(0)).otherwise(first.bitwiseXOR(mine).bitwiseAND(high - 1))
        flipped = first.bitwiseXOR(F.when(hit, high - 1).otherwise(t))
        return F.array(flipped, *(F.when(axis == k, mine.bitwiseXOR(t)).otherwise(F.get(s, F.lit(k))) for k in (1, 2)))

    steps = F.sequence(F.lit(0), F.lit(3 * bits - 4)) if bits > 1 else F.array().cast("array<int>")
    cell_of = F.aggregate(steps, F.get(plain, F.lit(0)), redo)
    return F.get(F.transform(F.array(cell_of), lambda s: F.struct(*(F.get(s, F.lit(c)).cast("long").alias(f"i{k}") for c, k in enumerate(AXES)))), F.lit(0))


def hilbert_parent(key: Column, levels: int) -> Column:
    """Key of the cell that holds a cell, ``levels`` coarser."""
    return F.shiftright(key.cast("long"), 3 * levels)


def hilbert_children(key: Column, levels: int) -> tuple[Column, Column]:
    """Least and largest key of the cells in a cell, ``levels`` finer."""
    first = F.shiftleft(key.cast("long"), 3 * levels)
    return first, first + ((1 << 3 * levels) - 1)


def hilbert_shell(key: Column, bits: int) -> Column:
    """Keys of the 27 cells around a cell, itself included, in the order of their offsets; periodic."""
    n = F.lit(1 << bits)
    offsets = F.array(*(F.struct(*(F.lit(o).alias(f"o{k}") for k, o in zip(AXES, off, strict=True))) for off in product((-1, 0, 1), repeat=3)))
    around = lambda c: F.transform(offsets, lambda o: hilbert_of_cell(*(F.pmod(c[f"i{k}"] + o[f"o{k}"], n) for k in AXES), bits))
    return F.get(F.transform(F.array(hilbert_cell(key, bits)), around), F.lit(0))
