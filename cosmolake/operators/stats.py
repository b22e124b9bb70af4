"""Statistics of fields and catalogues: velocity moments and histograms, expansion scatter, mass functions, weight classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from cosmolake.functions.expr import distance2, pbc
from cosmolake.operators.rounds import BROADCAST_ROWS, stored
from cosmolake.operators.spatial import AXES, around, cell, cells_across
from cosmolake.session import ship


def velocity_moments(particles: DataFrame) -> DataFrame:
    """One row: n, mean velocities, mean speed, 3-D dispersion about the means, least and largest speed, mean angular momentum."""
    speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    l = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}  # noqa: E741
    return particles.agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(f"v{k}").alias(f"mean_v{k}") for k in AXES), F.avg(speed).alias("mean_speed"),
        F.sqrt(F.var_pop("vx") + F.var_pop("vy") + F.var_pop("vz")).alias("sigma"), F.min(speed).alias("min_speed"), F.max(speed).alias("max_speed"),
        *(F.avg(F.col(p) * F.col(f"v{q}") - F.col(q) * F.col(f"v{p}")).alias(f"mean_l{k}") for k, (p, q) in l.items()),
    )


def speed_histogram(particles: DataFrame, low: float, high: float, bins: int, log: bool = False) -> DataFrame:
    """(bin, v, n, density): counts of speeds in equal or logarithmic bins; the density integrates to the share inside."""
    speed = F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2)
    f = (lambda c: F.log10(c)) if log else (lambda c: c)
    lo, hi = (math.log10(low), math.log10(high)) if log else (low, high)
    width = (hi - lo) / bins
    x = particles.select(speed.alias("s")).where((F.col("s") >= low) & (F.col("s") < high)).select(F.floor((f(F.col("s")) - lo) / width).cast("int").alias("bin"))
    total = particles.agg(F.count(F.lit(1)).alias("_all"))
    h = x.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total), F.lit(True))  # one row
    mid = lo + (F.col("bin") + 0.5) * width
    return h.select("bin", (F.pow(F.lit(10.0), mid) if log else mid).alias("v"), "n", (F.col("n") / F.col("_all") / width).alias("density"))


BLOCK = 2_048  #: Points of one cell that meet observers together, about.
PAIRS = 1 << 15  #: Pairs that are worked on at once.
SHARDS = 8  #: Over so many keys at most the observers that meet one block are dealt.


def _meetings(observers: DataFrame, halos: DataFrame, n: int, box: float) -> DataFrame:
    """(block, shard, side, observer, x..vz, known): a block's objects (side 0), then the observers in the cells around it, for each shard of them.

    Cells hold blocks of about ``BLOCK`` objects; a task holds one block and a
    batch of observers. ``known``: no velocity is null.
    """
    vs = [f"v{k}" for k in AXES]
    row = lambda x, *more: x.select(
        *more, *(F.col(k).cast("double").alias(k) for k in AXES), *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in vs),
        (F.col("vx").isNotNull() & F.col("vy").isNotNull() & F.col("vz").isNotNull()).alias("known"),
    )
    b = row(halos, *(cell(k, n, box).alias(f"c{k}") for k in AXES))
    cells = ["cx", "cy", "cz"]
    parts = b.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    blocks = parts.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).withColumn("block", F.monotonically_increasing_id())
    blocks = stored(blocks.withColumn("shards", F.least("parts", F.lit(SHARDS))), "blocks")
    few = F.broadcast(blocks) if blocks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else blocks
    # Objects are dealt by their place in the input, so that a heap at one point is dealt too.
    deal = b.withColumn("_i", F.monotonically_increasing_id()).join(F.broadcast(parts) if few is not blocks else parts, cells)
    theirs = deal.withColumn("part", F.pmod("_i", "parts").cast("int")).drop("parts").join(few, [*cells, "part"])
    theirs = theirs.select("block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(0).alias("side"), F.lit(None).cast(observers.schema["observer"].dataType).alias("observer"), *AXES, *vs, "known")
    ours = row(observers, "observer", F.explode(around(n, box)).alias("_c")).select("*", "_c.*").join(few, cells)
    ours = ours.select("block", F.pmod(F.xxhash64(*AXES, *vs), "shards").cast("int").alias("shard"), F.lit(1).alias("side"), "observer", *AXES, *vs, "known")
    spark = observers.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return theirs.union(ours).repartition(tasks, "block", "shard").sortWithinPartitions("block", "shard", "side")


def _rates(a: np.ndarray, b: np.ndarray, known_a: np.ndarray, known_b: np.ndarray, squares: list[float], hubble: float, box: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each observer (columns of ``a``: x..vz) and sphere: the sum of the rates of the objects ``b`` in it, how many they are, and how many have one."""
    total, n, m = (np.zeros((len(squares), a.shape[1]), t) for t in (np.float64, np.int64, np.int64))
    step = max(1, PAIRS // b.shape[1])
    for at in range(0, a.shape[1], step):
        p = a[:, at : at + step]
        d2, los = np.zeros((2, p.shape[1], b.shape[1]))
        for k in range(3):
            d = b[k][None, :] - p[k][:, None]
            if not (b[k].max() - p[k].min() < box / 2 and b[k].min() - p[k].max() >= -box / 2):
                d -= box * np.floor(d / box + 0.5)
            los += (b[k + 3][None, :] - p[k + 3][:, None]) * d
            d *= d
            d2 += d
        apart = d2 > 0
        both = known_a[at : at + step, None] & known_b[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            los /= d2
        los += hubble
        los[~(apart & both)] = 0.0
        whole = bool(both.all())
        for s, square in enumerate(squares):
            inside = d2 <= square
            total[s, at : at + step] = np.where(inside, los, 0.0).sum(axis=1)
            inside &= apart
            n[s, at : at + step] = inside.sum(axis=1)
            m[s, at : at + step] = n[s, at : at + step] if whole else (inside & both).sum(axis=1)
    return total, n, m


def expansion_scatter(observers: DataFrame, halos: DataFrame, radius: float, box: float = 1.0, hubble: float = 100.0, spheres: int = 1) -> DataFrame:
    """(observer, sphere, h_los, n): mean line-of-sight expansion rate of objects around observers in nested spheres of radius * k / spheres.

    Observers meet the objects of neighbouring cells block by block in Arrow:
    no row is a pair. A cell of many objects is dealt over many keys.
    """
    ship(observers.sparkSession)
    squares = [min(radius * radius, (radius * (k + 1) / spheres) ** 2) for k in range(spheres)]
    x = _meetings(observers, halos, cells_across(radius, box), box)
    kind = observers.schema["observer"].dataType
    columns = [*AXES, *(f"v{k}" for k in AXES)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            block, shard, side = (batch.column(k).to_numpy() for k in range(3))
            cut = np.flatnonzero((block[1:] != block[:-1]) | (shard[1:] != shard[:-1]) | (side[1:] != side[:-1])) + 1
            values = np.stack([batch.column(c).to_numpy() for c in columns])
            known = batch.column("known").to_numpy(zero_copy_only=False)
            ends = [0, *cut.tolist(), batch.num_rows] if batch.num_rows else [0]
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                key = (block[i], shard[i])
                if side[i] == 0:
                    held = [*(held if key == at else []), (values[:, i:j], known[i:j])]
                    at = key
                    continue
                if len(held) > 1:
                    held = [(np.concatenate([v for v, _ in held], axis=1), np.concatenate([w for _, w in held]))]
                total, n, m = _rates(values[:, i:j], held[0][0], known[i:j], held[0][1], squares, hubble, box)
                s, k = np.nonzero(n)
                who = batch.column("observer").take(pa.array(i + k))
                yield pa.record_batch([who, pa.array(s + 1, pa.int32()), pa.array(total[s, k]), pa.array(n[s, k]), pa.array(m[s, k])], ["observer", "sphere", "total", "n", "m"])

    fields = StructType([StructField("observer", kind), StructField("sphere", IntegerType()), StructField("total", DoubleType()), StructField("n", LongType()), StructField("m", LongType())])
    g = x.mapInArrow(task, fields).groupBy("observer", "sphere").agg(F.sum("total").alias("t"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    return g.select("observer", "sphere", F.when(F.col("m") > 0, F.col("t") / F.col("m")).alias("h_los"), "n")


def expansion_variance(scatter: DataFrame) -> DataFrame:
    """(sphere, mean_h, sigma_h): mean over observers and relative scatter of their rates."""
    g = scatter.groupBy("sphere").agg(F.avg("h_los").alias("mean_h"), F.stddev_pop("h_los").alias("_s"), F.count(F.lit(1)).alias("n_observers"))
    return g.select("sphere", "mean_h", (F.col("_s") / F.abs(F.col("mean_h"))).alias("sigma_h"), "n_observers")


def weight_classes(particles: DataFrame, tolerance: float = 0.1, most: int = 100_000) -> list[tuple[float, float, int]]:
    """(weight, total mass, n) of species by weight, in order of first appearance: a weight within ``tolerance`` of a class seen before belongs to it.

    Works on the distinct weights with their first pid; more than ``most`` of
    them aren't species and raise.
    """
    rows = particles.groupBy("mass").agg(F.min("pid").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("first", "mass").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct weights")
    out: list[list[float]] = []
    parts: list[list[float]] = []
    for r in rows:
        for k, c in enumerate(out):
            if abs(r["mass"] - c[0]) <= tolerance * c[0]:
                c[1] += r["n"]
                parts[k].append(r["mass"] * r["n"])
                break
        else:
            out.append([r["mass"], r["n"]])
            parts.append([r["mass"] * r["n"]])
    return [(c[0], math.fsum(p), int(c[1])) for c, p in zip(out, parts, strict=True)]


def extent(particles: DataFrame) -> DataFrame:
    """One row: least and largest coordinate along each axis."""
    return particles.agg(*(f(k).alias(f"{n}_{k}") for k in AXES for n, f in (("min", F.min), ("max", F.max))))


def scaled(particles: DataFrame, length: float, velocity: float, mass: float) -> DataFrame:
    """Positions, velocities and masses multiplied by unit factors."""
    return particles.withColumns({k: F.col(k) * length for k in AXES} | {f"v{k}": F.col(f"v{k}") * velocity for k in AXES} | {"mass": F.col("mass") * mass})


def near_host(halos: DataFrame, host: int, box: float = 1.0) -> DataFrame:
    """Objects within the radius of a host, the host included, with their places on a stereographic map around it."""
    h = halos.where(F.col("halo_id") == host).select(*(F.col(k).alias(f"_{k}") for k in (*AXES, "radius")))
    x = halos.join(F.broadcast(h), F.lit(True))  # one row
    x = x.where(distance2([F.col(k) for k in AXES], [F.col(f"_{k}") for k in AXES], box) < F.col("_radius") * F.col("_radius"))
    return x.select("halo_id", *(pbc(F.col(k) - F.col(f"_{k}"), box).alias(f"r{k}") for k in AXES), "radius")


def with_replacement(rows: DataFrame, share: float, seed: int = 1) -> DataFrame:
    return rows.sample(withReplacement=True, fraction=share, seed=seed)


def drawn(rows: DataFrame, n: int, key: str, seed: int = 1) -> DataFrame:
    """n rows without replacement, the first by a hash of their key: the same ones each time."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def criteria_counts(halos: DataFrame, host: int, reach: float = 1.0, min_npart: int = 20, box: float = 1.0) -> DataFrame:
    """(criterion, n, mass, mass_fraction) of a host's subs by radius (d + R/2 <= reach R_host) and by pointer."""
    h = halos.where(F.col("halo_id") == host).select(*(F.col(k).alias(f"_{k}") for k in (*AXES, "radius", "mass")))
    x = halos.where((F.col("halo_id") != host) & (F.col("npart") >= min_npart)).join(F.broadcast(h), F.lit(True))  # one row
    d = F.sqrt(distance2([F.col(k) for k in AXES], [F.col(f"_{k}") for k in AXES], box))
    x = x.withColumn("_c", F.explode(F.array_compact(F.array(F.when(d + 0.5 * F.col("radius") <= reach * F.col("_radius"), F.lit("radius")), F.when(F.col("host_id") == host, F.lit("pointer"))))))
    return x.groupBy(F.col("_c").alias("criterion")).agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"), (F.sum("mass") / F.first("_mass")).alias("mass_fraction"))


def criteria_difference(halos: DataFrame, host: int, reach: float = 1.0, min_npart: int = 20, box: float = 1.0) -> DataFrame:
    """(halo_id, kind): subs by radius without a pointer to anything (``free``) or with one elsewhere (``elsewhere``)."""
    h = halos.where(F.col("halo_id") == host).select(*(F.col(k).alias(f"_{k}") for k in (*AXES, "radius")))
    x = halos.where((F.col("halo_id") != host) & (F.col("npart") >= min_npart)).join(F.broadcast(h), F.lit(True))  # one row
    d = F.sqrt(distance2([F.col(k) for k in AXES], [F.col(f"_{k}") for k in AXES], box))
    x = x.where((d + 0.5 * F.col("radius") <= reach * F.col("_radius")) & (F.col("host_id") != host))
    return x.select("halo_id", F.when(F.col("host_id") < 0, "free").otherwise("elsewhere").alias("kind"))
