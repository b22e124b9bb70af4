"""Text sources: snapshots, catalogues, memberships, trees and small tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.sources.files import parsed

HEADER_LINES = 12


def ascii_header(first: list[str]) -> dict[str, str]:
    """``# Key = value`` lines as a dict."""
    return {k.strip("# \t"): v.strip() for k, _, v in (line.partition("=") for line in first if line.startswith("#") and "=" in line)}


def ascii_snapshot(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """(file, pid, x, y, z, vx, vy, vz, mass, u, ptype) of text snapshots: header lines, then 6 to 8 numbers a row.

    The id is the row's place; without a mass column the header's PMass holds;
    u is -1 if missing, and tells the species: gas from 0 up, else -u.
    """

    def parse(rows: Iterator[str]) -> Iterator[tuple]:
        head: list[str] = []
        pid, pmass = 0, 1.0
        for line in rows:
            if line.startswith("#"):
                head.append(line)
                pmass = float(ascii_header(head).get("PMass", pmass))
                continue
            v = line.split()
            if len(v) < 6:
                continue
            mass = float(v[6]) if len(v) > 6 else pmass
            u = float(v[7]) if len(v) > 7 else -1.0
            yield pid, *map(float, v[:6]), mass, u, 0 if u >= 0 else int(-u)
            pid += 1

    return parsed(spark, path, "pid long, x double, y double, z double, vx double, vy double, vz double, mass double, u double, ptype int", parse, whole)


def _clean(name: str) -> str:
    return re.sub(r"\(\d+\)$", "", name.lstrip("#"))


def catalogue_text(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, long_columns: tuple[str, ...] = ("haloid", "hostHalo", "host_id", "numSubStruct", "num_sub", "npart", "nbins")) -> DataFrame:
    """A catalogue of white-space separated columns under one ``#name(1) name(2) ...`` line; ``columns`` picks some.

    Names come from the first line of the first file, which the driver reads;
    rows are split and cast by Spark.
    """
    text = spark.read.text(path)
    head = text.where(F.col("value").startswith("#")).limit(1).collect()
    names = [_clean(n) for n in head[0]["value"].split()] if head else []
    parts = F.split(F.trim("value"), "\\s+")
    picked = columns or names
    cols = [F.get(parts, F.lit(names.index(c))).cast("long" if c in long_columns else "double").alias(c) for c in picked]
    return text.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(*cols)


def memberships(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """(file, halo_id, npart, pid, ptype) of ragged membership files: a count, then blocks ``npart haloid`` and npart rows ``pid [ptype]``.

    A leading count line may be missing; a species outside 0 to 5, or none, is 1.
    """

    def parse(rows: Iterator[str]) -> Iterator[tuple]:
        for line in rows:
            v = line.split()
            if len(v) < 2 or line.startswith("#"):
                continue
            n, halo = int(v[0]), int(v[1])
            for _ in range(n):
                w = next(rows).split()
                kind = int(w[1]) if len(w) > 1 else 1
                yield halo, n, int(w[0]), kind if 0 <= kind <= 5 else 1

    return parsed(spark, path, "halo_id long, npart long, pid long, ptype int", parse, whole)


def star_particles(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """(file, halo_id, pid, mass, age, metal): blocks ``n haloid`` and rows of star particles."""

    def parse(rows: Iterator[str]) -> Iterator[tuple]:
        for line in rows:
            v = line.split()
            if len(v) < 2 or line.startswith("#"):
                continue
            for _ in range(int(v[0])):
                w = next(rows).split()
                yield int(v[1]), int(w[0]), float(w[1]), float(w[2]), float(w[3])

    return parsed(spark, path, "halo_id long, pid long, mass double, age double, metal double", parse, whole)


def tree_croco(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """(file, haloid, npart, rank, progid, npart_prog, common, merit): comment lines, blocks ``haloid npart nprog`` and rows ``common progid npart_prog merit``."""

    def parse(rows: Iterator[str]) -> Iterator[tuple]:
        for line in rows:
            if line.startswith("#") or not line.strip():
                continue
            halo, npart, n = map(int, line.split()[:3])
            for k in range(n):
                w = next(rows).split()
                yield halo, npart, k + 1, int(w[1]), int(w[2]), int(w[0]), float(w[3]) if len(w) > 3 else None

    return parsed(spark, path, "haloid long, npart long, rank int, progid long, npart_prog long, common long, merit double", parse, whole)


def tree_merged(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """(file, haloid, rank, progid) of merged trees: a version line, a description, a count, blocks ``haloid nprog``, END."""

    def parse(rows: Iterator[str]) -> Iterator[tuple]:
        next(rows, None)
        next(rows, None)
        next(rows, None)
        for line in rows:
            v = line.split()
            if not v or v[0] == "END":
                continue
            for k in range(int(v[1])):
                yield int(v[0]), k + 1, int(next(rows).split()[0])

    return parsed(spark, path, "haloid long, rank int, progid long", parse, whole)


def tree_blocks(spark: SparkSession, path: str | list[str], whole: bool = False) -> DataFrame:
    """(file, haloid, rank, progid) of one snapshot's tree: a count, then blocks ``haloid nprog``."""

    def parse(rows: Iterator[str]) -> Iterator[tuple]:
        next(rows, None)
        for line in rows:
            v = line.split()
            if not v or line.startswith("#"):
                continue
            for k in range(int(v[1])):
                yield int(v[0]), k + 1, int(next(rows).split()[0])

    return parsed(spark, path, "haloid long, rank int, progid long", parse, whole)


def best_progenitors(rows: DataFrame) -> DataFrame:
    """(haloid, progid): first progenitors; an id of 0 means none."""
    return rows.where((F.col("rank") == 1) & (F.col("progid") != 0)).select("haloid", "progid")


def columns_of(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """White-space separated numbers by position, comment lines left out; ``schema`` in DDL."""
    parts = F.split(F.trim("value"), "\\s+")
    fields = [f.split() for f in schema.split(",")]
    text = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return text.select(*(F.get(parts, F.lit(k)).cast(f[1]).alias(f[0]) for k, f in enumerate(fields)))


def tree_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(haloid, progid) of an index file."""
    return columns_of(spark, path, "haloid long, progid long")


def snap_map(spark: SparkSession, path: str) -> DataFrame:
    """(snapid, zred, aexp, cosmictime)."""
    return columns_of(spark, path, "snapid int, zred double, aexp double, cosmictime double")


def dark_energy(spark: SparkSession, path: str) -> DataFrame:
    """(a, hubble, omega_m) by a."""
    return columns_of(spark, path, "a double, hubble double, omega_m double").orderBy("a")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(haloid): a count line, then ids."""

    def parse(rows: Iterator[str]) -> Iterator[tuple]:
        next(rows, None)
        for line in rows:
            if line.strip():
                yield (int(line.split()[0]),)

    return parsed(spark, path, "haloid long", parse).drop("file")


def redshifts(spark: SparkSession, path: str) -> DataFrame:
    """(snapid, zred): one z a line, or ``isnap z``; without a number the line's place."""

    def parse(rows: Iterator[str]) -> Iterator[tuple]:
        for k, line in enumerate(x for x in rows if x.strip() and not x.startswith("#")):
            v = line.split()
            yield (int(v[0]), float(v[1])) if len(v) > 1 and v[1] != "_" else (k, float(v[0]))

    return parsed(spark, path, "snapid int, zred double", parse).drop("file")


def redshift_of_name(path: Column) -> Column:
    """The number after the last z of a file name."""
    return F.regexp_extract(path, r"^.*z([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def disks(spark: SparkSession, path: str | list[str], bins: str = "nbins") -> DataFrame:
    """(file, haloid, bin, line, kind): object lines and their bin lines of disk files; the object's last column counts its bins.

    Numbers stay in ``values`` as text; the object line has bin -1.
    """

    def parse(rows: Iterator[str]) -> Iterator[tuple]:
        for line in rows:
            if line.startswith("#") or not line.strip():
                continue
            v = line.split()
            yield int(v[0]), -1, " ".join(v)
            for k in range(int(v[-1])):
                yield int(v[0]), k, " ".join(next(rows).split())

    return parsed(spark, path, "haloid long, bin int, line string", parse)


def profiles_text(spark: SparkSession, profile_path: str, halos: DataFrame) -> DataFrame:
    """(halo_id, bin, values): profile rows given to their objects by walking the catalogue's ``nbins``.

    ``halos`` has (halo_id, idx, nbins) in the file's order.
    """
    from pyspark.sql.window import Window as W

    def parse(rows: Iterator[str]) -> Iterator[tuple]:
        k = 0
        for line in rows:
            if line.startswith("#") or not line.strip():
                continue
            yield k, " ".join(line.split())
            k += 1

    rows = parsed(spark, profile_path, "place long, line string", parse)
    # A catalogue is one row an object, so its running sum is the walk itself.
    start = halos.withColumn("_from", F.coalesce(F.sum("nbins").over(W.orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = start.select("halo_id", F.explode(F.sequence(F.lit(0), F.col("nbins") - 1)).alias("bin"), "_from").withColumn("place", F.col("_from") + F.col("bin"))
    return own.join(rows, "place").select("halo_id", "bin", F.transform(F.split("line", " "), lambda v: v.cast("double")).alias("values"))
