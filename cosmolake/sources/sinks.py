"""Sinks: ordered text of catalogues, memberships and trees, tables, and writers of Gadget and TIPSY files.

Text that must be in order is ranged and sorted in parallel: the part files
of a folder, put together by name, are the file. Reading such a folder takes
``whole=True``.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cosmolake.sources.files import opened


def write_lines(rows: DataFrame, order: list[str], path: str, parts: int | None = None) -> None:
    """``value`` of rows in the order of the given columns."""
    n = parts or rows.sparkSession.sparkContext.defaultParallelism
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def _joined(columns: list[str], sep: str = "\t") -> Column:
    return F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in columns))


def halos_text(halos: DataFrame, path: str, columns: list[str], by: str = "npart", min_npart: int = 20) -> None:
    """A catalogue by ``by`` down under a line of numbered names, objects of ``min_npart`` particles at least."""
    rows = halos.where(F.col("npart") >= min_npart).select(F.lit(1).alias("a"), (-F.col(by)).cast("double").alias("b"), F.col("halo_id").alias("c"), _joined(columns).alias("value"))
    head = halos.sparkSession.createDataFrame([(0, 0.0, 0, "#" + "\t".join(f"{c}({k + 1})" for k, c in enumerate(columns)))], "a int, b double, c long, value string")
    write_lines(head.union(rows), ["a", "b", "c"], path)


def profiles_text(profiles: DataFrame, path: str, columns: list[str]) -> None:
    """Bins of all objects in the order of ``idx`` and ``bin``."""
    rows = profiles.select(F.lit(1).alias("a"), F.col("idx").cast("long").alias("b"), F.col("bin").cast("long").alias("c"), _joined(columns).alias("value"))
    head = profiles.sparkSession.createDataFrame([(0, 0, 0, "#" + "\t".join(f"{c}({k + 1})" for k, c in enumerate(columns)))], "a int, b long, c long, value string")
    write_lines(head.union(rows), ["a", "b", "c"], path)


def _blocks(rows: DataFrame, key: str, head: Column, line: Column, order: list[str], total: bool) -> DataFrame:
    """(a, b, c, value): per key a head line, then its rows; before all the number of keys."""
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    heads = size.select(F.lit(1).alias("a"), F.col(key).alias("b"), F.lit(0).alias("c"), head.alias("value"))
    body = rows.select(F.lit(1).alias("a"), F.col(key).alias("b"), F.row_number().over(W.partitionBy(key).orderBy(*order)).alias("c"), line.alias("value"))
    out = heads.union(body)
    return out.union(size.agg(F.lit(0).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("c"), F.count(F.lit(1)).cast("string").alias("value"))) if total else out


def particles_text(members: DataFrame, path: str) -> None:
    """Memberships (halo_id, pid, ptype): the count, then blocks."""
    write_lines(_blocks(members, "halo_id", F.concat_ws(" ", "n", "halo_id"), F.concat_ws("\t", "pid", "ptype"), ["pid", "ptype"], True), ["a", "b", "c"], path)


def stars_text(stars: DataFrame, path: str) -> None:
    """Star particles (halo_id, pid, mass, age, metal) in blocks."""
    write_lines(_blocks(stars, "halo_id", F.concat_ws(" ", "n", "halo_id"), _joined(["pid", "mass", "age", "metal"], " "), ["pid"], True), ["a", "b", "c"], path)


def substructure_text(halos: DataFrame, path: str) -> None:
    """Hosts, each with its number of subs and their list on the next line."""
    s = halos.where("host_id >= 0").groupBy("host_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("halo_id")).alias("subs"))
    text = F.concat(F.concat_ws(" ", "host_id", "n"), F.lit("\n"), F.array_join(F.col("subs").cast("array<string>"), " "))
    write_lines(s.select("host_id", text.alias("value")), ["host_id"], path)


def tree_text(edges: DataFrame, path: str) -> None:
    """Three folders of one snapshot's ranked edges: ``mtree`` blocks, ``mtree_idx`` best only, ``croco`` with counts and merits."""
    size = edges.groupBy("haloid", "npart").agg(F.count(F.lit(1)).alias("n"))
    n = F.lit(1)
    body = lambda line: edges.select(n.alias("a"), F.col("haloid").alias("b"), F.col("rank").cast("long").alias("c"), line.alias("value"))
    heads = lambda line: size.select(n.alias("a"), F.col("haloid").alias("b"), F.lit(0).cast("long").alias("c"), line.alias("value"))
    total = size.agg(F.lit(0).alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), F.count(F.lit(1)).cast("string").alias("value"))
    note = lambda rows: edges.sparkSession.createDataFrame([(0, -1, k, v) for k, v in enumerate(rows)], "a int, b long, c long, value string")
    order = ["a", "b", "c"]
    write_lines(total.union(heads(F.concat_ws(" ", "haloid", "n"))).union(body(F.col("progid").cast("string"))), order, f"{path}/mtree")
    write_lines(note(["# haloid progid"]).union(edges.where("rank = 1").select(n, F.col("haloid"), F.lit(1).cast("long"), F.concat_ws(" ", "haloid", "progid"))), order, f"{path}/mtree_idx")
    crossed = heads(F.concat_ws(" ", "haloid", "npart", "n")).union(body(F.concat_ws(" ", "common", "progid", "npart_prog", "merit")))
    write_lines(note(["# object, particles, progenitors", "# common particles, progenitor, its particles, merit", "#"]).union(crossed), order, f"{path}/croco")


def merged_tree_text(edges: DataFrame, path: str) -> None:
    """All snapshots' ranked edges (serial ids) as one tree: two heads, the count, blocks, END."""
    size = edges.groupBy("haloid").agg(F.count(F.lit(1)).alias("n"))
    text = edges.sparkSession.createDataFrame([(0, 0, 0, "1"), (0, 0, 1, "merged tree"), (2, 0, 0, "END")], "a int, b long, c long, value string")
    total = size.agg(F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.lit(2).cast("long").alias("c"), F.count(F.lit(1)).cast("string").alias("value"))
    heads = size.select(F.lit(1), F.col("haloid"), F.lit(0).cast("long"), F.concat_ws(" ", "haloid", "n"))
    body = edges.select(F.lit(1), F.col("haloid"), F.col("rank").cast("long"), F.col("progid").cast("string"))
    write_lines(text.union(total).union(heads).union(body), ["a", "b", "c"], path)


def table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A Parquet table, the engine's binary form and its cache, partitioned by the given columns."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def saved(df: DataFrame, name: str) -> None:
    """A table of the session's catalogue."""
    df.write.mode("overwrite").saveAsTable(name)


def geometry_text(halos: DataFrame, path: str) -> None:
    """Spheres ``s x y z r red green blue`` of a catalogue by id."""
    value = F.concat(F.lit("s "), _joined(["x", "y", "z", "radius"], " "), F.lit(" 1 0 0"))
    write_lines(halos.select("halo_id", value.alias("value")), ["halo_id"], path)


def ascii_snapshot_text(particles: DataFrame, path: str, header: dict[str, str]) -> None:
    """A text snapshot by pid under ``# Key = value`` lines."""
    head = particles.sparkSession.createDataFrame([(0, k, f"# {a} = {b}") for k, (a, b) in enumerate(header.items())], "a int, b long, value string")
    rows = particles.select(F.lit(1), F.col("pid"), _joined(["x", "y", "z", "vx", "vy", "vz", "mass", "u"], " "))
    write_lines(head.union(rows), ["a", "b"], path)


def disks_text(halos: DataFrame, bins: DataFrame, path: str, halo_columns: list[str], bin_columns: list[str], min_stars: int = 10) -> None:
    """Objects of ``min_stars`` stars at least with their bins under them; the object line ends in the number of bins."""
    some = halos.where(F.col("n_star") >= min_stars)
    n = bins.groupBy("halo_id").agg(F.count(F.lit(1)).alias("_n"))
    heads = some.join(n, "halo_id", "left").select(F.col("halo_id").alias("b"), F.lit(-1).alias("c"), F.concat_ws(" ", F.col("halo_id").cast("string"), _joined(halo_columns, " "), F.coalesce("_n", F.lit(0)).cast("string")).alias("value"))
    body = bins.join(some.select("halo_id"), "halo_id", "left_semi").select(F.col("halo_id").alias("b"), F.col("bin").alias("c"), _joined(bin_columns, " ").alias("value"))
    write_lines(heads.union(body), ["b", "c"], path)


def gadget_files(particles: DataFrame, folder: str, box: float, a: float = 1.0, omega0: float = 0.3, lambda0: float = 0.7, h: float = 0.7, files: int = 1) -> DataFrame:
    """Write a Gadget-1 snapshot of several files; returns their manifest (path, n). A task holds one file's particles: choose ``files`` by memory.

    Particles (pid, x, y, z, vx, vy, vz, mass, u, ptype) are dealt by a hash of
    their id; each file counts its own, all carry the totals.
    """
    totals = {r["ptype"]: r["n"] for r in particles.groupBy("ptype").agg(F.count(F.lit(1)).alias("n")).collect()}  # six species at most
    all_n = [int(totals.get(k, 0)) for k in range(6)]

    def block(data: bytes) -> bytes:
        return struct.pack("<i", len(data)) + data + struct.pack("<i", len(data))

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(found)
        if not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held).sort_by([("ptype", "ascending"), ("pid", "ascending")])
        col = {c: t[c].to_numpy() for c in t.column_names}
        np_ = np.bincount(col["ptype"], minlength=6)[:6]
        head = struct.pack("<6i6d2d2i6Iii4d", *map(int, np_), *[0.0] * 6, a, 1 / a - 1, 0, 0, *all_n, 0, files, box, omega0, lambda0, h).ljust(256, b"\0")
        body = block(head)
        for names in (("x", "y", "z"), ("vx", "vy", "vz")):
            body += block(np.stack([col[c] for c in names], 1).astype("<f4").tobytes())
        body += block(col["pid"].astype("<i8").tobytes()) + block(col["mass"].astype("<f4").tobytes())
        if np_[0]:
            body += block(np.nan_to_num(col["u"][: np_[0]]).astype("<f4").tobytes())
        yield _written(folder, body, len(t))

    return _dealt(particles, files).mapInArrow(task, "path string, n long")


def _dealt(particles: DataFrame, files: int) -> DataFrame:
    return particles.select("pid", "x", "y", "z", "vx", "vy", "vz", "mass", "u", "ptype").repartition(files, "pid")


def _written(folder: str, body: bytes, n: int) -> pa.RecordBatch:
    """A snapshot file of its own name; a task that runs again leaves the first one's file unlisted."""
    path = f"{folder}/snapshot-{uuid.uuid4().hex}"
    system, at = opened(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(at, compression=None) as out:
        out.write(body)
    return pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], ["path", "n"])


def tipsy_files(particles: DataFrame, folder: str, a: float = 1.0, files: int = 1, x_unit: float = 1.0, v_unit: float = 1.0, m_unit: float = 1.0) -> DataFrame:
    """Write TIPSY snapshots; returns their manifest (path, n). A task holds one file's particles: choose ``files`` by memory.

    Gas (ptype 0) comes first, then dark particles, then stars (ptype 4), each
    by pid; ``u`` stands where gas has its temperature. Positions, velocities
    and masses are multiplied by their units.
    """

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(found)
        if not sum(b.num_rows for b in held):
            return
        t = pa.Table.from_batches(held).sort_by([("pid", "ascending")])
        col = {c: t[c].to_numpy() for c in t.column_names}
        kinds = {"gas": col["ptype"] == 0, "star": col["ptype"] == 4}
        kinds["dark"] = ~(kinds["gas"] | kinds["star"])
        n = {k: int(v.sum()) for k, v in kinds.items()}
        body = struct.pack("<d6I", a, len(t), 3, n["gas"], n["dark"], n["star"], 0)
        for kind, width in (("gas", 12), ("dark", 9), ("star", 11)):
            rows = np.zeros((n[kind], width), "<f4")
            for k, (c, unit) in enumerate([("mass", m_unit), *((c, x_unit) for c in ("x", "y", "z")), *((c, v_unit) for c in ("vx", "vy", "vz"))]):
                rows[:, k] = col[c][kinds[kind]] * unit
            if kind == "gas":
                rows[:, 8] = np.nan_to_num(col["u"][kinds[kind]].astype(float))
            body += rows.tobytes()
        yield _written(folder, body, len(t))

    return _dealt(particles.withColumn("u", F.col("u").cast("double")), files).mapInArrow(task, "path string, n long")
