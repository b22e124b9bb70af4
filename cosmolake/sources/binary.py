"""Binary sources: particle snapshots and memberships of fixed layouts, read in ranges of rows by many tasks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cosmolake.sources.files import listed, opened

RANGE = 1 << 20  #: Particles of one range.
PARTICLES = "pid long, x double, y double, z double, vx double, vy double, vz double, mass double, u double, ptype int"
_NAMES = [f.split()[0] for f in PARTICLES.split(", ")]
_KINDS = [pa.int64(), *[pa.float64()] * 8, pa.int32()]


def _spread(spark: SparkSession, ranges: DataFrame) -> DataFrame:
    return ranges.repartition(4 * spark.sparkContext.defaultParallelism, "path", "first")


def _ranged(spark: SparkSession, path: str | list[str], count, read, beside=None) -> DataFrame:
    """Rows of files: ``count(file)`` tells how many, ``read(file, first, n)`` yields batches of a range.

    ``beside(path)`` names a small file that goes with each; both functions
    take its bytes as a last argument.
    """

    def more(p: str) -> tuple[bytes, ...]:
        if beside is None:
            return ()
        system, at = opened(beside(p))
        with system.open_input_file(at) as f:
            return (f.read(),)

    def plan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            rows = []
            for p in b.column(0).to_pylist():
                system, at = opened(p)
                with system.open_input_file(at) as f:
                    n = count(f, *more(p))
                rows += [(p, k, min(RANGE, n - k)) for k in range(0, n, RANGE)]
            cols = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "first", "n"])

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for p, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, at = opened(p)
                with system.open_input_file(at) as f:
                    yield read(f, first, n, *more(p))

    files = listed(spark, path).where("length > 0").select("path")
    ranges = files.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(plan, "path string, first long, n long")
    return _spread(spark, ranges).mapInArrow(task, PARTICLES)


def _rows(pid, pos, vel, mass, u, ptype) -> pa.RecordBatch:
    cols = [pid, *pos.T, *vel.T, mass, u, ptype]
    return pa.record_batch([pa.array(np.ascontiguousarray(c), k, from_pandas=True) for c, k in zip(cols, _KINDS, strict=True)], _NAMES)


class GadgetLayout:
    """Where the blocks of a Gadget file lie: byte order, version, header, offsets by name."""

    def __init__(self, f) -> None:
        f.seek(0)
        start = f.read(4)
        for order in "<>":
            (size,) = struct.unpack(order + "i", start)
            if size in (256, 8):
                break
        else:
            raise ValueError("not a Gadget file")
        self.order, self.version = order, 2 if size == 8 else 1
        self.blocks: list[tuple[str, int, int]] = []
        f.seek(0, 2)
        end, at = f.tell(), 0
        while at < end:
            name = ""
            if self.version == 2:
                f.seek(at + 4)
                name = f.read(4).decode("ascii", "replace").strip()
                at += 16
            f.seek(at)
            (size,) = struct.unpack(order + "i", f.read(4))
            self.blocks.append((name, at + 4, size & 0xFFFFFFFF))
            at += 8 + (size & 0xFFFFFFFF)
        f.seek(self.blocks[0][1])
        head = f.read(256)
        self.np = np.array(struct.unpack(order + "6i", head[:24]), np.int64)
        self.massarr = np.array(struct.unpack(order + "6d", head[24:72]))
        self.a, self.z = struct.unpack(order + "2d", head[72:88])
        self.box, self.omega0, self.lambda0, self.h = struct.unpack(order + "4d", head[128:160])
        self.n = int(self.np.sum())
        self.varied = [k for k in range(6) if self.np[k] and self.massarr[k] <= 0]
        names = ["HEAD", "POS", "VEL", "ID"] + (["MASS"] if self.varied else []) + ["U"]
        self.at = {(b[0] or (names[k] if k < len(names) else f"BLOCK{k}")): b[1:] for k, b in enumerate(self.blocks)}

    def numbers(self, f, name: str, per: int, total: int, first: int, n: int) -> np.ndarray:
        """n rows of ``per`` numbers of a block of ``total`` rows; the width follows from the block's size."""
        offset, size = self.at[name]
        width = size // max(1, total * per)
        kind = ("i" if name == "ID" else "f") + str(width)
        f.seek(offset + first * per * width)
        return np.frombuffer(f.read(n * per * width), self.order + kind).reshape(n, per) if per > 1 else np.frombuffer(f.read(n * width), self.order + kind)


def gadget(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Particles of Gadget-1/2 snapshots of one or many files, in the files' units; species by the header's counts, u for gas."""

    def read(f, first: int, n: int) -> pa.RecordBatch:
        g = GadgetLayout(f)
        edge = np.cumsum(g.np)
        ptype = np.searchsorted(edge, np.arange(first, first + n), side="right").astype(np.int32)
        mass = g.massarr[ptype].astype(float)
        if g.varied and "MASS" in g.at:
            has = np.isin(np.arange(6), g.varied)
            every = np.repeat(has, g.np)  # which particles stand in the block
            before = int(every[:first].sum())
            mine = every[first : first + n]
            mass[mine] = g.numbers(f, "MASS", 1, int(g.np[has].sum()), before, int(mine.sum()))
        u = np.full(n, np.nan)
        gas = max(0, min(n, int(g.np[0]) - first))
        if gas and "U" in g.at:
            u[:gas] = g.numbers(f, "U", 1, int(g.np[0]), first, gas)
        return _rows(g.numbers(f, "ID", 1, g.n, first, n).astype(np.int64), g.numbers(f, "POS", 3, g.n, first, n).astype(float), g.numbers(f, "VEL", 3, g.n, first, n).astype(float), mass, u, ptype)

    return _ranged(spark, path, lambda f: GadgetLayout(f).n, read)


_TIPSY = {"gas": 12, "dark": 9, "star": 11}


def _tipsy_head(f) -> tuple[str, int, int, int]:
    f.seek(0)
    head = f.read(32)
    for order in "<>":
        _, _, ndim, nsph, ndark, nstar, _ = struct.unpack(order + "d6I", head)
        if ndim == 3:
            return order, nsph, ndark, nstar
    raise ValueError("not a TIPSY file")


def tipsy(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Particles of TIPSY files: gas, dark, star records; ids by place, dark and stars before gas."""

    def read(f, first: int, n: int) -> pa.RecordBatch:
        order, nsph, ndark, nstar = _tipsy_head(f)
        spans, at, base = [], 32, 0
        for kind, count, ptype in (("gas", nsph, 0), ("dark", ndark, 1), ("star", nstar, 4)):
            lo, hi = max(first, base), min(first + n, base + count)
            if lo < hi:
                width = _TIPSY[kind]
                f.seek(at + (lo - base) * width * 4)
                v = np.frombuffer(f.read((hi - lo) * width * 4), order + "f4").reshape(-1, width).astype(float)
                place = np.arange(lo - base, hi - base)
                pid = place + {"gas": ndark + nstar, "dark": 0, "star": ndark}[kind]
                spans.append((pid, v[:, 1:4], v[:, 4:7], v[:, 0], v[:, 8] if kind == "gas" else np.full(hi - lo, np.nan), np.full(hi - lo, ptype, np.int32)))
            at += count * _TIPSY[kind] * 4
            base += count
        return _rows(*(np.concatenate(c) for c in zip(*spans, strict=True)))

    return _ranged(spark, path, lambda f: sum(_tipsy_head(f)[1:]), read)


def cubep3m(spark: SparkSession, path: str | list[str], grid: int, offset: tuple[float, float, float] = (0.0, 0.0, 0.0), mass: float = 8.0, chunked: bool = False) -> DataFrame:
    """Particles of CubeP3M files: 48-byte header (208 when chunked), then six float32 a particle; positions move by the file's offset and wrap in the grid."""
    skip = 208 if chunked else 48

    def count(f) -> int:
        f.seek(0)
        return struct.unpack("<i", f.read(4))[0]

    def read(f, first: int, n: int) -> pa.RecordBatch:
        f.seek(skip + first * 24)
        v = np.frombuffer(f.read(n * 24), "<f4").reshape(-1, 6).astype(float)
        return _rows(np.arange(first, first + n), np.mod(v[:, :3] + np.array(offset), grid), v[:, 3:], np.full(n, mass), np.full(n, np.nan), np.full(n, 1, np.int32))

    return _ranged(spark, path, count, read)


#: ART's header record: 45 characters, 21 numbers of four bytes (the 13th to 16th and the 5th whole), 100 further ones.
_ART_HEAD = 45 + 4 * 121


class ArtHeader:
    """What an ART header file says: rows of a page, species with their masses and the ends of their rows."""

    def __init__(self, head: bytes) -> None:
        self.order = next((o for o in "<>" if struct.unpack(o + "i", head[:4])[0] == _ART_HEAD), None)
        if self.order is None:
            raise ValueError("not an ART header file")
        self.aexpn, _, _, _, _, self.mass = struct.unpack(self.order + "4fif", head[49:73])
        rows, self.grid, species, _, self.omega0, self.lambda0, self.h = struct.unpack(self.order + "4i3f", head[97:125])
        self.masses = np.frombuffer(head[133:], self.order + "f4", species).astype(float)
        self.ends = np.frombuffer(head[173:], self.order + "i4", species).astype(np.int64)
        self.box, self.unit = (struct.unpack(self.order + "f", head[133 + 4 * k : 137 + 4 * k])[0] for k in (99, 58))
        self.page = rows * rows
        self.n = int(self.ends[-1]) if species else rows**3


def art(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Particles of ART files (``PMcrs0.DAT``, headers ``PMcrd.DAT`` beside them), all dark.

    A file is pages of six blocks, one for each coordinate and velocity; the
    last page is as long as the others. Positions start at 1 in the file, at 0
    here. A particle's id is its place plus one page, and the species (so the
    mass) is looked up by that id, the last one's beyond its end.
    """

    def beside(p: str) -> str:
        folder, _, name = p.rpartition("/")
        return f"{folder}/PMcrd{name[name.rindex('s') + 2 :]}"

    def read(f, first: int, n: int, head: bytes) -> pa.RecordBatch:
        h = ArtHeader(head)
        pieces = []
        for page in range(first // h.page, (first + n - 1) // h.page + 1):
            lo, hi = max(first, page * h.page) - page * h.page, min(first + n, (page + 1) * h.page) - page * h.page
            columns = []
            for k in range(6):
                f.seek(((page * 6 + k) * h.page + lo) * 4)
                columns.append(np.frombuffer(f.read((hi - lo) * 4), h.order + "f4"))
            pieces.append(np.stack(columns, 1))
        v = np.concatenate(pieces)
        pid = np.arange(first, first + n) + h.page
        mass = h.masses[np.minimum(np.searchsorted(h.ends, pid, side="right"), len(h.ends) - 1)] if len(h.ends) else np.full(n, h.mass)
        return _rows(pid, (v[:, :3] - np.float32(1)).astype(float), v[:, 3:].astype(float), mass, np.full(n, np.nan), np.full(n, 1, np.int32))

    return _ranged(spark, path, lambda f, head: ArtHeader(head).n, read, beside)


#: DEVA's species by code: star -1, dark 0, gas 1 and 2.
_DEVA_STAR, _DEVA_DARK = -1, 0


class DevaLayout:
    """Where the blocks of a DEVA file lie; ``native`` files are Fortran records, one for each number of the header and one a block."""

    def __init__(self, f, native: bool) -> None:
        f.seek(0)
        if native:
            start = f.read(4)
            self.order = next((o for o in "<>" if struct.unpack(o + "i", start)[0] in (4, 8)), None)
            if self.order is None:
                raise ValueError("not a native DEVA file")
            f.seek(0, 2)
            end, at, records = f.tell(), 0, []
            while at < end:
                f.seek(at)
                (size,) = struct.unpack(self.order + "i", f.read(4))
                records.append((at + 4, size))
                at += 8 + size
            ints, reals = records[0][1], records[100][1]
            at = records[0][0]
            f.seek(0)
            head = f.read(records[200][0] - 4)
            number = lambda k, kind, width: struct.unpack(self.order + {("i", 4): "i", ("i", 8): "q", ("f", 4): "f", ("f", 8): "d"}[kind, width], head[records[k][0] : records[k][0] + width])[0]
            whole, real = (lambda k: number(k, "i", ints)), (lambda k: number(100 + k, "f", reals))
            places = [r[0] for r in records[200:]]
        else:
            head = f.read(800)
            self.order = min("<>", key=lambda o: struct.unpack(o + "I", head[28:32])[0])  # read the wrong way round, a number of particles is larger
            ints = reals = 4
            whole = lambda k: struct.unpack(self.order + "i", head[4 * k : 4 * k + 4])[0]
            real = lambda k: struct.unpack(self.order + "f", head[400 + 4 * k : 404 + 4 * k])[0]
            places = None
        self.n, self.gas, self.stars = whole(7), whole(8), whole(23)
        self.baryons = self.gas + self.stars
        self.ints, self.reals = f"{self.order}i{ints}", f"{self.order}f{reals}"
        self.a, self.box, h0t0 = real(1), real(33), real(38)
        #: Thermal energies in (km/s)**2.
        self.energy = (self.a * 100 * self.box / h0t0) ** 2 if h0t0 else 0.0
        if places is None:
            widths = [reals, 3 * reals, 3 * reals, ints]
            places = [800]
            for w in widths:
                places.append(places[-1] + w * self.n)
            places.append(places[-1] + reals * self.baryons)
        self.at = dict(zip(("mass", "pos", "vel", "kind", "soft", "energy"), places, strict=False))

    def numbers(self, f, name: str, per: int, first: int, n: int) -> np.ndarray:
        kind = np.dtype(self.ints if name == "kind" else self.reals)
        f.seek(self.at[name] + first * per * kind.itemsize)
        v = np.frombuffer(f.read(n * per * kind.itemsize), kind)
        return v.reshape(n, per) if per > 1 else v


def deva(spark: SparkSession, path: str | list[str], native: bool = False) -> DataFrame:
    """Particles of DEVA files in the files' units, thermal energies in (km/s)**2; ids are places. Gas and stars come first, and only gas has an energy."""

    def read(f, first: int, n: int) -> pa.RecordBatch:
        d = DevaLayout(f, native)
        kind = d.numbers(f, "kind", 1, first, n)
        ptype = np.select([kind == _DEVA_DARK, kind == _DEVA_STAR], [1, 4], 0).astype(np.int32)
        u = np.full(n, np.nan)
        some = max(0, min(n, d.baryons - first))
        if some:
            u[:some] = np.where(ptype[:some] == 0, d.numbers(f, "energy", 1, first, some) * d.energy, np.nan)
        return _rows(np.arange(first, first + n), d.numbers(f, "pos", 3, first, n).astype(float), d.numbers(f, "vel", 3, first, n).astype(float), d.numbers(f, "mass", 1, first, n).astype(float), u, ptype)

    return _ranged(spark, path, lambda f: DevaLayout(f, native).n, read)


def memberships_bin(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, halo_id, pid, ptype) of binary memberships: uint64 count, then for each object uint64 npart and id, and npart pairs uint64 pid, uint32 species."""
    pair = np.dtype([("pid", "<u8"), ("ptype", "<u4")])

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for p in b.column(0).to_pylist():
                system, at = opened(p)
                with system.open_input_stream(at, compression=None) as f:
                    (halos,) = struct.unpack("<Q", f.read(8))
                    for _ in range(halos):
                        n, halo = struct.unpack("<QQ", f.read(16))
                        for k in range(0, n, RANGE):
                            v = np.frombuffer(f.read(min(RANGE, n - k) * pair.itemsize), pair)
                            yield pa.record_batch([pa.array([p] * len(v), pa.string()), pa.array(np.full(len(v), halo, np.int64)), pa.array(v["pid"].astype(np.int64)), pa.array(v["ptype"].astype(np.int32))], ["file", "halo_id", "pid", "ptype"])

    return listed(spark, path).select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(task, "file string, halo_id long, pid long, ptype int")


def catalogue_bin(spark: SparkSession, path: str | list[str], longs: list[str], counts: list[str], floats: list[str]) -> DataFrame:
    """Fixed-width catalogue rows after a header of uint64 rows and uint32 columns: uint64 ``longs``, uint32 ``counts``, float32 ``floats``."""
    row = np.dtype([(c, "<u8") for c in longs] + [(c, "<u4") for c in counts] + [(c, "<f4") for c in floats])
    names = [*longs, *counts, *floats]
    schema = ", ".join([f"`{c}` long" for c in (*longs, *counts)] + [f"`{c}` double" for c in floats])

    def task(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for p in b.column(0).to_pylist():
                system, at = opened(p)
                with system.open_input_stream(at, compression=None) as f:
                    n, width = struct.unpack("<QI", f.read(12))
                    if width != len(names):
                        raise ValueError(f"{p}: {width} columns, {len(names)} expected")
                    for k in range(0, n, RANGE):
                        v = np.frombuffer(f.read(min(RANGE, n - k) * row.itemsize), row)
                        yield pa.record_batch([pa.array(v[c].astype(np.float64 if c in floats else np.int64)) for c in names], names)

    return listed(spark, path).select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(task, schema)


#: Formats that need a library this engine doesn't bring, and numbers of formats that no reader serves.
UNSUPPORTED = ("hdf5", "unknown")


def snapshot(spark: SparkSession, path: str | list[str], kind: str, **options) -> DataFrame:
    """Particles of a snapshot by the name of its format; ``parquet`` is the engine's own, ``empty`` has no rows."""
    if kind in UNSUPPORTED:
        raise ValueError(f"no reader for {kind} snapshots: convert them to parquet with the columns {PARTICLES}")
    if kind == "empty":
        return spark.createDataFrame([], PARTICLES)
    if kind == "parquet":
        return spark.read.parquet(*([path] if isinstance(path, str) else path))
    if kind == "ascii":
        from cosmolake.sources.text import ascii_snapshot

        return ascii_snapshot(spark, path).drop("file")
    return {"gadget": gadget, "tipsy": tipsy, "cubep3m": cubep3m, "art": art, "deva": deva}[kind](spark, path, **options)
