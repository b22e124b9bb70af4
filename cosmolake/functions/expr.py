"""Column expressions: periodic distances, ids, merits, units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SERIAL = 10**12  #: Multiplier of the snapshot in a serial object id.


def pbc(d: Column, box: float = 1.0) -> Column:
    """Minimum-image coordinate difference in a periodic box."""
    return d - box * F.floor(d / box + 0.5)


def distance2(a: list[Column], b: list[Column], box: float | None = 1.0) -> Column:
    """Squared distance; ``box`` None: not periodic."""
    parts = [(x - y) if box is None else pbc(x - y, box) for x, y in zip(a, b, strict=True)]
    return reduce(lambda s, p: s + p * p, parts, F.lit(0.0))


def wrap(x: Column, box: float = 1.0) -> Column:
    """A coordinate moved into [0, box)."""
    return x - box * F.floor(x / box)


def merit(common: Column, n0: Column, n1: Column) -> Column:
    """Shared fraction of two memberships: common squared by the product of sizes."""
    return common.cast("double") * common / (n0.cast("double") * n1)


def frac(x: Column) -> Column:
    """A ratio folded to at most 1."""
    return F.least(x, 1 / x)


def serial_id(snap: Column, index: Column) -> Column:
    """Serial object id: snapshot times 10**12 plus the 1-based index."""
    return snap.cast("long") * F.lit(SERIAL) + index.cast("long") + 1


def serial_snap(haloid: Column) -> Column:
    """The snapshot of a serial id, by whole-number division."""
    return F.call_function("div", haloid.cast("long"), F.lit(SERIAL))


def packed_id(npart: Column, x: Column, y: Column, z: Column) -> Column:
    """Packed object id: decimal magnitude of npart in the top four bits, then 20 bits for each unit-box coordinate (signed bit pattern)."""
    axis = lambda c: F.floor(c * F.lit(1 << 20)).cast("long").bitwiseAND(F.lit((1 << 20) - 1))
    size = F.shiftleft(F.floor(F.log10(npart.cast("double"))).cast("long"), 60)
    return size.bitwiseOR(F.shiftleft(axis(x), 40)).bitwiseOR(F.shiftleft(axis(y), 20)).bitwiseOR(axis(z))


def snap_id(snap: Column, index: Column) -> Column:
    """Snapshot in the top bits, index in the lower 54."""
    return F.shiftleft(snap.cast("long"), 54).bitwiseOR(index.cast("long"))


def grid_index(pid: Column, n: int) -> tuple[Column, Column, Column]:
    """Lattice position of a particle numbered x first in an n by n by n start grid."""
    return pid % n, F.floor(pid / n).cast("long") % n, F.floor(pid / (n * n)).cast("long")


def gaussian(x: Column, a: float, mu: float, sigma: float) -> Column:
    return a * F.exp(-((x - mu) * (x - mu)) / (2 * sigma * sigma))


def lognormal(x: Column, a: float, mu: float, sigma: float) -> Column:
    return a / x * F.exp(-((F.log(x) - mu) * (F.log(x) - mu)) / (2 * sigma * sigma))


def powerlaw(x: Column, a: float, n: float) -> Column:
    return a * F.pow(x, F.lit(n))


def physical(value: Column, kind: str, a: float, h: float) -> Column:
    """A comoving h-unit value in physical units: lengths by a/h, masses by 1/h, the rest as it is."""
    return value * (a / h) if kind == "length" else value / h if kind == "mass" else value
