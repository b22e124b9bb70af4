"""Concentrations, tensors and spins of objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfw_ratio(c: np.ndarray) -> np.ndarray:
    """(Vmax/Vvir)**2 of a profile of concentration c."""
    return 0.216 * c / (np.log1p(c) - c / (1 + c))


def nfw_concentration(ratio: np.ndarray) -> np.ndarray:
    """Concentration on [2.2, 100] by bisection; -1 where the squared velocity ratio isn't in (1, 5.9]."""
    ratio = np.asarray(ratio, float)
    lo, hi = np.full(ratio.shape, 2.2), np.full(ratio.shape, 100.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        up = nfw_ratio(mid) < ratio
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return np.where((ratio > 1) & (ratio <= 5.9), (lo + hi) / 2, -1.0)


def c_nfw(ratio: Column) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(nfw_concentration(x.to_numpy(float)))

    return F.pandas_udf(run, "double")(ratio)


def r1_ratio(c: np.ndarray) -> np.ndarray:
    """First moment radius over virial radius of a profile of concentration c."""
    return (c - 2 * np.log1p(c) + c / (1 + c)) / (c * (np.log1p(c) - c / (1 + c)))


def r1_concentration(ratio: np.ndarray) -> np.ndarray:
    """Concentration on [1, 500] by bisection; -1 where the ratio isn't in (0.19, 0.585)."""
    ratio = np.asarray(ratio, float)
    lo, hi = np.full(ratio.shape, 1.0), np.full(ratio.shape, 500.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        down = r1_ratio(mid) > ratio
        lo, hi = np.where(down, mid, lo), np.where(down, hi, mid)
    return np.where((ratio > 0.19) & (ratio < 0.585), (lo + hi) / 2, -1.0)


def c_r1(ratio: Column) -> Column:
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(r1_concentration(x.to_numpy(float)))

    return F.pandas_udf(run, "double")(ratio)


AXES = "struct<a:double,b:double,c:double,e1:array<double>,e2:array<double>,e3:array<double>>"


def axes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (n, 3) downwards and eigenvectors (n, 3, 3; rows), each vector's largest component positive."""
    values, vectors = np.linalg.eigh(t)
    values, vectors = values[:, ::-1], np.swapaxes(vectors, 1, 2)[:, ::-1]
    k = np.abs(vectors).argmax(axis=2)
    sign = np.sign(np.take_along_axis(vectors, k[:, :, None], axis=2))
    return values, vectors * np.where(sign == 0, 1, sign)


def shape(*columns: Column) -> Column:
    """Largest eigenvalue, axis ratios and axes of tensors (xx, yy, zz, xy, yz, xz, n); see :func:`shapes`."""

    def run(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, yz: pd.Series, xz: pd.Series, n: pd.Series) -> pd.DataFrame:
        return shapes(xx, yy, zz, xy, yz, xz, n)

    return F.pandas_udf(run, AXES)(*columns)


def shapes(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, yz: pd.Series, xz: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Largest eigenvalue, axis ratios b = sqrt(l2/l1), c = sqrt(l3/l1) and axes of symmetric tensors; (1, 0, 0) for 10 particles or fewer."""
    t = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], 1).astype(float)
    t = np.nan_to_num(t)
    values, vectors = axes(t) if len(t) else (np.zeros((0, 3)), np.zeros((0, 3, 3)))
    top = np.where(values[:, 0] > 0, values[:, 0], 1.0)
    few = (n.to_numpy() <= 10) | (values[:, 0] <= 0)
    ratio = np.sqrt(np.maximum(values, 0) / top[:, None])
    return pd.DataFrame({
        "a": np.where(few, 1.0, values[:, 0]), "b": np.where(few, 0.0, ratio[:, 1]), "c": np.where(few, 0.0, ratio[:, 2]),
        "e1": list(vectors[:, 0]), "e2": list(vectors[:, 1]), "e3": list(vectors[:, 2]),
    })


def spin(l: Column, m: Column, r: Column, factor: float = 1.0) -> Column:  # noqa: E741
    """Spin from specific angular momentum and the circular velocity at the edge."""
    return l / m / F.sqrt(2 * m * r) * factor


def energy_spin(l: Column, m: Column, energy: Column, g: float = 1.0) -> Column:  # noqa: E741
    """Spin from the total energy."""
    return F.sqrt(F.abs(energy)) * l / (g * F.pow(m, F.lit(1.5)) * m)


def surface_pressure(kin_out: Column, kin_in: Column, r_out: Column, r_in: Column) -> Column:
    """Surface term from the kinetic energies of the last two bins."""
    f = r_in / r_out
    return -0.125 * F.pow(1 + f, F.lit(3.0)) / (1 - f * f * f) * 2 * (kin_out - kin_in)
