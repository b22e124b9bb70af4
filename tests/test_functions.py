from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cosmolake.functions import cosmology as c
from cosmolake.functions import expr, halo_math


def test_einstein_de_sitter():
    e = c.Cosmology(1.0, 0.0, 0.5)
    assert c.age(e, 1.0)[0] == pytest.approx(2 / 3, rel=1e-6)
    assert c.growth(e, np.array([0.25]))[0] == pytest.approx(0.25, rel=1e-5)
    assert c.virial_overdensity(e, 1.0) == pytest.approx(18 * math.pi**2, rel=0.01)
    assert c.deceleration(e, 0.3) == pytest.approx(0.5)


def test_vacuum_cosmology():
    v = c.Cosmology(0.3, 0.7, 0.7)
    assert c.age_gyr(v, 1.0)[0] == pytest.approx(13.467, abs=0.01)
    assert c.virial_overdensity(v, 1.0) == pytest.approx(337, rel=0.02)
    assert c.virial_overdensity(v, 1.0, critical=True) == pytest.approx(101, rel=0.02)
    assert c.a_of_age(v, c.age(v, 0.6))[0] == pytest.approx(0.6, rel=1e-4)
    assert c.omega(v, 1.0) + c.vacuum(v, 1.0) == pytest.approx(1)


def test_roots_and_interpolation():
    assert c.bisect(lambda x: x * x - 2, 0, 2) == pytest.approx(math.sqrt(2))
    lo, hi = c.bracket(lambda x: x - 10, 0, 1)
    assert lo < 10 < hi
    x = np.linspace(0, 3, 10)
    assert np.allclose(c.cubic_interpolate(x, x**3, [0.1, 1.55, 2.9]), [0.001, 1.55**3, 2.9**3])


def test_polynomials_splines_and_integrals():
    x = np.linspace(0, 3, 12)
    assert np.allclose(c.polynomial_interpolate(x, x**5, [0.1, 1.55, 2.9]), np.array([0.1, 1.55, 2.9]) ** 5)
    assert np.allclose(c.polynomial_interpolate(x[:3], x[:3] ** 2, [0.3]), [0.09])
    assert np.allclose(c.spline(x, x**3, 0.0, 27.0)([0.0, 0.1, 1.55, 2.9, 3.0]), np.array([0.0, 0.1, 1.55, 2.9, 3.0]) ** 3)
    natural = c.spline(x, np.sin(np.pi * x))
    assert np.allclose(natural(x), np.sin(np.pi * x)) and natural([1.4])[0] == pytest.approx(math.sin(1.4 * math.pi), abs=0.01)
    assert c.spline([0, 2], [1, 5])([0.5])[0] == pytest.approx(2)
    assert c.integrate(np.sqrt, 0, 1) == pytest.approx(2 / 3, rel=1e-8)
    assert c.integrate(lambda t: 1 / (1e-4 + t * t), -1, 1) == pytest.approx(200 * math.atan(100), rel=1e-8)
    assert c.integrate(np.exp, 1, 0) == pytest.approx(1 - math.e) and c.integrate(np.exp, 2, 2) == 0


def test_concentrations():
    assert halo_math.nfw_concentration(np.array([1.0, 6.0])).tolist() == [-1, -1]
    got = halo_math.nfw_concentration(np.array([3.0]))[0]
    assert 2.2 <= got <= 100 and halo_math.nfw_ratio(got) == pytest.approx(3.0)
    at = halo_math.r1_concentration(np.array([0.3, 0.1, 0.7]))
    assert at[1] == at[2] == -1 and halo_math.r1_ratio(at[0]) == pytest.approx(0.3)


def test_axes_are_sorted_and_signed():
    t = np.diag([1.0, 9.0, 4.0])[None]
    values, vectors = halo_math.axes(t)
    assert values[0].tolist() == [9, 4, 1] and vectors[0, 0].tolist() == [0, 1, 0]


def test_expressions(spark):
    r = spark.range(1).select(
        expr.pbc(F.lit(0.9) - F.lit(0.05)).alias("d"), expr.wrap(F.lit(-0.25)).alias("w"), expr.serial_id(F.lit(63), F.lit(4)).alias("s"), expr.serial_snap(F.lit(63 * 10**12 + 5)).alias("t"),
        expr.packed_id(F.lit(12345), F.lit(0.5), F.lit(0.25), F.lit(0.0)).alias("p"), expr.frac(F.lit(4.0)).alias("f"),
    ).first()
    assert r["d"] == pytest.approx(-0.15) and r["w"] == pytest.approx(0.75) and r["s"] == 63 * 10**12 + 5 and r["t"] == 63 and r["f"] == 0.25
    assert r["p"] == (4 << 60) + (1 << 59) + (1 << 38) or r["p"] == ((4 << 60) | (524288 << 40) | (262144 << 20))
