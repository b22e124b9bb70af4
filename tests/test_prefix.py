from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cosmolake.operators import prefix


def members(spark, rows, extra=""):
    return spark.createDataFrame(rows, "halo_id long, pid long, d double, m double, dx double, dy double, dz double, vx double, vy double, vz double, u double" + extra)


def ball(n=200, halo=1, seed=0, hot=0.0):
    r = np.random.default_rng(seed)
    rad = np.sort(r.random(n)) ** (1 / 3)
    direction = r.normal(size=(n, 3))
    direction /= np.linalg.norm(direction, axis=1)[:, None]
    v = r.normal(size=(n, 3)) * 0.3
    if hot:
        v[-5:] += hot
    return [(halo, k, float(rad[k]), 1.0, *map(float, direction[k] * rad[k]), *map(float, v[k]), None) for k in range(n)]


def slow_potential(d, m):
    total = last_i = last_d = mass = 0.0
    phi = []
    for r, w in zip(d, m, strict=True):
        mass += w
        i = mass / r**2 if r > 5e-16 else last_i
        if r > 5e-16:
            total += 0.5 * (i + last_i) * (r - last_d)
        last_i, last_d = i, r
        phi.append(total)
    return phi, total + mass / d[-1]


def test_potential_equals_the_loop(spark):
    rows = [(1, 99, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None), *ball(80), *ball(3, halo=2)]
    got = prefix.potential(members(spark, rows), ["pid"]).orderBy("halo_id", "rn").collect()
    for halo in (1, 2):
        own = sorted((r[2], r[1], r[3]) for r in rows if r[0] == halo)
        phi, phi0 = slow_potential([o[0] for o in own], [o[2] for o in own])
        mine = [r for r in got if r["halo_id"] == halo]
        assert np.allclose([r["phi"] for r in mine], phi) and mine[0]["phi0"] == pytest.approx(phi0)


def test_virial_cut_includes_the_crossing_particle(spark):
    rows = ball(300)
    got = prefix.virial_cut(members(spark, rows), ["pid"], 150.0)
    d = [r[2] for r in rows]
    dens = [(k + 1) / (4 * math.pi / 3 * x**3) for k, x in enumerate(d)]
    cross = next((k for k, x in enumerate(dens) if x < 150.0), len(d) - 1)
    assert got.count() == cross + 1
    assert prefix.virial_cut(members(spark, rows), ["pid"], 0.0).count() == 300


def test_uniform_ball_has_cubic_mass(spark):
    p = prefix.profile(members(spark, ball(5000)), ["pid"]).collect()
    outer = [r for r in p if r["r"] > 0.3]
    assert all(r["npart"] == pytest.approx(5000 * r["r"] ** 3, rel=0.1) for r in outer)


def test_profile_bins_are_cumulative_and_strict(spark):
    rows = ball(100)
    p = prefix.profile(members(spark, rows), ["pid"]).orderBy("bin").collect()
    top = max(r["bin"] for r in p)
    for r in p:
        assert r["npart"] == (100 if r["bin"] == top else sum(x[2] < r["r"] - 1e-12 for x in rows))


def test_unbinding_drops_the_fast_ones_and_stops(spark):
    cold = prefix.unbind(members(spark, ball(120)), ["pid"], phi_factor=1.0)
    assert cold.count() == 120
    got = {r["pid"] for r in prefix.unbind(members(spark, ball(120, hot=500.0)), ["pid"]).collect()}
    assert got == set(range(115))
    assert prefix.unbind(members(spark, ball(10, hot=500.0)), ["pid"]).count() == 10  # below the least size nothing is tried


def test_unbinding_pass_equals_a_literal_walk():
    r = np.random.default_rng(3)
    n = 60
    d, m, v = np.sort(r.random(n)), r.random(n) + 0.5, r.normal(size=(n, 3)) * 8
    keep = prefix.unbind_once(m, d, v, np.zeros(n), 0, 1.0, 1.0)
    phi, phi0 = slow_potential(d, m)
    kept, bulk, mass = [], m[0] * v[0], m[0]
    for k in range(n):
        w = v[k] - bulk / mass
        if (w**2).sum() <= 2 * abs(phi[k] - phi0):
            if not kept:
                bulk, mass = np.zeros(3), 0.0
            kept.append(k)
            bulk, mass = bulk + m[k] * v[k], mass + m[k]
    assert np.flatnonzero(keep).tolist() == kept


def test_integrals_use_the_prefix_mean(spark):
    rows = ball(40)
    got = prefix.integrals(members(spark, rows), ["pid"]).collect()[0]
    v, x = np.array([r[7:10] for r in rows]), np.array([r[4:7] for r in rows])
    u = v - np.cumsum(v, axis=0) / np.arange(1, 41)[:, None]
    assert got["e_kin"] == pytest.approx(0.5 * (u**2).sum())
    assert got["l_z"] == pytest.approx((x[:, 0] * u[:, 1] - x[:, 1] * u[:, 0]).sum())


def test_smoothing_and_peaks():
    y = np.array([1.0, 2, 6, 2, 1])
    assert np.allclose(prefix.smooth(y), [1.5, 3, 10 / 3, 3, 1.5])
    x = np.linspace(0, 1, 101)
    at, _ = prefix.peak(x, np.exp(-((x - 0.4) ** 2) / 0.01), 1)
    assert at == pytest.approx(0.4, abs=0.02)


def test_convergence_flags_all_bins_up_to_the_last_bad_one(spark):
    p = spark.createDataFrame([(1, b, 0.1 * (b + 1), n, 1.0 * n, 1.0, 1.0, 1.0) for b, n in enumerate([2, 500, 3, 800, 900])], "halo_id long, bin int, r double, npart long, m_in_r double, ovdens double, dens double, v_circ double")
    got = [r["r"] < 0 for r in prefix.convergence_radius(p).orderBy("bin").collect()]
    assert got == [True, True, True, False, False]


def test_empty_and_single(spark):
    none = members(spark, [])
    assert prefix.potential(none, ["pid"]).count() == 0 and prefix.profile(none, ["pid"]).count() == 0 and prefix.unbind(none, ["pid"]).count() == 0
    one = members(spark, [(1, 1, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, None)])
    assert prefix.potential(one, ["pid"]).count() == 1 and prefix.profile(one, ["pid"]).count() == 1 and prefix.virial_cut(one, ["pid"], 200).count() == 1


def test_peaks_equal_the_curve_by_curve_version(spark):
    r = np.random.default_rng(9)
    rows = [(h, k, float(d), float(m)) for h, n in ((1, 60), (2, 7), (3, 3), (4, 6)) for k, (d, m) in enumerate(zip(np.sort(r.random(n)), r.random(n) + 0.5, strict=True))]
    got = {x["halo_id"]: x for x in prefix.peaks(spark.createDataFrame(rows, "halo_id long, pid long, d double, m double"), ["pid"]).collect()}
    for h in (1, 2, 3, 4):
        d, m = (np.array([x[c] for x in rows if x[0] == h]) for c in (2, 3))
        edge = np.concatenate([[0.0], d])
        q = m / (4 * np.pi / 3 * (edge[1:] ** 3 - edge[:-1] ** 3)) * d * d
        at, top = prefix.peak(d[5:], (np.cumsum(m) / d)[5:], 1)
        want = (at, np.sqrt(top), prefix.peak(d[5:], q[5:], 3)[0])
        assert np.allclose([got[h][c] for c in ("r_max", "v_max", "r2")], want, equal_nan=True)
    assert np.allclose(prefix.smooth(np.array([1.0, 5.0])), [1.0, 5.0])
    assert prefix.peak(np.array([1.0, 2, 3, 4]), np.array([1.0, 8, 2, 1]), 1) == (1.0, 1.0)  # the raw height where the smoothed curve [4.5, 3.7, 3.7, 1.5] is highest


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from cosmolake.operators import rounds

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="checkpoint"):
        rounds.folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://x:1")), "x")


def test_full_profile_equals_the_loop(spark):
    rows = ball(300, seed=3)
    rows = [(h, k, d, 1.0 + k % 3, *rest) for h, k, d, _, *rest in rows]
    got = prefix.full_profile(members(spark, rows), ["pid"], hubble=0.5, sums={"odd": F.when(F.col("pid") % 2 == 1, F.col("m"))}).orderBy("bin").collect()
    d, m = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    x, v = np.array([r[4:7] for r in rows]), np.array([r[7:10] for r in rows])
    phi, phi0 = slow_potential(d, m)
    u = v - np.cumsum(m[:, None] * v, axis=0) / np.cumsum(m)[:, None]
    kin = m * ((u + 0.5 * x) ** 2).sum(axis=1)
    spin = m[:, None] * np.cross(x, u)
    for r in got:
        n = r["npart"]
        assert r["m_in_r"] == pytest.approx(m[:n].sum()) and r["odd"] == pytest.approx(m[:n][1::2].sum())
        assert r["e_kin"] == pytest.approx(0.5 * kin[:n].sum()) and r["sig_v"] == pytest.approx(math.sqrt(kin[:n].sum() / m[:n].sum()))
        assert r["e_pot"] == pytest.approx(0.5 * (m[:n] * (np.array(phi[:n]) - phi0)).sum())
        assert r["v_esc"] == pytest.approx(math.sqrt(2 * abs(phi[n - 1] - phi0)))
        assert [r["l_x"], r["l_y"], r["l_z"]] == pytest.approx(list(spin[:n].sum(axis=0)))
        values, vectors = np.linalg.eigh((m[:n, None, None] * x[:n, :, None] * x[:n, None, :]).sum(axis=0))
        if n > 10:
            assert r["b"] == pytest.approx(math.sqrt(values[1] / values[2])) and abs(np.dot(r["e1"], vectors[:, 2])) == pytest.approx(1.0)
        else:
            assert (r["b"], r["c"]) == (0.0, 0.0)
    plain = prefix.profile(members(spark, rows), ["pid"]).orderBy("bin").collect()
    assert [tuple(r) for r in plain] == [tuple(r)[:8] for r in got]
    assert prefix.full_profile(members(spark, []), ["pid"]).count() == 0


def test_the_most_bound_particle_counts_its_mass(spark):
    rows = ball(60, seed=4)
    rows = [(h, k, d, 50.0 if k == 40 else 1.0, *rest) for h, k, d, _, *rest in rows]
    d, m = [r[2] for r in rows], np.array([r[3] for r in rows])
    v = np.array([r[7:10] for r in rows])
    phi, phi0 = slow_potential(d, m)
    u = v - np.cumsum(m[:, None] * v, axis=0) / np.cumsum(m)[:, None]
    e = m * (0.5 * (u**2).sum(axis=1) + np.array(phi) - phi0)
    assert [tuple(r) for r in prefix.most_bound(members(spark, rows), ["pid"]).collect()] == [(1, int(e.argmin()))]
