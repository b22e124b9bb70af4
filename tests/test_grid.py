from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cosmolake.operators import grid
from cosmolake.operators.rounds import min_labels
from cosmolake.plans.finder import Settings, find_halos


def particles(spark, rows):
    return spark.createDataFrame([(k, *map(float, r), 0.0, 0.0, 0.0, 1.0, 1) for k, r in enumerate(rows)], "pid long, x double, y double, z double, vx double, vy double, vz double, mass double, ptype int")


@pytest.mark.parametrize("kernel", grid.KERNELS)
def test_deposit_keeps_mass(spark, kernel):
    p = particles(spark, np.random.default_rng(0).random((50, 3)))
    assert grid.deposit(p, 4, kernel=kernel).agg({"dens": "sum"}).first()[0] == pytest.approx(50)


def test_uniform_lattice_has_mean_density(spark):
    n = 4
    p = particles(spark, [((i + 0.5) / n, (j + 0.5) / n, (k + 0.5) / n) for i in range(n) for j in range(n) for k in range(n)])
    assert all(r["dens"] == pytest.approx(1) for r in grid.density_at(p, n).collect())


def test_power_of_a_wave(spark):
    n = 8
    x = np.arange(64) / 64
    x = (x + 0.02 * np.sin(2 * np.pi * 2 * x)) % 1
    rows = [(a, (j + 0.5) / n, (k + 0.5) / n) for a in x for j in range(n) for k in range(n)]
    got = {r["k"]: r["power"] for r in grid.power_spectrum(particles(spark, rows), n).collect()}
    assert max(got, key=got.get) == 2


def test_labels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 9), (7, 7)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 7, 8, 9)], "node long")
    assert {r["node"]: r["label"] for r in min_labels(nodes, edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 4, 7: 7, 8: 8}


def test_refinement_reaches_neighbours(spark):
    cells = spark.createDataFrame([(3, 3, 3, 9), (0, 0, 0, 1)], "ix long, iy long, iz long, n_part long")
    got = {tuple(r) for r in grid.to_refine(cells, 8, 5).collect()}
    assert len(got) == 18 and (2, 2, 2) in got and (3, 4, 4) in got and (4, 3, 3) not in got


def clump(centre, n, radius, seed):
    r = np.random.default_rng(seed)
    d = r.normal(size=(n, 3))
    d *= (radius * r.random(n) / np.linalg.norm(d, axis=1))[:, None]
    return np.mod(np.array(centre) + d, 1)


def test_two_clumps_and_one_over_the_border(spark):
    rows = np.concatenate([clump((0.25, 0.25, 0.25), 200, 0.01, 1), clump((0.0, 0.75, 0.5), 100, 0.01, 2), np.random.default_rng(3).random((60, 3))])
    halos, members, profiles = find_halos(particles(spark, rows), Settings(grid=8, per_cell=5, unbind=True))
    got = sorted(((r["npart"], round(r["x"], 1) % 1, r["host_id"]) for r in halos.collect()), reverse=True)
    assert len(got) >= 2 and got[0][0] >= 195 and got[1][0] >= 97
    assert got[0][1] == pytest.approx(0.2, abs=0.1) and got[1][1] == pytest.approx(0.0, abs=0.01) and got[0][2] == got[1][2] == -1
    assert members.count() == sum(g[0] for g in got) and profiles.count() > 0


def test_hilbert_neighbours_along_the_curve_touch(spark):
    n = 4
    rows = [((i + 0.5) / n, (j + 0.5) / n, (k + 0.5) / n) for i in range(n) for j in range(n) for k in range(n)]
    got = particles(spark, rows).select("x", "y", "z", grid.hilbert_key(F.col("x"), F.col("y"), F.col("z"), 2).alias("key")).orderBy("key").collect()
    assert [r["key"] for r in got] == list(range(64))
    for a, b in zip(got, got[1:], strict=False):
        assert sum(abs(a[c] - b[c]) for c in "xyz") == pytest.approx(1 / n)


def test_too_many_cells_raise(spark):
    import pytest

    from cosmolake.operators import grid

    cells = spark.createDataFrame([(11, 1, 2, 3)], "level int, ix long, iy long, iz long")
    with pytest.raises(ValueError, match="cells a side"):
        grid.patches(cells, 512)
    assert grid.patches(cells, 256).count() == 1


def test_hilbert_keys_back_to_cells(spark):
    for bits in (1, 2, 3):
        n = 1 << bits
        x = spark.range(n**3).withColumn("c", grid.hilbert_cell(F.col("id"), bits))
        x = x.withColumn("key", grid.hilbert_of_cell(F.col("c.ix"), F.col("c.iy"), F.col("c.iz"), bits)).select("id", "key", "c.*").collect()
        assert all(r["id"] == r["key"] for r in x) and len({(r["ix"], r["iy"], r["iz"]) for r in x}) == n**3


def test_hilbert_levels_and_shells(spark):
    x = spark.range(512).select("id", grid.hilbert_parent(F.col("id"), 1).alias("up"), grid.hilbert_cell(F.col("id"), 3).alias("c"), F.col("id").between(*grid.hilbert_children(grid.hilbert_parent(F.col("id"), 1), 1)).alias("within"), grid.hilbert_shell(F.col("id"), 3).alias("near"))
    rows = x.withColumn("p", grid.hilbert_cell(F.col("up"), 2)).collect()
    at = {r["id"]: (r["c"]["ix"], r["c"]["iy"], r["c"]["iz"]) for r in rows}
    for r in rows:
        assert r["within"] and tuple(v // 2 for v in at[r["id"]]) == tuple(r["p"])
        assert [at[k] for k in r["near"]] == [tuple((v + o) % 8 for v, o in zip(at[r["id"]], (a, b, c), strict=True)) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def test_potential_of_a_wave(spark):
    n = 8
    rows = [((i + 0.5) / n, (j + 0.5) / n, (k + 0.5) / n) for i in range(n) for j in range(n) for k in range(n) for _ in range(1 + (i % 2))]
    got = grid.potential(particles(spark, rows), n, kernel="ngp").collect()
    assert len(got) == n**3 and sum(r["pot"] for r in got) == pytest.approx(0, abs=1e-9)
    # A wave of two cells: its Laplacian is -4 n**2 times itself.
    assert all(r["delta"] == pytest.approx(-4 * n * n * r["pot"]) and r["delta"] == pytest.approx(1 / 3 if r["ix"] % 2 else -1 / 3) for r in got)


def test_weighted_centres(spark):
    placed = spark.createDataFrame([(7, 0, 0, 0, 0, 0.1, 0.1, 0.1), (7, 0, 0, 0, 0, 0.1, 0.1, 0.1), (7, 0, 0, 0, 0, 0.1, 0.1, 0.1), (7, 0, 3, 0, 0, 0.9, 0.1, 0.1)], "patch_id long, level int, ix long, iy long, iz long, x double, y double, z double")
    at = lambda centre, w=None: grid.patch_table(placed, 4, centre, weights=w).first()["x"]
    weights = spark.createDataFrame([(0, 0, 0, 0, -5.0), (0, 3, 0, 0, 2.0)], "level int, ix long, iy long, iz long, weight double")
    assert at("geom") == pytest.approx(0.0, abs=1e-12) and at("dens") == pytest.approx(0.0625)
    assert at("weighted", weights) == pytest.approx(0.875)
    assert at("weighted", weights.limit(0)) == pytest.approx(at("geom"), abs=1e-12)
    with pytest.raises(ValueError, match="weights"):
        at("weighted")
    pot = spark.createDataFrame([(0, 0, 0, -0.5), (1, 0, 0, 0.25)], "ix long, iy long, iz long, pot double")
    got = {r["ix"]: r["weight"] for r in grid.depth_weights(placed, pot, 4, 2).collect()}
    assert got == {0: 0.5, 3: 0.0}
