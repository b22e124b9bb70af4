from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cosmolake.operators import spatial


def cloud(spark, n, seed, extra=None):
    r = np.random.default_rng(seed)
    rows = [(k, *map(float, r.random(3))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "pid long, x double, y double, z double")


def dist2(a, b):
    d = np.abs(np.array(a[1:4]) - np.array(b[1:4]))
    d = np.minimum(d, 1 - d)
    return (d**2).sum()


@pytest.mark.parametrize("radius", [0.01, 0.12, 0.3, 0.45, 0.9])
def test_within_equals_all_pairs(spark, radius):
    rows, df = cloud(spark, 60, 1)
    got = {(r["pid"], r["b_pid"]) for r in spatial.within(df, df, radius).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if dist2(a, b) <= radius * radius}


def test_gather_of_varied_radii(spark):
    rows, df = cloud(spark, 80, 2)
    radii = [0.0, 0.001, 0.05, 0.2, 0.6, 1.0]
    h = df.where(F.col("pid") < len(radii)).withColumn("radius", F.element_at(F.array(*map(F.lit, radii)), (F.col("pid") + 1).cast("int")))
    got = {(r["pid"], r["b_pid"]) for r in spatial.gather(h, df).collect()}
    assert got == {(a[0], b[0]) for a, rad in zip(rows, radii, strict=False) for b in rows if dist2(a, b) <= rad * rad}


def test_pair_over_the_border(spark):
    df = spark.createDataFrame([(1, 0.995, 0.5, 0.5), (2, 0.005, 0.5, 0.5), (3, 0.5, 0.5, 0.5)], "pid long, x double, y double, z double")
    assert spatial.within(df, df, 0.02).where("pid < b_pid").count() == 1


def test_nearest_more_massive(spark):
    rows, df = cloud(spark, 40, 3)
    h = df.select(F.col("pid").alias("halo_id"), ((F.col("pid") * 7) % 40).alias("npart"), "x", "y", "z")
    got = {r["halo_id"]: r["other"] for r in spatial.nearest_more_massive(h).collect()}
    for a in rows:
        more = [(dist2(a, b), b[0]) for b in rows if (b[0] * 7) % 40 > (a[0] * 7) % 40]
        assert got[a[0]] == (min(more)[1] if more else None)


def test_correlation_of_a_uniform_box_is_small(spark):
    _, df = cloud(spark, 800, 4)
    for r in spatial.correlation(df, 0.05, 0.3, 4).collect():
        assert abs(r["xi"]) < 0.25


def test_empty(spark):
    _, df = cloud(spark, 5, 5)
    assert spatial.within(df.limit(0), df, 0.1).count() == 0
    assert spatial.nearest_more_massive(df.limit(0).select(F.col("pid").alias("halo_id"), F.lit(1).alias("npart"), "x", "y", "z")).count() == 0


def test_pair_counts_equal_brute_force(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(6)
    at = np.concatenate([r.random((120, 3)), 0.5 + 0.02 * r.random((80, 3)), [[0.1, 0.1, 0.1]] * 3])
    df = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "pid long, x double, y double, z double")
    d = at[:, None] - at[None]
    d2 = ((d - np.floor(d + 0.5)) ** 2).sum(axis=2)[np.triu_indices(len(at), 1)]
    for lo, hi, chunk in ((0.01, 0.1, 1024), (0.01, 0.1, 7), (0.05, 0.45, 16), (0.1, 0.8, 5)):
        monkeypatch.setattr(spatial, "CHUNK", chunk)
        edges = [10 ** (np.log10(lo) + k * (np.log10(hi) - np.log10(lo)) / 6) for k in range(7)]
        want = {k: n for k in range(6) if (n := int(((d2 > edges[k] ** 2) & (d2 < edges[k + 1] ** 2)).sum()))}
        assert {x["bin"]: x["n_pairs"] for x in spatial.pair_histogram(df, lo, hi, 6).collect()} == want
    assert spatial.pair_histogram(df.limit(0), 0.1, 0.2, 3).count() == 0


def test_nearest_siblings_equal_all_pairs(spark):
    r = np.random.default_rng(4)
    rows = [(k, int(r.integers(1, 6)), *map(float, np.mod(r.normal(0, 0.02, 3) * (1 + 20 * (k % 7 == 0)), 1))) for k in range(150)]
    rows += [(500, 9, 0.5, 0.5, 0.5), (501, 10, 0.1, 0.1, 0.1), (502, 10, 0.1, 0.1, 0.1), (503, 10, 0.6, 0.6, 0.6)]
    patches = spark.createDataFrame([(k, x, y, z) for k, _, x, y, z in rows], "patch_id long, x double, y double, z double")
    links = spark.createDataFrame([(k, p) for k, p, *_ in rows], "patch_id long, parent_id long")
    mains = spark.createDataFrame([(0,)], "main_id long")
    d = lambda a, b: math.sqrt(sum(((u - v + 0.5) % 1 - 0.5) ** 2 for u, v in zip(a[2:], b[2:], strict=True)))
    want = {}
    for a in rows[1:]:
        others = [d(a, b) for b in rows[1:] if b[1] == a[1] and b[0] != a[0]]
        if others:
            want[a[0]] = min(others) / 2
    got = spatial.sibling_distance(links, patches, mains).collect()
    assert len(got) == len(want) and all(abs(r["close"] - want[r["patch_id"]]) < 1e-9 for r in got)
    assert spatial.sibling_distance(links.limit(0), patches, mains).count() == 0


def test_links_need_not_list_all_boxes_around_a_centre(spark, monkeypatch):
    from cosmolake.plans import q_spatial

    r = np.random.default_rng(8)
    at = np.concatenate([0.5 + 0.05 * r.normal(size=(150, 3)), r.random((60, 3)), [[0.01, 0.99, 0.5]] * 4])
    rows = [(k, int(r.integers(0, 4)), *map(float, p), *map(float, r.choice([0.002, 0.02, 0.1, 0.6], 3))) for k, p in enumerate(at)]
    p = spark.createDataFrame(rows, "patch_id long, level int, x double, y double, z double, hx double, hy double, hz double")
    off = lambda a, b: [(u - v + 0.5) % 1 - 0.5 for u, v in zip(a[2:5], b[2:5], strict=True)]
    want = {}
    for a in rows:
        held = [(sum(d * d for d in off(a, b)), b[0]) for b in rows if b[1] + 1 == a[1] and all(abs(d) <= h for d, h in zip(off(a, b), b[5:], strict=True))]
        if held:
            want[a[0]] = min(held)[1]
    assert {x["patch_id"]: x["parent_id"] for x in spatial.nearest_parent(spatial.box_parents(p, p)).collect()} == want
    for first in (None, 0.001, 0.3):
        assert {x["patch_id"]: x["parent_id"] for x in spatial.holding_parents(p, p, first=first).collect()} == want
    assert spatial.holding_parents(p, p.limit(0)).count() == 0 and spatial.holding_parents(p.limit(0), p).count() == 0
    monkeypatch.setattr(spatial, "box_parents", None)  # its rows grow with the square of the patches
    monkeypatch.setattr(q_spatial, "patches", lambda *_: p)
    got = {x["patch_id"]: x["parent_id"] for x in q_spatial.links(spark, "").collect()}
    assert {k: v for k, v in got.items() if k in want} == want and set(got) == {a[0] for a in rows if a[1] > 0}


def test_expansion_rates_equal_all_pairs_without_a_row_a_pair(spark, monkeypatch):
    from cosmolake.operators import stats

    r = np.random.default_rng(9)
    at = np.concatenate([0.5 + 0.05 * r.normal(size=(90, 3)), r.random((40, 3)), [[0.01, 0.99, 0.5]] * 5])
    v = r.normal(size=at.shape)
    rows = [(f"h{k}", *map(float, p), *(float(c) if k != 7 else None for c in u)) for k, (p, u) in enumerate(zip(at, v, strict=True))]
    h = spark.createDataFrame(rows, "observer string, x double, y double, z double, vx double, vy double, vz double")
    monkeypatch.setattr(spatial, "within", None)
    monkeypatch.setattr(stats, "within", None, raising=False)
    for radius, block in ((0.2, 2_048), (0.2, 9), (0.07, 5), (0.6, 16)):
        monkeypatch.setattr(stats, "BLOCK", block, raising=False)
        got = {(x["observer"], x["sphere"]): (x["h_los"], x["n"]) for x in stats.expansion_scatter(h.where("hash(observer) % 2 = 0"), h.drop("observer"), radius, spheres=3).collect()}
        want = {}
        for (name,) in h.where("hash(observer) % 2 = 0").select("observer").collect():
            k = int(name[1:])
            d = at - at[k]
            d -= np.floor(d + 0.5)
            d2 = (d**2).sum(axis=1)
            rate = 100 + ((v - v[k]) * d).sum(axis=1) / np.where(d2 > 0, d2, 1)
            known = (np.arange(len(at)) != 7) & (k != 7)
            for s in range(3):
                inside = (d2 > 0) & (d2 <= (radius * (s + 1) / 3) ** 2)
                if inside.any():
                    want[name, s + 1] = (rate[inside & known].mean() if (inside & known).any() else None, int(inside.sum()))
        assert set(got) == set(want)
        for key, (rate, n) in want.items():
            assert got[key][1] == n and (got[key][0] is None if rate is None else abs(got[key][0] - rate) < 1e-7 * max(1, abs(rate)))
    assert stats.expansion_scatter(h.limit(0), h.drop("observer"), 0.2).count() == 0
