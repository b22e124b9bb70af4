from __future__ import annotations

from cosmolake.operators import catalogue as c


def halos(spark, rows):
    return spark.createDataFrame(rows, "halo_id long, host_id long, npart long, mass double, radius double, x double, y double, z double")


NESTED = [(1, -1, 100, 100.0, 0.3, 0.5, 0.5, 0.5), (2, 1, 50, 50.0, 0.1, 0.55, 0.5, 0.5), (3, 2, 30, 30.0, 0.05, 0.56, 0.5, 0.5), (4, 1, 40, 40.0, 0.01, 0.95, 0.5, 0.5), (5, 77, 10, 5.0, 0.1, 0.1, 0.1, 0.1)]


def test_closure_and_excision(spark):
    h = halos(spark, NESTED)
    assert sorted((r["host"], r["sub"], r["depth"]) for r in c.closure(h).collect()) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1), (77, 5, 1)]
    m = spark.createDataFrame([(1, p) for p in range(10)] + [(2, p) for p in range(5)] + [(3, p) for p in range(2)], "halo_id long, pid long")
    assert sorted(map(tuple, c.excise_substructure(m, h).collect())) == [(1, p) for p in range(5, 10)] + [(2, p) for p in range(2, 5)] + [(3, 0), (3, 1)]


def test_closure_stops_on_a_cycle(spark):
    h = halos(spark, [(1, 2, 9, 1.0, 0.1, 0.0, 0.0, 0.0), (2, 1, 9, 1.0, 0.1, 0.0, 0.0, 0.0)])
    assert c.closure(h, max_depth=4).count() == 8


def test_credible_hosts(spark):
    got = {r["halo_id"]: r["host_id"] for r in c.credible_hosts(halos(spark, NESTED), 20).collect()}
    assert got == {1: -1, 2: 1, 3: 2, 4: -1, 5: -1}


def test_checks(spark):
    h = halos(spark, NESTED)
    assert [tuple(r) for r in c.dangling_hosts(h).collect()] == [(5, 77)]
    assert c.duplicate_ids(h.union(h.limit(1)), "halo_id").count() == 1
    assert {r["halo_id"]: r["n_sub"] for r in c.host_sub_counts(h).collect()} == {1: 2, 2: 1, 3: 0, 4: 0, 5: 0}


def test_first_owner_is_the_smallest(spark):
    m = spark.createDataFrame([(1, p) for p in range(9)] + [(2, p) for p in range(4, 9)], "halo_id long, pid long")
    got = {r["pid"]: r["halo_id"] for r in c.first_owner(m).collect()}
    assert got == {**dict.fromkeys(range(4), 1), **dict.fromkeys(range(4, 9), 2)}


def test_order_without_a_single_task(spark):
    h = halos(spark, [(k, -1, (k * 37) % 11, 1.0, 0.1, 0.0, 0.0, 0.0) for k in range(50)])
    got = c.ordered(h, parts=7).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(50))
    assert [r["halo_id"] for r in got] == [k for _, k in sorted((-((k * 37) % 11), k) for k in range(50))]
    assert c.ordered(h.limit(0)).count() == 0


def test_infall_and_changes(spark):
    t = spark.createDataFrame([(1, 1, 10, 2.0), (1, 2, 11, 1.5), (1, 3, 12, 0.8), (1, 4, 13, 0.5), (2, 1, 20, 3.0), (2, 2, 21, 2.0), (3, 1, 30, 0.4)], "halo long, snap long, id long, dist double")
    assert {r["halo"]: (r["infall_snap"], r["infall_id"]) for r in c.infall(t).collect()} == {1: (2, 11), 2: (2, 0), 3: (1, 30)}
    assert {r["halo"]: (r["min_dist"], r["min_snap"]) for r in c.least_distance(t).collect()}[1] == (0.5, 4)
    k = spark.createDataFrame([(1, 4, 5), (1, 3, 0), (1, 2, 5), (1, 1, 6)], "halo long, snap long, host long")
    assert sorted((r["snap"], r["event"]) for r in c.host_changes(k).collect()) == [(2, "b"), (3, "h")]


def test_unit_cube(spark):
    p = spark.createDataFrame([(1, 0.0, 5.0, 10.0), (2, 10.0, 0.0, 5.0)], "pid long, x double, y double, z double")
    assert {r["pid"]: (r["x"], r["y"], r["z"]) for r in c.unit_cube(p).collect()} == {1: (0.0, 0.5, 0.0), 2: (0.0, 0.0, 0.5)}


def test_closure_of_a_deep_chain_and_a_cycle(spark):
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 201)] + [(0, -1)], "halo_id long, host_id long")
    got = c.closure(chain)
    assert got.count() == 200 * 201 // 2 and got.agg({"depth": "max"}).first()[0] == 200 and got.where("depth <> sub - host").count() == 0
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "halo_id long, host_id long")
    assert sorted(map(tuple, c.closure(ring).collect())) == [(a, b, (a - b - 1) % 3 + 1) for a in (1, 2, 3) for b in (1, 2, 3)]
