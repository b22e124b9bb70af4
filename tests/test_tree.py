from __future__ import annotations

import pytest

from cosmolake.operators import tree


def member(spark, sets):
    return spark.createDataFrame([(s, h, p) for s, h, ids in sets for p in ids], "snap int, halo_id long, pid long")


def test_common_must_exceed_the_least(spark):
    m = member(spark, [(2, 1, range(1, 21)), (1, 5, range(11, 41))])
    assert tree.overlaps(m).count() == 0
    m = member(spark, [(2, 1, [*range(1, 21), 41]), (1, 5, [*range(11, 41), 41])])
    e = tree.overlaps(m).collect()[0]
    assert (e["common"], e["npart"], e["npart_prog"]) == (11, 21, 31) and e["merit"] == pytest.approx(121 / (21 * 31))


def test_mutual_best_removes_one_way_edges(spark):
    m = member(spark, [(2, 1, range(0, 20)), (2, 2, range(20, 100)), (1, 9, range(5, 100))])
    assert {(r["haloid"], r["progid"]) for r in tree.overlaps(m).collect()} == {(1, 9), (2, 9)}
    assert [(r["haloid"], r["progid"]) for r in tree.mutual_best(tree.overlaps(m)).collect()] == [(2, 9)]


def test_skipped_snapshot(spark):
    m = member(spark, [(3, 1, range(30)), (2, 7, range(100, 130)), (1, 4, range(30)), (1, 5, range(100, 130))])
    got = {(r["snap"], r["haloid"], r["from_snap"], r["progid"]) for r in tree.skip_snapshots(m, [3, 2, 1]).collect()}
    assert got == {(3, 1, 1, 4), (2, 7, 1, 5)}
    assert {r["snap"] for r in tree.skip_snapshots(m, [3, 2, 1], max_skip=0).collect()} == {2}


def test_traces_and_matrix(spark):
    branch = spark.createDataFrame([(3, 1, 2), (2, 2, 3), (3, 9, 8)], "snap int, haloid long, progid long")
    start = spark.createDataFrame([(3, 1), (3, 9)], "snap int, haloid long")
    t = tree.trace(branch, start, 5)
    assert sorted(map(tuple, t.collect())) == [(1, 1, 3), (1, 2, 2), (1, 3, 1), (9, 2, 8), (9, 3, 9)]
    assert sorted(map(tuple, tree.tree_matrix(t, [1, 2, 3]).collect())) == [(1, 3, 2, 1), (9, 0, 8, 9)]
    assert {r["haloid"]: r["progid"] for r in tree.progenitors_at(branch, start, 1, 5).collect()} == {1: 3, 9: 0}
    assert {r["haloid"]: r["last_progid"] for r in tree.last_progenitors(t).collect()} == {1: 3, 9: 8}


def test_descendants(spark):
    branch = spark.createDataFrame([(3, 1, 2), (3, 5, 2)], "snap int, haloid long, progid long")
    ids = spark.createDataFrame([(2, 2), (2, 3)], "snap int, haloid long")
    assert {r["haloid"]: r["descid"] for r in tree.descendant_ids(branch, ids).collect()} == {2: 1, 3: 0}


def test_merger_rules(spark):
    e = spark.createDataFrame([(2, 1, 2000, 1, 1400, 500, 0.3), (2, 1, 2000, 2, 600, 300, 0.1), (2, 7, 1500, 3, 1450, 900, 0.5), (2, 8, 10, 4, 9, 9, 0.9)], "snap int, haloid long, npart long, progid long, npart_prog long, common long, merit double")
    assert tuple(tree.merger_count(e).collect()[0]) == (2, 2, 1)
    assert tuple(tree.merger_count(e, "secondary").collect()[0]) == (2, 2, 1)


def test_trace_through_many_snapshots(spark):
    branch = spark.createDataFrame([(s, 7 * s, 7 * (s - 1)) for s in range(1, 101)], "snap int, haloid long, progid long")
    start = spark.createDataFrame([(100, 700)], "snap int, haloid long")
    for steps in (0, 1, 5, 99, 200):
        got = sorted((r["snap"], r["progid"]) for r in tree.trace(branch, start, steps).collect())
        assert got == [(s, 7 * s) for s in range(max(0, 100 - steps), 101)]
