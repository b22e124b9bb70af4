from __future__ import annotations

import gzip
import struct

import numpy as np
import pytest

from cosmolake.sources import binary, params, sinks, text


def test_text_snapshot(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# Header = 12\n# PMass = 2.5\n0.1 0.2 0.3 1 2 3\n0.4 0.5 0.6 4 5 6 7.5\n0.7 0.8 0.9 7 8 9 1 3.0\n0.7 0.8 0.9 7 8 9 1 -4\n")
    got = [tuple(r)[1:] for r in text.ascii_snapshot(spark, str(tmp_path)).orderBy("pid").collect()]
    assert [g[7:] for g in got] == [(2.5, -1.0, 1), (7.5, -1.0, 1), (1.0, 3.0, 0), (1.0, -4.0, 4)] and got[1][:4] == (1, 0.4, 0.5, 0.6)


def test_ragged_memberships_and_gzip(spark, tmp_path):
    content = "2\n3 11\n1 1\n2 9\n3\n1 12\n7 4\n"
    (tmp_path / "a_particles").write_text(content)
    with gzip.open(tmp_path / "b_particles.gz", "wt") as f:
        f.write(content)
    got = text.memberships(spark, str(tmp_path)).collect()
    want = [(11, 3, 1, 1), (11, 3, 2, 1), (11, 3, 3, 1), (12, 1, 7, 4)]
    assert sorted(tuple(r)[1:] for r in got) == sorted(want * 2)


def test_trees_and_tables(spark, tmp_path):
    (tmp_path / "c").write_text("# a\n# b\n# c\n5 20 2\n9 7 30 0.5\n3 8 10 0.1\n6 10 0\n")
    assert sorted(tuple(r)[1:] for r in text.tree_croco(spark, str(tmp_path / "c")).collect()) == [(5, 20, 1, 7, 30, 9, 0.5), (5, 20, 2, 8, 10, 3, 0.1)]
    (tmp_path / "m").write_text("1\nabout\n2\n5 1\n7\n6 1\n0\nEND\n")
    assert [tuple(r) for r in text.best_progenitors(text.tree_merged(spark, str(tmp_path / "m"))).collect()] == [(5, 7)]
    (tmp_path / "i").write_text("# haloid progid\n5 7\n6 8\n")
    assert sorted(map(tuple, text.tree_index(spark, str(tmp_path / "i")).collect())) == [(5, 7), (6, 8)]
    (tmp_path / "l").write_text("2\n5\n6\n")
    assert sorted(r[0] for r in text.id_list(spark, str(tmp_path / "l")).collect()) == [5, 6]
    (tmp_path / "z").write_text("0.0\n1.5 _ 9.3\n2.0\n")
    assert sorted(map(tuple, text.redshifts(spark, str(tmp_path / "z")).collect())) == [(0, 0.0), (1, 1.5), (2, 2.0)]
    name = spark.createDataFrame([("out.zoom.z1.25.objects",), ("none",)], "p string").select(text.redshift_of_name(__import__("pyspark").sql.functions.col("p")).alias("z"))
    assert [r["z"] for r in name.collect()] == [1.25, None]


def test_catalogue_and_profiles(spark, tmp_path):
    (tmp_path / "h").write_text("#halo_id(1)\tnpart(2)\tx(3)\n4\t20\t0.5\n5 30 0.25\n")
    assert [tuple(r) for r in text.catalogue_text(spark, str(tmp_path / "h"), ["x", "npart"], ("npart",)).collect()] == [(0.5, 20), (0.25, 30)]
    (tmp_path / "p").write_text("#r(1) n(2)\n0.1 1\n0.2 2\n0.3 3\n")
    h = spark.createDataFrame([(9, 0, 2), (8, 1, 1)], "halo_id long, idx long, nbins int")
    got = sorted((r["halo_id"], r["bin"], r["values"]) for r in text.profiles_text(spark, str(tmp_path / "p"), h).collect())
    assert got == [(8, 0, [0.3, 3.0]), (9, 0, [0.1, 1.0]), (9, 1, [0.2, 2.0])]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("order", "<>")
def test_gadget_versions_and_byte_orders(spark, tmp_path, monkeypatch, version, order):
    monkeypatch.setattr(binary, "RANGE", 3)
    n = [2, 3, 0, 0, 2, 0]
    head = struct.pack(order + "6i6d2d2i6Iii4d", *n, 0.0, 5.0, 0, 0, 0, 0, 0.5, 1.0, 0, 0, *n, 0, 1, 10.0, 0.3, 0.7, 0.7).ljust(256, b"\0")
    pos, vel = np.arange(21, dtype=order + "f4"), -np.arange(21, dtype=order + "f4")
    blocks = [("HEAD", head), ("POS ", pos.tobytes()), ("VEL ", vel.tobytes()), ("ID  ", np.arange(100, 107, dtype=order + "i4").tobytes()), ("MASS", np.array([1, 2, 3, 4], order + "f4").tobytes()), ("U   ", np.array([8, 9], order + "f4").tobytes())]
    out = b""
    for name, data in blocks:
        size = struct.pack(order + "i", len(data))
        if version == 2:
            out += struct.pack(order + "i", 8) + name.encode() + struct.pack(order + "ii", len(data) + 8, 8)
        out += size + data + size
    (tmp_path / "snap").write_bytes(out)
    got = binary.gadget(spark, str(tmp_path)).orderBy("pid").collect()
    assert [r["pid"] for r in got] == list(range(100, 107)) and [r["ptype"] for r in got] == [0, 0, 1, 1, 1, 4, 4]
    assert [r["mass"] for r in got] == [1, 2, 5, 5, 5, 3, 4] and [r["x"] for r in got] == [0, 3, 6, 9, 12, 15, 18] and got[1]["u"] == 9


def test_tipsy_and_cubep3m(spark, tmp_path):
    gas, dark, star = np.arange(12, dtype="<f4"), np.arange(18, dtype="<f4"), np.arange(11, dtype="<f4")
    (tmp_path / "t").write_bytes(struct.pack("<d6I", 1.0, 4, 3, 1, 2, 1, 0) + gas.tobytes() + dark.tobytes() + star.tobytes())
    got = binary.tipsy(spark, str(tmp_path / "t")).orderBy("pid").collect()
    assert [(r["pid"], r["ptype"], r["mass"]) for r in got] == [(0, 1, 0.0), (1, 1, 9.0), (2, 4, 0.0), (3, 0, 0.0)] and got[3]["u"] == 8
    (tmp_path / "q").write_bytes(struct.pack("<i", 2).ljust(48, b"\0") + np.arange(12, dtype="<f4").tobytes())
    got = binary.cubep3m(spark, str(tmp_path / "q"), 8, (3.0, 0, 0)).orderBy("pid").collect()
    assert [r["x"] for r in got] == [3.0, 1.0]


def test_tipsy_files(spark, tmp_path):
    rows = [(k, k / 10, 0.5, 0.25, 1.0, 2.0, 3.0, 1.0 + k, 7.0 if k % 3 == 0 else None, (0, 1, 4)[k % 3]) for k in range(20)]
    df = spark.createDataFrame(rows, binary.PARTICLES)
    sinks.tipsy_files(df, str(tmp_path / "t"), files=1, v_unit=2.0).collect()
    got = binary.tipsy(spark, str(tmp_path / "t")).orderBy("ptype", "mass").collect()
    want = sorted(rows, key=lambda r: (r[9], r[7]))
    assert [(r["ptype"], r["mass"], round(r["x"], 6), r["vz"]) for r in got] == [(r[9], r[7], r[1], 6.0) for r in want]
    assert all((r["u"] == 7.0) == (r["ptype"] == 0) for r in got)
    sinks.tipsy_files(df.limit(0), str(tmp_path / "none")).collect()
    assert not (tmp_path / "none").exists()


@pytest.mark.parametrize("order", "<>")
def test_art_pages(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(binary, "RANGE", 3)
    rows, n = 2, 10  # pages of four
    ends = np.array([6, 10], order + "i4")
    head = struct.pack(order + "i", 529) + b"ART".ljust(45) + struct.pack(order + "4fif", 0.5, 0, 0, 0, 7, 1.0) + bytes(24) + struct.pack(order + "4i3f", rows, 64, 2, 0, 0.3, 0.7, 0.7) + bytes(8)
    extras = np.zeros(100, order + "f4")
    extras[:2] = 2.0, 5.0
    extras[10:12] = ends.view(order + "f4")
    (tmp_path / "PMcrd.0.DAT").write_bytes(head + extras.tobytes() + struct.pack(order + "i", 529))
    v = np.arange(72, dtype=order + "f4").reshape(3, 6, 4)  # page, column, place
    (tmp_path / "PMcrs0.0.DAT").write_bytes(v.tobytes())
    got = binary.snapshot(spark, str(tmp_path / "PMcrs*"), "art").orderBy("pid").collect()
    assert [r["pid"] for r in got] == list(range(4, 14))
    assert [r["mass"] for r in got] == [2.0] * 2 + [5.0] * 8  # looked up by id, as ids are a page ahead
    assert [(r["x"], r["z"], r["vx"], r["vz"]) for r in got] == [(v[k // 4, 0, k % 4] - 1, v[k // 4, 2, k % 4] - 1, v[k // 4, 3, k % 4], v[k // 4, 5, k % 4]) for k in range(n)]


@pytest.mark.parametrize(("order", "native", "wide"), [("<", False, False), (">", False, False), ("<", True, False), (">", True, True)])
def test_deva(spark, tmp_path, monkeypatch, order, native, wide):
    monkeypatch.setattr(binary, "RANGE", 2)
    i, f = (order + "i8", order + "f8") if wide else (order + "i4", order + "f4")
    whole, real = np.zeros(100, i), np.zeros(100, f)
    whole[[7, 8, 9, 23]] = 6, 2, 3, 1
    real[[1, 33, 38]] = 0.5, 2.0, 4.0  # energies times 25**2
    blocks = [np.arange(6, dtype=f), np.arange(18, dtype=f), (-np.arange(18)).astype(f), np.array([1, -1, 2, 0, 0, 0], i), np.zeros(3, f), np.array([1, 2, 3], f)]
    if native:
        one = lambda a: struct.pack(order + "i", a.nbytes) + a.tobytes() + struct.pack(order + "i", a.nbytes)
        data = b"".join(one(x) for x in [*np.split(whole, 100), *np.split(real, 100), *blocks])
    else:
        data = b"".join(x.tobytes() for x in [whole, real, *blocks])
    (tmp_path / "d").write_bytes(data)
    got = binary.snapshot(spark, str(tmp_path / "d"), "deva", native=native).orderBy("pid").collect()
    assert [(r["pid"], r["mass"], r["y"], r["vx"], r["ptype"]) for r in got] == [(k, k, 3 * k + 1, -3.0 * k, (0, 4, 0, 1, 1, 1)[k]) for k in range(6)]
    assert [r["u"] for r in got if r["ptype"] == 0] == [625.0, 1875.0] and all(r["u"] is None for r in got if r["ptype"])


def test_binary_memberships_and_catalogues(spark, tmp_path):
    pair = np.array([(7, 1), (8, 4)], np.dtype([("pid", "<u8"), ("ptype", "<u4")]))
    (tmp_path / "b").write_bytes(struct.pack("<Q", 1) + struct.pack("<QQ", 2, 5) + pair.tobytes())
    assert [tuple(r)[1:] for r in binary.memberships_bin(spark, str(tmp_path / "b")).collect()] == [(5, 7, 1), (5, 8, 4)]
    row = np.array([(5, 20, 0.5)], np.dtype([("id", "<u8"), ("n", "<u4"), ("x", "<f4")]))
    (tmp_path / "h").write_bytes(struct.pack("<QI", 1, 3) + row.tobytes())
    assert [tuple(r) for r in binary.catalogue_bin(spark, str(tmp_path / "h"), ["id"], ["n"], ["x"]).collect()] == [(5, 20, 0.5)]


def test_formats_without_a_reader(spark):
    with pytest.raises(ValueError, match="convert"):
        binary.snapshot(spark, "x", "hdf5")
    assert binary.snapshot(spark, "x", "empty").count() == 0


def test_parameters():
    p = params.parameters("[FINDER]\nic_filename = a.snap # input\nLgridDomain = 128\nVescTune = 1.6\n[GADGET]\nGADGET_LUNIT = 1e-3\n")
    assert (p.ic_filename, p.lgrid_domain, p.vesc_tune, p.n_min_per_halo) == ("a.snap", 128, 1.6, 20)


def test_ordered_text_is_in_order(spark, tmp_path):
    df = spark.createDataFrame([(k, f"line {k}") for k in range(200)], "k long, value string").repartition(6)
    sinks.write_lines(df, ["k"], str(tmp_path / "out"), 5)
    got = [line for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert got == [f"line {k}" for k in range(200)]


def test_disk_text(spark, tmp_path):
    h = spark.createDataFrame([(1, 20, 0.5), (2, 3, 0.1)], "halo_id long, n_star long, x double")
    b = spark.createDataFrame([(1, 0, 0.1), (1, 1, 0.2), (2, 0, 0.3)], "halo_id long, bin int, kappa double")
    sinks.disks_text(h, b, str(tmp_path / "d"), ["x"], ["kappa"])
    got = text.parsed(spark, str(tmp_path / "d"), "line string", lambda rows: ((r,) for r in rows), whole=True).collect()
    assert [r["line"] for r in got] == ["1 0.5 2", "0.1", "0.2"]
