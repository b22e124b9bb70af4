"""Queries: selections, joins by id and host, checks, set operations, orders and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.functions import expr
from cosmolake.operators import catalogue as c
from cosmolake.operators import tree
from cosmolake.plans.q_tree import EDGES, edges
from cosmolake.plans.registry import query
from cosmolake.plans.views import HALOS, MEMBERS, MEMBERSHIP, POINTS, halos, members, membership, points
from cosmolake.session import table

PH = f"WITH {POINTS}, {HALOS}"
PBC = "({0} - floor({0} + 0.5))"


def d2(a: str, b: str, box: bool = True) -> str:
    parts = [f"({a}{k} - {b}{k})" for k in "xyz"]
    return " + ".join(f"{PBC.format(p) if box else p} * {PBC.format(p) if box else p}" for p in parts)


@query("species_filter", f"WITH {POINTS} SELECT pid, ptype FROM pts WHERE ptype = 1")
def _species(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.one_species(points(spark, sf_dir), 1).select("pid", "ptype")


@query("high_resolution_filter", f"WITH {POINTS} SELECT pid, ptype FROM pts WHERE ptype IN (0, 1, 4)")
def _hires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.high_resolution(points(spark, sf_dir)).select("pid", "ptype")


@query("clean_ptype", f"WITH {POINTS} SELECT pid, CASE WHEN ptype - 1 BETWEEN 0 AND 5 THEN ptype - 1 ELSE 1 END AS ptype FROM pts")
def _ptype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.clean_ptype(points(spark, sf_dir).withColumn("ptype", F.col("ptype") - 1)).select("pid", "ptype")


@query("sphere_open_space", f"WITH {POINTS} SELECT pid FROM pts WHERE (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) + (z - 0.5) * (z - 0.5) <= 0.0144::DOUBLE")
def _sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.in_sphere(points(spark, sf_dir), (0.5, 0.5, 0.5), 0.12, None, closed=True).select("pid")


@query("sphere_periodic", f"WITH {POINTS}, q AS (SELECT *, 0.95::DOUBLE AS qx, 0.5::DOUBLE AS qy, 0.5::DOUBLE AS qz FROM pts) SELECT pid FROM q WHERE {d2('', 'q')} < 0.1225::DOUBLE")
def _sphere_pbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.in_sphere(points(spark, sf_dir), (0.95, 0.5, 0.5), 0.35).select("pid")


@query("minimum_size", f"{PH} SELECT halo_id, npart FROM halos WHERE npart >= 500")
def _min_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.at_least(halos(spark, sf_dir), 500).select("halo_id", "npart")


@query("mass_window", f"{PH} SELECT halo_id, mass FROM halos WHERE mass >= 300 AND mass < 1200")
def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.mass_window(halos(spark, sf_dir), 300, 1200).select("halo_id", "mass")


@query("first_n_halos", f"{PH} SELECT halo_id, npart FROM halos ORDER BY npart DESC, halo_id LIMIT 20")
def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.first_n(halos(spark, sf_dir), 20).select("halo_id", "npart")


@query("keep_ids", "SELECT s_suppkey AS halo_id, s_name FROM supplier WHERE s_suppkey IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity = 50)")
def _keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("halo_id"), "s_name")
    return c.keep_ids(rows, table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_suppkey").alias("halo_id")))


@query("remove_ids", "SELECT p_partkey AS halo_id, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def _remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("halo_id"), "p_name")
    return c.remove_ids(rows, table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("halo_id")))


@query("random_share")
def _share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.random_share(points(spark, sf_dir), 0.3).select("pid")


@query("unit_cube", f"WITH {POINTS}, e AS (SELECT least(min(x), min(y), min(z)) AS lo, greatest(max(x), max(y), max(z)) AS hi FROM pts), s AS (SELECT pid, (x - lo) / (hi - lo) AS x, (y - lo) / (hi - lo) AS y, (z - lo) / (hi - lo) AS z FROM pts, e) SELECT pid, round(x - floor(x), 9) AS x, round(y - floor(y), 9) AS y, round(z - floor(z), 9) AS z FROM s")
def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.unit_cube(points(spark, sf_dir)).select("pid", *(F.round(k, 9).alias(k) for k in "xyz"))


@query("physical_units", f"{PH} SELECT halo_id, round(radius * (0.5 / 0.7)::DOUBLE, 9) AS radius, round(mass / 0.7::DOUBLE, 6) AS mass, round(vx, 9) AS vx FROM halos")
def _physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = halos(spark, sf_dir)
    return h.select("halo_id", F.round(expr.physical(F.col("radius"), "length", 0.5, 0.7), 9).alias("radius"), F.round(expr.physical(F.col("mass"), "mass", 0.5, 0.7), 6).alias("mass"), F.round("vx", 9).alias("vx"))


@query("unique_ids", f"{PH} SELECT halo_id, 7 * 1000000000000 + halo_id + 1 AS haloid, CASE WHEN host_id < 0 THEN 0 ELSE 7 * 1000000000000 + host_id + 1 END AS hostid, 7::BIGINT AS snap FROM halos")
def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.unique_ids(halos(spark, sf_dir), F.lit(7)).select("halo_id", "haloid", "hostid", expr.serial_snap(F.col("haloid")).alias("snap"))


@query("packed_ids", f"{PH} SELECT halo_id, (floor(log10(npart))::BIGINT << 60) | (floor(x * 1048576)::BIGINT << 40) | (floor(y * 1048576)::BIGINT << 20) | floor(z * 1048576)::BIGINT AS packed, (7::BIGINT << 54) | halo_id AS snap_index FROM halos")
def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halos(spark, sf_dir).select("halo_id", expr.packed_id(F.col("npart"), F.col("x"), F.col("y"), F.col("z")).alias("packed"), expr.snap_id(F.lit(7), F.col("halo_id")).alias("snap_index"))


@query("rows_by_id", f"WITH {MEMBERSHIP}, h AS (SELECT snap, halo_id, count(*) AS npart FROM mem WHERE (snap + halo_id) % 3 <> 0 GROUP BY ALL), w AS (SELECT DISTINCT snap, halo_id FROM mem) SELECT w.snap, w.halo_id, coalesce(npart, 0) AS npart FROM w LEFT JOIN h USING (snap, halo_id)")
def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = membership(spark, sf_dir)
    h = m.where((F.col("snap") + F.col("halo_id")) % 3 != 0).groupBy("snap", "halo_id").agg(F.count(F.lit(1)).alias("npart"))
    return c.rows_by_id(m.select("snap", "halo_id").distinct(), h, ["snap", "halo_id"], ["npart"])


@query("sub_halos_by_host", f"{PH} SELECT halo_id FROM halos WHERE host_id = 3")
def _subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.sub_halos(halos(spark, sf_dir), 3).select("halo_id")


@query("sub_halos_by_radius", f"{PH}, o AS (SELECT x AS hx, y AS hy, z AS hz, radius AS r FROM halos WHERE halo_id = 3) SELECT halo_id FROM halos, o WHERE halo_id <> 3 AND {d2('', 'h', False)} BETWEEN (0.5 * r) * (0.5 * r) AND (6 * r) * (6 * r)")
def _subs_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.sub_halos(halos(spark, sf_dir), 3, 0.5, 6.0).select("halo_id")


@query("species_counts", f"WITH {POINTS} SELECT pid % 10 AS g, count(*) FILTER (WHERE ptype = 0) AS n_gas, count(*) FILTER (WHERE ptype = 4) AS n_star, count(*) AS n_all FROM pts GROUP BY g")
def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.species_counts(points(spark, sf_dir).withColumn("g", F.col("pid") % 10), "g")


@query("species_mass", f"WITH {MEMBERS} SELECT halo_id, round(sum(CASE WHEN species = 'A' THEN m ELSE 0 END), 2) AS m_a, round(sum(CASE WHEN species = 'N' THEN m ELSE 0 END), 2) AS m_n, count(*) FILTER (WHERE species NOT IN ('A', 'N')) AS n_other FROM memb GROUP BY halo_id")
def _species_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.species_mass(members(spark, sf_dir), ["A", "N"]).select("halo_id", F.round("m_a", 2).alias("m_a"), F.round("m_n", 2).alias("m_n"), "n_other")


@query("host_sub_counts", f"{PH} SELECT h.halo_id, count(s.halo_id) AS n_sub FROM halos h LEFT JOIN halos s ON s.host_id = h.halo_id GROUP BY h.halo_id")
def _sub_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.host_sub_counts(halos(spark, sf_dir))


@query("wrong_sub_counts", f"{PH}, n AS (SELECT h.halo_id, h.halo_id % 3 AS stated, count(s.halo_id) AS n_sub FROM halos h LEFT JOIN halos s ON s.host_id = h.halo_id GROUP BY h.halo_id) SELECT * FROM n WHERE stated <> n_sub")
def _wrong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.wrong_sub_counts(halos(spark, sf_dir).withColumn("stated", F.col("halo_id") % 3), "stated").select("halo_id", "stated", "n_sub")


@query("dangling_hosts", f"{PH}, p AS (SELECT halo_id, host_id FROM halos WHERE halo_id % 7 <> 2) SELECT halo_id, host_id FROM p WHERE host_id >= 0 AND host_id NOT IN (SELECT halo_id FROM p)")
def _dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.dangling_hosts(halos(spark, sf_dir).where("halo_id % 7 <> 2"))


@query("duplicate_ids", "SELECT l_orderkey * 10 + l_linenumber AS pid, count(*) AS n FROM lineitem GROUP BY pid HAVING n > 1")
def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.duplicate_ids(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid")), "pid")


@query("substructure_list", f"{PH} SELECT host_id, count(*) AS n_sub, string_agg(halo_id::VARCHAR, ',' ORDER BY halo_id) AS subs FROM halos WHERE host_id >= 0 GROUP BY host_id")
def _substructure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.substructure(halos(spark, sf_dir)).withColumn("subs", F.array_join(F.col("subs").cast("array<string>"), ","))


@query("rank_order", f"{PH} SELECT halo_id, npart, row_number() OVER (ORDER BY npart DESC, halo_id) - 1 AS idx FROM halos")
def _order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.ordered(halos(spark, sf_dir)).select("halo_id", "npart", F.col("idx").cast("long").alias("idx"))


@query("rank_inverse", f"{PH}, r AS (SELECT halo_id, row_number() OVER (ORDER BY mass DESC, halo_id) - 1 AS idx FROM halos) SELECT idx, halo_id FROM r")
def _inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.ordered(halos(spark, sf_dir), "mass").select(F.col("idx").cast("long").alias("idx"), "halo_id")


@query("sort_by_column", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def _sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("cumulative_mass_function", f"{PH} SELECT halo_id, mass, row_number() OVER (ORDER BY mass DESC, halo_id) AS n_above FROM halos")
def _cmf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.cumulative_mass_function(halos(spark, sf_dir)).withColumn("n_above", F.col("n_above").cast("long"))


@query("top_k_by_mass", f"{PH} SELECT halo_id, mass FROM halos ORDER BY mass DESC, halo_id LIMIT 10")
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.top_k(halos(spark, sf_dir), "mass", 10).select("halo_id", "mass")


@query("array_positions", "SELECT l_partkey AS v, coalesce(p_partkey, -1) AS pos, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size < 25) ON p_partkey = l_partkey GROUP BY ALL")
def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size < 25").select(F.col("p_partkey").alias("v"), F.col("p_partkey").alias("pos"))
    return c.positions_of(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("v")), part, "v").groupBy("v", "pos").agg(F.count(F.lit(1)).alias("n"))


@query("first_owner_dedup", f"WITH {MEMBERSHIP}, m AS (SELECT snap * 100 + halo_id AS halo_id, pid FROM mem), s AS (SELECT halo_id, count(*) AS n FROM m GROUP BY halo_id), r AS (SELECT m.halo_id, pid, row_number() OVER (PARTITION BY pid ORDER BY n, m.halo_id) AS k FROM m JOIN s USING (halo_id)) SELECT halo_id, pid FROM r WHERE k = 1")
def _owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.first_owner(membership(spark, sf_dir).select((F.col("snap") * 100 + F.col("halo_id")).alias("halo_id"), "pid"))


@query("distinct_particles", f"WITH {MEMBERSHIP} SELECT DISTINCT pid FROM mem")
def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership(spark, sf_dir).select("pid").distinct()


@query("union_catalogues", f"WITH {MEMBERSHIP} SELECT snap, halo_id, count(*) AS n FROM (SELECT * FROM mem WHERE snap < 1998 UNION ALL SELECT * FROM mem WHERE snap >= 1998) GROUP BY ALL")
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = membership(spark, sf_dir)
    return m.where("snap < 1998").unionByName(m.where("snap >= 1998")).groupBy("snap", "halo_id").agg(F.count(F.lit(1)).alias("n"))


@query("exclude_other_halos", f"WITH {MEMBERSHIP}, m AS (SELECT * FROM mem WHERE snap = 1998) SELECT pid FROM m WHERE halo_id = 3 AND pid NOT IN (SELECT pid FROM m WHERE halo_id <> 3)")
def _exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.exclude_others(membership(spark, sf_dir).where("snap = 1998"), 3)


@query("without_duplicates", f"WITH {MEMBERSHIP}, m AS (SELECT * FROM mem WHERE snap = 1999), d AS (SELECT pid FROM m GROUP BY pid HAVING count(*) > 1) SELECT pid FROM m WHERE halo_id = 5 AND pid NOT IN (SELECT pid FROM d)")
def _nodup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.without_duplicates(membership(spark, sf_dir).where("snap = 1999"), 5)


@query("difference_by_halo", f"WITH {MEMBERSHIP} SELECT snap * 100 + halo_id AS halo_id, pid FROM mem EXCEPT SELECT (snap + 1) * 100 + halo_id, pid FROM mem")
def _difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = membership(spark, sf_dir)
    at = lambda later: m.select(((F.col("snap") + later) * 100 + F.col("halo_id")).alias("halo_id"), "pid")
    return c.difference_by_halo(at(0), at(1))


CLOSURE = f"""WITH RECURSIVE {POINTS}, {HALOS},
 cl AS (SELECT host_id AS host, halo_id AS sub, 1 AS depth FROM halos WHERE host_id >= 0
        UNION ALL SELECT cl.host, h.halo_id, depth + 1 FROM cl JOIN halos h ON h.host_id = cl.sub)"""


@query("substructure_closure", f"{CLOSURE} SELECT host, sub, depth FROM cl")
def _closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.closure(halos(spark, sf_dir))


@query("credible_hosts", f"{CLOSURE}, ok AS (SELECT sub, host, depth FROM cl JOIN (SELECT halo_id AS sub, x, y, z, radius, npart FROM halos) s USING (sub) JOIN (SELECT halo_id AS host, x AS hx, y AS hy, z AS hz, radius AS hr, npart AS hn FROM halos) h USING (host) WHERE {d2('', 'h')} < (hr * 6 + 0.5 * radius * 6) * (hr * 6 + 0.5 * radius * 6) AND least(npart, hn) >= 100) SELECT h.halo_id, coalesce(b.host, -1) AS host_id FROM halos h LEFT JOIN (SELECT sub, arg_min(host, depth) AS host FROM ok GROUP BY sub) b ON b.sub = h.halo_id")
def _credible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.credible_hosts(halos(spark, sf_dir).withColumn("radius", F.col("radius") * 6), 100)


@query("excise_substructure", f"{CLOSURE}, m AS (SELECT l_suppkey % 40 AS halo_id, l_partkey AS pid FROM lineitem GROUP BY ALL) SELECT halo_id, pid FROM m EXCEPT SELECT cl.host, m.pid FROM cl JOIN m ON m.halo_id = cl.sub")
def _excise(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("halo_id"), F.col("l_partkey").alias("pid")).distinct()
    return c.excise_substructure(m, halos(spark, sf_dir))


@query("excised_mass", f"{CLOSURE}, m AS (SELECT l_suppkey % 40 AS halo_id, l_partkey AS pid, sum(l_quantity) AS m, avg(l_discount) AS zm FROM lineitem GROUP BY ALL), x AS (SELECT halo_id, pid FROM m EXCEPT SELECT cl.host, m.pid FROM cl JOIN m ON m.halo_id = cl.sub) SELECT halo_id, count(*) AS n_star, round(sum(m), 2) AS m_star, round(avg(zm), 9) AS mean_z FROM x JOIN m USING (halo_id, pid) GROUP BY halo_id")
def _excised_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("halo_id"), F.col("l_partkey").alias("pid")).agg(F.sum("l_quantity").alias("m"), F.avg("l_discount").alias("zm"))
    return c.excise_substructure(m, halos(spark, sf_dir)).groupBy("halo_id").agg(F.count(F.lit(1)).alias("n_star"), F.round(F.sum("m"), 2).alias("m_star"), F.round(F.avg("zm"), 9).alias("mean_z"))


@query("state_transitions", "WITH w AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT user_id, event_id, before, event_type FROM w WHERE before IS NOT NULL AND before <> event_type")
def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return c.transitions(e, "user_id", "at", "event_type").select("user_id", "event_id", "before", "event_type")


TRACK = "tr AS (SELECT o_custkey AS halo, o_orderkey AS snap, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 5 END AS host, o_orderkey % 11 AS id, (o_orderkey * 37 % 300) / 100.0::DOUBLE AS dist FROM orders)"


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(F.col("o_custkey").alias("halo"), k.alias("snap"), F.when(k % 3 == 0, F.lit(0)).otherwise(k % 5).alias("host"), (k % 11).alias("id"), ((k * 37 % 300) / 100.0).alias("dist"))


@query("host_changes", f"WITH {TRACK}, w AS (SELECT *, lag(host) OVER d AS later, list(host) OVER (PARTITION BY halo ORDER BY snap DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM tr WINDOW d AS (PARTITION BY halo ORDER BY snap DESC)), e AS (SELECT halo, snap, host, CASE WHEN later > 0 AND host <= 0 THEN 'h' WHEN later <= 0 AND host > 0 THEN CASE WHEN list_contains(seen, host) THEN 'b' ELSE 's' END END AS event FROM w) SELECT * FROM e WHERE event IS NOT NULL")
def _host_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.host_changes(track(spark, sf_dir))


@query("infall", f"WITH {TRACK}, w AS (SELECT *, lag(snap) OVER t AS ps, lag(id) OVER t AS pi, lag(dist) OVER t AS pd FROM tr WINDOW t AS (PARTITION BY halo ORDER BY snap)), i AS (SELECT halo, snap, CASE WHEN pd > 1 THEN ps ELSE snap END AS at_snap, CASE WHEN pd > 1 THEN pi ELSE id END AS who, row_number() OVER (PARTITION BY halo ORDER BY snap) AS k FROM w WHERE dist > 0 AND dist <= 1), l AS (SELECT halo, max(snap) AS last FROM tr GROUP BY halo) SELECT l.halo, coalesce(at_snap, last) AS infall_snap, coalesce(who, 0) AS infall_id FROM l LEFT JOIN (SELECT * FROM i WHERE k = 1) i USING (halo)")
def _infall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.infall(track(spark, sf_dir))


@query("min_host_distance", f"WITH {TRACK}, r AS (SELECT *, row_number() OVER (PARTITION BY halo ORDER BY dist, snap) AS k FROM tr) SELECT halo, dist AS min_dist, snap AS min_snap FROM r WHERE k = 1")
def _least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.least_distance(track(spark, sf_dir))


@query("backsplash", f"WITH {TRACK}, b AS (SELECT halo, arg_max(dist, snap) AS now, min(dist) AS least FROM tr GROUP BY halo) SELECT * FROM b WHERE now > 1 AND least < 1")
def _backsplash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.backsplash(track(spark, sf_dir))


HOSTED = "hs AS (SELECT DISTINCT snap, halo_id, CASE WHEN (snap + halo_id) % 3 = 0 THEN (halo_id * 7 + 1) % 25 ELSE -1 END AS host_id FROM mem)"


@query("accreted_subs", f"WITH {EDGES}, {HOSTED} SELECT s.snap, s.host_id AS host, s.halo_id AS sub FROM hs s JOIN best bs ON bs.snap = s.snap AND bs.haloid = s.halo_id JOIN best bh ON bh.snap = s.snap AND bh.haloid = s.host_id JOIN hs w ON w.snap = s.snap - 1 AND w.halo_id = bs.progid WHERE s.host_id >= 0 AND w.host_id < 0 AND bs.progid <> bh.progid")
def _accreted(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = membership(spark, sf_dir)
    host = F.when((F.col("snap") + F.col("halo_id")) % 3 == 0, (F.col("halo_id") * 7 + 1) % 25).otherwise(F.lit(-1))
    return c.accreted_subs(tree.main_branch(edges(spark, sf_dir)), m.select("snap", "halo_id", host.alias("host_id")).distinct())


@query("particle_displacement", f"WITH {POINTS}, q AS (SELECT pid, x - floor(x + vx) + vx AS p_x, y - floor(y + vy) + vy AS p_y, z - floor(z + vz) + vz AS p_z, x AS a_x, y AS a_y, z AS a_z, (pid % 8 + 0.5) / 8.0::DOUBLE AS l_x, ((pid // 8) % 8 + 0.5) / 8.0::DOUBLE AS l_y, (pid // 64 + 0.5) / 8.0::DOUBLE AS l_z FROM pts) SELECT pid, round(sqrt({d2('a_', 'p_')}), 9) AS d12, round(sqrt({d2('p_', 'l_')}), 9) AS d_lattice FROM q")
def _displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    moved = p.select("pid", *(expr.wrap(F.col(k) + F.col(f"v{k}")).alias(k) for k in "xyz"))
    return c.displacement(p, moved, 8).select("pid", F.round("d12", 9).alias("d12"), F.round("d_lattice", 9).alias("d_lattice"))


@query("farthest_star", f"WITH {MEMBERS}, r AS (SELECT halo_id, max(d) AS r_star FROM memb WHERE species = 'R' GROUP BY halo_id) SELECT halo_id, round(r_star, 6) AS r_star, round(sum(m), 2) AS m_enclosed FROM memb JOIN r USING (halo_id) WHERE d <= r_star GROUP BY halo_id, r_star")
def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.farthest_star(members(spark, sf_dir), "R").select("halo_id", F.round("r_star", 6).alias("r_star"), F.round("m_enclosed", 2).alias("m_enclosed"))


@query("snapshot_redshifts", f"WITH {MEMBERSHIP} SELECT DISTINCT snap, round((2001 - snap) * 0.1::DOUBLE, 6) AS zred, round(13.8::DOUBLE - (2001 - snap) * 1.3::DOUBLE, 6) AS cosmictime FROM mem")
def _redshifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = spark.createDataFrame([(s, (2001 - s) * 0.1, 13.8 - (2001 - s) * 1.3) for s in range(1990, 2010)], "snap int, zred double, cosmictime double")
    return membership(spark, sf_dir).select("snap").distinct().join(F.broadcast(snaps), "snap").select("snap", F.round("zred", 6).alias("zred"), F.round("cosmictime", 6).alias("cosmictime"))
