"""Small tables on which queries and their oracles differed: ways through corners, places at the very limit, long ways and deep trees."""

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pipeloom.operators import limits, lines, spatial, tree
from pipeloom.operators.lines import growing_rays
from pipeloom.operators.spatial import nearest_within, within
from pipeloom.plans import geometry, planning, registry
from pipeloom.sources.views import view


def both(spark, folder, name, **tables):
    """The sorted rows of a query and of its oracle over tables given as select statements."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{table}.parquet'")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(folder)).select(*want.columns).collect()
    return sorted(map(tuple, got), key=repr), sorted(want.fetchall(), key=repr)


def customers(*keys):
    return f"select unnest({list(keys)})::bigint as c_custkey, 0::integer as c_nationkey"


def suppliers(n):
    return f"select range as s_suppkey from range({n})"


def parts(*rows):
    return "select * from (values " + ", ".join(f"({k}::bigint, {size}::integer)" for k, size in rows) + ") t(p_partkey, p_size)"


def test_f26_no_way_inside_at_a_corner(spark, tmp_path):
    got, want = both(spark, tmp_path, "crossing_angles", customer=customers(2229, 12229), supplier=suppliers(1000), part=parts((12349, 28)))
    assert got == want == []


def test_f29_a_corner_beside_the_way_does_not_block(spark, tmp_path):
    got, want = both(spark, tmp_path, "segment_blocked_box", customer=customers(79853, 40254), supplier=suppliers(6000), part=parts((74241, 43), (13069, 32)))
    assert got == want == []


def test_f30_a_corner_beside_the_way_is_no_crossing(spark, tmp_path):
    got, want = both(spark, tmp_path, "free_crossings", customer=customers(40677), supplier=suppliers(6000), part=parts((61782, 49)))
    assert got == want == []


@pytest.mark.parametrize("name", ["tie_in_choices", "reserved_attempts"])  # F27, F28
def test_f27_f28_pipes_ten_metres_away(spark, tmp_path, name):
    keys = customers(16254, 17605, 25376, 3491, 25837, 3952, 26381, 27732, 38712, 40063, 76483, 77834)
    got, want = both(spark, tmp_path, name, customer=keys, supplier=suppliers(1))
    assert got == want


def test_f25_ways_that_part_at_a_rounded_limit(spark, tmp_path):
    got, want = both(spark, tmp_path, "common_prefix", customer=customers(33567, 39567), supplier=suppliers(6000))
    assert got == want == [(33567, 39567, 6.5)]


def test_f31_nodes_reached_by_long_ways(spark, tmp_path):
    got, want = both(spark, tmp_path, "unreachable_nodes", customer="select range as c_custkey from range(15000)")
    assert got == want and len(got) == 2211


def test_f32_a_tree_of_fourteen_levels(spark, tmp_path):
    keys = [1_000_000 // 3**k for k in range(14)]
    got, want = both(spark, tmp_path, "dn_optimizer", customer=customers(*keys))
    assert got == want and len(got) == 14 and all(dn for _, dn in got)


def test_nearest_within_equals_brute_force(spark):
    """dense points, lone ones, copies and ties."""
    places = [((k * 37) % 40 / 8, (k * 53) % 40 / 8) for k in range(150)] + [(3.0, 3.0)] * 40 + [(25.0, 4.0), (29.0, 4.0), (27.0, 4.0), (70.0, 90.0), (80.0, 90.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "p bigint, x double, y double")
    d2 = lambda i, j: (places[i][0] - places[j][0]) ** 2 + (places[i][1] - places[j][1]) ** 2
    for others in (True, False):
        want = {}
        for i in range(len(places)):
            near = min((d2(i, j), j) for j in range(len(places)) if not others or i != j)
            if near[0] <= 100:
                want[i] = near[::-1]
        got = nearest_within(points, points.withColumnRenamed("p", "q"), 10.0, "p", "q", others)
        assert {r.p: (r.q, r.d2) for r in got.collect()} == want and got.count() == len(want)


def test_points_spread_over_cells_are_not_broadcast(spark):
    """a few bytes of points are many rows once they are spread."""
    points = spark.range(100).selectExpr("id as p", "cast(id as double) as x", "0.0D as y")
    plan = within(points, points.withColumnRenamed("p", "q"), 3.0, "p", "q")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_f4_nothing_that_grows_is_broadcast(spark, sf_dir, monkeypatch):
    plans = []
    real = spatial.staged
    monkeypatch.setattr(spatial, "staged", lambda df, label: plans.append(df) or real(df, label))
    plans.append(registry.queries()["snap_priority"](spark, sf_dir))
    assert len(plans) > 4
    for df in plans:
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_f37_points_of_a_cell_are_not_sorted(spark, monkeypatch):
    plans = {}
    real = spatial.staged
    monkeypatch.setattr(spatial, "staged", lambda df, label: plans.setdefault(label, df) and None or real(df, label))
    points = spark.range(60).selectExpr("id as p", "cast(id * 7 % 31 as double) as x", "cast(id * 5 % 17 as double) as y")
    assert {r.group_id for r in spatial.clusters(points, 9.0, "p").collect()} == {0}
    assert "SortAggregate" not in plans["ends"]._jdf.queryExecution().executedPlan().toString()


def pairs_met(monkeypatch, module, name):
    """Counts the rows of joins made through a function of a module while queries run."""
    counts = []
    real = getattr(module, name)

    def counted(*args, **kwargs):
        out = real(*args, **kwargs)
        counts.append(out.count())
        return out

    monkeypatch.setattr(module, name, counted)
    return counts


def test_f21_vertices_near_edges(spark, tmp_path):
    got, want = both(spark, tmp_path, "near_overlaps", customer="select range as c_custkey from range(1500)")
    assert got == want and len(got) > 100


def test_f36_rays_end_at_the_first_edge(spark, tmp_path):
    got, want = both(spark, tmp_path, "ray_hits", customer="select range as c_custkey from range(1200)")
    assert got == want and len(got) > 500
    assert growing_rays(spark.createDataFrame([(float(k % 3), 1.0) for k in range(900)], "x double, y double"), 30.0) == [1.0, 4.0, 16.0, 30.0]


def test_f44_ways_that_are_hidden_are_not_tried_again(spark, monkeypatch):
    boxes = spark.createDataFrame([(10.0 + k / 1000, 10.0, 4.0, 4.0) for k in range(400)] + [(200.0, 10.0, 4.0, 4.0)], "cx double, cy double, half_w double, half_h double")
    ways = [(0, 0.0, 10.0, 30.0, 10.0), (1, 0.0, 14.0, 30.0, 14.0), (2, 190.0, 0.0, 210.0, 20.0), (3, 0.0, 30.0, 30.0, 30.0), (4, 10.0, 10.0, 10.0, 10.0)]
    met = pairs_met(monkeypatch, spatial, "routes_in_boxes")
    got = spatial.routes_met(spark.createDataFrame(ways, "route_id bigint, ax double, ay double, bx double, by double"), boxes)
    assert sorted(r.route_id for r in got.collect()) == [0, 1, 2, 4]
    assert sum(met) < 900  # 1201 pairs meet


def test_f44_strings(spark, tmp_path):
    got, want = both(spark, tmp_path, "pulled_strings", customer="select range as c_custkey from range(400)", part="select range as p_partkey, (1 + range % 50)::integer as p_size from range(3000)")
    assert got == want


def test_f17_corners_in_boxes_see_nothing(spark, tmp_path, monkeypatch):
    near = {}
    for key in (k for k in range(20000) if 1 <= k % 11 <= 5):
        near.setdefault((key * 6151 % 100003 // 800, key * 12289 % 99991 // 800), []).append(key)
    pairs = [keys[:2] for keys in near.values() if len(keys) > 1][:20]
    seen = []
    real = planning.within
    monkeypatch.setattr(planning, "within", lambda left, *rest: seen.append(left.count()) or real(left, *rest))
    got, want = both(spark, tmp_path, "visibility_edges", part=parts(*((k, size) for pair in pairs for k, size in zip(pair, (50, 4)))))
    assert got == want and len(got) > 0 and len(pairs) == 20
    assert seen[0] <= 80  # of 160 corners; those of the smaller boxes are inside the larger


def test_f24_chambers_of_points_without_one(spark, tmp_path):
    con = duckdb.connect()
    for table, sql in {"customer": "select range as c_custkey, 0::integer as c_nationkey from range(400)", "supplier": "select range as s_suppkey from range(60)"}.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{table}.parquet'")
    rows = view(spark, str(tmp_path), "oks").select("oks_id", "x", "y").join(planning.chunk_six(spark, str(tmp_path)).withColumn("group_id", F.col("chunk")).select("oks_id", "group_id"), "oks_id")
    near = within(rows, view(spark, str(tmp_path), "chamber"), 60.0, "oks_id", "chamber_id").select("oks_id", "chamber_id", "bx", "by")
    want = rows.join(near, "oks_id", "left").groupBy("group_id").applyInPandas(planning.greedy_group, "group_id long, round int, oks_id long, kind string, target_id long, length_m double")
    got = planning.steiner_plan(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    near_one = spark.createDataFrame([(0, 0.0, 0.0)], "p bigint, x double, y double")
    many = spark.createDataFrame([(k, 1.0 + k / 500, 0.0) for k in range(9)] + [(9, 1.0, 1e-5)], "q bigint, x double, y double")
    assert sorted(r.q for r in nearest_within(near_one, many, 60.0, "p", "q", more=2e-6).collect()) == [0, 9]


def test_f49_boxes_around_points_are_counted(spark, monkeypatch):
    places = [(k * 37 % 200 / 8, k * 53 % 200 / 8) for k in range(300)]
    boxes = [(k * 7 % 25 * 1.0, k * 11 % 25 * 1.0, k % 9 / 2, k % 5 / 2) for k in range(120)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(places)], "p bigint, x double, y double")
    want = {i: n for i, (x, y) in enumerate(places) if (n := sum(abs(x - cx) <= w and abs(y - cy) <= h for cx, cy, w, h in boxes))}
    assert {r.p: r.n for r in spatial.boxes_around(points, spark.createDataFrame(boxes, "cx double, cy double, half_w double, half_h double"), "p").collect()} == want
    met = pairs_met(monkeypatch, geometry, "points_in_boxes")
    geometry.zones_without_own(spark, "/root/testdata/sf0.001")
    assert not met


def test_f5_f6_nearest_lines_by_growing_reaches(spark, monkeypatch):
    ends = [(k, k * 37 % 160 / 8, k * 53 % 160 / 8) for k in range(200)] + [(200, 28.0, 10.0)]
    vertices = spark.createDataFrame([(k, s, x + 6 * s, y + s) for k, x, y in ends for s in (0, 1)], "line_id bigint, seq int, x double, y double")
    points = spark.createDataFrame([(k, x, y) for k, x, y in ends] + [(300, 60.0, 60.0)], "oks_id bigint, x double, y double")
    e, met = lines.edges(vertices), []
    order = Window.partitionBy("oks_id").orderBy(F.round("d", 6), "line_id")
    every = lines.project(points, e, 10.0, "oks_id", others=True)
    want = every.withColumn("place", F.row_number().over(order)).filter("place <= 2")
    real = lines.project
    monkeypatch.setattr(lines, "project", lambda *args: met.append(real(*args)) or met[-1])
    got = lines.nearest_lines(points, e, 10.0, "oks_id", n=2, others=True)
    told = lambda df: sorted((r.oks_id, r.place, r.line_id, round(r.d, 6)) for r in df.collect())
    assert told(got) == told(want) and len(met) > 1
    assert sum(m.count() for m in met) < every.count() / 2


def test_f43_trees_are_not_broadcast(spark, sf_dir, monkeypatch):
    plans = []
    for module in (tree, limits):
        real = module.staged
        monkeypatch.setattr(module, "staged", lambda df, label, real=real: plans.append(df) or real(df, label))
    plans.append(registry.queries()["length_limits"](spark, sf_dir))
    assert len(plans) > 8
    for df in plans:
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
