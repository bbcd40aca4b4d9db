from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pipeloom.functions.reference import CHAMBER_BANDS, band, by_dn, min_dn, penalty, raw_score, segment_cost
from pipeloom.operators.components import components
from pipeloom.operators.spatial import crossings, elementary_pieces, nearest, points_in_boxes, routes_in_boxes, within
from pipeloom.operators.tree import bfs, on_cycle, roll_up, walk_up


def one(df):
    return df.first()[0]


def test_min_dn(spark):
    flows = ["0.1", "3.5", "3.51", "65.1", "80", "180", "22501.9", "22502"]
    df = spark.createDataFrame([(Decimal(f),) for f in flows], "f decimal(18,2)").select(min_dn(F.col("f")))
    assert [r[0] for r in df.collect()] == [50, 50, 65, 150, 200, 250, 1400, 1400]
    assert one(spark.sql("select cast(null as decimal(18,2)) f").select(min_dn(F.col("f")))) is None


def test_costs(spark):
    row = spark.sql("select cast(145.2 as decimal(18,3)) l, 200 dn, cast(1.6 as decimal(4,2)) k, cast(0.5 as decimal(18,3)) l2, 50 dn2, cast(1 as decimal(4,2)) k2")
    got = row.select(segment_cost(F.col("l"), F.col("dn"), F.col("k")), segment_cost(F.col("l2"), F.col("dn2"), F.col("k2"))).first()
    assert tuple(got) == (27_942_288, 37_012)
    for flow, want in (("12.5", 106_250_000), ("0", 100_000_000), ("0.3", 100_150_000)):
        assert one(spark.sql(f"select cast({flow} as decimal(18,2)) f").select(penalty(F.col("f")))) == want
    assert round(one(spark.sql("select 13974800 c, 100 l").select(raw_score(F.col("c"), F.col("l")))), 4) == 0.6913
    assert [r[0] for r in spark.createDataFrame([(50,), (250,), (600,), (1400,)], "dn int").select(band(F.col("dn"), CHAMBER_BANDS)).collect()] == [3_000_000, 5_000_000, 8_000_000, 12_000_000]
    with pytest.raises(Exception, match="unknown dn"):
        spark.sql("select 51 dn").select(by_dn(F.col("dn"), 3)).collect()


def test_trees(spark):
    tree = spark.createDataFrame([(1, None, 0.0), (2, 1, 30.1), (3, 1, 0.0), (4, 3, 50.2), (9, None, 7.0)], "node_id long, parent_id long, v double")
    assert {r.node_id: float(r.s) for r in roll_up(tree, "v", "s").collect()} == {1: 80.3, 2: 30.1, 3: 50.2, 4: 50.2, 9: 7.0}
    assert {r.node_id: (r.d, r.head) for r in walk_up(tree, F.lit(1), "d", "long").collect()} == {1: (1, 1), 2: (2, 1), 3: (2, 1), 4: (3, 1), 9: (1, 9)}
    deep = spark.createDataFrame([(i, i - 1 if i else None, 1.0) for i in range(150)] + [(200, 500, 2.0)], "node_id long, parent_id long, v double")
    assert {r.node_id: float(r.s) for r in roll_up(deep, "v", "s").collect()} == {i: float(150 - i) for i in range(150)} | {200: 2.0}
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, None), (5, 4)], "node_id long, parent_id long")
    assert {r[0] for r in on_cycle(loop).collect()} == {1, 2, 3}
    with pytest.raises(ValueError, match="cycle"):
        roll_up(loop.withColumn("v", F.lit(1)), "v", "s").collect()
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "u long, v long")
    assert {tuple(r) for r in bfs(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 1)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 5)]
    got = {r.node: r.component_id for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k != v} == {i: 0 for i in range(1, 41)} | {101: 100}


def test_spatial(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 0.0)], "i long, x double, y double")
    b = spark.createDataFrame([(5, 0.0, 10.0), (6, 10.0, 0.0), (7, -3.0, 4.0)], "j long, x double, y double")
    pairs = within(a, b, 10.0, "i", "j")
    assert {(r.i, r.j) for r in pairs.collect()} == {(1, 5), (1, 6), (1, 7), (2, 6)}
    assert {(r.i, r.j) for r in nearest(pairs, "i", "j").collect()} == {(1, 7), (2, 6)}
    box = spark.createDataFrame([(1, 5.0, 5.0, 5.0, 1.0)], "restriction_id long, cx double, cy double, half_w double, half_h double")
    inside = spark.createDataFrame([(1, 10.0, 6.0), (2, 10.1, 5.0)], "i long, x double, y double")
    assert [r.i for r in points_in_boxes(inside, box, "i").collect()] == [1]
    routes = spark.createDataFrame([(1, 5.0, -20.0, 5.0, 200.0), (2, 20.0, 0.0, 20.0, 9.0), (3, 0.0, 5.5, 300.0, 5.5)], "route_id long, ax double, ay double, bx double, by double")
    assert {r.route_id for r in routes_in_boxes(routes, box).collect()} == {1, 3}
    assert {tuple(r) for r in crossings(routes).collect()} == {(1, 3), (2, 3)}
    spans = spark.createDataFrame([(1, 0.0, 0.5, 1.6), (1, 0.25, 0.75, 1.75)], "r long, lo double, hi double, k double")
    assert sorted((r["at"], r.stop, r.k) for r in elementary_pieces(spans, "r", [1.6, 1.75]).collect()) == [(0.0, 0.25, 1.6), (0.25, 0.5, 1.75), (0.5, 0.75, 1.75)]


def test_projection(spark):
    from pipeloom.functions.projection import is_lon_lat, to_lon_lat, to_utm

    p = spark.createDataFrame([(39.0, 0.0), (37.6, 55.75), (36.1, 57.2), (41.9, -10.0)], "lon double, lat double")
    east, north = to_utm(F.col("lon"), F.col("lat"))
    both = p.withColumn("e", east).withColumn("n", north)
    assert both.first().e == pytest.approx(500000, abs=1e-6) and both.first().n == pytest.approx(0, abs=1e-6)
    lon, lat = to_lon_lat(F.col("e"), F.col("n"))
    for r in both.withColumn("lon2", lon).withColumn("lat2", lat).collect():
        assert r.lon2 == pytest.approx(r.lon, abs=2e-8) and r.lat2 == pytest.approx(r.lat, abs=2e-8)
    assert [r[0] for r in spark.sql("select 55.7 a, 37.6 b union all select 10.0, 95.0").select(is_lon_lat(F.col("a"), F.col("b"))).collect()] == [True, False]
