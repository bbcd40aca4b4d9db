"""Small tables and plans on which the findings of round 4 showed."""

from pyspark.sql import functions as F

from pipeloom.operators import polygons, spatial
from pipeloom.plans import zones
from test_findings_r03 import both, customers


def test_f28_area_of_all_vertices(spark, tmp_path):
    got, want = both(spark, tmp_path, "area_of_interest", customer=customers(5, 700, 9001))
    ends = [((k * 7919) % 100003 / 100 + 12 * s + (k * 31 + s * 17) % 13, (k * 104729) % 99991 / 100 + (k * 53 + s * 29) % 41 - 20) for k in (5, 700, 9001) for s in range(4)]
    points = [((k * 7919) % 100003 / 100, (k * 104729) % 99991 / 100) for k in (5, 700, 9001)]
    x, y = zip(*ends, *points)
    assert got == want == [tuple(round(v, 6) for v in (min(x) - 1000, max(x) + 1000, min(y) - 1000, max(y) + 1000))]


def test_f1_f6_f9_regions_within_a_task(spark, monkeypatch):
    """Small keys are cut as in cells, in one shuffle; large ones go to cells."""
    table = zones.polygons(spark, "/root/testdata/sf0.001").withColumn("d", zones.offset(F.col("rules_key"), zones.DN))
    stars = polygons.ring_edges(zones.polygons(spark, "/root/testdata/sf0.001", order=5), "restriction_id").drop("ring", "i")
    calls = []
    real = polygons._region_in_cells
    monkeypatch.setattr(polygons, "_region_in_cells", lambda *args: calls.append(1) or real(*args))
    told = lambda df: sorted(tuple(round(v, 7) for v in r) for r in df.collect())
    for edges, inside in ((polygons.offset_curves(table, "d", "restriction_id"), lambda w: w >= 1), (stars, lambda w: w != 0)):
        made = {}
        for many in (100, 0):
            monkeypatch.setattr(polygons, "MANY", many)
            made[many] = told(polygons.region(edges, inside, "restriction_id"))
        assert made[100] == made[0] and len(made[0]) > 100
        calls.clear()
    monkeypatch.setattr(polygons, "MANY", 100)
    plan = polygons.region(stars, key="restriction_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1 and not calls  # beside the one that deals the polygons out
    monkeypatch.setattr(polygons, "AT_ONCE", 500)
    assert told(polygons.region(stars, lambda w: w != 0, "restriction_id")) == made[0]


def test_f18_pairs_that_share_cells_are_not_shuffled(spark):
    ways = [(k, *((k * a) % 997 / 10 for a in (37, 61, 89, 113))) for k in range(120)] + [(200, 10.0, 0.0, 10.0, 90.0), (201, 0.0, 10.0, 90.0, 10.0), (202, 20.0, 5.0, 20.0, 60.0), (203, 0.0, 0.0, 80.0, 80.0)]
    side = lambda o, x, y: (o[3] - o[1]) * (y - o[2]) - (o[4] - o[2]) * (x - o[1])
    proper = lambda p, q: side(p, *q[1:3]) * side(p, *q[3:]) < 0 and side(q, *p[1:3]) * side(q, *p[3:]) < 0
    want = sorted((p[0], q[0]) for p in ways for q in ways if p[0] < q[0] and proper(p, q))
    made = spatial.crossings(spark.createDataFrame(ways, "route_id bigint, ax double, ay double, bx double, by double"), 10.0)
    assert sorted(map(tuple, made.collect())) == want and len(want) > 1000
    assert "Aggregate" not in made._jdf.queryExecution().executedPlan().toString()


def test_f7_zones_are_not_broadcast(spark):
    table = zones.polygons(spark, "/root/testdata/sf0.001").withColumn("d", F.lit(3.0))
    ways = spark.range(20).selectExpr("id as route_id", "cast(id as double) as ax", "0.0D as ay", "500.0D as bx", "500.0D as by")
    edges = polygons.ring_edges(table, "restriction_id")
    for made in (polygons.zone_spans(ways, table, "d", "restriction_id"), polygons.inside_spans(ways, edges, "restriction_id")):
        assert "BroadcastExchange" not in made._jdf.queryExecution().executedPlan().toString()
