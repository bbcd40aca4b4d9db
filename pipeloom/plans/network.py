"""Network queries: snapping, degrees, tie-in candidates, traversal, groups and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipeloom.operators.components import components
from pipeloom.operators.ranks import rank_in_blocks
from pipeloom.operators.spatial import clusters, elementary_pieces, micro, nearest_within, points_in_boxes, routes_in_boxes, shuffled, within
from pipeloom.operators.tree import bfs, on_cycle
from pipeloom.shared import load
from pipeloom.sources.views import sql_views, view

SNAP, NEIGHBOUR, JOIN_RADIUS = 10.0, 30.0, 16.0


def snap_nearest_chamber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_within(view(spark, sf_dir, "oks"), view(spark, sf_dir, "chamber"), SNAP, "oks_id", "chamber_id").select("oks_id", "chamber_id", F.round("d2", 6).alias("d2"))


def snap_grid_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    oks = view(spark, sf_dir, "oks")
    return nearest_within(oks, oks.withColumnRenamed("oks_id", "other_id"), NEIGHBOUR, "oks_id", "other_id", others=True).select("oks_id", "other_id", F.round("d2", 6).alias("d2"))


def snap_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chamber in reach before another connection point in reach, else nothing (-1)."""
    chambers, others = snap_nearest_chamber(spark, sf_dir).select("oks_id", "chamber_id"), snap_grid_self(spark, sf_dir).select("oks_id", "other_id")
    out = view(spark, sf_dir, "oks").select("oks_id").join(shuffled(chambers), "oks_id", "left").join(shuffled(others), "oks_id", "left")
    kind = F.when(F.col("chamber_id").isNotNull(), "chamber").when(F.col("other_id").isNotNull(), "point").otherwise("none")
    return out.select("oks_id", kind.alias("snapped_to"), F.coalesce("chamber_id", "other_id", F.lit(-1)).cast("bigint").alias("target_id"))


def chamber_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The larger of the ports in use on record and the number of tree edges at the node of the chamber's number."""
    tree = view(spark, sf_dir, "tree")
    ends = tree.filter("parent_id is not null").select(F.col("node_id").alias("chamber_id")).unionByName(tree.filter("parent_id is not null").select(F.col("parent_id").alias("chamber_id")))
    counted = ends.groupBy("chamber_id").agg(F.count("*").alias("edges"))
    return view(spark, sf_dir, "chamber").join(counted, "chamber_id", "left").select("chamber_id", F.greatest("used_ports", F.coalesce("edges", F.lit(0))).cast("bigint").alias("degree"))


def tie_in_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chambers with a free port in reach of each connection point, in order: nearest first, then by id."""
    free = view(spark, sf_dir, "chamber").join(chamber_degree(spark, sf_dir), "chamber_id").filter("degree < 4")
    pairs = within(view(spark, sf_dir, "oks"), free, 3 * SNAP, "oks_id", "chamber_id")
    return pairs.select("oks_id", "chamber_id", F.row_number().over(Window.partitionBy("oks_id").orderBy("d2", "chamber_id")).alias("place"))


def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = view(spark, sf_dir, "tree")
    edges = tree.filter("parent_id is not null").select(F.col("node_id").alias("u"), F.col("parent_id").alias("v"))
    return bfs(edges, tree.filter("parent_id is null").select(F.col("node_id").alias("node"))).select(F.col("node").alias("node_id"), "depth")


def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that never reach a root once node 1 is made a child of node 13, its own descendant."""
    tree = view(spark, sf_dir, "tree").select("node_id", F.when(F.col("node_id") == 1, 13).otherwise(F.col("parent_id")).cast("bigint").alias("parent_id"))
    return on_cycle(tree)


def point_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection points joined over gaps of JOIN_RADIUS at most; single points are groups of their own."""
    return clusters(view(spark, sf_dir, "oks"), JOIN_RADIUS, "oks_id")


def joint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for joint plans: over gaps of 250 m."""
    return clusters(view(spark, sf_dir, "oks"), 250.0, "oks_id")


def tree_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of the forest with a cross link from each seventh node: no parent of that number, more than four edges at a node."""
    tree = view(spark, sf_dir, "tree")
    links = tree.filter("node_id % 7 = 0").select(F.explode(F.array("node_id", F.floor(F.col("node_id") / 2).cast("long"))).alias("node_id"))
    known = tree.select(F.col("node_id").alias("parent_id"))
    lost = tree.filter("parent_id is not null").join(known, "parent_id", "left_anti").select("node_id", F.lit("unknown parent").alias("problem"))
    ends = tree.filter("parent_id is not null").select("node_id").unionByName(tree.filter("parent_id is not null").select(F.col("parent_id").alias("node_id"))).unionByName(links)
    full = ends.groupBy("node_id").agg(F.count("*").alias("n")).filter("n > 4").select("node_id", F.lit("crowded").alias("problem"))
    return lost.unionByName(full)


def median_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each market segment in two halves along the longer side of their box."""
    oks = view(spark, sf_dir, "oks").join(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("oks_id"), F.col("c_nationkey").alias("area")), "oks_id")
    box = oks.groupBy("area").agg((F.max("x") - F.min("x") >= F.max("y") - F.min("y")).alias("wide"), F.count("*").alias("n"))
    placed = oks.join(box, "area").withColumn("along", F.when(F.col("wide"), F.col("x")).otherwise(F.col("y")))
    ranked = rank_in_blocks(placed, "area", F.floor(F.col("along") / 10), ["along", "oks_id"])
    return ranked.select("oks_id", "area", F.when(F.col("rank") - 1 < F.floor(F.col("n") / 2), 0).otherwise(1).alias("half"))


def chunk_six(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("oks_id"), F.col("c_nationkey").alias("area"))
    ranked = rank_in_blocks(area, "area", F.floor(F.col("oks_id") / 10_000), ["oks_id"])
    return ranked.select("oks_id", "area", F.floor((F.col("rank") - 1) / 6).cast("bigint").alias("chunk"))


def own_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = view(spark, sf_dir, "restriction").filter("rules_key = 'oks_existing'")
    return points_in_boxes(view(spark, sf_dir, "oks"), boxes, "oks_id").groupBy("oks_id").agg(F.min("restriction_id").alias("restriction_id"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-point route from each connection point to the chamber of the same number modulo the chambers."""
    chambers = view(spark, sf_dir, "chamber")
    n = chambers.count()
    a = view(spark, sf_dir, "oks").select(F.col("oks_id").alias("route_id"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("oks_id") % n).alias("chamber_id"))
    return a.join(chambers.select("chamber_id", F.col("x").alias("bx"), F.col("y").alias("by")), "chamber_id").select("route_id", "ax", "ay", "bx", "by")


def segment_blocked_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that meet a prohibited box grown by 1 m less the tolerance."""
    boxes = view(spark, sf_dir, "restriction").filter("rules_key in ('park', 'social_area', 'prohibited_site', 'water', 'railway')")
    boxes = boxes.withColumn("half_w", F.col("half_w") + 0.99).withColumn("half_h", F.col("half_h") + 0.99)
    return routes_in_boxes(routes(spark, sf_dir), boxes, 100.0).groupBy("route_id").agg(F.count("*").alias("n_zones"), F.min("restriction_id").alias("first_zone"))


def special_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of routes in roads and tram tracks, with the larger coefficient where they overlap."""
    boxes = view(spark, sf_dir, "restriction").filter("rules_key in ('road', 'tram_tracks')").withColumn("half_w", F.col("half_w") + 3).withColumn("half_h", F.col("half_h") + 3)
    k = F.when(F.col("rules_key") == "road", 1.6).otherwise(1.75)
    spans = routes_in_boxes(routes(spark, sf_dir), boxes, 100.0).select("route_id", micro(F.col("enter")).alias("lo"), micro(F.col("leave")).alias("hi"), k.alias("k")).filter("lo < hi")
    return elementary_pieces(spans, "route_id", [1.6, 1.75]).select("route_id", F.col("at").alias("lo"), F.col("stop").alias("hi"), "k")


def weighted_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route lengths with special metres counted by their coefficient."""
    length = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    extra = special_sections(spark, sf_dir).groupBy("route_id").agg(F.sum((F.col("hi") - F.col("lo")) * (F.col("k") - 1)).alias("extra"))
    return routes(spark, sf_dir).join(extra, "route_id", "left").select("route_id", F.round(length * (F.coalesce("extra", F.lit(0.0)) + 1), 3).alias("weighted_m"))


_P = f"with {sql_views('oks', 'chamber', 'tree', 'restriction')}"
_D2 = "(o.x - c.x) * (o.x - c.x) + (o.y - c.y) * (o.y - c.y)"
_NEAR = f"near_c as (select oks_id, chamber_id, d2 from (select oks_id, chamber_id, {_D2} as d2, row_number() over (partition by oks_id order by {_D2}, chamber_id) as r from oks o join chamber c on c.x between o.x - 10 and o.x + 10 and {_D2} <= 100) where r = 1)"
_SELF = f"near_o as (select oks_id, other_id, d2 from (select o.oks_id, c.oks_id as other_id, {_D2} as d2, row_number() over (partition by o.oks_id order by {_D2}, c.oks_id) as r from oks o join oks c on c.oks_id <> o.oks_id and c.x between o.x - 30 and o.x + 30 and {_D2} <= 900) where r = 1)"
_DEGREE = "degree as (select chamber_id, greatest(used_ports, coalesce(edges, 0))::bigint as degree from chamber left join (select n, count(*) as edges from (select node_id as n from tree where parent_id is not null union all select parent_id from tree where parent_id is not null) group by n) on n = chamber_id)"
_ROUTES = "routes as (select oks_id as route_id, o.x as ax, o.y as ay, c.x as bx, c.y as b_y from oks o join chamber c on c.chamber_id = o.oks_id % (select count(*) from chamber))"


def _clipped(grow: str, keys: str) -> str:
    """Routes against boxes by the slab method."""
    return f"""{_ROUTES}, box as materialized (select restriction_id, rules_key, cx, cy, half_w + {grow} as hw, half_h + {grow} as hh from restriction where rules_key in ({keys})),
  strip as materialized (select r.*, unnest(range(floor(least(ax, bx) / 50)::bigint, floor(greatest(ax, bx) / 50)::bigint + 1)) as strip from routes r),
  cell as materialized (select *, unnest(range(floor((least(case when bx = ax then ay else ay + (b_y - ay) * ((greatest(strip * 50.0, least(ax, bx)) - ax) / (bx - ax)) end, case when bx = ax then b_y else ay + (b_y - ay) * ((least(strip * 50.0 + 50, greatest(ax, bx)) - ax) / (bx - ax)) end) - 1e-6) / 50)::bigint,
    floor((greatest(case when bx = ax then ay else ay + (b_y - ay) * ((greatest(strip * 50.0, least(ax, bx)) - ax) / (bx - ax)) end, case when bx = ax then b_y else ay + (b_y - ay) * ((least(strip * 50.0 + 50, greatest(ax, bx)) - ax) / (bx - ax)) end) + 1e-6) / 50)::bigint + 1)) as row from strip),
  spot as materialized (select *, unnest(range(floor((cy - hh) / 50)::bigint, floor((cy + hh) / 50)::bigint + 1)) as row from (select *, unnest(range(floor((cx - hw) / 50)::bigint, floor((cx + hw) / 50)::bigint + 1)) as strip from box)),
  close as materialized (select distinct route_id, restriction_id from cell join spot using (strip, row)),
  met as materialized (select route_id, restriction_id, rules_key,
    greatest(0.0, coalesce(case when bx <> ax then least((cx - hw - ax) / (bx - ax), (cx + hw - ax) / (bx - ax)) end, 0.0), coalesce(case when b_y <> ay then least((cy - hh - ay) / (b_y - ay), (cy + hh - ay) / (b_y - ay)) end, 0.0)) as enter,
    case when (bx = ax and abs(ax - cx) > hw) or (b_y = ay and abs(ay - cy) > hh) then -1.0 else
    least(1.0, coalesce(case when bx <> ax then greatest((cx - hw - ax) / (bx - ax), (cx + hw - ax) / (bx - ax)) end, 1.0), coalesce(case when b_y <> ay then greatest((cy - hh - ay) / (b_y - ay), (cy + hh - ay) / (b_y - ay)) end, 1.0)) end as leave
    from close join routes using (route_id) join box using (restriction_id))"""


_SPECIAL = _clipped("3", "'road', 'tram_tracks'") + """, spans as (select route_id, round(enter, 6) as lo, round(leave, 6) as hi, case rules_key when 'road' then 1.6::double else 1.75::double end as k from met where enter <= leave and round(enter, 6) < round(leave, 6)),
  cuts as materialized (select route_id, cut, lead(cut) over (partition by route_id order by cut) as stop from (select route_id, lo as cut from spans union select route_id, hi from spans)),
  pieces as (select c.route_id, c.cut as lo, c.stop as hi, max(k) as k from cuts c join spans s on s.route_id = c.route_id and s.lo <= c.cut and c.stop <= s.hi group by 1, 2, 3)"""
_AREA = "area as (select oks_id, x, y, c_nationkey as area from oks join customer on c_custkey = oks_id)"

QUERIES = {
    "snap_nearest_chamber": (snap_nearest_chamber, f"{_P}, {_NEAR} select oks_id, chamber_id, round(d2, 6) as d2 from near_c"),
    "snap_grid_self": (snap_grid_self, f"{_P}, {_SELF} select oks_id, other_id, round(d2, 6) as d2 from near_o"),
    "snap_priority": (snap_priority, f"{_P}, {_NEAR}, {_SELF} select oks_id, case when chamber_id is not null then 'chamber' when other_id is not null then 'point' else 'none' end as snapped_to, coalesce(chamber_id, other_id, -1)::bigint as target_id from oks left join near_c using (oks_id) left join near_o using (oks_id)"),
    "chamber_degree": (chamber_degree, f"{_P}, {_DEGREE} select chamber_id, degree from degree"),
    "tie_in_candidates": (tie_in_candidates, f"{_P}, {_DEGREE} select oks_id, chamber_id, row_number() over (partition by oks_id order by {_D2}, chamber_id)::int as place from oks o join (chamber join degree using (chamber_id)) c on degree < 4 and {_D2} <= 900"),
    "bfs_depth": (bfs_depth, f"with recursive {sql_views('tree')}, b as (select node_id, 0 as depth from tree where parent_id is null union all select t.node_id, depth + 1 from b join tree t on t.parent_id = b.node_id) select node_id, depth from b"),
    "cycle_check": (cycle_check, f"with recursive {sql_views('tree')}, c as (select node_id, case when node_id = 1 then 13 else parent_id end as parent_id from tree), r as (select node_id from c where parent_id is null union all select c.node_id from r join c on c.parent_id = r.node_id) select node_id from c where node_id not in (select node_id from r)"),
    "point_groups": (point_groups, f"with recursive {sql_views('oks')}, e as (select o.oks_id as u, c.oks_id as v from oks o join oks c on o.oks_id <> c.oks_id and c.x between o.x - 16 and o.x + 16 and {_D2} <= 256), r as (select oks_id as u, oks_id as v from oks union select r.u, e.v from r join e on e.u = r.v) select u as oks_id, min(v) as group_id from r group by u"),
    "joint_groups": (joint_groups, f"with recursive {sql_views('oks')}, e as materialized (select o.oks_id as u, c.oks_id as v from oks o join oks c on {_D2} <= 62500), r as (select min(oks_id) as u from oks union select e.v from r join e using (u)) select oks_id, case when oks_id in (select u from r) then (select min(oks_id) from oks) end as group_id from oks"),
    "tree_validity": (tree_validity, f"{_P} select node_id, 'unknown parent' as problem from tree where parent_id is not null and parent_id not in (select node_id from tree) union all select n, 'crowded' from (select node_id as n from tree where parent_id is not null union all select parent_id from tree where parent_id is not null union all select unnest([node_id, node_id // 2]) from tree where node_id % 7 = 0) group by n having count(*) > 4"),
    "median_split": (median_split, f"{_P}, {_AREA}, box as (select area, max(x) - min(x) >= max(y) - min(y) as wide, count(*) as n from area group by area) select oks_id, area, case when row_number() over (partition by area order by case when wide then x else y end, oks_id) - 1 < n // 2 then 0 else 1 end as half from area join box using (area)"),
    "chunk_six": (chunk_six, "select c_custkey as oks_id, c_nationkey as area, ((row_number() over (partition by c_nationkey order by c_custkey) - 1) // 6)::bigint as chunk from customer"),
    "own_polygon": (own_polygon, f"{_P} select oks_id, min(restriction_id) as restriction_id from oks join restriction on rules_key = 'oks_existing' and abs(x - cx) <= half_w and abs(y - cy) <= half_h group by oks_id"),
    "segment_blocked_box": (segment_blocked_box, f"{_P}, {_clipped('0.99', repr('park') + ', ' + ', '.join(map(repr, ('social_area', 'prohibited_site', 'water', 'railway'))))} select route_id, count(*) as n_zones, min(restriction_id) as first_zone from met where enter <= leave group by route_id"),
    "special_sections": (special_sections, f"{_P}, {_SPECIAL} select route_id, lo, hi, k from pieces"),
    "weighted_length": (weighted_length, f"{_P}, {_SPECIAL.replace('pieces as (', 'pieces as materialized (')} select route_id, round(sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y)) * (coalesce(extra, 0.0) + 1), 3) as weighted_m from routes left join (select route_id, sum((hi - lo) * (k - 1)) as extra from pieces group by 1) using (route_id)"),
}
