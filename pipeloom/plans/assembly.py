"""Queries that put a network together: parents and problems of the tree, chambers, tie-ins, merged plans, exports, depths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipeloom.functions.reference import by_dn, min_dn, roubles, segment_cost, sql_case, sql_min_dn
from pipeloom.operators.lines import spaced
from pipeloom.operators.ranks import rank_in_blocks
from pipeloom.operators.spatial import nearest_of_all, within
from pipeloom.operators.tree import bfs, roll_up, walk_up
from pipeloom.plans.geometry import _NEAR, _projections, vertices
from pipeloom.plans.network import _D2, _DEGREE, _P, chamber_degree
from pipeloom.plans.sizing import _ADDED, _CLOSURE, _DN, flows, upstream_added_flow, variant_summary
from pipeloom.shared import load
from pipeloom.sources.views import sql_views, view

DEMAND = 36  # own flow from which a node of the tree counts as a demand
NORMAL_DEPTH, STEP_M, PORTS = 3.0, 0.05, 4


def _tree(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return view(spark, sf_dir, "tree").select("node_id", "parent_id", *columns)


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges: the tree's, and a cross link from each seventh node."""
    t = _tree(spark, sf_dir)
    links = t.filter("node_id % 7 = 0").select(F.col("node_id").alias("u"), F.floor(F.col("node_id") / 2).cast("long").alias("v")).join(t.select(F.col("node_id").alias("v")), "v", "left_semi")
    return t.filter("parent_id is not null").select(F.col("node_id").alias("u"), F.col("parent_id").alias("v")).join(t.select(F.col("node_id").alias("v")), "v", "left_semi").unionByName(links).filter("u <> v")


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).agg(F.min("node_id").alias("node"))


def parent_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parent of each node that the source reaches: of its neighbours one step nearer to the source, the smallest."""
    edges = _graph(spark, sf_dir)
    depth = bfs(edges, _roots(spark, sf_dir))
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    up = depth.select(F.col("node").alias("v"), (F.col("depth") + 1).alias("depth"))
    near = both.join(up, "v").join(depth.withColumnRenamed("node", "u"), ["u", "depth"])
    return near.groupBy(F.col("u").alias("node_id"), "depth").agg(F.min("v").alias("parent_id"))


def unreachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the edges of each eleventh node taken away: nodes that the source does not reach, with edges or without."""
    edges = _graph(spark, sf_dir).filter("u % 11 <> 5 and v % 11 <> 5")
    reached = bfs(edges, _roots(spark, sf_dir)).select(F.col("node").alias("node_id"))
    ends = edges.select(F.col("u").alias("node_id")).unionByName(edges.select(F.col("v").alias("node_id"))).distinct().withColumn("tied", F.lit(True))
    lost = _tree(spark, sf_dir).select("node_id").join(reached, "node_id", "left_anti").join(ends, "node_id", "left")
    return lost.select("node_id", F.when(F.col("tied"), "unreachable").otherwise("isolated").alias("problem"))


def upstream_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upstream objects on record count for all as soon as any pipe has one; else those found from the geometry."""
    t = _tree(spark, sf_dir).withColumn("explicit", F.when(F.col("node_id") % 7 == 3, F.col("parent_id")))
    any_on_record = t.agg(F.bool_or(F.col("explicit").isNotNull()).alias("on_record"))
    return t.join(F.broadcast(any_on_record)).select("node_id", F.when(F.col("on_record"), F.col("explicit")).otherwise(F.col("parent_id")).alias("upstream_id"), F.when(F.col("on_record"), "explicit").otherwise("inferred").alias("mode"))


def pipe_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a pipe's line runs against the flow: its last vertex is nearer to the upstream node than its first."""
    t = _tree(spark, sf_dir).filter("parent_id is not null")
    up = view(spark, sf_dir, "tree").select(F.col("node_id").alias("parent_id"), "x", "y")
    ends = vertices(spark, sf_dir).filter("seq in (0, 3)").select(F.col("line_id").alias("node_id"), "seq", F.col("x").alias("vx"), F.col("y").alias("vy"))
    d2 = (F.col("vx") - F.col("x")) * (F.col("vx") - F.col("x")) + (F.col("vy") - F.col("y")) * (F.col("vy") - F.col("y"))
    return t.join(up, "parent_id").join(ends, "node_id").groupBy("node_id").agg((F.min(F.when(F.col("seq") == 3, d2)) < F.min(F.when(F.col("seq") == 0, d2))).alias("reversed"))


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tree(spark, sf_dir, "own_flow", "length_m").withColumn("demand", (F.col("own_flow") >= DEMAND).cast("int"))
    return t.join(roll_up(t, "demand", "live", "int", F.max), "node_id").filter("live = 1")


def live_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree without its dead ends: nodes with a demand at or below them."""
    return _live(spark, sf_dir).select("node_id", "parent_id")


def merged_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the tree without dead ends, pipes that meet at a node with one pipe in and one out and no demand are one: the chain's lowest node, its top, pipes and length."""
    t = _live(spark, sf_dir)
    below = t.filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    t = t.join(below, "node_id", "left").withColumn("through", (F.coalesce("n", F.lit(0)) == 1) & (F.col("demand") == 0))
    up = t.select(F.col("node_id").alias("parent_id"), F.col("through").alias("on"))
    t = t.join(up, "parent_id", "left").withColumn("stops", ~F.coalesce("on", F.lit(False)))
    size = walk_up(t, F.col("length_m"), "length_m", "decimal(18,3)", stop=F.col("stops"))
    pipes = walk_up(t, F.lit(1), "n_pipes", "bigint", stop=F.col("stops")).select("node_id", "n_pipes")
    return t.filter("not through").select("node_id").join(size, "node_id").join(pipes, "node_id").select("node_id", F.col("head").alias("top_id"), "n_pipes", F.col("length_m").cast("double").alias("length_m"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir, "length_m", "k_spec").join(flows(spark, sf_dir).select("node_id", min_dn(F.col("flow")).alias("dn")), "node_id")


def chamber_required_dn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest dn among the pipes that meet at each node."""
    t = _sized(spark, sf_dir)
    ends = t.select("node_id", "dn").unionByName(t.filter("parent_id is not null").select(F.col("parent_id").alias("node_id"), "dn"))
    return ends.groupBy("node_id").agg(F.max("dn").alias("dn"), F.count("*").alias("n_pipes"))


def chamber_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chambers with new pipes: the dn on record (or the largest next to it), what is needed, and whether the ports suffice."""
    new = view(spark, sf_dir, "new_segment").groupBy(F.col("l_suppkey").alias("chamber_id")).agg(F.max("dn").alias("new_dn"), F.countDistinct("variant_key").alias("n_new"))
    t = _sized(spark, sf_dir).join(upstream_added_flow(spark, sf_dir).join(flows(spark, sf_dir), "node_id").select("node_id", min_dn(F.col("flow") + F.col("added")).alias("dn_after")), "node_id", "left")
    ends = t.select(F.col("node_id").alias("chamber_id"), "dn", F.coalesce("dn_after", "dn").alias("after")).unionByName(t.filter("parent_id is not null").select(F.col("parent_id").alias("chamber_id"), "dn", F.coalesce("dn_after", "dn").alias("after")))
    beside = ends.groupBy("chamber_id").agg(F.max("dn").alias("beside_dn"), F.max("after").alias("after_dn"), F.count("*").alias("n_pipes"))
    c = view(spark, sf_dir, "chamber").select("chamber_id", F.when(F.col("chamber_id") % 3 > 0, 100 * (F.col("chamber_id") % 4 + 1)).cast("int").alias("record_dn"))
    both = c.join(new, "chamber_id").join(beside, "chamber_id")
    original = F.coalesce("record_dn", "beside_dn")
    return both.select("chamber_id", original.alias("original_dn"), F.greatest(original, "new_dn", "after_dn").alias("required_dn"), F.col("record_dn").isNull().alias("dn_missing"), (F.col("n_pipes") + F.col("n_new") > PORTS).alias("over_limit"))


def affected_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes that a tie-in changes: all that its flow passes, and those tied into along their length."""
    passed = upstream_added_flow(spark, sf_dir).select("node_id", F.lit(True).alias("passed"))
    tied = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_id"), F.lit(True).alias("tied")).distinct()
    return passed.join(tied, "node_id", "full").select("node_id", F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("tied", F.lit(False)).alias("tied"))


def group_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, "oks").join(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("oks_id"), F.col("c_nationkey").alias("area")), "oks_id")
    return g.groupBy("area").agg(F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"), F.count("*").alias("n"))


def plan_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest dn of each variant and how many points it connects."""
    return view(spark, sf_dir, "new_segment").groupBy("variant_key").agg(F.max("dn").alias("max_dn"), F.countDistinct(F.when(F.col("l_returnflag") != "N", F.col("l_suppkey"))).alias("n_connected"))


def sizing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sizing at once, by dn: pipes, metres, cost, reconstruction cost of those whose flow grows beyond their dn."""
    t = _sized(spark, sf_dir).join(upstream_added_flow(spark, sf_dir), "node_id", "left").join(flows(spark, sf_dir), "node_id")
    after = min_dn(F.col("flow") + F.coalesce("added", F.lit(0).cast("decimal(18,2)")))
    again = F.when(after > F.col("dn"), roubles(F.col("length_m").cast("decimal(12,3)") * by_dn(after, 4).cast("decimal(10,0)"))).otherwise(0)
    return t.groupBy("dn").agg(F.count("*").alias("n"), F.sum("length_m").cast("double").alias("length_m"), F.sum(segment_cost(F.col("length_m"), F.col("dn"), F.col("k_spec"))).alias("cost"), F.sum(again).cast("bigint").alias("reconstruction"))


def tie_in_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to tie in at within 10 m of each connection point: chambers with a free port, and pipes, which give way to a
    chamber with a free port within 10 m of the place. In order of distance, chambers first, then cost and number."""
    free = view(spark, sf_dir, "chamber").join(chamber_degree(spark, sf_dir), "chamber_id").filter(F.col("degree") < PORTS).select("chamber_id", "x", "y")
    points = view(spark, sf_dir, "oks").select("oks_id", "x", "y")
    direct = within(points, free, 10.0, "oks_id", "chamber_id").select("oks_id", F.lit("chamber").alias("kind"), F.col("chamber_id").alias("target_id"), F.round(F.sqrt("d2"), 6).alias("d"))
    pipes = _projections(spark, sf_dir).withColumn("key", F.struct("oks_id", "line_id"))
    moved = within(pipes.select("key", F.col("px").alias("x"), F.col("py").alias("y")), free, 10.01, "key", "chamber_id").groupBy("key").agg(F.min(F.struct(F.round("d2", 6).alias("d2"), "chamber_id", "bx", "by")).alias("c"))
    place = pipes.join(moved, "key", "left").join(points, "oks_id")
    from_point = F.sqrt((F.col("c.bx") - F.col("x")) * (F.col("c.bx") - F.col("x")) + (F.col("c.by") - F.col("y")) * (F.col("c.by") - F.col("y")))
    along = place.select("oks_id", F.when(F.col("c").isNull(), "pipe").otherwise("chamber").alias("kind"), F.coalesce("c.chamber_id", "line_id").alias("target_id"), F.round(F.when(F.col("c").isNull(), F.col("d")).otherwise(from_point), 6).alias("d"))
    all_of = direct.unionByName(along).groupBy("oks_id", "kind", "target_id").agg(F.min("d").alias("d"))
    cost = F.when(F.col("kind") == "chamber", 5_000_000).otherwise(3_000_000)
    order = Window.partitionBy("oks_id").orderBy("d", F.col("kind") == "pipe", cost, "target_id")
    return all_of.select("oks_id", "kind", "target_id", "d", F.row_number().over(order).alias("place"))


def second_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best place to tie in at on another object than the best one's."""
    c = tie_in_choices(spark, sf_dir)
    first = c.filter("place = 1").select("oks_id", F.col("kind").alias("k1"), F.col("target_id").alias("t1"))
    other = c.join(first, "oks_id").filter("kind <> k1 or target_id <> t1")
    return other.groupBy("oks_id").agg(F.min_by(F.struct("kind", "target_id"), "place").alias("b")).select("oks_id", "b.kind", "b.target_id")


def varied_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three attempts for each customer, among suppliers of its orders taken by price: the first, then the first that
    is a chamber with a free port, then the others, each at least 15 m from those taken."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("chamber_id"), F.col("l_quantity").cast("double").alias("cost"))
    c = view(spark, sf_dir, "chamber").select("chamber_id", "x", "y", (F.col("used_ports") < 2).alias("roomy"))
    tried = li.join(o, "o_orderkey").groupBy("o_custkey", "chamber_id").agg(F.min("cost").alias("cost")).join(c, "chamber_id")
    listed = tried.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("cost", "chamber_id", "x", "y", "roomy"))).alias("t"))
    far = lambda kept, p: F.forall(kept, lambda q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]) >= 225.0)
    head = F.slice("t", 1, 1)
    roomy = F.slice(F.filter("t", lambda p: p["roomy"] & far(head, p)), 1, 1)
    kept = F.aggregate("t", F.concat(head, roomy), lambda acc, p: F.when((F.size(acc) < 3) & far(acc, p), F.concat(acc, F.array(p))).otherwise(acc))
    return listed.select("o_custkey", F.posexplode(kept).alias("place", "p")).select("o_custkey", "place", F.col("p.chamber_id").alias("chamber_id"))


def focus_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all restriction centres the 2400 nearest to a chamber."""
    r = view(spark, sf_dir, "restriction").select("restriction_id", F.col("cx").alias("x"), F.col("cy").alias("y"))
    near = nearest_of_all(r, view(spark, sf_dir, "chamber"), 50.0, "restriction_id", "chamber_id").select("restriction_id", F.round("d2", 6).alias("d2"))
    return near.orderBy("d2", "restriction_id").limit(2400)


def refinement_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each group, variants without penalty by score, then those with one."""
    v = variant_summary(spark, sf_dir)
    return v.select("group_id", "variant_key", F.row_number().over(Window.partitionBy("group_id").orderBy(F.col("penalty") > 0, "score", "variant_key")).alias("turn"))


def merged_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partial plans in one: the second's own ids that the first has too get a prefix, ids of the input stay."""
    part = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("plan"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("own"), F.col("l_suppkey").cast("string").alias("input_id"))
    a = part.filter("plan % 2 = 0").select((F.col("plan") / 2).cast("bigint").alias("pair"), "own", "input_id").distinct()
    b = part.filter("plan % 2 = 1").select(((F.col("plan") - 1) / 2).cast("bigint").alias("pair"), "own", "input_id").distinct()
    known = a.select("pair", "own").distinct().withColumn("taken", F.lit(True))
    renamed = b.join(known, ["pair", "own"], "left").select("pair", F.when(F.col("taken"), F.concat(F.lit("p2_"), F.col("own"))).otherwise(F.col("own")).alias("own"), "input_id")
    return a.unionByName(renamed).groupBy("pair", "own").agg(F.countDistinct("input_id").alias("n_inputs"), F.min("input_id").alias("first_input"))


def variant_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer's two first variants, what each connects that the other does not."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v"), "o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("r")).filter("r <= 2")
    sets = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("v")).agg(F.collect_set("l_suppkey").alias("s"))
    both = o.join(sets, "v").groupBy("o_custkey").agg(F.max(F.when(F.col("r") == 1, F.col("s"))).alias("a"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("b")).filter("a is not null and b is not null")
    text = lambda x: F.concat_ws("+", F.transform(F.sort_array(x), lambda i: i.cast("string")))
    return both.select("o_custkey", text(F.array_except("a", "b")).alias("only_first"), text(F.array_except("b", "a")).alias("only_second"))


def variant_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs among each group's three best variants: told apart by what they connect, or by over 30 m of length."""
    v = variant_summary(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy("score", "variant_key"))).filter("r <= 3")
    sets = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("variant_key")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("s"))
    v = v.join(sets, "variant_key", "left").select("group_id", "r", "variant_key", F.col("length_m").cast("double").alias("m"), F.coalesce("s", F.array().cast("array<bigint>")).alias("s"))
    a, b = (v.select("group_id", *(F.col(c).alias(f"{c}_{k}") for c in ("r", "variant_key", "m", "s"))) for k in "ab")
    pairs = a.join(b, "group_id").filter("r_a < r_b")
    return pairs.select("group_id", F.col("variant_key_a").alias("a"), F.col("variant_key_b").alias("b"), ((F.col("s_a") != F.col("s_b")) | (F.abs(F.col("m_a") - F.col("m_b")) > 30)).alias("distinct_plans"))


def export_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants in the order in which they are first seen, with the features of each part."""
    s = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("variant_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    first = s.groupBy("variant_id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_features"))
    ranked = rank_in_blocks(first.withColumn("all", F.lit(0)), "all", F.floor(F.col("first_pos") / 100_000), ["first_pos", "variant_id"])
    return ranked.select("variant_id", F.col("rank").cast("int").alias("part"), "n_features")


def export_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as the export writes them: input objects keep theirs, numbers as numbers; new objects get their variant's prefix."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    new, number = F.col("o_orderstatus") == "P", F.col("o_orderkey") % 3 != 0
    text = F.when(new, F.concat(F.lit("v"), F.col("o_custkey").cast("string"), F.lit("_n"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", F.when(~new & number, F.concat(F.lit('{"id":'), text, F.lit("}"))).otherwise(F.to_json(F.struct(text.alias("id")))).alias("json"))


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each new pipe the sentence that explains its cost."""
    s = view(spark, sf_dir, "new_segment").select("variant_key", "l_linenumber", "l_suppkey", "l_partkey", "length_m", "dn", "k_spec", segment_cost(F.col("length_m"), F.col("dn"), F.col("k_spec")).alias("cost"))
    return s.select("variant_key", "l_linenumber", "l_suppkey", "l_partkey", F.format_string("DN%d, %d m x %d x K %s = %d", "dn", F.col("length_m").cast("int"), by_dn(F.col("dn"), 3), F.col("k_spec").cast("string"), "cost").alias("why"))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth profiles: for each order a vertex for each quantity, with a depth between 2 and 4 m."""
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_quantity").cast("double").alias("m")).agg((F.min(F.col("l_suppkey") % 41) * 0.05 + 2).alias("depth"))


def depth_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles with a vertex put in wherever the depth passes 3 m between two others."""
    here = Window.partitionBy("l_orderkey").orderBy("m")
    p = _profile(spark, sf_dir).select("l_orderkey", "m", F.round("depth", 6).alias("depth"), F.lead("m").over(here).alias("m2"), F.lead(F.round("depth", 6)).over(here).alias("d2"))
    passes = ((F.col("depth") < NORMAL_DEPTH) & (F.col("d2") > NORMAL_DEPTH)) | ((F.col("depth") > NORMAL_DEPTH) & (F.col("d2") < NORMAL_DEPTH))
    mid = F.col("m") + (F.col("m2") - F.col("m")) * ((NORMAL_DEPTH - F.col("depth")) / (F.col("d2") - F.col("depth")))
    own = F.struct(F.col("m").alias("m"), F.col("depth").alias("depth"), F.lit(False).alias("put_in"))
    new = F.struct(F.round(mid, 6).alias("m"), F.lit(NORMAL_DEPTH).alias("depth"), F.lit(True).alias("put_in"))
    return p.select("l_orderkey", F.explode(F.when(passes, F.array(own, new)).otherwise(F.array(own))).alias("v")).select("l_orderkey", "v.*")


def depth_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's route cut at the vertices of its profile and priced again: the mean coefficient of a piece's ends, none of which crosses 3 m."""
    here = Window.partitionBy("l_orderkey").orderBy("m", "put_in")
    k = lambda c: 1 + 0.1 * F.greatest(F.col(c) - NORMAL_DEPTH, F.lit(0.0))
    p = depth_splits(spark, sf_dir).withColumn("m2", F.lead("m").over(here)).withColumn("e2", F.lead("depth").over(here)).filter("m2 is not null")
    piece = p.select("l_orderkey", F.round(F.col("m2") - F.col("m"), 3).alias("length_m"), F.round((k("depth") + k("e2")) / 2, 4).alias("k"))
    cost = roubles(F.col("length_m").cast("decimal(12,3)") * F.lit(120275).cast("decimal(10,0)") * F.col("k").cast("decimal(6,4)"))
    return piece.groupBy("l_orderkey").agg(F.count("*").alias("n_pieces"), F.sum(cost).alias("cost"))


def depth_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths above (rounded down to steps of 5 cm, but not below 0.7 m) and below (rounded up) an obstacle, with their coefficients."""
    u = view(spark, sf_dir, "restriction").select("restriction_id", F.round(F.col("half_w") / 3 + 0.313, 6).alias("h"))
    down = F.floor((F.col("h") + 1e-9) / STEP_M) * STEP_M
    above = F.when(down < 0.7, F.ceil((0.7 - 1e-9) / F.lit(STEP_M)) * STEP_M).otherwise(down)
    below = F.ceil((F.col("h") - 1e-9) / STEP_M) * STEP_M
    k = lambda h: F.round(1 + 0.1 * F.greatest(h - NORMAL_DEPTH, F.lit(0.0)), 6)
    return u.select("restriction_id", F.round(above, 6).alias("above"), F.round(below, 6).alias("below"), k(above).alias("k_above"), k(below).alias("k_below"))


def reserved_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts whose target no other waiting point needs as its only way."""
    c = tie_in_choices(spark, sf_dir)
    only = c.groupBy("oks_id").agg(F.count("*").alias("n"), F.min(F.struct("kind", "target_id")).alias("t")).filter("n = 1").select(F.col("oks_id").alias("holder"), "t.kind", "t.target_id")
    return c.join(only, (c.kind == only.kind) & (c.target_id == only.target_id) & (c.oks_id != F.col("holder")), "left_anti").select("oks_id", "kind", "target_id")


def strategy_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chambers each point can use by mode: all in reach (joint), those of its own group (clustered), and with 25 m more (separate)."""
    group = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("oks_id"), (F.col("c_nationkey") % 5).alias("g"))
    pairs = within(view(spark, sf_dir, "oks"), view(spark, sf_dir, "chamber"), 75.0, "oks_id", "chamber_id").join(group, "oks_id")
    near = F.round("d2", 6) <= 2500
    return pairs.groupBy("oks_id").agg(F.count_if(near).alias("joint"), F.count_if(near & (F.col("chamber_id") % 5 == F.col("g"))).alias("clustered"), F.count("*").alias("separate"))


def spaced_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors on each order's route at least 22 m apart, from its first cut on."""
    at = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set((F.col("l_partkey") % 200).cast("double"))).alias("cuts"))
    return at.select("l_orderkey", F.explode(spaced(F.col("cuts"), 22.0)).alias("at_m"))


_T = f"with recursive {sql_views('tree')}"
_G = f"""{_T}, root as (select min(node_id) as node from tree),
  e as (select node_id as u, parent_id as v from tree where parent_id in (select node_id from tree) union all select node_id, node_id // 2 from tree where node_id % 7 = 0 and node_id // 2 in (select node_id from tree) and node_id <> node_id // 2),
  kept as (select * from e where {{keep}}), both_ways as (select u, v from kept union select v, u from kept),
  reach(node, depth) using key (node) as (select node, 0 from root union select v, min(depth) + 1 from reach join both_ways on u = node where v not in (select node from recurring.reach) group by v)"""
_LIVE = _CLOSURE + f", live as materialized (select t.* from tree t where node_id in (select anc from up join tree on node_id = leaf where own_flow >= {DEMAND}))"
_CHOICES = f"""{_P}, {_DEGREE}, free as (select chamber_id, x, y from chamber join degree using (chamber_id) where degree < 4), {_NEAR},
  spot as (select n.oks_id, n.line_id, n.d, ax + (bx - ax) * t as px, ay + (b_y - ay) * t as py from near n join (select *, row_number() over (partition by oks_id, line_id order by round(d2, 9), seq) as r from far where d2 <= 100) f on f.oks_id = n.oks_id and f.line_id = n.line_id and r = 1),
  moved as (select * from (select s.*, c.chamber_id, c.x as cx, c.y as cy, row_number() over (partition by oks_id, line_id order by round((px - c.x) * (px - c.x) + (py - c.y) * (py - c.y), 6), chamber_id) as r from spot s left join free c on (px - c.x) * (px - c.x) + (py - c.y) * (py - c.y) <= 10.01::double * 10.01) where r = 1),
  every as (select oks_id, 'chamber' as kind, chamber_id as target_id, round(sqrt({_D2}), 6) as d from oks o join free c on {_D2} <= 100
    union all select m.oks_id, case when chamber_id is null then 'pipe' else 'chamber' end, coalesce(chamber_id, line_id), round(case when chamber_id is null then d else sqrt((cx - o.x) * (cx - o.x) + (cy - o.y) * (cy - o.y)) end, 6) from moved m join oks o on o.oks_id = m.oks_id),
  best as (select oks_id, kind, target_id, min(d) as d from every group by 1, 2, 3),
  choice as materialized (select *, row_number() over (partition by oks_id order by d, kind = 'pipe', case kind when 'chamber' then 5000000 else 3000000 end, target_id)::int as place from best)"""
_PROFILE = """prof as (select l_orderkey, l_quantity::double as m, round(min(l_suppkey % 41) * 0.05::double + 2, 6) as depth from lineitem group by 1, 2),
  ahead as (select *, lead(m) over w as m2, lead(depth) over w as d2 from prof window w as (partition by l_orderkey order by m)),
  cuts as (select l_orderkey, m, depth, false as put_in from ahead union all select l_orderkey, round(m + (m2 - m) * ((3 - depth) / (d2 - depth)), 6), 3.0::double, true from ahead where (depth < 3 and d2 > 3) or (depth > 3 and d2 < 3))"""
_SCORES = f"""with {sql_views('new_segment')}, items as (select variant_key, sum(cast(round(length_m * ({sql_case('dn', 3)}) * k_spec, 0) as bigint))::bigint as segments, sum(case when dn <= 200 then 3000000 when dn <= 500 then 5000000 when dn <= 1000 then 8000000 else 12000000 end)::bigint as chambers,
  count(*) filter (where l_returnflag = 'R') as tie_ins, cast(sum(length_m) as decimal(18,3)) as length_m from new_segment group by 1),
v as (select o_orderkey as variant_key, o_custkey as group_id, (coalesce(segments, 0) + coalesce(chambers, 0) + coalesce(tie_ins, 0) * 5000000)::bigint as construction,
  case when segments is null then 100000000 + 500000 * (1 + o_custkey % 40) else 0 end::bigint as penalty, coalesce(length_m, 0)::decimal(18,3) as length_m from orders left join items on variant_key = o_orderkey),
s as (select *, cast(round(cast(0.7::double * (construction + penalty)::double / 25e6::double + 0.3::double * length_m::double / 100.0::double as decimal(24,10)), 4) as decimal(18,4)) as score from v)"""

QUERIES = {
    "parent_by_depth": (parent_by_depth, _G.format(keep="true") + " select r.node as node_id, r.depth, min(b.v) as parent_id from reach r join both_ways b on b.u = r.node join reach q on q.node = b.v and q.depth + 1 = r.depth group by 1, 2"),
    "unreachable_nodes": (unreachable_nodes, _G.format(keep="u % 11 <> 5 and v % 11 <> 5") + " select node_id, case when node_id in (select u from both_ways) then 'unreachable' else 'isolated' end as problem from tree where node_id not in (select node from reach)"),
    "upstream_mode": (upstream_mode, f"with {sql_views('tree')}, e as (select *, case when node_id % 7 = 3 then parent_id end as explicit from tree), a as (select bool_or(explicit is not null) as r from e) select node_id, case when r then explicit else parent_id end as upstream_id, case when r then 'explicit' else 'inferred' end as mode from e, a"),
    "pipe_orientation": (pipe_orientation, f"""with {sql_views('tree')}, vertex as (select c_custkey as line_id, k as seq, cast((c_custkey * 7919) % 100003 as double) / 100 + 12 * k + (c_custkey * 31 + k * 17) % 13 as x, cast((c_custkey * 104729) % 99991 as double) / 100 + (c_custkey * 53 + k * 29) % 41 - 20 as y from customer, (values (0), (3)) v(k)),
  d as (select t.node_id, seq, (v.x - u.x) * (v.x - u.x) + (v.y - u.y) * (v.y - u.y) as d2 from tree t join tree u on u.node_id = t.parent_id join vertex v on v.line_id = t.node_id) select node_id, min(d2) filter (where seq = 3) < min(d2) filter (where seq = 0) as reversed from d group by 1"""),
    "live_nodes": (live_nodes, _LIVE + " select node_id, parent_id from live"),
    "merged_chains": (merged_chains, _LIVE + f""", n as (select l.node_id, l.parent_id, l.length_m, own_flow < {DEMAND} and (select count(*) from live c where c.parent_id = l.node_id) = 1 as through from live l),
  w as (select node_id, node_id as top_id, parent_id as nxt, 1 as n_pipes, length_m from n where not through union all select w.node_id, n.node_id, n.parent_id, n_pipes + 1, cast(w.length_m + n.length_m as decimal(18,3)) from w join n on n.node_id = w.nxt and n.through)
  select node_id, arg_max(top_id, n_pipes) as top_id, max(n_pipes)::bigint as n_pipes, max(length_m)::double as length_m from w group by 1"""),
    "chamber_required_dn": (chamber_required_dn, _DN + ", e as (select node_id, dn from sized union all select parent_id, dn from sized join tree using (node_id) where parent_id is not null) select node_id, max(dn) as dn, count(*) as n_pipes from e group by 1"),
    "chamber_reconstruction": (chamber_reconstruction, _DN + f""", {sql_views('chamber', 'new_segment')}, {_ADDED}, aft as (select s.node_id, s.dn, case when added is null then s.dn else {sql_min_dn('(s.flow + added)')} end as after from sized s left join added a on a.node_id = s.node_id),
  e as (select node_id as chamber_id, dn, after from aft union all select parent_id, dn, after from aft join tree using (node_id) where parent_id is not null), b as (select chamber_id, max(dn) as beside, max(after) as after, count(*) as n from e group by 1),
  nw as (select l_suppkey as chamber_id, max(dn) as new_dn, count(distinct variant_key) as n_new from new_segment group by 1), c as (select chamber_id, case when chamber_id % 3 > 0 then 100 * (chamber_id % 4 + 1) end as record from chamber)
  select chamber_id, coalesce(record, beside)::int as original_dn, greatest(coalesce(record, beside), new_dn, after)::int as required_dn, record is null as dn_missing, n + n_new > 4 as over_limit from c join nw using (chamber_id) join b using (chamber_id)"""),
    "affected_pipes": (affected_pipes, _CLOSURE + ", " + _ADDED + " select coalesce(a.node_id, t.node_id) as node_id, a.node_id is not null as passed, t.node_id is not null as tied from (select * from added where added > 0) a full join tied t on t.node_id = a.node_id"),
    "group_centroids": (group_centroids, f"with {sql_views('oks')} select c_nationkey as area, round(avg(x), 4) as x, round(avg(y), 4) as y, count(*) as n from oks join customer on c_custkey = oks_id group by 1"),
    "plan_extent": (plan_extent, f"with {sql_views('new_segment')} select variant_key, max(dn) as max_dn, count(distinct case when l_returnflag <> 'N' then l_suppkey end) as n_connected from new_segment group by 1"),
    "sizing_summary": (sizing_summary, _DN + f""", {_ADDED}, s as (select z.node_id, z.dn, length_m, k_spec, {sql_min_dn('(z.flow + coalesce(added, 0))')} as after from sized z join tree using (node_id) left join added a on a.node_id = z.node_id)
  select dn, count(*) as n, sum(length_m)::double as length_m, sum(cast(round(length_m * ({sql_case('dn', 3)}) * k_spec, 0) as bigint))::bigint as cost, sum(case when after > dn then cast(round(length_m * ({sql_case('after', 4)}), 0) as bigint) else 0 end)::bigint as reconstruction from s group by 1"""),
    "tie_in_choices": (tie_in_choices, _CHOICES + " select oks_id, kind, target_id, d, place from choice"),
    "second_choice": (second_choice, _CHOICES + " select oks_id, arg_min(kind, place) as kind, arg_min(target_id, place) as target_id from choice c where not exists (select 1 from choice f where f.place = 1 and f.oks_id = c.oks_id and f.kind = c.kind and f.target_id = c.target_id) group by 1"),
    "varied_attempts": (varied_attempts, None),
    "focus_corners": (focus_corners, f"{_P} select restriction_id, min(round((cx - x) * (cx - x) + (cy - y) * (cy - y), 6)) as d2 from restriction, chamber group by 1 order by 2, 1 limit 2400"),
    "refinement_order": (refinement_order, _SCORES + " select group_id, variant_key, row_number() over (partition by group_id order by penalty > 0, score, variant_key)::int as turn from s"),
    "merged_plans": (merged_plans, "with p as (select distinct l_orderkey // 2 as pair, l_orderkey % 2 as side, 'n' || l_linenumber::varchar as own, l_suppkey::varchar as i from lineitem), r as (select pair, case when side = 1 and exists (select 1 from p a where a.pair = p.pair and a.side = 0 and a.own = p.own) then 'p2_' || own else own end as own, i from p) select pair, own, count(distinct i) as n_inputs, min(i) as first_input from r group by 1, 2"),
    "variant_differences": (variant_differences, "with o as (select o_orderkey as v, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as r from orders), s as (select l_orderkey as v, list(distinct l_suppkey) as s from lineitem group by 1), b as (select o_custkey, max(s) filter (where r = 1) as a, max(s) filter (where r = 2) as b from o join s using (v) where r <= 2 group by 1) select o_custkey, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), '+') as only_first, array_to_string(list_sort(list_filter(b, lambda x: not list_contains(a, x))), '+') as only_second from b where a is not null and b is not null"),
    "variant_pairs": (variant_pairs, _SCORES + ", t as (select group_id, variant_key, length_m::double as m, row_number() over (partition by group_id order by score, variant_key) as r from s), c as (select l_orderkey as variant_key, list_sort(list(distinct l_suppkey)) as x from lineitem group by 1), w as (select t.*, coalesce(x, []) as x from t left join c using (variant_key) where r <= 3) select p.group_id, p.variant_key as a, q.variant_key as b, p.x <> q.x or abs(p.m - q.m) > 30 as distinct_plans from w p join w q on p.group_id = q.group_id and p.r < q.r"),
    "export_parts": (export_parts, "with f as (select l_suppkey as variant_id, min(l_orderkey * 10 + l_linenumber) as p, count(*) as n_features from lineitem group by 1) select variant_id, rank() over (order by p, variant_id)::int as part, n_features from f"),
    "export_ids": (export_ids, """select o_orderkey, case when o_orderstatus = 'P' then '{"id":"v' || o_custkey || '_n' || o_orderkey || '"}' when o_orderkey % 3 <> 0 then '{"id":' || o_orderkey || '}' else '{"id":"' || o_orderkey || '"}' end as json from orders"""),
    "explanations": (explanations, f"with {sql_views('new_segment')} select variant_key, l_linenumber, l_suppkey, l_partkey, 'DN' || dn || ', ' || length_m::int || ' m x ' || ({sql_case('dn', 3)}) || ' x K ' || k_spec::varchar || ' = ' || cast(round(length_m * ({sql_case('dn', 3)}) * k_spec, 0) as bigint) as why from new_segment"),
    "depth_splits": (depth_splits, f"with {_PROFILE} select l_orderkey, m, depth, put_in from cuts"),
    "depth_costs": (depth_costs, f"""with {_PROFILE}, n as (select l_orderkey, m, depth, lead(m) over w as m2, lead(depth) over w as e2 from cuts window w as (partition by l_orderkey order by m, put_in)),
  p as (select l_orderkey, round(m2 - m, 3) as len, round((1 + 0.1::double * greatest(depth - 3, 0.0) + 1 + 0.1::double * greatest(e2 - 3, 0.0)) / 2, 4) as k from n where m2 is not null) select l_orderkey, count(*) as n_pieces, sum(cast(round(len::decimal(12,3) * 120275 * k::decimal(6,4), 0) as bigint))::bigint as cost from p group by 1"""),
    "depth_steps": (depth_steps, f"{_P}, u as (select restriction_id, round(half_w / 3 + 0.313::double, 6) as h from restriction), q as (select restriction_id, case when floor((h + 1e-9) / 0.05::double) * 0.05::double < 0.7 then ceil((0.7::double - 1e-9) / 0.05::double) * 0.05::double else floor((h + 1e-9) / 0.05::double) * 0.05::double end as a, ceil((h - 1e-9) / 0.05::double) * 0.05::double as b from u) select restriction_id, round(a, 6) as above, round(b, 6) as below, round(1 + 0.1::double * greatest(a - 3, 0.0), 6) as k_above, round(1 + 0.1::double * greatest(b - 3, 0.0), 6) as k_below from q"),
    "reserved_attempts": (reserved_attempts, _CHOICES + ", only_way as (select oks_id as holder, min(kind) as kind, min(target_id) as target_id from choice group by 1 having count(*) = 1) select oks_id, kind, target_id from choice c where not exists (select 1 from only_way w where w.kind = c.kind and w.target_id = c.target_id and w.holder <> c.oks_id)"),
    "strategy_reach": (strategy_reach, f"{_P}, p as (select oks_id, chamber_id, round({_D2}, 6) as d2, c_nationkey % 5 as g from oks o join chamber c on {_D2} <= 5625 join customer on c_custkey = oks_id) select oks_id, count(*) filter (where d2 <= 2500) as joint, count(*) filter (where d2 <= 2500 and chamber_id % 5 = g) as clustered, count(*) as separate from p group by 1"),
    "spaced_stops": (spaced_stops, "with recursive c as (select distinct l_orderkey, (l_partkey % 200)::double as m from lineitem), k as (select l_orderkey, min(m) as at_m from c group by 1 union all select l_orderkey, (select min(m) from c where c.l_orderkey = k.l_orderkey and m >= k.at_m + 22) from k where exists (select 1 from c where c.l_orderkey = k.l_orderkey and m >= k.at_m + 22)) select l_orderkey, at_m from k"),
}
