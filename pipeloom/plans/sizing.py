"""Sizing and costing queries: flows, diameters, runs, reconstruction, costs, variants and their ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipeloom.functions.reference import BUILDING_OFFSETS, CHAMBER_BANDS, TIE_IN_COST, band, by_dn, min_dn, penalty, raw_score, roubles, segment_cost, sql_band, sql_case, sql_min_dn
from pipeloom.operators.tree import roll_up, walk_up
from pipeloom.shared import load, staged
from pipeloom.sources.views import sql_views, view


def min_dn_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "oks").select("oks_id", "flow_tph", min_dn(F.col("flow_tph")).alias("dn"))


def chamber_band_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "new_segment").groupBy("dn").agg(F.count("*").alias("n"))
    return s.select("dn", "n", band(F.col("dn"), CHAMBER_BANDS).cast("bigint").alias("chamber_cost"), band(F.col("dn"), BUILDING_OFFSETS).alias("offset_m"))


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(view(spark, sf_dir, "tree"), "own_flow", "flow")


def tree_flow_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows(spark, sf_dir)


def tree_dn_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest dn in each subtree equals the dn of its flow, since flows grow towards the root."""
    own = flows(spark, sf_dir).select("node_id", min_dn(F.col("flow")).alias("own_dn"))
    joined = view(spark, sf_dir, "tree").select("node_id", "parent_id").join(own, "node_id")
    return own.join(roll_up(joined, "own_dn", "dn", "int", F.max), "node_id")


def tree_leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = view(spark, sf_dir, "tree")
    leaves = tree.select(F.col("node_id").alias("leaf_id")).join(tree.select(F.col("parent_id").alias("leaf_id")).distinct(), "leaf_id", "left_anti")
    length = walk_up(tree, F.col("length_m"), "path_m", "decimal(18,3)").select("node_id", "path_m")
    steps = walk_up(tree, F.lit(1), "depth", "bigint").select("node_id", "depth")
    return leaves.join(length.join(steps, "node_id").withColumnRenamed("node_id", "leaf_id"), "leaf_id").select("leaf_id", "depth", "path_m")


def dn_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of one dn on the way from the root: for each node where a run ends, its length against the limit."""
    tree = view(spark, sf_dir, "tree").select("node_id", "parent_id", "length_m").join(flows(spark, sf_dir).select("node_id", min_dn(F.col("flow")).alias("dn")), "node_id")
    tree = staged(tree.join(tree.select(F.col("node_id").alias("parent_id"), F.col("dn").alias("up_dn")), "parent_id", "left"), "runs")
    run = walk_up(tree, F.col("length_m"), "run_m", "decimal(18,3)", stop=F.col("up_dn").isNull() | (F.col("up_dn") != F.col("dn")))
    goes_on = tree.filter("up_dn = dn").select(F.col("parent_id").alias("node_id")).distinct()
    ends = tree.select("node_id", "dn").join(goes_on, "node_id", "left_anti").join(run, "node_id")
    return ends.select("node_id", F.col("head").alias("run_head"), "dn", "run_m", (F.col("run_m") > by_dn(F.col("dn"), 2) + F.lit("0.01").cast("decimal(4,2)")).alias("too_long"))


def _tie_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node_id")).agg(F.sum((F.col("o_orderkey") % 5 + 1).cast("decimal(18,2)")).cast("decimal(18,2)").alias("tied"))


def upstream_added_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = view(spark, sf_dir, "tree").select("node_id", "parent_id").join(_tie_ins(spark, sf_dir), "node_id", "left")
    return roll_up(tree.withColumn("tied", F.coalesce("tied", F.lit(0).cast("decimal(18,2)"))), "tied", "added").filter("added > 0")


def suffix_tie_in_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("at_m")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(18,2)").alias("tied"))
    beyond = Window.partitionBy("l_orderkey").orderBy(F.desc("at_m"))
    return at.select("l_orderkey", "at_m", F.sum("tied").over(beyond).cast("decimal(18,2)").alias("flow"))


def reconstruction_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes whose flow with what is tied in needs more than the dn that they have."""
    tree = view(spark, sf_dir, "tree").select("node_id", "length_m").join(flows(spark, sf_dir), "node_id").join(upstream_added_flow(spark, sf_dir), "node_id")
    before, after = min_dn(F.col("flow")), min_dn(F.col("flow") + F.col("added"))
    parts = tree.select("node_id", "length_m", before.alias("dn_before"), after.alias("dn_after")).filter("dn_after > dn_before")
    return parts.select("*", roubles(F.col("length_m").cast("decimal(12,3)") * by_dn(F.col("dn_after"), 4).cast("decimal(10,0)")).alias("cost"))


def segment_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "new_segment")
    return s.select("variant_key", "l_linenumber", "l_suppkey", "length_m", "dn", segment_cost(F.col("length_m"), F.col("dn"), F.col("k_spec")).alias("cost"))


def penalty_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "oks").select("oks_id", penalty(F.col("flow_tph")).alias("penalty"))


def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each variant: segments, a chamber for each, tie-ins of status F, penalty for orders without segments."""
    seg = view(spark, sf_dir, "new_segment")
    items = seg.groupBy("variant_key").agg(
        F.sum(segment_cost(F.col("length_m"), F.col("dn"), F.col("k_spec"))).alias("segments"), F.sum(band(F.col("dn"), CHAMBER_BANDS)).cast("bigint").alias("chambers"),
        F.count_if(F.col("l_returnflag") == "R").alias("tie_ins"), F.sum("length_m").cast("decimal(18,3)").alias("length_m"), F.count("*").alias("n"),
    )
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("variant_key"), F.col("o_custkey").alias("group_id"))
    nothing = F.lit(0).cast("bigint")
    v = orders.join(items, "variant_key", "left").select(
        "variant_key", "group_id", (F.coalesce("segments", nothing) + F.coalesce("chambers", nothing) + F.coalesce("tie_ins", nothing) * TIE_IN_COST).alias("construction"),
        F.when(F.col("n").isNull(), penalty(F.lit(1) + F.col("group_id") % 40)).otherwise(nothing).alias("penalty"), F.coalesce("length_m", F.lit(0).cast("decimal(18,3)")).alias("length_m"),
    )
    raw = raw_score(F.col("construction") + F.col("penalty"), F.col("length_m"))
    return v.select("*", F.round(raw.cast("decimal(24,10)"), 4).cast("decimal(18,4)").alias("score"))


def variant_rank_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best variants of each group by raw score, then cost, length and id."""
    v = variant_summary(spark, sf_dir)
    raw = raw_score(F.col("construction") + F.col("penalty"), F.col("length_m"))
    order = Window.partitionBy("group_id").orderBy(raw, F.col("construction") + F.col("penalty"), "length_m", "variant_key")
    return v.select("*", F.row_number().over(order).alias("rank")).filter("rank <= 3")


_CLOSURE = f"""with recursive {sql_views('tree')}, up as (select node_id as leaf, node_id as anc, 0 as d from tree union all
  select up.leaf, t.parent_id, up.d + 1 from up join tree t on t.node_id = up.anc where t.parent_id is not null)"""
_FLOW = _CLOSURE + ", flow as (select up.anc as node_id, cast(sum(t.own_flow) as decimal(18,2)) as flow from up join tree t on t.node_id = up.leaf group by up.anc)"
_DN = _FLOW + f", sized as (select f.node_id, f.flow, {sql_min_dn('f.flow')} as dn from flow f)"
_ADDED = "tied as (select o_custkey as node_id, cast(sum(o_orderkey % 5 + 1) as decimal(18,2)) as tied from orders group by 1), added as (select up.anc as node_id, cast(sum(tied) as decimal(18,2)) as added from up join tied on tied.node_id = up.leaf group by 1)"
_COST = f"cast(round(length_m * ({sql_case('dn', 3)}) * k_spec, 0) as bigint)"
_VARIANT = f"""with {sql_views('new_segment')}, items as (select variant_key, sum({_COST})::bigint as segments, sum({sql_band('dn', CHAMBER_BANDS)})::bigint as chambers,
  count(*) filter (where l_returnflag = 'R') as tie_ins, cast(sum(length_m) as decimal(18,3)) as length_m from new_segment group by 1),
v as (select o_orderkey as variant_key, o_custkey as group_id, (coalesce(segments, 0) + coalesce(chambers, 0) + coalesce(tie_ins, 0) * {TIE_IN_COST})::bigint as construction,
  case when segments is null then 100000000 + 500000 * (1 + o_custkey % 40) else 0 end::bigint as penalty, coalesce(length_m, 0)::decimal(18,3) as length_m
  from orders left join items on variant_key = o_orderkey),
s as (select *, 0.7::double * (construction + penalty)::double / 25e6::double + 0.3::double * length_m::double / 100.0::double as raw from v)"""
_SCORED = "variant_key, group_id, construction, penalty, length_m, cast(round(cast(raw as decimal(24,10)), 4) as decimal(18,4)) as score"

QUERIES = {
    "min_dn_asof": (min_dn_asof, f"with {sql_views('oks')} select oks_id, flow_tph, {sql_min_dn('flow_tph')} as dn from oks"),
    "chamber_band_cost": (chamber_band_cost, f"with {sql_views('new_segment')} select dn, count(*) as n, ({sql_band('dn', CHAMBER_BANDS)})::bigint as chamber_cost, ({sql_band('dn', BUILDING_OFFSETS)})::double as offset_m from new_segment group by dn"),
    "tree_flow_rollup": (tree_flow_rollup, _FLOW + " select node_id, flow from flow"),
    "tree_dn_monotone": (tree_dn_monotone, _DN + " select s.node_id, s.dn as own_dn, m.dn from sized s join (select up.anc as node_id, max(z.dn) as dn from up join sized z on z.node_id = up.leaf group by 1) m on m.node_id = s.node_id"),
    "tree_leaf_paths": (tree_leaf_paths, _CLOSURE + " select leaf as leaf_id, count(*) as depth, cast(sum(length_m) as decimal(18,3)) as path_m from up join tree on node_id = anc where leaf not in (select parent_id from tree where parent_id is not null) group by leaf"),
    "dn_runs": (dn_runs, _DN + f""", t as (select tree.node_id, parent_id, length_m, dn from tree join sized using (node_id)),
  r as (select node_id as tip, node_id as head, parent_id as up, dn, length_m as run_m from t union all
        select r.tip, t.node_id, t.parent_id, r.dn, r.run_m + t.length_m from r join t on t.node_id = r.up and t.dn = r.dn),
  whole as (select tip, dn, arg_max(head, run_m) as run_head, max(run_m) as run_m from r group by tip, dn)
  select tip as node_id, run_head, dn, cast(run_m as decimal(18,3)) as run_m, run_m > ({sql_case('dn', 2)}) + 0.01 as too_long from whole
  where not exists (select 1 from t where t.parent_id = whole.tip and t.dn = whole.dn)"""),
    "upstream_added_flow": (upstream_added_flow, _CLOSURE + ", " + _ADDED + " select node_id, added from added"),
    "suffix_tie_in_flow": (suffix_tie_in_flow, "select l_orderkey, l_linenumber as at_m, cast(sum(sum(l_quantity::decimal(18,2))) over (partition by l_orderkey order by l_linenumber desc) as decimal(18,2)) as flow from lineitem group by 1, 2"),
    "reconstruction_parts": (reconstruction_parts, _FLOW + ", " + _ADDED + f""", b as (select f.node_id, length_m, {sql_min_dn('f.flow')} as dn_before, {sql_min_dn('(f.flow + a.added)')} as dn_after from flow f join added a using (node_id) join tree using (node_id))
  select node_id, length_m, dn_before, dn_after, cast(round(length_m * ({sql_case('dn_after', 4)}), 0) as bigint) as cost from b where dn_after > dn_before"""),
    "segment_cost": (segment_costs, f"with {sql_views('new_segment')} select variant_key, l_linenumber, l_suppkey, length_m, dn, {_COST} as cost from new_segment"),
    "penalty_cost": (penalty_cost, f"with {sql_views('oks')} select oks_id, cast(round(100000000 + 500000 * flow_tph, 0) as bigint) as penalty from oks"),
    "variant_summary": (variant_summary, _VARIANT + f" select {_SCORED} from s"),
    "variant_rank_top3": (variant_rank_top3, _VARIANT + f" select {_SCORED}, rank::int as rank from (select *, row_number() over (partition by group_id order by raw, construction + penalty, length_m, variant_key) as rank from s) where rank <= 3"),
}
