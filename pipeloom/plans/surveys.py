"""Ingest, validation, comparison and depth queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipeloom.functions.reference import BUILDING_OFFSETS, GABARITS, RULES, UTILITIES, band
from pipeloom.operators.ranks import two_largest
from pipeloom.plans.network import routes
from pipeloom.shared import load
from pipeloom.sources.views import sql_views, view


def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of two kinds under one numbering: a later row of an id and kind is dropped, an id of another kind is renamed."""
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") % 500).alias("id"), F.lit("point").alias("kind"))
    b = load(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("pos"), F.col("s_suppkey").alias("id"), F.lit("chamber").alias("kind"))
    rows = a.unionByName(b)
    first = rows.groupBy("id", "kind").agg(F.min("pos").alias("pos"))
    lead = first.groupBy("id").agg(F.min_by("kind", "pos").alias("first_kind"))
    name = F.when(F.col("kind") == F.col("first_kind"), F.col("id").cast("string")).otherwise(F.concat_ws("#", F.col("id").cast("string"), "kind"))
    return first.join(lead, "id").select("pos", "kind", name.alias("name"))


def schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and lenient numbers written in dirty ways, normalised, with the problem of each row."""
    p = load(spark, sf_dir, "part")
    code = F.translate(F.lower(F.trim(F.concat(F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, "Heat-Network").when(F.col("p_partkey") % 3 == 1, "heat chamber").otherwise("OTHER"), F.lit(" ")))), "- ", "__")
    text = F.when(F.col("p_partkey") % 7 == 0, F.lit("n/a")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",5 ")))
    number = F.expr("try_cast(x as double)")
    out = p.select("p_partkey", code.alias("code"), F.replace(F.translate(text, "  ", ""), F.lit(","), F.lit(".")).alias("x")).withColumn("value", number)
    problem = F.when(~F.col("code").isin("heat_network", "heat_chamber"), "UNKNOWN_TYPE").when(F.col("value").isNull() & (F.col("code") == "heat_network"), "MISSING_DIAMETER").otherwise("OK")
    return out.select("p_partkey", "code", "value", problem.alias("problem"))


def report_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_validate(spark, sf_dir).groupBy("code").agg(F.count("*").alias("n"), F.count_if(F.col("problem") != "OK").alias("n_bad"))


def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar of the open properties of each event."""
    return load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.length("props").cast("bigint").alias("n"))


def restriction_zone_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half sizes of each restriction's zone for new pipes of dn 100, 600 and 1200: offset and half the pair's width added."""
    dns = F.explode(F.array(*(F.lit(d) for d in (100, 600, 1200)))).alias("dn")
    r = view(spark, sf_dir, "restriction").select("restriction_id", "rules_key", "half_w", "half_h", dns)
    fixed = F.lit(None).cast("double")
    for key, (_, offset, _) in RULES.items():
        if offset is not None:
            fixed = F.when(F.col("rules_key") == key, F.lit(offset)).otherwise(fixed)
    grow = F.coalesce(fixed, band(F.col("dn"), BUILDING_OFFSETS)) + F.when(F.col("dn") == 100, GABARITS[100][1]).when(F.col("dn") == 600, GABARITS[600][1]).otherwise(GABARITS[1200][1]) / 2
    return r.select("restriction_id", "dn", F.round(F.col("half_w") + grow, 6).alias("half_w"), F.round(F.col("half_h") + grow, 6).alias("half_h"))


def depth_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of a dn 200 pipe at each utility: above or below, by depth coefficient, then nearness to 3 m, then above."""
    u = view(spark, sf_dir, "restriction").filter("rules_key in ('gas_pipeline', 'power_cable', 'heat_network')")
    pick = lambda i: F.when(F.col("rules_key") == "gas_pipeline", UTILITIES["gas_pipeline"][i]).when(F.col("rules_key") == "power_cable", UTILITIES["power_cable"][i]).otherwise(GABARITS[100][0] if i == 1 else UTILITIES["heat_network"][i])
    floor = F.when(F.col("restriction_id") % 4 == 0, 2.4).otherwise(0.7)
    above = pick(0) - pick(2) - F.lit(GABARITS[200][0])
    below = pick(0) + pick(1) + pick(2)
    cost = lambda h: F.round(1 + 0.1 * F.greatest(h - 3.0, F.lit(0.0)), 9)
    out = u.select("restriction_id", "rules_key", F.round(above, 6).alias("above"), F.round(below, 6).alias("below"), floor.alias("floor"))
    up_ok, down_ok = F.col("above") >= F.col("floor"), F.col("below") >= F.col("floor")
    near = F.round(F.abs(F.col("above") - 3), 6) <= F.round(F.abs(F.col("below") - 3), 6)
    go_up = up_ok & (~down_ok | (cost(F.col("above")) < cost(F.col("below"))) | ((cost(F.col("above")) == cost(F.col("below"))) & near))
    depth = F.when(go_up, F.col("above")).when(down_ok, F.col("below"))
    return out.select("restriction_id", "rules_key", depth.alias("depth"), cost(depth).alias("k_depth"))


def depth_ramps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plateaus of 4 m at utility crossings along each route, merged where the gap is shorter than both ramps."""
    depth = depth_choice(spark, sf_dir).filter("depth is not null").select("restriction_id", "depth")
    at = view(spark, sf_dir, "restriction").join(depth, "restriction_id").select(F.floor(F.col("restriction_id") / 40).cast("bigint").alias("route_id"), (F.col("restriction_id") % 997 * 3.0).alias("m"), "depth", "restriction_id")
    w = Window.partitionBy("route_id").orderBy("m", "restriction_id")
    need = lambda h: F.abs(h - 3.0) / 0.1
    gap = F.col("m") - F.lag("m").over(w) - 4.0
    joined = at.withColumn("fresh", F.when(F.lag("m").over(w).isNull() | (F.round(gap, 6) >= F.round(need(F.col("depth")) + need(F.lag("depth").over(w)), 6)), 1).otherwise(0))
    return joined.withColumn("plateau", F.sum("fresh").over(w)).groupBy("route_id", "plateau").agg((F.min("m") - 2.0).alias("start_m"), (F.max("m") + 2.0).alias("stop_m"), F.when(F.max("depth") <= 3.0, F.min("depth")).otherwise(F.max("depth")).alias("depth"))


def variant_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of one customer with equal sets of tie-ins: the first stands for the others."""
    sets = view(spark, sf_dir, "new_segment").groupBy("variant_key").agg(F.concat_ws("+", F.transform(F.sort_array(F.collect_set("l_suppkey")), lambda x: x.cast("string"))).alias("signature"))
    v = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("variant_key"), F.col("o_custkey").alias("group_id")).join(sets, "variant_key")
    return v.groupBy("group_id", "signature").agg(F.min("variant_key").alias("variant_key"), F.count("*").alias("n_equal"))


def drop_avoidable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants that leave out a supplier which another variant of the group connects go, unless none would stay."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("variant_key"), F.col("l_suppkey").alias("oks"), (F.col("l_returnflag") != "N").alias("joined"))
    v = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("variant_key"), F.col("o_custkey").alias("group_id"))
    state = lines.join(v, "variant_key").groupBy("group_id", "variant_key", "oks").agg(F.bool_or("joined").alias("joined"))
    anywhere = state.groupBy("group_id", "oks").agg(F.bool_or("joined").alias("can"))
    bad = state.filter("not joined").join(anywhere.filter("can"), ["group_id", "oks"]).select("variant_key").distinct().withColumn("bad", F.lit(True))
    marked = state.select("group_id", "variant_key").distinct().join(bad, "variant_key", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    all_bad = marked.groupBy("group_id").agg(F.bool_and("bad").alias("all_bad"))
    return marked.join(all_bad, "group_id").filter("all_bad or not bad").select("group_id", "variant_key")


def hausdorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrete Hausdorff distance between the order dates (as points in days and price) of each nation's two busiest customers."""
    o = load(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 1000).cast("double").alias("x"), (F.col("o_orderkey") * 37 % 991).cast("double").alias("y"))
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    busy = o.join(c, "o_custkey").groupBy("nation", "o_custkey").agg(F.count("*").alias("n"))
    two = two_largest(busy, "nation", "n", "o_custkey").withColumnRenamed("place", "r")
    pts = o.join(two, "o_custkey").select("nation", "r", "x", "y", F.monotonically_increasing_id().alias("p"))
    other = pts.select("nation", (3 - F.col("r")).alias("r"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    near = pts.join(other, ["nation", "r"]).groupBy("nation", "r", "x", "y").agg(F.min(d2).alias("d2"))
    return near.groupBy("nation").agg(F.round(F.sqrt(F.max("d2")), 6).alias("distance"))


def turn_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn in degrees at each inner node of the tree between the edge in and each edge out; over 90 is a problem."""
    t = view(spark, sf_dir, "tree").select("node_id", "parent_id", "x", "y")
    mid = t.select(F.col("node_id").alias("parent_id"), F.col("parent_id").alias("top"), F.col("x").alias("mx"), F.col("y").alias("my")).filter("top is not null")
    top = t.select(F.col("node_id").alias("top"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    e = t.join(mid, "parent_id").join(top, "top")
    ax, ay, bx, by = F.col("mx") - F.col("tx"), F.col("my") - F.col("ty"), F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    size = F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size))))
    return e.filter(size > 0).select("node_id", F.round(turn, 6).alias("turn_deg"), (turn > 90).alias("too_sharp"))


def geojson_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A GeoJSON feature for each route; numeric ids stay numbers."""
    r = routes(spark, sf_dir)
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array("ax", "ay"), F.array("bx", "by")).alias("coordinates"))
    props = F.struct(F.col("route_id").alias("id"), F.lit("heat_network").alias("object_type"))
    return r.select("route_id", F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), line.alias("geometry"))).alias("feature"))


_V = lambda *n: f"with {sql_views(*n)}"
_CODE = "replace(replace(lower(trim(case p_partkey % 3 when 0 then ' Heat-Network ' when 1 then ' heat chamber ' else ' OTHER ' end)), '-', '_'), ' ', '_')"
_CHECKED = f"""with c as (select p_partkey, {_CODE} as code, case when p_partkey % 7 = 0 then null else p_size + 0.5::double end as value from part),
  checked as (select p_partkey, code, value, case when code not in ('heat_network', 'heat_chamber') then 'UNKNOWN_TYPE' when value is null and code = 'heat_network' then 'MISSING_DIAMETER' else 'OK' end as problem from c)"""
_GROW = "case when rules_key = 'oks_existing' then case when dn <= 400 then 5.0 when dn <= 800 then 7.0 else 9.0 end when rules_key in ('road', 'tram_tracks') then 1.5 when rules_key in ('gas_pipeline', 'power_cable') then 2.0 else 1.0 end::double + case dn when 100 then 0.51 when 600 then 1.85 else 3.1 end::double / 2"
_DEPTH = f"""{_V('restriction')}, u as (select restriction_id, rules_key, case rules_key when 'gas_pipeline' then 2.8 when 'power_cable' then 2.7 else 3.0 end::double as top, case rules_key when 'gas_pipeline' then 0.4 when 'power_cable' then 0.2 else 0.18 end::double as high,
  case rules_key when 'gas_pipeline' then 0.2 else 0.5 end::double as clear, case when restriction_id % 4 = 0 then 2.4 else 0.7 end::double as floor from restriction where rules_key in ('gas_pipeline', 'power_cable', 'heat_network')),
  h as (select *, round(top - clear - 0.315::double, 6) as above, round(top + high + clear, 6) as below from u),
  k as (select *, round(1 + 0.1::double * greatest(above - 3, 0), 9) as ka, round(1 + 0.1::double * greatest(below - 3, 0), 9) as kb from h),
  chosen as (select restriction_id, rules_key, case when above >= floor and (below < floor or ka < kb or (ka = kb and round(abs(above - 3), 6) <= round(abs(below - 3), 6))) then above when below >= floor then below end as depth from k)"""

QUERIES = {
    "dup_ids": (dup_ids, "with r as (select c_custkey as pos, c_custkey % 500 as id, 'point' as kind from customer union all select s_suppkey + 1000000000, s_suppkey, 'chamber' from supplier), f as (select id, kind, min(pos) as pos from r group by 1, 2) select pos, kind, case when kind = first_value(kind) over (partition by id order by pos) then id::varchar else id::varchar || '#' || kind end as name from f"),
    "schema_validate": (schema_validate, _CHECKED + " select p_partkey, code, value, problem from checked"),
    "report_counts": (report_counts, _CHECKED + " select code, count(*) as n, count(*) filter (where problem <> 'OK') as n_bad from checked group by code"),
    "event_props_json": (event_props_json, "select event_id, json_extract_string(props, '$.k') as k, length(props)::bigint as n from events"),
    "restriction_zone_box": (restriction_zone_box, f"{_V('restriction')} select restriction_id, dn, round(half_w + {_GROW}, 6) as half_w, round(half_h + {_GROW}, 6) as half_h from restriction, (values (100), (600), (1200)) d(dn)"),
    "depth_choice": (depth_choice, _DEPTH + " select restriction_id, rules_key, depth, round(1 + 0.1::double * greatest(depth - 3, 0), 9) as k_depth from chosen"),
    "depth_ramps": (depth_ramps, _DEPTH + """, a as (select (restriction_id // 40)::bigint as route_id, restriction_id % 997 * 3.0::double as m, depth, restriction_id from chosen where depth is not null),
  g as (select *, lag(m) over w as m0, lag(depth) over w as d0 from a window w as (partition by route_id order by m, restriction_id)),
  p as (select *, sum(case when m0 is null or round(m - m0 - 4, 6) >= round(abs(depth - 3) / 0.1::double + abs(d0 - 3) / 0.1::double, 6) then 1 else 0 end) over (partition by route_id order by m, restriction_id)::bigint as plateau from g)
  select route_id, plateau, min(m) - 2 as start_m, max(m) + 2 as stop_m, case when max(depth) <= 3 then min(depth) else max(depth) end as depth from p group by 1, 2"""),
    "variant_signatures": (variant_signatures, "with s as (select l_orderkey, string_agg(distinct l_suppkey::varchar, '+' order by l_suppkey::varchar) as x, list_sort(list_distinct(list(l_suppkey))) as ids from lineitem group by 1) select o_custkey as group_id, array_to_string(ids, '+') as signature, min(l_orderkey) as variant_key, count(*) as n_equal from s join orders on o_orderkey = l_orderkey group by 1, 2"),
    "drop_avoidable": (drop_avoidable, "with st as (select o_custkey as g, l_orderkey as v, l_suppkey as s, bool_or(l_returnflag <> 'N') as j from lineitem join orders on o_orderkey = l_orderkey group by 1, 2, 3), c as (select g, s, bool_or(j) as can from st group by 1, 2), b as (select st.g, v, bool_or(not j and can) as bad from st join c on c.g = st.g and c.s = st.s group by 1, 2) select g as group_id, v as variant_key from (select *, bool_and(bad) over (partition by g) as all_bad from b) where all_bad or not bad"),
    "hausdorff": (hausdorff, "with o as (select o_custkey, (o_orderkey % 1000)::double as x, (o_orderkey * 37 % 991)::double as y, c_nationkey as nation from orders join customer on c_custkey = o_custkey), b as (select nation, o_custkey, row_number() over (partition by nation order by count(*) desc, o_custkey) as r from o group by 1, 2), p as (select o.nation, r, x, y from o join b using (nation, o_custkey) where r <= 2), n as (select p.nation, p.r, p.x, p.y, min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as d2 from p join p q on q.nation = p.nation and q.r = 3 - p.r group by 1, 2, 3, 4) select nation, round(sqrt(max(d2)), 6) as distance from n group by 1"),
    "turn_angles": (turn_angles, f"{_V('tree')}, e as (select t.node_id, m.x - p.x as ax, m.y - p.y as ay, t.x - m.x as bx, t.y - m.y as by2 from tree t join tree m on m.node_id = t.parent_id join tree p on p.node_id = m.parent_id), a as (select node_id, degrees(acos(greatest(-1.0, least(1.0, (ax * bx + ay * by2) / sqrt((ax * ax + ay * ay) * (bx * bx + by2 * by2)))))) as turn from e where (ax * ax + ay * ay) * (bx * bx + by2 * by2) > 0) select node_id, round(turn, 6) as turn_deg, turn > 90 as too_sharp from a"),
    "geojson_export": (geojson_export, None),
}
