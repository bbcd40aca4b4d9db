"""Ingest queries over feature texts made from the given tables: structure, kinds, numbers, rules, duplicates, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.functions.reference import DIAMETERS, GABARITS, RULES, UTILITIES
from pipeloom.operators.spatial import nearest_of_all, nearest_within, shuffled
from pipeloom.plans.geometry import _V, vertices
from pipeloom.plans.network import _P
from pipeloom.shared import load
from pipeloom.sources.geojson import checked_features, parse_features
from pipeloom.sources.views import sql_views, view

#: Features written for each part, by p_partkey % 16: most have something wrong. {k} the key, {x} {y} a place in degrees.
TEXTS = [
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"heat_network","diameter":"1 00"}},"geometry":{{"type":"LineString","coordinates":[[{x},{y}],[37.5,55.5]]}}}}',
    '{{"type":"Feature","id":"{k}","properties":{{"object_type":" Heat-Chamber "}},"geometry":{{"coordinates":[{x},{y}],"type":"Point"}}}}',
    '{{"type":"Feature","properties":{{"id":{k}.0,"object_type":"oks_connection_point","flow_tph":"3,5"}},"geometry":{{"type":"Point","coordinates":[{x},{y}]}}}}',
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"oks_connection_point","flow_tph":0}},"geometry":{{"type":"Point","coordinates":[{x},{y}]}}}}',
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"oks_connection_point","flow_tph":2}},"geometry":{{"type":"LineString","coordinates":[[{x},{y}],[37.5,55.5]]}}}}',
    '{{"type":"Feature","properties":{{"object_type":"source"}},"geometry":{{"type":"Point","coordinates":[{x},{y}]}}}}',
    '{{"type":"Feature","properties":{{"id":{k}}},"geometry":{{"type":"Point","coordinates":[{x},{y}]}}}}',
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"source"}},"geometry":null}}',
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"source"}},"geometry":{{"type":"Point","coordinates":[200.5,{y}]}}}}',
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"source"}},"geometry":{{"type":"Point","coordinates":[{x},95.5]}}}}',
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"restriction"}},"geometry":{{"type":"Polygon","coordinates":[[[{x},{y}],[37.6,55.5],[37.6,55.6],[{x},{y}]]]}}}}',
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"restriction","restriction_type":"park"}},"geometry":{{"type":"Polygon","coordinates":[[[{x},{y}],[37.6,55.5]]]}}}}',
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"oks_existing"}},"geometry":{{"type":"MultiPolygon","coordinates":[[[[{x},{y}],[37.6,55.5],[37.6,55.6],[{x},{y}]]]]}}}}',
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"heat_network","diameter":-5}},"geometry":{{"type":"LineString","coordinates":[[{x},{y}],[37.5,55.5]]}}}}',
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"bench"}},"geometry":{{"type":"Point","coordinates":[{x},{y}]}}}}',
    '{{"type":"Feature","properties":{{"id":{k},"object_type":"source"',
]
#: What each of them is found to be: kind, problem, number of coordinate pairs.
FOUND = [
    ("segment", None, 2), ("chamber", None, 1), ("demand", None, 1), ("demand", "OKS_FLOW_REQUIRED", 1), ("demand", "OKS_GEOMETRY", 2), (None, "MISSING_ID", 1), (None, "MISSING_OBJECT_TYPE", 1), ("source", "MISSING_GEOMETRY", 0),
    ("source", "COORD_ORDER", 1), ("source", "COORD_ORDER", 1), ("restriction", "RESTRICTION_TYPE", 4), ("restriction", "GEOMETRY_INVALID", 2), ("restriction", None, 4), ("segment", "NET_DIAMETER", 2), ("unknown", "UNKNOWN_OBJECT_TYPE", 1), (None, "FEATURE_PARSE", 0),
]
_TYPES = ["oks", "OKS-existing", " park", "tram tracks", "water", "monument", "gas_pipeline", None]  # restriction types as they are written
_RESOLVED = ["oks_existing", "oks_existing", "park", "tram_tracks", "water", None, "gas_pipeline", None]
_NUMBERS = ["12", "1 234,5", "1 000", "3.25", "n/a", "", "-7,0", "1e3"]
_VALUES = [12.0, 1234.5, 1000.0, 3.25, None, None, -7.0, 1000.0]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_partkey", (36 + F.col("p_partkey") % 200 / 100).cast("string").alias("x"), (55 + F.col("p_partkey") % 90 / 100).cast("string").alias("y"))
    text = F.lit(None).cast("string")
    for i, t in enumerate(TEXTS):
        made = F.lit(t.replace("{{", "{").replace("}}", "}").replace("{k}", "\u0001").replace("{x}", "\u0002").replace("{y}", "\u0003"))
        made = F.replace(F.replace(F.replace(made, F.lit("\u0001"), F.col("p_partkey").cast("string")), F.lit("\u0002"), F.col("x")), F.lit("\u0003"), F.col("y"))
        text = F.when(F.col("p_partkey") % len(TEXTS) == i, made).otherwise(text)
    return p.select("p_partkey", text.alias("value"))


def feature_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind, canonical id, first problem and coordinate pairs of each feature text."""
    f = checked_features(parse_features(_texts(spark, sf_dir), keep=["p_partkey"]))
    return f.select("p_partkey", "id", "kind", "problem", F.floor(F.coalesce(F.size("coordinates"), F.lit(0)) / 2).cast("int").alias("n_pairs"))


def feature_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many features of each kind were taken and turned away, as a JSON report."""
    f = feature_checks(spark, sf_dir).groupBy(F.coalesce("kind", F.lit("none")).alias("kind")).agg(F.count_if(F.col("problem").isNull()).alias("taken"), F.count_if(F.col("problem").isNotNull()).alias("rejected"))
    return f.select("kind", F.to_json(F.struct("kind", "taken", "rejected")).alias("report"))


def _pick(key, values: list):
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(key % len(values) == i, F.lit(v)).otherwise(out)
    return out


def restriction_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restriction types as written, the rule that each resolves to, and prohibited with 1 m where none does."""
    p = load(spark, sf_dir, "part").select("p_partkey", _pick(F.col("p_partkey"), _TYPES).alias("written"))
    code = F.translate(F.lower(F.trim("written")), "- ", "__")
    code = F.when(code == "oks", "oks_existing").otherwise(code)
    known = code.isin(list(RULES))
    effect, offset = F.lit("prohibited"), F.lit(1.0)
    for name, (what, metres, _) in RULES.items():
        effect, offset = F.when(code == name, what).otherwise(effect), F.when(code == name, F.lit(metres).cast("double")).otherwise(offset)
    return p.select("p_partkey", F.when(known, code).alias("rule"), F.when(code.isNotNull(), effect).alias("effect"), F.when(code.isNotNull(), offset).alias("offset_m"))


def lenient_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with spaces, no-break spaces and decimal commas; null where there is none, and whole ones as integers."""
    p = load(spark, sf_dir, "part").select("p_partkey", _pick(F.col("p_partkey"), _NUMBERS).alias("t"))
    value = F.expr("try_cast(nullif(replace(translate(t, '  ', ''), ',', '.'), '') as double)")
    return p.select("p_partkey", value.alias("value")).withColumn("whole", F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint")))


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of a variant that are named twice."""
    return view(spark, sf_dir, "new_segment").groupBy("variant_key", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


def own_obstacles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth obstacles of each order's route but those that it ties into itself."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("restriction_id"), "l_suppkey").distinct()
    tied = li.filter("l_suppkey % 5 = 0").select("l_orderkey", "restriction_id").distinct()
    kinds = view(spark, sf_dir, "restriction").filter("rules_key in ('gas_pipeline', 'power_cable', 'heat_network')").select("restriction_id")
    return li.select("l_orderkey", "restriction_id").distinct().join(kinds, "restriction_id", "left_semi").join(tied, ["l_orderkey", "restriction_id"], "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("n"))


def feature_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature with the pipe and the chamber of its id, where there are such."""
    f = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    pipes = view(spark, sf_dir, "tree").select(F.col("node_id").alias("id"), F.col("length_m").cast("double").alias("length_m"))
    chambers = view(spark, sf_dir, "chamber").select(F.col("chamber_id").alias("id"), "used_ports")
    return f.join(pipes, "id", "left").join(chambers, "id", "left")


def chamber_incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chamber to each pipe's first vertex: within 10 m where another pipe's end joins there (5 m), else within 30 m."""
    ends = vertices(spark, sf_dir).filter("seq in (0, 3)").select("line_id", "seq", "x", "y")
    starts = ends.filter("seq = 0").select("line_id", "x", "y")
    other = ends.select(F.col("line_id").alias("other_id"), "x", "y")
    joint = nearest_within(starts, other, 5.0, "line_id", "other_id", others=True).select("line_id", F.lit(True).alias("joint"))
    near = nearest_within(starts, view(spark, sf_dir, "chamber"), 30.0, "line_id", "chamber_id").join(joint, "line_id", "left")
    reach = F.when(F.coalesce("joint", F.lit(False)), 100.0).otherwise(900.0)
    return near.filter(F.col("d2") <= reach).select("line_id", "chamber_id", F.round("d2", 6).alias("d2"))


def reference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New pipes by dn, with their reference row; has_row tells where tables lack one."""
    spec = spark.createDataFrame([(d[0], float(d[1]), d[2], d[3], d[4], GABARITS[d[0]][1]) for d in DIAMETERS], "dn int, capacity double, longest_m int, price int, rebuild_price int, width double")
    used = view(spark, sf_dir, "new_segment").groupBy("dn").agg(F.count("*").alias("n"))
    return used.join(F.broadcast(spec), "dn", "left").select("dn", "n", "capacity", "longest_m", "price", "rebuild_price", "width", F.col("price").isNotNull().alias("has_row"))


def all_restrictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restrictions on record and the existing pipes, which are restrictions too, by kind with what they take up."""
    r = view(spark, sf_dir, "restriction").select("rules_key", (F.col("half_w") * F.col("half_h") * 4).alias("area"))
    pipes = view(spark, sf_dir, "tree").select(F.lit("heat_network").alias("rules_key"), (F.col("length_m").cast("double") * GABARITS[200][1]).alias("area"))
    return r.unionByName(pipes).groupBy("rules_key").agg(F.count("*").alias("n"), F.round(F.sum("area"), 2).alias("area"))


def two_pass_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restrictions that a second pass keeps, after a first one over points and pipes: those that the area of interest meets."""
    box = area_box(view(spark, sf_dir, "oks"), vertices(spark, sf_dir).filter("seq = 0").select("line_id", "x", "y"), "line_id")
    r = view(spark, sf_dir, "restriction")
    hit = (F.col("cx") + F.col("half_w") >= F.col("x0")) & (F.col("cx") - F.col("half_w") <= F.col("x1")) & (F.col("cy") + F.col("half_h") >= F.col("y0")) & (F.col("cy") - F.col("half_h") <= F.col("y1"))
    return r.join(F.broadcast(box), hit, "left_semi").select("restriction_id", "rules_key")


def area_box(oks: DataFrame, v: DataFrame, vertex_id: str) -> DataFrame:
    """The envelope of points and of the pipe vertex nearest to each; of all vertices where these span at most 3 km; 1 km wider on every side."""
    near = nearest_of_all(oks, v, 25.0, "oks_id", vertex_id).select(vertex_id).join(shuffled(v), vertex_id).select("x", "y")
    span = lambda d: d.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    some, whole = span(oks.select("x", "y").unionByName(near)), span(v)
    whole = whole.select(*(F.col(c).alias(f"w{c}") for c in ("x0", "x1", "y0", "y1")))
    short = F.sqrt((F.col("wx1") - F.col("wx0")) * (F.col("wx1") - F.col("wx0")) + (F.col("wy1") - F.col("wy0")) * (F.col("wy1") - F.col("wy0"))) <= 3000
    low = lambda c: F.when(short, F.least(c, f"w{c}")).otherwise(F.col(c)) - 1000
    high = lambda c: F.when(short, F.greatest(c, f"w{c}")).otherwise(F.col(c)) + 1000
    return some.join(F.broadcast(whole)).select(low("x0").alias("x0"), high("x1").alias("x1"), low("y0").alias("y0"), high("y1").alias("y1"))


def area_of_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area box over every vertex of the pipes."""
    v = vertices(spark, sf_dir).select((F.col("line_id") * 4 + F.col("seq")).alias("vertex_id"), "x", "y")
    return area_box(view(spark, sf_dir, "oks"), v, "vertex_id").select(*(F.round(c, 6).alias(c) for c in ("x0", "x1", "y0", "y1")))


def utility_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half widths that keep a new pipe of dn 200 clear of each utility: its own, the clearance and half of the pair."""
    half = F.lit(None).cast("double")
    for name, (_, high, clear) in UTILITIES.items():
        half = F.when(F.col("rules_key") == name, F.lit((high or GABARITS[100][0]) / 2 + clear + GABARITS[200][1] / 2)).otherwise(half)
    r = view(spark, sf_dir, "restriction").filter(F.col("rules_key").isin(list(UTILITIES)))
    return r.select("restriction_id", "rules_key", F.round(half, 6).alias("half_m"))


def _sql_pick(key: str, values: list) -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {i} then {'null' if v is None else repr(v)}" for i, v in enumerate(values)) + " end"


_EFFECT = "case rule " + " ".join(f"when '{n}' then '{w}'" for n, (w, _, _) in RULES.items()) + " else 'prohibited' end"
_OFFSET = "case rule " + " ".join(f"when '{n}' then {'null' if m is None else m}" for n, (_, m, _) in RULES.items()) + " else 1.0 end::double"
_FEATURES = f"f as (select p_partkey, case when p_partkey % 16 in (5, 15) then null else p_partkey::varchar end as id, {_sql_pick('p_partkey', [k for k, _, _ in FOUND])} as kind, {_sql_pick('p_partkey', [p for _, p, _ in FOUND])} as problem, ({_sql_pick('p_partkey', [n for _, _, n in FOUND])})::int as n_pairs from part)"
_V0 = "vertex as (select c_custkey as line_id, k as seq, cast((c_custkey * 7919) % 100003 as double) / 100 + 12 * k + (c_custkey * 31 + k * 17) % 13 as x, cast((c_custkey * 104729) % 99991 as double) / 100 + (c_custkey * 53 + k * 29) % 41 - 20 as y from customer, (values (0), (3)) v(k))"
_BOX = f"""{_P}, {_V0}, few as (select * from oks), v as (select * from vertex where seq = 0),
  n as (select v.x, v.y from (select oks_id, arg_min(line_id, (round(d2, 9), line_id)) as line_id from (select o.oks_id, v.line_id, (o.x - v.x) * (o.x - v.x) + (o.y - v.y) * (o.y - v.y) as d2 from few o, v) group by 1) join v using (line_id)),
  s as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from (select x, y from few union all select x, y from n)), w as (select min(x) as wx0, max(x) as wx1, min(y) as wy0, max(y) as wy1 from v),
  b as (select *, sqrt((wx1 - wx0) * (wx1 - wx0) + (wy1 - wy0) * (wy1 - wy0)) <= 3000 as short from s, w),
  box as (select case when short then least(x0, wx0) else x0 end - 1000 as x0, case when short then greatest(x1, wx1) else x1 end + 1000 as x1, case when short then least(y0, wy0) else y0 end - 1000 as y0, case when short then greatest(y1, wy1) else y1 end + 1000 as y1 from b)"""
_WHOLE_BOX = _BOX.replace(_V0, _V).replace("v as (select * from vertex where seq = 0)", "v as (select *, line_id * 4 + seq as vertex_id from vertex)").replace("arg_min(line_id, (round(d2, 9), line_id)) as line_id", "arg_min(vertex_id, (round(d2, 9), vertex_id)) as vertex_id").replace("v.line_id, (o.x", "v.vertex_id, (o.x").replace("using (line_id)", "using (vertex_id)")

QUERIES = {
    "feature_checks": (feature_checks, f"with {_FEATURES} select * from f"),
    "feature_report": (feature_report, f"""with {_FEATURES}, g as (select coalesce(kind, 'none') as kind, count(*) filter (where problem is null) as taken, count(*) filter (where problem is not null) as rejected from f group by 1) select kind, '{{"kind":"' || kind || '","taken":' || taken || ',"rejected":' || rejected || '}}' as report from g"""),
    "restriction_rules": (restriction_rules, f"with r as (select p_partkey, {_sql_pick('p_partkey', _RESOLVED)} as rule, p_partkey % 8 <> 7 as written from part) select p_partkey, rule, case when written then {_EFFECT} end as effect, case when written then {_OFFSET} end as offset_m from r"),
    "lenient_numbers": (lenient_numbers, f"with v as (select p_partkey, ({_sql_pick('p_partkey', _VALUES)})::double as value from part) select p_partkey, value, case when value = floor(value) then value::bigint end as whole from v"),
    "repeated_keys": (repeated_keys, "select l_orderkey as variant_key, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1"),
    "own_obstacles": (own_obstacles, f"{_P}, li as (select distinct l_orderkey, l_partkey as r, l_suppkey from lineitem), t as (select l_orderkey, r from li where l_suppkey % 5 = 0), k as (select l_orderkey, r from li join restriction on restriction_id = r and rules_key in ('gas_pipeline', 'power_cable', 'heat_network') except select * from t) select l_orderkey, count(*) as n from k group by 1"),
    "feature_objects": (feature_objects, f"{_P} select p_partkey as id, length_m::double as length_m, used_ports from part left join tree on node_id = p_partkey left join chamber on chamber_id = p_partkey"),
    "chamber_incidence": (chamber_incidence, f"""{_P}, {_V0}, s as (select * from vertex where seq = 0), j as (select distinct s.line_id from s join vertex v on v.line_id <> s.line_id and (s.x - v.x) * (s.x - v.x) + (s.y - v.y) * (s.y - v.y) <= 25),
  p as (select s.line_id, chamber_id, (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) as d2, j.line_id is not null as joint from s join chamber c on (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) <= 900 left join j on j.line_id = s.line_id)
  select line_id, chamber_id, round(d2, 6) as d2 from (select *, row_number() over (partition by line_id order by d2, chamber_id) as r from p where d2 <= case when joint then 100 else 900 end) where r = 1"""),
    "reference_cover": (reference_cover, f"with {sql_views('new_segment')}, spec(dn, capacity, longest_m, price, rebuild_price, width) as (values {', '.join(f'({d[0]}, {float(d[1])}::double, {d[2]}, {d[3]}, {d[4]}, {GABARITS[d[0]][1]}::double)' for d in DIAMETERS)}) select dn, count(*) as n, any_value(capacity) as capacity, any_value(longest_m) as longest_m, any_value(price) as price, any_value(rebuild_price) as rebuild_price, any_value(width) as width, any_value(price) is not null as has_row from new_segment left join spec using (dn) group by 1"),
    "all_restrictions": (all_restrictions, f"{_P}, a as (select rules_key, half_w * half_h * 4 as area from restriction union all select 'heat_network', length_m::double * {GABARITS[200][1]}::double from tree) select rules_key, count(*) as n, round(sum(area), 2) as area from a group by 1"),
    "two_pass_scan": (two_pass_scan, _BOX + " select restriction_id, rules_key from restriction, box where cx + half_w >= x0 and cx - half_w <= x1 and cy + half_h >= y0 and cy - half_h <= y1"),
    "area_of_interest": (area_of_interest, _WHOLE_BOX + " select round(x0, 6) as x0, round(x1, 6) as x1, round(y0, 6) as y0, round(y1, 6) as y1 from box"),
    "utility_envelopes": (utility_envelopes, f"{_P} select restriction_id, rules_key, round(case rules_key " + " ".join(f"when '{n}' then {((h or GABARITS[100][0]) / 2 + c + GABARITS[200][1] / 2)!r}" for n, (_, h, c) in UTILITIES.items()) + f" end::double, 6) as half_m from restriction where rules_key in ({', '.join(map(repr, UTILITIES))})"),
}
