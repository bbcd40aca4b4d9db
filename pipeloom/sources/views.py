"""Domain rows over the given tables, in integer arithmetic so that every engine agrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pipeloom.shared import load



def _xy(key: str, a: int, b: int) -> list[str]:
    return [f"cast(({key} * {a}) % 100003 as double) / 100 as x", f"cast(({key} * {b}) % 99991 as double) / 100 as y"]


RULE_ORDER = ["oks_existing", "park", "social_area", "prohibited_site", "water", "railway", "road", "tram_tracks", "gas_pipeline", "power_cable", "heat_network"]
_RULE = "case p_partkey % 11 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(RULE_ORDER)) + " end as rules_key"

#: name -> (table, columns); the same text for Spark and for oracles.
VIEWS = {
    "oks": ("customer", ["c_custkey as oks_id", "cast(1 + c_custkey % 40 as decimal(18,2)) as flow_tph", *_xy("c_custkey", 7919, 104729)]),
    "chamber": ("supplier", ["s_suppkey as chamber_id", "s_suppkey % 5 as used_ports", *_xy("s_suppkey", 15485863, 32452843)]),
    "tree": (
        "customer",
        ["c_custkey as node_id", "case when c_custkey = 0 then null else cast(floor(c_custkey / 3) as bigint) end as parent_id", "cast(3 + (c_custkey * 37) % 400 as decimal(18,3)) as length_m",
         "cast(case c_custkey % 6 when 0 then 1.60 when 1 then 1.25 else 1.00 end as decimal(4,2)) as k_spec", "cast(1 + c_custkey % 40 as decimal(18,2)) as own_flow", *_xy("c_custkey", 7919, 104729)],
    ),
    "restriction": ("part", ["p_partkey as restriction_id", _RULE, "cast((p_partkey * 6151) % 100003 as double) / 100 as cx", "cast((p_partkey * 12289) % 99991 as double) / 100 as cy", "cast(p_size as double) / 4 as half_w", "cast(p_size as double) / 5 as half_h"]),
    "new_segment": (
        "lineitem",
        ["l_orderkey as variant_key", "cast(l_quantity as decimal(18,3)) as length_m", "case when l_partkey % 18 < 7 then 100 when l_partkey % 18 < 12 then 200 else 500 end as dn",
         "cast(case l_returnflag when 'R' then 1.60 when 'A' then 1.25 else 1.00 end as decimal(4,2)) as k_spec", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag"],
    ),
}

def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return load(spark, sf_dir, table).selectExpr(*columns)


def sql_views(*names: str) -> str:
    """The views as a with clause of an oracle."""
    return ", ".join(f"{n} as (select {', '.join(VIEWS[n][1])} from {VIEWS[n][0]})" for n in names)
