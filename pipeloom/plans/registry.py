"""All registered queries of the network domain with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from pipeloom.plans import assembly, branching, depths, details, geometry, ingest, network, planning, sizing, surveys, zones

PARTS = (sizing, network, surveys, planning, geometry, assembly, ingest, details, zones, depths, branching)
#: Decimal results of queries, handed out as doubles by both engines.
DECIMALS = {
    "min_dn_asof": ["flow_tph"], "tree_flow_rollup": ["flow"], "tree_leaf_paths": ["path_m"], "dn_runs": ["run_m"], "upstream_added_flow": ["added"], "suffix_tie_in_flow": ["flow"],
    "reconstruction_parts": ["length_m"], "segment_cost": ["length_m"], "variant_summary": ["length_m", "score"], "variant_rank_top3": ["length_m", "score"],
}


def _plain(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema.fields if isinstance(f.dataType, DecimalType)})

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _plain(query) for part in PARTS for name, (query, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
    for name, columns in DECIMALS.items():
        found[name] = f"select * replace ({', '.join(f'cast({c} as double) as {c}' for c in columns)}) from ({found[name]})"
    return found
