"""Diameters raised until no run of one diameter is longer than its limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeloom.functions.reference import DIAMETERS, by_dn
from pipeloom.operators.spatial import shuffled
from pipeloom.operators.tree import roll_up, walk_up
from pipeloom.shared import staged

TOLERANCE = "0.01"


def _with_parent_dn(t: DataFrame) -> DataFrame:
    return t.join(shuffled(t.select(F.col("node_id").alias("parent_id"), F.col("dn").alias("up_dn"))), "parent_id", "left")


def over_limit(tree: DataFrame) -> DataFrame:
    """(node_id, longest): of each pipe (node_id, parent_id, length_m, dn, dn never falling towards the root) the longest run of its dn through it.

    A run goes from its head down one way as far as the dn holds. Metres from the head are summed up the tree, and their largest is carried
    back up inside the run, each in as many rounds as the logarithm of the depth.
    """
    t = staged(_with_parent_dn(tree), "runs")
    head = F.col("up_dn").isNull() | (F.col("up_dn") != F.col("dn"))
    down = walk_up(t, F.col("length_m"), "run_m", "decimal(18,3)", stop=head).select("node_id", "run_m")
    cut = t.select("node_id", F.when(~head, F.col("parent_id")).alias("parent_id")).join(shuffled(down), "node_id")
    return roll_up(cut, "run_m", "longest", "decimal(18,3)", how=F.max)


def raise_for_length(tree: DataFrame) -> DataFrame:
    """(node_id, dn, too_long) of pipes (node_id, parent_id, length_m, dn): every run over its limit is raised by one diameter as a
    whole, all such runs at once, and diameters are kept from falling towards the root, until nothing changes.

    Runs of the largest dn stay and are told as too long. Each round raises some pipe, so rounds are at most pipes times
    diameters; in each, members of a run change together, so in practice they follow the diameters. Null dns count as the smallest.
    """
    sizes = [d[0] for d in DIAMETERS]
    onward = F.create_map(*(F.lit(x) for a, b in zip(sizes, sizes[1:]) for x in (a, b)))
    state = staged(tree.select("node_id", "parent_id", "length_m", F.coalesce("dn", F.lit(sizes[0])).alias("dn")), "dns")
    while True:
        level = roll_up(state, "dn", "dn", "int", how=F.max)
        state = staged(state.drop("dn").join(shuffled(level), "node_id"), "dns")
        known = state.join(shuffled(over_limit(state)), "node_id").withColumn("too_long", F.col("longest") > by_dn(F.col("dn"), 2) + F.lit(TOLERANCE).cast("decimal(4,2)"))
        known = staged(known, "limits")
        if known.filter(F.col("too_long") & (F.col("dn") < sizes[-1])).isEmpty():
            return known.select("node_id", "dn", "too_long")
        state = known.select("node_id", "parent_id", "length_m", F.when(F.col("too_long"), F.coalesce(F.try_element_at(onward, F.col("dn")), F.col("dn"))).otherwise(F.col("dn")).alias("dn"))
