"""Cheapest ways over a whole graph with turns taken into account: rounds of joins over (before, node) states."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeloom.shared import staged

ROUNDS = 10_000


def arcs_of(edges: DataFrame) -> DataFrame:
    """(u, v, d, ux, uy): both directions of undirected edges (a, b, ax, ay, bx, by, d), with the unit vector ahead; of repeated edges the shortest."""
    ahead = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "d", F.expr("bx - ax").alias("dx"), F.expr("`by` - ay").alias("dy"))
    both = ahead.unionByName(ahead.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))).filter("u <> v")
    both = both.groupBy("u", "v").agg(F.min(F.struct("d", "dx", "dy")).alias("e")).select("u", "v", "e.*").withColumn("l", F.expr("nullif(sqrt(dx * dx + dy * dy), 0)"))
    return both.select("u", "v", "d", F.coalesce(F.col("dx") / F.col("l"), F.lit(0.0)).alias("ux"), F.coalesce(F.col("dy") / F.col("l"), F.lit(0.0)).alias("uy"))


def cheapest_states(edges: DataFrame, starts: DataFrame, goals: DataFrame | None = None, most: float = 90.0, free: float = 5.0, turn_cost: float = 10.0, bucket: float = 50.0, factor: float = 1.0, slack: float = 0.0) -> DataFrame:
    """(before, node, cost, hops, came, source) of the states that a search from starts (node, cost) reaches.

    A state is a node with the node before it; came is the one before that. A turn of over `most` degrees is no way, one of over
    `free` degrees costs turn_cost. Ties go to fewer hops, then the smaller source and came. Each round expands the states
    whose cost lies within `bucket` of the cheapest open one, so states are rarely expanded twice, and writes the table of states. Where goals
    (node) are given, the search ends when the cheapest open state costs more than factor * c + slack, c the cost of the goal
    that is reached last; goals out of reach let it run on to the end.
    """
    arcs = staged(arcs_of(edges), "arcs")
    begun = starts.groupBy("node").agg(F.min("cost").cast("double").alias("start")).select(F.col("node").alias("u"), "start")
    state = arcs.join(begun, "u").select(F.col("u").alias("before"), F.col("v").alias("node"), (F.col("start") + F.col("d")).alias("cost"), F.lit(1).alias("hops"), F.lit(None).cast(arcs.schema["u"].dataType).alias("came"), F.col("u").alias("source"), "ux", "uy", F.lit(None).cast("double").alias("done"))
    state = staged(state, "states")
    straight, sharpest = math.cos(math.radians(free)) - 1e-12, math.cos(math.radians(most)) - 1e-9
    wanted = None if goals is None else staged(goals.select("node").distinct(), "goals")
    many = None if wanted is None else wanted.count()
    open_ = F.col("done").isNull() | (F.col("cost") < F.col("done"))
    for _ in range(ROUNDS):
        least = state.filter(open_).agg(F.min("cost")).first()[0]
        if least is None:
            break
        if wanted is not None:
            reached = state.join(wanted, "node").groupBy("node").agg(F.min("cost").alias("c")).agg(F.count("*"), F.max("c")).first()
            if reached[0] == many and least > factor * (reached[1] or 0.0) + slack:
                break
        now = open_ & (F.col("cost") < least + bucket)
        front = state.filter(now).select(F.col("before").alias("came"), F.col("node").alias("u"), F.col("cost").alias("c"), "hops", "source", F.col("ux").alias("wx"), F.col("uy").alias("wy"))
        met = front.join(arcs, "u").withColumn("dot", F.expr("wx * ux + wy * uy")).filter(F.col("dot") >= sharpest)
        found = met.select(
            F.col("u").alias("before"), F.col("v").alias("node"), "ux", "uy", (F.col("c") + F.col("d") + F.when(F.col("dot") < straight, turn_cost).otherwise(0.0)).alias("cost"),
            (F.col("hops") + 1).alias("hops"), "came", "source", F.lit(None).cast("double").alias("done"),
        )
        merged = state.withColumn("done", F.when(now, F.col("cost")).otherwise(F.col("done"))).unionByName(found)
        merged = merged.groupBy("before", "node").agg(F.min(F.struct("cost", "hops", "source", "came", "ux", "uy")).alias("s"), F.min("done").alias("done"))
        state = staged(merged.select("before", "node", "s.*", "done"), "states")
    else:
        raise RuntimeError("the search did not end")
    return state.select("before", "node", "cost", "hops", "came", "source")


def cheapest(states: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, cost, hops, source, before) of every node that is reached, starts included."""
    found = states.select("node", "cost", "hops", "source", "before").unionByName(starts.select("node", F.col("cost").cast("double").alias("cost"), F.lit(0).alias("hops"), F.col("node").alias("source"), F.lit(None).cast(states.schema["before"].dataType).alias("before")))
    return found.groupBy("node").agg(F.min(F.struct("cost", "hops", "source", "before")).alias("s")).select("node", "s.*")


def traced(states: DataFrame, ends: DataFrame) -> DataFrame:
    """(goal, place, node): the nodes of the ways to ends (node, before, hops), place 0 at the start; a join for each hop of the longest way."""
    states = staged(states.select("before", "node", "came"), "links")
    at = staged(ends.select(F.col("node").alias("goal"), "node", "before", F.col("hops").alias("place")), "trace")
    out, longest = at.select("goal", "place", "node"), at.agg(F.max("place")).first()[0] or 0
    for _ in range(longest):
        at = at.filter("before is not null").join(states, ["before", "node"]).select("goal", F.col("before").alias("node"), F.col("came").alias("before"), (F.col("place") - 1).alias("place"))
        at = staged(at, "trace")
        out = out.unionByName(at.select("goal", "place", "node"))
    return out
