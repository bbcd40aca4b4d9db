"""Operators over parent-pointer forests, by pointer doubling: rounds grow with the logarithm of the depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pipeloom.operators.spatial import shuffled
from pipeloom.shared import staged

KEPT, ROUNDS, SHORT = 8, 64, 64


def _kept(state: DataFrame, label: str) -> tuple[DataFrame, int]:
    """The staged state, and how many of its pointers lead on, counted while it is written."""
    seen = Observation()
    written = staged(state.observe(seen, F.count("up").alias("open")), label)
    return written, seen.get["open"]


def _rounds(nodes: DataFrame) -> int:
    return max(1, nodes.count().bit_length())


def _short_paths(tree: DataFrame, node: str, parent: str) -> DataFrame | None:
    """(n, path): every node with all its ancestors, by doubling; None where some have more than SHORT."""
    up = F.col(parent)
    state, going = _kept(tree.select(F.col(node).alias("n"), F.when(up.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(up.cast("bigint"))).alias("path"), up.alias("up")), "paths")
    for _ in range(SHORT.bit_length() - 1):
        if not going:
            break
        hop = state.select(F.col("n").alias("up"), F.col("path").alias("more"), F.col("up").alias("up2"))
        state, going = _kept(state.join(shuffled(hop), "up", "left").select("n", F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more")).alias("path"), F.col("up2").alias("up")), "paths")
    return None if going else state.select("n", "path")


def roll_up(tree: DataFrame, value: str, out: str, kind: str = "decimal(18,2)", how=F.sum, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(node, out): the sum (or max) of value over each node's subtree.

    Where no node has more than SHORT ancestors, each gives its value to all of them, summed before and after one shuffle. Else,
    with S_k the aggregate over descendants nearer than 2^k and the 2^k-th ancestor as pointer, S_(k+1) adds the S_k of
    the nodes that point here. Nodes on or below a cycle raise an error, once as many pointers stay open as in the round before:
    on a tree every round closes some.
    """
    paths = _short_paths(tree, node, parent)
    if paths is not None:
        own = tree.select(F.col(node).alias("n"), F.col(value).cast(kind).alias("s"))
        given = own.select("n", F.lit(True).alias("own"), "s").unionByName(own.join(shuffled(paths), "n").select(F.explode("path").alias("n"), F.lit(False).alias("own"), "s"))
        return given.groupBy("n").agg(F.bool_or("own").alias("own"), how("s").cast(kind).alias(out)).filter("own").select(F.col("n").alias(node), out)
    state, going = _kept(tree.select(F.col(node).alias("n"), F.col(parent).alias("up"), F.col(value).cast(kind).alias("s")), "rollup")
    join_two = (lambda a, b: (a + b).cast(kind)) if how is F.sum else F.greatest
    for _ in range(ROUNDS):
        if not going:
            return state.select(F.col("n").alias(node), F.col("s").alias(out))
        gift = state.filter("up is not null").groupBy("up").agg(how("s").cast(kind).alias("gift")).withColumnRenamed("up", "n")
        hop = state.select(F.col("n").alias("up"), F.col("up").alias("up2"))
        state = state.join(shuffled(gift), "n", "left").join(shuffled(hop), "up", "left").select("n", F.col("up2").alias("up"), F.when(F.col("gift").isNull(), F.col("s")).otherwise(join_two(F.col("s"), F.col("gift"))).alias("s"))
        before = going
        state, going = _kept(state, "rollup")
        if going == before:
            break
    raise ValueError("the parents have a cycle")


def walk_up(tree: DataFrame, step: Column, out: str, kind: str, stop: Column | None = None, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """(node, out, head): the sum of step from each node up to its root, or to the first node where stop holds (inclusive)."""
    ends = F.lit(False) if stop is None else F.coalesce(stop, F.lit(False))
    state, going = _kept(tree.select(F.col(node).alias("n"), F.when(ends, None).otherwise(F.col(parent)).alias("up"), step.cast(kind).alias("s"), F.col(node).alias("head")), "walk")
    for _ in range(ROUNDS):
        if not going:
            return state.select(F.col("n").alias(node), F.col("s").alias(out), "head")
        hop, before = state.select(F.col("n").alias("up"), F.col("up").alias("up2"), F.col("s").alias("s2"), F.col("head").alias("head2")), going
        state, going = _kept(state.join(shuffled(hop), "up", "left").select("n", F.col("up2").alias("up"), (F.col("s") + F.coalesce("s2", F.lit(0))).cast(kind).alias("s"), F.coalesce("head2", "head").alias("head")), "walk")
        if going == before:
            break
    raise ValueError("the parents have a cycle")


def on_cycle(tree: DataFrame, node: str = "node_id", parent: str = "parent_id") -> DataFrame:
    """Nodes whose walk upstream never ends: those on a cycle or below one. A parent that is no node ends the walk."""
    state, going = _kept(tree.select(F.col(node).alias("n"), F.col(parent).alias("up")), "cycle")
    for _ in range(_rounds(tree) + 1):
        if not going:
            break
        hop = state.select(F.col("n").alias("up"), F.col("up").alias("up2"))
        state, going = _kept(state.filter("up is not null").join(shuffled(hop), "up").select("n", F.col("up2").alias("up")), "cycle")
    return state.filter("up is not null").select(F.col("n").alias(node))


def bfs(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, depth) of the nodes reachable over undirected edges (u, v), a frontier at a time: one job for each level."""
    both = staged(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    seen = frontier = staged(sources.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    depth, going = 0, 1
    while going:
        depth += 1
        fresh = both.join(frontier.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        found = Observation()
        frontier = staged(fresh.withColumn("depth", F.lit(depth)).observe(found, F.count("*").alias("n")), "bfs")
        going = found.get["n"]
        seen = seen.unionByName(frontier)
        if depth % KEPT == 0:  # so that the plan doesn't grow with the levels
            seen = staged(seen, "seen")
    return seen
