"""Diameters of least cost over a forest of pipes, level by level as joins and aggregations.

A node stands for the pipe to its parent. A dn covers the flow, does not shrink towards the root, and a run of pipes of one
dn is no longer than its limit. A state is a pipe, a dn and the run's head, the pipe nearest to the root in its run; it
exists while the metres from the head to the pipe's end keep the limit. Its cost is the pipe's own and, for each pipe
below, the lesser of going on with the run and of beginning a run of a smaller dn there. Costs go from the deepest level
up, choices from the roots down. A pipe has as many states as dns and pipes above it within a run's limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeloom.functions.reference import CHAMBER_BANDS, DIAMETERS, band, min_dn, roubles
from pipeloom.operators.tree import walk_up
from pipeloom.shared import staged

SLACK_M = 0.01


def _options(tree: DataFrame) -> DataFrame:
    """(node_id, dn, longest, own): the dns that cover each pipe's flow; what the pipe, and a chamber where it parts, cost."""
    rows = F.array(*(F.struct(F.lit(d[0]).alias("dn"), F.lit(float(d[2])).alias("longest"), F.lit(d[3]).alias("price")) for d in DIAMETERS))
    each = tree.select("node_id", "length_m", "forks", min_dn(F.col("flow").cast("decimal(18,2)")).alias("least"), F.explode(rows).alias("o")).filter("o.dn >= least")
    chamber = F.when(F.col("forks") > 1, band(F.col("o.dn"), CHAMBER_BANDS)).otherwise(0)
    return each.select("node_id", "o.dn", "o.longest", (roubles(F.col("length_m").cast("decimal(12,3)") * F.col("o.price").cast("decimal(10,0)")) + chamber).cast("bigint").alias("own"))


def _dearest(states: DataFrame, below: DataFrame | None) -> DataFrame:
    """The states of a level with their cost, given those of the level below."""
    if below is None:
        return states.filter("forks = 0").withColumn("cost", F.col("own"))
    on = below.filter("head <> node_id").select(F.col("parent_id").alias("p"), F.col("node_id").alias("child"), "dn", "head", F.col("cost").alias("go_on"))
    fresh = below.filter("head = node_id").select(F.col("parent_id").alias("p"), F.col("node_id").alias("child"), F.col("dn").alias("smaller"), "cost")
    dns = F.explode(F.array(*(F.lit(d[0]) for d in DIAMETERS))).alias("dn")
    anew = fresh.select("p", "child", "smaller", "cost", dns).filter("smaller < dn").groupBy("p", "child", "dn").agg(F.min("cost").alias("anew"))
    anew = states.select("node_id", "dn", "head").join(anew.withColumnRenamed("p", "node_id"), ["node_id", "dn"]).select(F.col("node_id").alias("p"), "child", "dn", "head", F.col("anew").alias("cost"))
    ways = anew.unionByName(on.withColumnRenamed("go_on", "cost")).groupBy("p", "child", "dn", "head").agg(F.min("cost").alias("cost"))
    sums = ways.groupBy(F.col("p").alias("node_id"), "dn", "head").agg(F.sum("cost").alias("kids"), F.count("*").alias("n"))
    full = states.join(sums, ["node_id", "dn", "head"], "left").filter(F.coalesce("n", F.lit(0)) == F.col("forks"))
    return full.withColumn("cost", F.col("own") + F.coalesce("kids", F.lit(0))).drop("kids", "n")


def cheapest_diameters(tree: DataFrame) -> DataFrame:
    """(node_id, dn) of each pipe of (node_id, parent_id, length_m, flow); dn is null throughout a tree that has no allowed choice.

    On equal costs a run goes on, and a smaller dn is taken. A parent that is no node ends its tree.
    """
    kids = tree.filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("forks"))
    known = tree.select(F.col("node_id").alias("parent_id")).withColumn("there", F.lit(True))
    tree = tree.join(known, "parent_id", "left").withColumn("parent_id", F.when(F.col("there"), F.col("parent_id"))).drop("there")
    depth = walk_up(tree, F.lit(1), "depth", "int").select("node_id", "depth")
    tree = staged(tree.join(kids, "node_id", "left").join(depth, "node_id").select("node_id", "parent_id", F.col("length_m").cast("double").alias("length_m"), "flow", F.coalesce("forks", F.lit(0)).alias("forks"), "depth"), "pipes")
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    options = staged(_options(tree), "options")
    limit = max(d[2] for d in DIAMETERS) + SLACK_M
    heads = [staged(tree.filter("depth = 1").select("node_id", F.col("node_id").alias("head"), F.col("length_m").alias("m")), "heads")]
    for level in range(2, deepest + 1):  # the pipes above each pipe, within the largest limit
        here = tree.filter(F.col("depth") == level)
        up = heads[-1].select(F.col("node_id").alias("parent_id"), "head", F.col("m").alias("before"))
        more = here.join(up, "parent_id").select("node_id", "head", (F.col("before") + F.col("length_m")).alias("m")).filter(F.col("m") <= limit)
        heads.append(staged(more.unionByName(here.select("node_id", F.col("node_id").alias("head"), F.col("length_m").alias("m"))), "heads"))
    below, costs = None, []
    for level in range(deepest, 0, -1):
        states = heads[level - 1].join(options, "node_id").filter(F.col("m") <= F.col("longest") + SLACK_M)
        states = states.join(tree.filter(F.col("depth") == level).select("node_id", "parent_id", "forks"), "node_id").select("node_id", "parent_id", "forks", "dn", "head", "own")
        below = staged(_dearest(states, below).select("node_id", "parent_id", "dn", "head", "cost"), "costs")
        costs.append(below)
    if not costs:
        return tree.select("node_id", F.lit(None).cast("int").alias("dn"))
    order = Window.partitionBy("node_id").orderBy("cost", F.desc("goes_on"), "dn")
    chosen = [costs[-1].groupBy("node_id").agg(F.min_by(F.struct("dn", "head"), F.struct("cost", "dn")).alias("b")).select("node_id", "b.dn", "b.head")]
    for level in range(2, deepest + 1):
        up = staged(chosen[-1], "chosen")
        chosen[-1] = up
        up = up.select(F.col("node_id").alias("parent_id"), F.col("dn").alias("up_dn"), F.col("head").alias("up_head"))
        ways = costs[deepest - level].join(up, "parent_id").withColumn("goes_on", (F.col("dn") == F.col("up_dn")) & (F.col("head") == F.col("up_head")))
        ways = ways.filter(F.col("goes_on") | ((F.col("head") == F.col("node_id")) & (F.col("dn") < F.col("up_dn"))))
        chosen.append(ways.withColumn("r", F.row_number().over(order)).filter("r = 1").select("node_id", "dn", "head"))
    found = chosen[0]
    for c in chosen[1:]:
        found = found.unionByName(c)
    return tree.select("node_id").join(found.select("node_id", "dn"), "node_id", "left")
