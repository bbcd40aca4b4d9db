"""Routes merged to trees: a trie of their snapped corners, with cascades of chambers where more ways part than a chamber has ports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeloom.shared import staged

OUTLETS, CASCADE_STEP = 3, 2.0


@dataclass
class RouteTree:
    """nodes: node_id, parent_id, x, y, depth, kind (root, point, chamber, cascade, technical), n_routes; ends: route_id, node_id."""

    nodes: DataFrame
    ends: DataFrame


def merged_routes(routes: DataFrame, snap: float = 0.01, outlets: int = OUTLETS, step: float = CASCADE_STEP) -> RouteTree:
    """The tree of routes (route_id, points: array of (x, y) from the start on).

    Corners are snapped to a grid and corners that repeat the one before dropped; routes share a node as far as all their corners agree, so every
    route is a path of its tree and routes from one start are one tree. Node ids are 64-bit hashes of the corners up to there. Of a node with
    more than `outlets` ways on, chamber j of its cascade holds two of them (the last as many as it has outlets) in the order of their ids, and
    stands j steps along the first of its ways, or at its last centimetre. Routes without corners have no end.
    """
    point = lambda p: F.struct((F.round(p["x"] / snap) * snap).alias("x"), (F.round(p["y"] / snap) * snap).alias("y"))
    snapped = routes.select("route_id", F.transform("points", point).alias("p"))
    snapped = snapped.select("route_id", F.filter("p", lambda q, i: (i == 0) | (q != F.element_at("p", F.when(i == 0, 1).otherwise(i)))).alias("p")).filter("size(p) > 0")
    keys = F.transform("p", lambda q, i: F.xxhash64(F.slice("p", 1, i + 1)))
    steps = staged(snapped.select("route_id", "p", keys.alias("k")).select("route_id", F.size("p").alias("n"), "k", F.posexplode("p").alias("i", "q")), "steps")
    steps = steps.select("route_id", "n", "i", "q", F.element_at("k", F.col("i") + 1).alias("node_id"), F.try_element_at("k", F.when(F.col("i") > 0, F.col("i"))).alias("parent_id"))
    nodes = steps.groupBy("node_id").agg(F.first("parent_id").alias("parent_id"), F.first("q").alias("q"), F.first("i").alias("depth"), F.count("*").alias("n_routes"), F.bool_or(F.col("i") == F.col("n") - 1).alias("ends"))
    nodes = staged(nodes, "trie")
    ways = nodes.filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("ways"))
    told = nodes.join(ways.withColumnRenamed("parent_id", "node_id"), "node_id", "left")
    kind = F.when(F.col("depth") == 0, "root").when(F.col("ends"), "point").when(F.col("ways") > 1, "chamber").otherwise("technical")
    own = told.select("node_id", "parent_id", "q.x", "q.y", "depth", kind.alias("kind"), "n_routes")
    # ways on beyond a node's outlets
    full = ways.filter(F.col("ways") > outlets).withColumn("chambers", F.ceil((F.col("ways") - 1) / (outlets - 1)))
    placed = nodes.select("node_id", "parent_id", "q", "n_routes").join(full, "parent_id").withColumn("r", F.row_number().over(Window.partitionBy("parent_id").orderBy("node_id")) - 1)
    placed = placed.withColumn("j", F.least(F.floor(F.col("r") / (outlets - 1)), F.col("chambers") - 1)).join(nodes.select(F.col("node_id").alias("parent_id"), F.col("q").alias("o"), "depth"), "parent_id")
    placed = staged(placed, "cascades")
    cascade = lambda j: F.xxhash64(F.lit("cascade"), "parent_id", j)
    length = F.sqrt((F.col("q.x") - F.col("o.x")) * (F.col("q.x") - F.col("o.x")) + (F.col("q.y") - F.col("o.y")) * (F.col("q.y") - F.col("o.y")))
    share = F.greatest(F.lit(0.0), F.least(F.col("j") * step, length - 0.01)) / length
    first = placed.filter((F.col("j") > 0) & (F.col("r") == F.col("j") * (outlets - 1)))
    above = placed.groupBy("parent_id", "j").agg(F.sum("n_routes").alias("own")).withColumn("n", F.sum("own").over(Window.partitionBy("parent_id").orderBy(F.desc("j")))).select("parent_id", "j", "n")
    made = first.join(above, ["parent_id", "j"]).select(
        cascade(F.col("j")).alias("node_id"), F.when(F.col("j") == 1, F.col("parent_id")).otherwise(cascade(F.col("j") - 1)).alias("parent_id"),
        (F.col("o.x") + (F.col("q.x") - F.col("o.x")) * share).alias("x"), (F.col("o.y") + (F.col("q.y") - F.col("o.y")) * share).alias("y"), "depth", F.lit("cascade").alias("kind"), F.col("n").alias("n_routes"),
    )
    moved = placed.filter("j > 0").select("node_id", cascade(F.col("j")).alias("now"))
    hung = own.join(moved, "node_id", "left").withColumn("parent_id", F.coalesce("now", "parent_id")).drop("now")
    return RouteTree(staged(hung.unionByName(made), "routes"), steps.filter(F.col("i") == F.col("n") - 1).select("route_id", "node_id"))
