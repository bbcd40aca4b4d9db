"""Ordering of linked rows by pointer doubling: chains and cycles of successors, and lines merged at their ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from pipeloom.shared import staged

ROUNDS = 64


def _doubled(state: DataFrame, join_two, label: str, cyclic: bool) -> DataFrame:
    """state (s, next, v) with v gathered over all successors; where `cyclic`, until v settles on every cycle."""
    sums = None
    for _ in range(ROUNDS):
        seen = Observation()
        state = staged(state.observe(seen, F.count("next").alias("open"), F.sum(F.xxhash64("s", "v").cast("decimal(38,0)")).alias("h")), label)
        now = seen.get
        if not now["open"] or cyclic and now == sums:
            return state
        sums = now
        hop = state.select(F.col("s").alias("next"), F.col("next").alias("next2"), F.col("v").alias("v2"))
        state = state.join(hop, "next", "left").select("s", F.col("next2").alias("next"), join_two(F.col("v"), F.col("v2")).alias("v"))
    raise RuntimeError("links did not settle")


def ranked_chains(links: DataFrame) -> DataFrame:
    """(s, chain, place, closed) of rows (s, next), next null at a chain's end, no two rows with one next.

    A chain is named by its last row, a cycle by its smallest, which comes first in it; places count from 0. Rounds grow with the
    logarithm of the longest chain.
    """
    links = staged(links.select("s", "next"), "links")
    low = _doubled(links.withColumn("v", F.col("s")), lambda a, b: F.least(a, b), "low", True)
    least = low.filter("next is not null").select("s", F.col("v").alias("least"))
    opened = links.join(least, "s", "left").select("s", F.when(F.col("next") != F.coalesce("least", F.lit(-1)), F.col("next")).alias("next"), "least")
    opened = staged(opened, "opened")
    end = F.when(F.col("next").isNull(), F.struct(F.lit(0).cast("long").alias("n"), F.col("s").alias("end"))).otherwise(F.struct(F.lit(1).cast("long").alias("n"), F.col("next").alias("end")))
    far = _doubled(opened.select("s", "next", end.alias("v")), lambda a, b: F.when(b.isNull(), a).otherwise(F.struct((a["n"] + b["n"]).alias("n"), b["end"].alias("end"))), "far", False)
    sizes = far.groupBy("v.end").agg(F.max("v.n").alias("most"))
    out = far.select("s", F.col("v.n").alias("n"), F.col("v.end").alias("end")).join(sizes, "end").join(opened.select("s", "least"), "s")
    return out.select("s", F.coalesce("least", "end").alias("chain"), (F.col("most") - F.col("n")).alias("place"), F.col("least").isNotNull().alias("closed"))


def directed_rings(pieces: DataFrame, key: str) -> DataFrame:
    """(key, ring, points) of directed edges (key, x1, y1, x2, y2) of which as many leave each point as enter it.

    Where several meet in a point, each goes on with the first to its left, so that rings touch but don't cross.
    """
    numbered = staged(pieces.select(key, "x1", "y1", "x2", "y2", F.monotonically_increasing_id().alias("s")), "pieces")
    ahead = F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))
    ins = numbered.select(key, F.col("x2").alias("x"), F.col("y2").alias("y"), "s", ahead.alias("a"))
    outs = numbered.select(key, F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("s").alias("next"), ahead.alias("b"))
    bend = F.pmod(F.col("b") - F.col("a") + F.pi(), 2 * F.pi())
    met = ins.join(outs, [key, "x", "y"]).withColumn("bend", bend)
    alone = met.groupBy(key, "x", "y").agg(F.collect_list(F.struct("bend", "s", "next")).alias("m"))  # the edges of one point
    taken = F.aggregate(
        F.sort_array("m", asc=False), F.array().cast("array<struct<s:bigint,next:bigint>>"),
        lambda acc, m: F.when(F.exists(acc, lambda t: (t["s"] == m["s"]) | (t["next"] == m["next"])), acc).otherwise(F.concat(acc, F.array(F.struct(m["s"].alias("s"), m["next"].alias("next"))))),
    )
    links = alone.select(F.explode(taken).alias("t")).select("t.s", "t.next")
    ranked = ranked_chains(numbered.select("s").join(links, "s", "left"))
    return numbered.join(ranked, "s").groupBy(key, F.col("chain").alias("ring")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x1", "y1"))), lambda p: F.struct(p["x1"].alias("x"), p["y1"].alias("y"))).alias("points"))


def merged_lines(lines: DataFrame) -> DataFrame:
    """(line, place, part, forward) of undirected parts (part, x1, y1, x2, y2): parts that meet end to end in a point of no others are one line.

    A line is named by its smallest part and, unless closed, runs the way that passes the smaller of its end parts first
    (or, of one part, as it stands). Parts of no length are left out; repeated parts close on each other.
    """
    lines = staged(lines.select(F.col("part").cast("long").alias("part"), "x1", "y1", "x2", "y2").filter("x1 <> x2 or y1 <> y2"), "parts")
    state = lambda f, a, b: lines.select((F.col("part") * 2 + f).alias("s"), *(F.col(f"{c}{n}").alias(o) for n, o in ((a, "f"), (b, "t")) for c, o in (("x", f"x{o}"), ("y", f"y{o}"))))
    states = staged(state(0, 1, 2).unionByName(state(1, 2, 1)), "states")
    pairs = states.groupBy("xf", "yf").agg(F.count("*").alias("n"), F.min("s").alias("one"), F.max("s").alias("two")).filter("n = 2")
    onward = states.join(pairs.select(F.col("xf").alias("xt"), F.col("yf").alias("yt"), "one", "two"), ["xt", "yt"], "left")
    back = F.col("s").bitwiseXOR(F.lit(1))
    links = onward.select("s", F.when(F.col("one") == back, F.col("two")).otherwise(F.col("one")).alias("next"))
    ranked = staged(ranked_chains(links), "ranked").withColumn("part", F.shiftright("s", 1))
    ways = ranked.groupBy("chain").agg(F.min("part").alias("line"), F.min_by("part", "place").alias("first"), F.min("s").alias("low"))
    ways = ways.groupBy("line").agg(F.min_by("chain", F.struct("first", "low")).alias("chain"))  # each line was found in both directions
    return ranked.join(ways, "chain").select("line", "place", "part", (F.col("s") % 2 == 0).alias("forward"))
