"""Operators over polylines, given as vertices (line_id, seq, x, y): edges with chainage, projection, samples and sublines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipeloom.operators.spatial import _cells_along, shuffled, spread
from pipeloom.shared import staged


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def edges(vertices: DataFrame) -> DataFrame:
    """(line_id, seq, ax, ay, bx, by, len, start, stop): each line's edges with the metres before and after them."""
    here = Window.partitionBy("line_id").orderBy("seq")
    out = vertices.select("line_id", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(here).alias("bx"), F.lead("y").over(here).alias("by")).filter("bx is not null")
    out = out.withColumn("len", distance(*(F.col(c) for c in ("ax", "ay", "bx", "by"))))
    before = F.coalesce(F.sum("len").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return out.withColumn("start", before).withColumn("stop", F.col("start") + F.col("len"))


def along(at: Column) -> tuple[Column, Column]:
    """The point of an edge that lies `at` metres along its line."""
    t = F.when(F.col("len") > 0, (at - F.col("start")) / F.col("len")).otherwise(F.lit(0.0))
    return F.col("ax") + (F.col("bx") - F.col("ax")) * t, F.col("ay") + (F.col("by") - F.col("ay")) * t


def to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The share of the segment at which its nearest point to (px, py) lies, and their squared distance."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size))).otherwise(F.lit(0.0))
    x, y = px - ax - dx * t, py - ay - dy * t  # from the segment's start, so that metres, not coordinates, are rounded
    return t, x * x + y * y


def project(points: DataFrame, line_edges: DataFrame, radius: float, point_id: str, size: float = 25.0, others: bool = False) -> DataFrame:
    """(point, line_id, at, d, px, py): of each line within radius of a point its nearest place; the first such edge on ties; others: not on the line of its own id."""
    a = points.withColumn("cell", F.struct(F.floor(F.col("x") / size).alias("cx_"), F.floor(F.col("y") / size).alias("cy_")))
    b = spread(line_edges).withColumn("cell", _cells_along(size, F.lit(radius)))
    t, d2 = to_segment(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    met = a.join(shuffled(b), "cell")
    met = (met.filter(F.col(point_id) != F.col("line_id")) if others else met).withColumn("t", t).withColumn("d2", d2).filter(F.col("d2") <= radius * radius)
    place = F.struct(F.round("d2", 9).alias("d2"), "seq", (F.col("start") + F.col("t") * F.col("len")).alias("at"), (F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("t")).alias("px"), (F.col("ay") + (F.col("by") - F.col("ay")) * F.col("t")).alias("py"))
    best = met.groupBy(point_id, "line_id").agg(F.min(place).alias("p"))
    return best.select(point_id, "line_id", F.col("p.at").alias("at"), F.sqrt("p.d2").alias("d"), F.col("p.px").alias("px"), F.col("p.py").alias("py"))


def growing_reaches(line_edges: DataFrame, radius: float, n: int) -> list[tuple[float, float]]:
    """Radii to look for n lines within, each with a cell size for it: the first has some eight for each asked for in reach where lines are densest, the last is radius."""
    middle = [F.floor((F.col(f"a{c}") + F.col(f"b{c}")) / 2 / radius) for c in "xy"]
    metres = line_edges.groupBy(*middle).agg(F.sum("len").alias("m")).agg(F.max("m")).first()[0] or 0.0
    thick = max(metres / radius**2, 1e-6)  # metres of line to a square metre; a strip of reach r on both sides meets 2 * r * thick lines
    reach, out = 4 * n / thick, []
    while reach < radius:
        out.append(reach)
        reach *= 4
    return [(r, min(25.0, max(2 * r, 48 / thick))) for r in [*out, radius]]


def growing_rays(points: DataFrame, length: float) -> list[float]:
    """Lengths of rays from points: the first as far as points are apart where they are densest, the last is length."""
    densest = points.groupBy(*(F.floor(F.col(c) / length) for c in "xy")).count().agg(F.max("count")).first()[0] or 1
    reach, out = length / densest**0.5, []
    while reach < length:
        out.append(reach)
        reach *= 4
    return [*out, length]


def nearest_lines(points: DataFrame, line_edges: DataFrame, radius: float, point_id: str, n: int = 1, others: bool = False) -> DataFrame:
    """The n nearest lines within radius of each point as project gives them, with their place from 1 on; ties, to six decimals, go to the smaller line_id.

    A point that has found n lines well inside a round's radius is done; the others look further, so the work follows the points, not the pairs in reach.
    """
    line_edges, waiting, found = staged(line_edges, "edges"), staged(points.filter("x is not null and y is not null"), "waiting"), None
    for reach, size in growing_reaches(line_edges, radius, n):
        near = project(waiting, line_edges, reach, point_id, size, others)
        first = near.withColumn("place", F.row_number().over(Window.partitionBy(point_id).orderBy(F.round("d", 6), "line_id"))).filter(F.col("place") <= n)
        if reach < radius:
            whole = F.max("d").over(Window.partitionBy(point_id)) < reach - 1e-5
            first = first.withColumn("whole", whole & (F.count("*").over(Window.partitionBy(point_id)) == n)).filter("whole").drop("whole")
        first = staged(first, "nearest")
        found = first if found is None else found.unionByName(first)
        if reach < radius:
            waiting = staged(waiting.join(shuffled(first.select(point_id).distinct()), point_id, "left_anti"), "waiting")
            if waiting.isEmpty():
                break
    return found


def samples(line_edges: DataFrame, step: float) -> DataFrame:
    """(line_id, k, x, y): points every step metres from each line's start on."""
    first, last = F.ceil(F.col("start") / step), F.ceil(F.col("stop") / step) - 1
    out = line_edges.filter(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    x, y = along(F.col("k") * step)
    return out.select("line_id", "k", x.alias("x"), y.alias("y"))


def subline(line_edges: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """The parts of the edges between lo and hi metres along their lines, with interpolated ends."""
    out = line_edges.withColumn("from", F.greatest(F.col("start"), lo)).withColumn("to", F.least(F.col("stop"), hi)).filter(F.col("from") < F.col("to"))
    (x0, y0), (x1, y1) = along(F.col("from")), along(F.col("to"))
    return out.select("line_id", "seq", "from", "to", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def spaced(values: Column, least: float) -> Column:
    """Of an ascending array those at least `least` beyond the last one kept."""
    return F.aggregate(values, F.slice(values, 1, 1), lambda kept, v: F.when(v - F.element_at(kept, -1) >= least, F.concat(kept, F.array(v))).otherwise(kept))


def islands(spans: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi): spans of a key that overlap or touch are one."""
    order = Window.partitionBy(key).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.coalesce(F.col("lo") > reach, F.lit(True)).cast("int"))
    return fresh.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def _peucker(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[int]:
    kept, open_spans = {0, len(x) - 1}, [(0, len(x) - 1)]
    while open_spans:
        i, j = open_spans.pop()
        if j - i < 2:
            continue
        dx, dy = x[j] - x[i], y[j] - y[i]
        size = dx * dx + dy * dy
        t = np.clip(((x[i + 1 : j] - x[i]) * dx + (y[i + 1 : j] - y[i]) * dy) / size, 0, 1) if size > 0 else np.zeros(j - i - 1)
        d = np.hypot(x[i + 1 : j] - x[i] - dx * t, y[i + 1 : j] - y[i] - dy * t).round(9)
        if d.max() > tolerance:
            k = i + 1 + int(d.argmax())
            kept.add(k)
            open_spans += [(i, k), (k, j)]
    return sorted(kept)


def simplified(vertices: DataFrame, tolerance: float) -> DataFrame:
    """The vertices that Douglas and Peucker's method keeps; a line is one row of arrays, as it is one object of a source."""
    lines = vertices.groupBy("line_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("v"))

    @F.pandas_udf("array<int>")
    def kept(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_peucker(np.asarray(a), np.asarray(b), tolerance) for a, b in zip(x, y)])

    lines = lines.withColumn("kept", kept(F.col("v.x"), F.col("v.y"))).select("line_id", "v", F.explode("kept").alias("i"))
    return lines.select("line_id", F.expr("v[i].seq").alias("seq"), F.expr("v[i].x").alias("x"), F.expr("v[i].y").alias("y"))
