"""Grid joins of points, boxes and two-point routes: equal cells first, then the exact predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipeloom.operators.components import components
from pipeloom.shared import staged


def _cells(lo_x: Column, hi_x: Column, lo_y: Column, hi_y: Column, size: float) -> Column:
    xs = F.sequence(F.floor(lo_x / size), F.floor(hi_x / size))
    ys = F.sequence(F.floor(lo_y / size), F.floor(hi_y / size))
    return F.explode(F.flatten(F.transform(xs, lambda a: F.transform(ys, lambda b: F.struct(a.alias("cx_"), b.alias("cy_"))))))


def squared(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str) -> DataFrame:
    """Pairs of points (x, y) at most radius apart, with their squared distance d2; one row for each pair.

    Left points go to their own cell, right points to all cells that their square of this radius touches, so that each
    pair meets once and the work grows with the pairs in reach.
    """
    a = left.select(F.col(left_id), F.col("x").alias("ax"), F.col("y").alias("ay"))
    a = a.withColumn("cell", F.struct(F.floor(F.col("ax") / radius).alias("cx_"), F.floor(F.col("ay") / radius).alias("cy_")))
    b = right.select(F.col(right_id), F.col("x").alias("bx"), F.col("y").alias("by"))
    b = b.withColumn("cell", _cells(F.col("bx") - radius, F.col("bx") + radius, F.col("by") - radius, F.col("by") + radius, radius))
    d2 = squared(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return a.join(shuffled(b), "cell").withColumn("d2", d2).filter(F.col("d2") <= radius * radius).drop("cell")


def shuffled(rows: DataFrame) -> DataFrame:
    """Rows as a side of a join that is never broadcast: their size is guessed from few bytes, of packed files or from before they were spread over cells."""
    return rows.hint("merge")


def nearest(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """The nearest right point of each left point; ties go to the smaller id."""
    best = pairs.groupBy(left_id).agg(F.min(F.struct("d2", right_id)).alias("best"))
    return best.select(left_id, F.col(f"best.{right_id}").alias(right_id), F.col("best.d2").alias("d2"))


def _smallest(points: DataFrame, point_id: str, n: int) -> DataFrame:
    """Of the points at one place the n with the smallest ids."""
    kept, rest = None, points
    for _ in range(n):
        low = rest.groupBy("x", "y").agg(F.min(point_id).alias(point_id))
        kept = low if kept is None else kept.unionByName(low)
        rest = rest.join(shuffled(low.withColumnRenamed(point_id, "low_")), ["x", "y"]).filter(F.col(point_id) > F.col("low_")).drop("low_")
    return kept.select(point_id, "x", "y")


def _nearly(pairs: DataFrame, more: float, left_id: str, right_id: str) -> DataFrame:
    """Of the pairs those at most `more` further than their left point's nearest one."""
    least = F.min("d2").over(Window.partitionBy(left_id))
    return pairs.withColumn("least_", least).filter(F.sqrt("d2") <= F.sqrt("least_") + more).select(left_id, right_id, "d2")


def nearest_within(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str, others: bool = False, more: float | None = None) -> DataFrame:
    """The nearest right point of each left point that has one at most radius away, with d2; ties go to the smaller id; others: not the point of its own id;
    more: also all that are at most so much further, the smallest id of each place.

    The search begins at a radius with a few right points in reach where they are densest, and doubles it up to the given one for those that
    have found none, so the work follows the points, not the pairs in reach. What is found well inside a round's radius is the nearest of all.
    """
    right = staged(_smallest(right.select(right_id, "x", "y").filter("x is not null and y is not null"), right_id, 2 if others else 1), "right")
    waiting = staged(left.select(left_id, "x", "y").filter("x is not null and y is not null"), "waiting")
    densest = right.groupBy(F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)).count().agg(F.max("count")).first()[0] or 1
    halvings, found = max(0, int(densest).bit_length() // 2 - 1), None  # some three to a cell
    for k in range(halvings, -1, -1):
        reach = radius / 2**k
        pairs = within(waiting, right, reach, left_id, right_id)
        pairs = pairs.filter(F.col(left_id) != F.col(right_id)) if others else pairs
        got = nearest(pairs, left_id, right_id) if more is None else _nearly(pairs, more, left_id, right_id)
        well = reach - (more or 0.0)
        if k:
            got = got.filter(F.lit(well > 0) & (F.col("d2") < well * well * (1 - 1e-6)))
        got = staged(got, "nearest")
        found = got if found is None else found.unionByName(got)
        if k:
            waiting = staged(waiting.join(shuffled(got.select(left_id)), left_id, "left_anti"), "waiting")
            if waiting.isEmpty():
                break
    return found


def routes_met(routes: DataFrame, boxes: DataFrame, size: float = 50.0) -> DataFrame:
    """(route_id) of the routes (route_id, ax, ay, bx, by) of which some way, not a touch, lies in a box (cx, cy, half_w, half_h), each once.

    Boxes are tried in shares that double, the first with a few boxes to a cell where they are densest; routes that have met one are done, so the
    work follows the routes and the boxes, not the pairs that meet.
    """
    sides = ["cx", "cy", "half_w", "half_h"]
    boxes = staged(boxes.select(*sides).distinct().withColumn("h_", F.xxhash64(*sides)), "boxes")
    waiting, found = staged(routes.select("route_id", "ax", "ay", "bx", "by"), "ways"), None
    densest = boxes.groupBy(F.floor(F.col("cx") / size), F.floor(F.col("cy") / size)).count().agg(F.max("count")).first()[0] or 1
    halvings = max(0, int(densest).bit_length() - 4)
    for k in range(halvings, -1, -1):
        share = F.pmod("h_", F.lit(2**k)) == 0
        if k < halvings:
            share &= F.pmod("h_", F.lit(2 ** (k + 1))) != 0
        met = routes_in_boxes(waiting, boxes.filter(share).select(*sides), size).filter("enter < leave").select("route_id").distinct()
        met = staged(met, "met")
        found = met if found is None else found.unionByName(met)
        if k:
            waiting = staged(waiting.join(shuffled(met), "route_id", "left_anti"), "ways")
            if waiting.isEmpty():
                break
    return found


def boxes_around(points: DataFrame, boxes: DataFrame, point_id: str) -> DataFrame:
    """(point_id, n): how many boxes (cx, cy, half_w, half_h) hold each point (x, y), borders included; points that none holds have no row.

    Boxes are counted, not listed: a cell that lies well inside a box is counted with the cell, and only points of the cells along its border are
    compared with it. Cells have a few points where these are densest, so the pairs compared follow the boxes' outlines.
    """
    points = staged(points.select(point_id, "x", "y"), "points")
    densest = points.groupBy(F.floor(F.col("x") / 25), F.floor(F.col("y") / 25)).count().agg(F.max("count")).first()[0] or 1
    size = min(25.0, 50.0 / densest**0.5)
    cell = F.struct(F.floor(F.col("x") / size).alias("cx_"), F.floor(F.col("y") / size).alias("cy_"))
    spread_ = spread(boxes.select("cx", "cy", "half_w", "half_h"))
    lo, hi = ([F.col(f"c{c}") + s * F.col(f"half_{h}") for c, h in (("x", "w"), ("y", "h"))] for s in (-1, 1))
    spread_ = spread_.withColumn("cell", _cells(lo[0], hi[0], lo[1], hi[1], size))
    inner = F.lit(True)
    for c, low, high in zip(("cx_", "cy_"), lo, hi):
        inner &= (F.col(f"cell.{c}") * size >= low + 1e-6) & ((F.col(f"cell.{c}") + 1) * size <= high - 1e-6)
    whole = spread_.filter(inner).groupBy("cell").agg(F.count("*").alias("n"))
    placed = points.withColumn("cell", cell)
    along = placed.join(shuffled(spread_.filter(~inner)), "cell").filter((F.abs(F.col("x") - F.col("cx")) <= F.col("half_w")) & (F.abs(F.col("y") - F.col("cy")) <= F.col("half_h")))
    counted = along.groupBy(point_id).agg(F.count("*").alias("n")).unionByName(placed.join(shuffled(whole), "cell").select(point_id, "n"))
    return counted.groupBy(point_id).agg(F.sum("n").alias("n"))


def nearest_of_all(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str) -> DataFrame:
    """The nearest right point of every left point, at any distance: the radius doubles for those that have found none; ties go to the smaller id."""
    right = staged(right.select(right_id, "x", "y").filter("x is not null and y is not null"), "right")
    waiting = staged(left.select(left_id, "x", "y").filter("x is not null and y is not null"), "waiting")
    found = nearest_within(waiting, right, radius, left_id, right_id)
    if right.isEmpty():
        return found
    while True:
        waiting, radius = staged(waiting.join(shuffled(found.select(left_id)), left_id, "left_anti"), "waiting"), radius * 2
        if waiting.isEmpty():
            return found
        found = found.unionByName(staged(nearest(within(waiting, right, radius, left_id, right_id), left_id, right_id), "nearest"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, point_id: str, size: float = 25.0) -> DataFrame:
    """Points (x, y) with the boxes (cx, cy, half_w, half_h, other columns kept) that hold them, borders included."""
    a = points.withColumn("cell", F.struct(F.floor(F.col("x") / size).alias("cx_"), F.floor(F.col("y") / size).alias("cy_")))
    b = boxes.withColumn("cell", _cells(F.col("cx") - F.col("half_w"), F.col("cx") + F.col("half_w"), F.col("cy") - F.col("half_h"), F.col("cy") + F.col("half_h"), size))
    return a.join(shuffled(b), "cell").filter((F.abs(F.col("x") - F.col("cx")) <= F.col("half_w")) & (F.abs(F.col("y") - F.col("cy")) <= F.col("half_h"))).drop("cell")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly before each of its few bytes turns into much work: a number of partitions that adaptive execution leaves alone."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def micro(x: Column) -> Column:
    """x to six decimals, half up, in doubles only."""
    return F.floor(x * 1e6 + 0.5) / 1e6


def _cells_along(size: float, reach: float | Column) -> Column:
    """Cells within reach of the way from (ax, ay) to (bx, by): in each column those beside the way's part there."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    low, high = F.least("ax", "bx"), F.greatest("ax", "bx")
    columns = F.sequence(F.floor((low - reach) / size), F.floor((high + reach) / size))

    def column(c: Column) -> Column:
        x0, x1 = F.greatest(low, c * size - reach), F.least(high, (c + 1) * size + reach)
        y = lambda x: F.when(dx != 0, F.col("ay") + dy * ((x - F.col("ax")) / dx))
        y0, y1 = F.coalesce(y(x0), F.col("ay")), F.coalesce(y(x1), F.col("by"))
        rows = F.sequence(F.floor((F.least(y0, y1) - reach - 1e-6) / size), F.floor((F.greatest(y0, y1) + reach + 1e-6) / size))
        return F.transform(rows, lambda r: F.struct(c.alias("cx_"), r.alias("cy_")))

    return F.explode(F.flatten(F.transform(columns, column)))


def routes_in_boxes(routes: DataFrame, boxes: DataFrame, size: float = 50.0) -> DataFrame:
    """Pairs of a route (route_id, ax, ay, bx, by) and a box that it meets, with enter and leave, parameters in [0, 1]; one row for each pair.

    A box is in the cell of its centre alone, and a route goes to the cells within the largest half side of the boxes of a class of its way, so
    each pair meets once and the work follows the ways' lengths, not the area between their ends. Classes hold boxes up to a cell,
    two, four cells and so on in half side, so that a few large boxes don't widen the search for the others.
    """
    grade = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest("half_w", "half_h", F.lit(size)) / size))).cast("int")
    classes = boxes.groupBy(grade.alias("grade")).agg(F.max(F.greatest("half_w", "half_h")).alias("reach"))  # as many as doublings of a cell
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    a = spread(routes).crossJoin(F.broadcast(classes)).withColumn("cell", _cells_along(size, F.col("reach"))).drop("reach")
    b = boxes.withColumn("grade", grade).withColumn("cell", F.struct(F.floor(F.col("cx") / size).alias("cx_"), F.floor(F.col("cy") / size).alias("cy_")))
    way = {"x": dx, "y": dy}  # divided by the way, not multiplied by its inverse: that is a bit off, and a way through a corner would enter before it leaves
    ends = {c: [F.try_divide(F.col(f"c{c}") + s * F.col(f"half_{h}") - F.col(f"a{c}"), way[c]) for s in (-1, 1)] for c, h in (("x", "w"), ("y", "h"))}
    enter = F.greatest(F.lit(0.0), *(F.least(*ends[c]) for c in "xy"))  # nulls, of ways along an axis, are passed over
    leave = F.least(F.lit(1.0), *(F.greatest(*ends[c]) for c in "xy"))
    beside = [(way[c] == 0) & (F.abs(F.col(f"a{c}") - F.col(f"c{c}")) > F.col(f"half_{h}")) for c, h in (("x", "w"), ("y", "h"))]
    met = a.join(shuffled(b), ["grade", "cell"]).filter(~beside[0] & ~beside[1] & (enter <= leave))
    return met.withColumn("enter", enter).withColumn("leave", leave).drop("grade", "cell")


def crossings(routes: DataFrame, size: float = 50.0) -> DataFrame:
    """Pairs (a, b), a < b, of routes that properly cross: the ends of each lie strictly on either side of the other.

    Two ways may share cells; their pair is taken in the cell of the crossing alone, so pairs are not shuffled to be told apart.
    """
    spread_ = spread(routes).withColumn("cell", _cells_along(size, F.lit(0.0)))
    p = spread_.select("cell", *(F.col(c).alias(f"p_{c}") for c in ("route_id", "ax", "ay", "bx", "by")))
    q = spread_.select("cell", *(F.col(c).alias(f"q_{c}") for c in ("route_id", "ax", "ay", "bx", "by")))

    def side(o: str, x: str, y: str) -> Column:
        return (F.col(f"{o}_bx") - F.col(f"{o}_ax")) * (F.col(y) - F.col(f"{o}_ay")) - (F.col(f"{o}_by") - F.col(f"{o}_ay")) * (F.col(x) - F.col(f"{o}_ax"))

    cross = (side("p", "q_ax", "q_ay") * side("p", "q_bx", "q_by") < 0) & (side("q", "p_ax", "p_ay") * side("q", "p_bx", "p_by") < 0)
    t = side("q", "p_ax", "p_ay") / (side("q", "p_ax", "p_ay") - side("q", "p_bx", "p_by"))  # of different signs, so in [0, 1]
    low, high = (F.greatest(F.least("p_ax", "p_bx"), F.least("q_ax", "q_bx")), F.least(F.greatest("p_ax", "p_bx"), F.greatest("q_ax", "q_bx")))
    x, y = F.least(F.greatest(F.col("p_ax") + t * (F.col("p_bx") - F.col("p_ax")), low), high), F.col("p_ay") + t * (F.col("p_by") - F.col("p_ay"))  # in columns of both
    here = (F.floor(x / size) == F.col("cell.cx_")) & (F.floor(y / size) == F.col("cell.cy_"))
    return p.join(shuffled(q), "cell").filter((F.col("p_route_id") < F.col("q_route_id")) & cross).filter(here).select(F.col("p_route_id").alias("a"), F.col("q_route_id").alias("b"))


def elementary_pieces(spans: DataFrame, key: str, levels: list[float]) -> DataFrame:
    """Cuts overlapping spans (key, lo, hi, k) at all bounds and gives each piece the largest k over it; gaps have no piece.

    levels: the values that k takes. A bound changes how many spans of each level are open; their running sums tell the
    largest one, in one pass over the sorted bounds of a key.
    """
    opened = [F.when(F.col("k") == k, 1).otherwise(0) for k in levels]
    bound = lambda c, sign: F.struct(F.col(c).alias("at"), F.array(*(sign * o for o in opened)).alias("d"))
    bounds = spans.select(key, F.explode(F.array(bound("lo", 1), bound("hi", -1))).alias("b")).groupBy(key, F.col("b.at").alias("at"))
    bounds = bounds.agg(*(F.sum(F.col("b.d")[i]).alias(f"_d{i}") for i in range(len(levels))))
    here = Window.partitionBy(key).orderBy("at")
    open_ = bounds.select(key, "at", F.lead("at").over(here).alias("stop"), *(F.sum(f"_d{i}").over(here).alias(f"_n{i}") for i in range(len(levels))))
    largest = F.greatest(F.lit(None).cast("double"), *(F.when(F.col(f"_n{i}") > 0, F.lit(float(k))) for i, k in enumerate(levels)))
    return open_.select(key, "at", "stop", largest.alias("k")).filter("stop is not null and k is not null")


def clusters(points: DataFrame, radius: float, point_id: str) -> DataFrame:
    """(point, group_id): points joined over gaps of radius at most; the group's smallest point names it.

    Points of one cell of side radius / sqrt(2) are one group by themselves, so cells are linked, not points: two cells within
    reach first by the points of each that are nearest to the other's centre; all points of two cells are compared only
    where that leaves them in different groups.
    """
    side = radius / 2**0.5 * (1 - 1e-9)
    cell = F.struct(F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"))
    placed = spread(points.select(F.col(point_id).alias("p"), "x", "y", cell.alias("c")))
    placed = staged(placed.join(placed.groupBy("c").agg(F.min("p").alias("low")), "c"), "placed")
    ahead = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)]
    toward = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ahead))).alias("o")
    gap = squared(F.col("x"), F.col("y"), (F.col("c.cx") + F.col("o.i") + 0.5) * side, (F.col("c.cy") + F.col("o.j") + 0.5) * side)
    ends = staged(placed.select("p", "x", "y", "low", "c", toward).groupBy("c", "o", "low").agg(F.min_by("x", gap).alias("x"), F.min_by("y", gap).alias("y")).select("c", "o", "low", F.struct("x", "y").alias("e")), "ends")  # of plain numbers, which are kept in a hash table; structs would be sorted
    back = ends.select(F.struct((F.col("c.cx") + F.col("o.i")).alias("cx"), (F.col("c.cy") + F.col("o.j")).alias("cy")).alias("c"), F.struct((-F.col("o.i")).alias("i"), (-F.col("o.j")).alias("j")).alias("o"), F.col("low").alias("low2"), F.col("e").alias("e2"), F.col("c").alias("c2"))
    pairs = ends.join(back, ["c", "o"]).filter("low < low2")
    near = squared(F.col("e.x"), F.col("e.y"), F.col("e2.x"), F.col("e2.y")) <= radius * radius
    pairs = staged(pairs.select("low", "low2", near.alias("near")), "cells")
    first = components(pairs.filter("near"), "low", "low2")
    of = lambda c: first.select(F.col("node").alias(c), F.col("component_id").alias(f"{c}_group"))
    open_ = pairs.filter("not near").join(of("low"), "low", "left").join(of("low2"), "low2", "left").filter(F.coalesce("low_group", "low") != F.coalesce("low2_group", "low2")).select("low", "low2")
    a, b = (placed.select(F.col("low").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}")) for n in ("low", "low2"))
    met = open_.join(a, "low").join(b, "low2").filter(squared(F.col("xlow"), F.col("ylow"), F.col("xlow2"), F.col("ylow2")) <= radius * radius).select("low", "low2").distinct()
    met = staged(met, "met")
    whole = first if met.isEmpty() else components(pairs.filter("near").select("low", "low2").unionByName(met), "low", "low2")
    whole = whole.withColumnRenamed("node", "low")
    return placed.join(whole, "low", "left").select(F.col("p").alias(point_id), F.coalesce("component_id", "low").alias("group_id"))
