"""Costs over a raster of cells: tiles spread their costs inwards, and their borders to the tiles beside them, in rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipeloom.operators.polygons import boundary_hits, points_in
from pipeloom.shared import staged

TILE = 64
ROUNDS = 100_000
#: The cell beside, as rows and columns away, from which a step comes: its bit is its place here.
BESIDE = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]


@dataclass
class Raster:
    """Cells by row and column; cell (row, col) has its centre at (x0 + col * cell, y0 + row * cell)."""

    x0: float
    y0: float
    cell: float
    rows: int
    cols: int


def raster_over(x0: float, y0: float, x9: float, y9: float, cell: float = 2.0, most: int = 250_000, coarsest: float = 20.0) -> Raster:
    """A raster over a box; cells are made half as large again until there are at most `most`. Coarser than `coarsest` is an error."""
    while True:
        cols, rows = (max(2, math.ceil(w / cell) + 1) for w in (x9 - x0, y9 - y0))
        if rows * cols <= most:
            return Raster(x0, y0, cell, rows, cols)
        cell *= 1.5
        if cell > coarsest:
            raise ValueError("the box needs coarser cells")


def free_steps(spark: SparkSession, raster: Raster, zones: DataFrame, key: str = "key") -> DataFrame:
    """(row, col, steps): cells whose centre lies in no zone (edges of polygons), and bits of the neighbours in BESIDE from which a step enters without crossing a zone's boundary."""
    cells = spark.range(raster.rows * raster.cols).select(F.floor(F.col("id") / raster.cols).alias("row"), (F.col("id") % raster.cols).alias("col"))
    x, y = (lambda c: F.lit(raster.x0) + c * raster.cell), (lambda r: F.lit(raster.y0) + r * raster.cell)
    cells = staged(cells.withColumn("id", F.col("row") * raster.cols + F.col("col")).withColumn("x", x(F.col("col"))).withColumn("y", y(F.col("row"))), "cells")
    free = staged(cells.join(points_in(cells, zones, "id", key).select("id").distinct(), "id", "left_anti"), "free")
    half = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for k, (r, c) in enumerate(BESIDE)))).alias("b")
    ways = free.select("id", "row", "col", half).select("id", "row", "col", F.col("b.k").alias("k"), (F.col("row") + F.col("b.dr")).alias("r2"), (F.col("col") + F.col("b.dc")).alias("c2"))
    ways = ways.join(free.select(F.col("row").alias("r2"), F.col("col").alias("c2")), ["r2", "c2"])
    ways = staged(ways.select("id", "row", "col", "k", (F.col("id") * 8 + F.col("k")).alias("route_id"), x(F.col("col")).alias("ax"), y(F.col("row")).alias("ay"), x(F.col("c2")).alias("bx"), y(F.col("r2")).alias("by")), "steps")
    one_way = ways.filter("k in (0, 2, 4, 5)")  # the others are the same lines backwards
    cut = boundary_hits(one_way, zones, key).select("route_id").distinct().join(one_way, "route_id").select("id", "k", (F.col("id") + F.element_at(F.array(*(F.lit(r * raster.cols + c) for r, c in BESIDE)), F.col("k") + 1)).alias("other"))
    back = F.element_at(F.array(*(F.lit(BESIDE.index((-r, -c))) for r, c in BESIDE)), F.col("k") + 1)
    barred = cut.select("id", "k").unionByName(cut.select(F.col("other").alias("id"), back.alias("k")))
    open_ = ways.join(barred, ["id", "k"], "left_anti").groupBy("id").agg(F.sum(F.expr("shiftleft(1, k)")).cast("int").alias("steps"))
    return free.join(open_, "id", "left").select("row", "col", F.coalesce("steps", F.lit(0)).alias("steps"))


_TILE = "tr int, tc int, cost binary, steps binary, changed boolean"


def _packed(table: pa.Table) -> pa.Table:
    """The cells of a tile as arrays: costs, and the bits of steps."""
    t = {c: table.column(c).to_numpy() for c in ("tr", "tc", "row", "col", "steps")}
    cost, steps = np.full((TILE, TILE), np.inf), np.zeros((TILE, TILE), np.uint8)
    cost[t["row"] % TILE, t["col"] % TILE] = table.column("cost").to_numpy()
    steps[t["row"] % TILE, t["col"] % TILE] = t["steps"]
    return _row(int(t["tr"][0]), int(t["tc"][0]), cost, steps, bool(np.isfinite(cost).any()))


def _row(tr: int, tc: int, cost: np.ndarray, steps: np.ndarray, changed: bool) -> pa.Table:
    return pa.table({"tr": pa.array([tr], pa.int32()), "tc": pa.array([tc], pa.int32()), "cost": pa.array([cost.tobytes()], pa.binary()), "steps": pa.array([steps.tobytes()], pa.binary()), "changed": [changed]})


def _spread(cell: float):
    """A tile's costs with what its neighbours' borders add: every cell takes the least over its open steps until nothing falls."""

    def run(tile: pa.Table, borders: pa.Table) -> pa.Table:
        if not tile.num_rows:
            return tile
        old = np.frombuffer(tile.column("cost")[0].as_py()).reshape(TILE, TILE)
        steps = np.frombuffer(tile.column("steps")[0].as_py(), np.uint8).reshape(TILE, TILE)
        halo = np.full((TILE + 2, TILE + 2), np.inf)
        halo[1:-1, 1:-1] = old
        for r, c, values in zip(*(borders.column(n).to_pylist() for n in ("dr", "dc", "values"))):
            rows = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(TILE + 1, TILE + 2)}[r]
            cols = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(TILE + 1, TILE + 2)}[c]
            halo[rows, cols] = np.frombuffer(values).reshape(halo[rows, cols].shape)
        inner, going = halo[1:-1, 1:-1], True
        while going:
            before = inner.copy()
            for k, (r, c) in enumerate(BESIDE):
                from_there = halo[1 + r : TILE + 1 + r, 1 + c : TILE + 1 + c] + cell * math.hypot(r, c)
                np.minimum(inner, np.where(steps >> k & 1, from_there, np.inf), out=inner)
            going = bool((inner < before).any())
        return _row(tile.column("tr")[0].as_py(), tile.column("tc")[0].as_py(), inner, steps, bool((inner < old).any()))

    return run


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tile beside: the edge of this tile that it touches."""
    for batch in batches:
        out = []
        for tr, tc, packed in zip(*(batch.column(c).to_pylist() for c in ("tr", "tc", "cost"))):
            cost = np.frombuffer(packed).reshape(TILE, TILE)
            for r, c in BESIDE:
                edge = cost[{-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[r], {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}[c]]
                if np.isfinite(edge).any():
                    out.append({"tr": tr + r, "tc": tc + c, "dr": -r, "dc": -c, "values": np.ascontiguousarray(edge).tobytes()})
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("tr", pa.int32()), ("tc", pa.int32()), ("dr", pa.int32()), ("dc", pa.int32()), ("values", pa.binary())]))


def grid_costs(steps: DataFrame, starts: DataFrame, cell: float) -> DataFrame:
    """(row, col, cost): the least cost from starts (row, col, cost) to each cell of steps (row, col, steps), over its eight neighbours; cells out of reach are left out.

    A task holds a tile of TILE x TILE cells. A round costs one shuffle of borders; rounds follow the tiles along the longest
    way, not its cells.
    """
    begun = starts.groupBy("row", "col").agg(F.min("cost").cast("double").alias("cost"))
    placed = steps.join(begun, ["row", "col"], "left").withColumns({"cost": F.coalesce("cost", F.lit(float("inf"))), "tr": F.floor(F.col("row") / TILE).cast("int"), "tc": F.floor(F.col("col") / TILE).cast("int")})
    tiles = staged(placed.groupBy("tr", "tc").applyInArrow(_packed, _TILE), "tiles")
    for r in range(ROUNDS):
        borders = tiles.filter("changed").mapInArrow(_borders, "tr int, tc int, dr int, dc int, values binary")
        tiles = staged(tiles.groupBy("tr", "tc").cogroup(borders.groupBy("tr", "tc")).applyInArrow(_spread(cell), _TILE), "tiles")
        if tiles.filter("changed").isEmpty():
            break
    else:
        raise RuntimeError("costs did not settle")
    return tiles.mapInArrow(_unpacked, "row long, col long, cost double")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tr, tc, packed in zip(*(batch.column(c).to_pylist() for c in ("tr", "tc", "cost"))):
            cost = np.frombuffer(packed).reshape(TILE, TILE)
            r, c = np.nonzero(np.isfinite(cost))
            yield pa.RecordBatch.from_arrays([pa.array(r + tr * TILE), pa.array(c + tc * TILE), pa.array(cost[r, c])], names=["row", "col", "cost"])


def nearest_free(points: DataFrame, steps: DataFrame, raster: Raster, point_id: str, reach: int = 3) -> DataFrame:
    """(point_id, row, col): the free cell nearest to each point (x, y), of those up to `reach` rows and columns from its own; ties go to the lower row and column."""
    at = lambda c, lo: F.round((F.col(c) - lo) / raster.cell).cast("long")
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)))).alias("o")
    tried = points.select(point_id, "x", "y", around).select(point_id, "x", "y", (at("y", raster.y0) + F.col("o.i")).alias("row"), (at("x", raster.x0) + F.col("o.j")).alias("col"))
    off_x, off_y = F.col("x") - raster.x0 - F.col("col") * raster.cell, F.col("y") - raster.y0 - F.col("row") * raster.cell
    met = tried.join(steps.select("row", "col"), ["row", "col"]).withColumn("d2", off_x * off_x + off_y * off_y)
    return met.groupBy(point_id).agg(F.min(F.struct("d2", "row", "col")).alias("m")).select(point_id, "m.row", "m.col")
