"""Costs over rasters against a queue."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from pipeloom.operators import raster
from pipeloom.operators.polygons import ring_edges
from pipeloom.operators.raster import BESIDE, Raster, free_steps, grid_costs, nearest_free, raster_over


def queue(steps, starts, cell):
    best, heap = {}, [(c, *at) for at, c in starts.items() if at in steps]
    heapq.heapify(heap)
    while heap:
        cost, r, c = heapq.heappop(heap)
        if (r, c) in best:
            continue
        best[r, c] = cost
        for k, (dr, dc) in enumerate(BESIDE):  # a step from here enters the cell that has this one beside it
            to = (r - dr, c - dc)
            if to in steps and steps[to] >> k & 1 and to not in best:
                heapq.heappush(heap, (cost + cell * math.hypot(dr, dc), *to))
    return best


def test_costs_equal_a_queue(spark):
    draw = random.Random(3)
    steps = {(r, c): draw.choice([255, 255, draw.randrange(256)]) for r in range(150) for c in range(140) if draw.random() < 0.8}
    starts = {(0, 0): 3.0, (149, 139): 0.0, (70, 70): 50.0, (3, 3): 0.0}
    table = spark.createDataFrame([(*k, v) for k, v in steps.items()], "row long, col long, steps int")
    begun = spark.createDataFrame([(*k, v) for k, v in starts.items()] + [(0, 0, 9.0)], "row long, col long, cost double")
    got = {(r.row, r.col): r.cost for r in grid_costs(table, begun, 2.5).collect()}
    want = queue(steps, starts, 2.5)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert grid_costs(table, begun.limit(0), 1.0).count() == 0


def test_cells_grow_until_they_fit():
    assert raster_over(0, 0, 100, 100) == Raster(0, 0, 2.0, 51, 51)
    big = raster_over(0, 0, 3000, 3000)
    assert big.cell == 2.0 * 1.5**3 and big.rows * big.cols <= 250_000 < (math.ceil(3000 / 4.5) + 1) ** 2
    with pytest.raises(ValueError):
        raster_over(0, 0, 1e6, 1e6)


def test_steps_and_ways_around_a_wall(spark):
    wall = spark.createDataFrame([(1, [[{"x": x, "y": y} for x, y in ((9.5, -5.0), (10.5, -5.0), (10.5, 15.5), (9.5, 15.5))]]), (2, [[{"x": x, "y": y} for x, y in ((4.2, 4.2), (4.8, 4.2), (4.8, 4.8), (4.2, 4.8))]])], "key long, rings array<array<struct<x:double,y:double>>>")
    grid = Raster(0.0, 0.0, 1.0, 21, 21)
    steps = free_steps(spark, grid, ring_edges(wall)).cache()
    got = {(r.row, r.col): r.steps for r in steps.collect()}
    assert set(got) == {(r, c) for r in range(21) for c in range(21)} - {(r, 10) for r in range(16)}
    assert got[5, 5] & 1 << BESIDE.index((-1, -1)) == 0 and got[4, 4] & 1 << BESIDE.index((1, 1)) == 0 and got[5, 5] & 1 << BESIDE.index((0, -1))  # a small block between two diagonal centres
    cost = {(r.row, r.col): r.cost for r in grid_costs(steps, spark.createDataFrame([(0, 9, 0.0)], "row long, col long, cost double"), 1.0).collect()}
    assert abs(cost[0, 11] - (30 + 2 * math.sqrt(2))) < 1e-9 or cost[0, 11] > 30
    near = nearest_free(spark.createDataFrame([(1, 10.1, 3.0), (2, 0.2, 0.2), (3, 500.0, 0.0)], "p long, x double, y double"), steps, grid, "p").collect()
    assert {(r.p, r.row, r.col) for r in near} == {(1, 3, 11), (2, 0, 0)}
