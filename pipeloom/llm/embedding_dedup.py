"""Embedding near-duplicates by collision-counting projections.

Vectors of equal label are spread over cells of a few random projections each, in several tables, so that a pair at the
cosine bound shares a cell in some table but for MISS of cases. The number of projections of a cell grows with the
logarithm of the largest label's vectors, so that cells stay small. In its cell a vector asks for those within a window
around its own value on each of COUNTED further projections. The first, in sorted order, gives the partners within
REACH, which a pair at the bound exceeds in MISS of cases; of all projections, the first with the others, a pair must
collide on as many as a pair at the bound does but for MISS of cases. Values are counted in steps of STEP, a byte each:
a window is at least WINDOW wide and at most a step wider, so no collision is lost. Such pairs are
verified by their cosine in double precision, each in the first table that brings it together.

Copies (equal vectors of one label) are one node. Cells are cut into blocks, pairs of blocks are groups, and a group
returns sums and a spanning forest of its links, not the links. Vectors that are null, empty, zero or hold null or
non-finite components, and those with a null label, link with nothing; vectors of unequal length don't link; repeated
rows are copies, and different vectors under one vec_id are linked and counted apart. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pipeloom.llm.words import mix
from pipeloom.operators.components import components
from pipeloom.shared import staged

COUNTED, MISS = 24, 1e-7
CELL_WIDTH, WINDOW = 8.0, 3.0  # in standard deviations of a projected difference at the bound
REACH = NormalDist().inv_cdf(1 - MISS / 2)
STEP = 0.5
BLOCK = 2048


def _plan(n: int) -> tuple[int, int, int]:
    """Projections of a cell, tables, and collisions needed, from the number of vectors of a label and MISS."""
    per_cell = min(12, max(3, round(math.log2(max(n, 2)) / 2)))
    near = (1 - math.sqrt(2 / math.pi) / CELL_WIDTH) ** per_cell
    tables = math.ceil(math.log(MISS) / math.log(1 - near))
    hit = math.erf(WINDOW / math.sqrt(2))
    missed, need = 0.0, 0
    for k in range(COUNTED + 1):
        missed += math.comb(COUNTED, k) * hit**k * (1 - hit) ** (COUNTED - k)
        if missed > MISS:
            break
        need = k + 1
    return per_cell, tables, need


def _directions(dim: int, many: int, seed: int) -> np.ndarray:
    """Random directions, scaled so that a difference of norm 1 projects to standard deviation 1."""
    return np.random.default_rng(seed + dim).normal(size=(dim, many))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1)[:, None]


def _by_length(vectors: list[bytes], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(v) for v in vectors])
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        yield rows, np.frombuffer(b"".join(vectors[i] for i in rows), kind).reshape(len(rows), -1).astype(np.float64)


def _packed(kind: str):
    """Vectors as bytes of their own precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(v, kind).tobytes() for v in batch.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "copies")), pa.array(packed, pa.binary())], names=["id", "label", "copies", "vector"])

    return run


def _cells(distance: float, per_cell: int, tables: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            keys = np.zeros((len(vectors), tables), np.uint64)
            for rows, x in _by_length(vectors, kind):
                spots = _unit(x) @ _directions(x.shape[1], per_cell * tables, 1) / distance
                shift = np.random.default_rng(2).uniform(0, CELL_WIDTH, per_cell * tables)
                spots = np.floor((spots + shift) / CELL_WIDTH).astype(np.int64).astype(np.uint64).reshape(len(rows), tables, per_cell)
                part = np.full((len(rows), tables), np.uint64(x.shape[1]))
                for k in range(per_cell):
                    part = mix(part * np.uint64(3) + spots[:, :, k])
                keys[rows] = part
            short = pa.array([k.tobytes() for k in (keys >> np.uint64(32)).astype("<u4")], pa.binary())  # enough to tell which tables a pair shares
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())), short], names=[*batch.schema.names, "cells", "short"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _count(cosine: float, distance: float, need: int, kind: str):
    """Of two blocks of one cell: each vector's links (by copies), and its component's smallest vector among these."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids = t.column("id").to_numpy()
        x = _unit(np.frombuffer(b"".join(t.column("vector").to_pylist()), kind).reshape(len(ids), -1).astype(np.float64))
        spots = x @ _directions(x.shape[1], COUNTED, 7) / distance
        order = np.lexsort((ids, spots[:, 0]))
        ids, x, spots = ids[order], x[order], spots[order]
        steps = np.ascontiguousarray(np.clip(np.floor(spots / STEP), -63, 63).astype(np.int8).T)  # differences fit a byte; the ends only draw values together
        width = math.ceil(WINDOW / STEP)
        copies, block = t.column("copies").to_numpy()[order], t.column("block").to_numpy()[order]
        cells = np.frombuffer(b"".join(t.column("short").to_pylist()), "<u4").reshape(len(ids), -1)[order]
        place, bi, bj = (t.column(c)[0].as_py() for c in ("place", "bi", "bj"))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        stop = np.searchsorted(spots[:, 0], spots[:, 0] + REACH * 1.0001, "right")
        for s in range(0, len(ids), 64):
            e = min(s + 64, len(ids))
            end = int(stop[e - 1])
            met = np.zeros((e - s, end - s), np.uint8)
            apart = np.empty(met.shape, np.int8)
            for k in range(COUNTED):
                np.subtract(steps[k, s:e, None], steps[k, None, s:end], out=apart)
                np.abs(apart, out=apart)
                met += apart <= width
            i, j = np.nonzero(np.triu(met >= need, 1))
            i, j = i + s, j + s
            if bi != bj:
                i, j = i[block[i] != block[j]], j[block[i] != block[j]]
            first = np.argmax(cells[i] == cells[j], axis=1) == place
            i, j = i[first], j[first]
            close = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            left.append(i[close])
            right.append(j[close])
        i, j = np.concatenate(left), np.concatenate(right)
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        low = ids[by_id][_roots(len(ids), rank[i], rank[j])][rank]
        some = links > 0
        return pa.Table.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(low[some])], names=["id", "links", "low"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).cast("string").alias("label"))
    huge = F.lit(float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
    sound &= F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < huge)) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False))).withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64("vector", "label", F.lit(1)))
    nodes = rows.filter("sound").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.first("label").alias("label"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    # numbered in the order of their smallest vec_id, which different vectors may share
    nodes = staged(nodes.repartitionByRange("least", "h1").sortWithinPartitions("least", "h1", "h2").withColumn("id", F.monotonically_increasing_id()), "nodes")
    kind = "<f4" if rows.schema["vector"].dataType == ArrayType(FloatType(), rows.schema["vector"].dataType.containsNull) else "<f8"
    per_cell, tables, need = _plan(nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    distance = math.sqrt(2 - 2 * cosine)
    packed = nodes.select("id", "label", "copies", "vector").mapInArrow(_packed(kind), "id long, label string, copies long, vector binary")
    spread = staged(packed.mapInArrow(_cells(distance, per_cell, tables, kind), "id long, label string, copies long, vector binary, cells array<long>, short binary"), "cells")
    keys = spread.select("id", "label", F.posexplode("cells").alias("place", "cell"))
    full = keys.groupBy("label", "place", "cell").agg(F.count("*").alias("n")).filter("n > 1").select("label", "place", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = keys.join(full, ["label", "place", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "place", "cell", "id", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    found = dealt.join(spread.select("id", "copies", "vector", "short"), "id").groupBy("label", "place", "cell", "bi", "bj").applyInArrow(_count(cosine, distance, need, kind), "id long, links long, low long")
    found = staged(found, "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.filter("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
    comp = comp.join(nodes.select(F.col("id").alias("component_id"), F.col("least").alias("c")), "component_id").select(F.col("node").alias("id"), "c")
    known = nodes.select("h1", "h2", "id", "least", "copies").join(counts, "id", "left").join(comp, "id", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("c", "least").alias("c"))
    out = rows.select("vec_id", "sound", "h1", "h2").join(known, ["h1", "h2"], "left")
    own = F.when(F.col("sound"), F.coalesce("c", "vec_id")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.when(F.col("sound"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
