"""Embedding whitening by a bidiagonal qd solver.

Entries become integers, floor(scale * c), and each distinct vector counts once. Blocks of centred rows are reduced to
triangles by QR, triangles are merged in a tree to one R, and R is brought to bidiagonal form by Householder
reflections. dqds finds its singular values to high relative accuracy, twisted factorisations of the bidiagonal's qd
representation the directions. An eigenvalue of the covariance is a squared singular value over the number of vectors.

Sums are exact integers, centring is exact before it is rounded once. Rows whose vector is null or holds null or
non-finite entries are dropped. Vectors of different lengths are whitened apart; components without variance (a single
distinct vector, empty vectors, constant or dependent dimensions) have no rows. Repeated rows and null ids keep their
rows. A deviation beyond 64 bits is null. An empty table gives an empty result; other columns are not read. Memory: a task
holds a batch and one triangle of a length; the driver holds (components + 3) numbers for each dimension of at most
LENGTHS_AT_ONCE dimensions in all, or of one length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeloom.shared import staged

FAN_IN = 16
BLOCK_BYTES = 8 << 20
LENGTHS_AT_ONCE = 1 << 20
_EPS = np.finfo(float).eps
_LOW = (1 << 32) - 1


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and the right rotation p of q.T @ r @ p, by Householder reflections."""
    r, n = r.copy(), r.shape[1]
    p = np.eye(n)

    def mirror(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            return None
        v = x / size
        v[0] += math.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        if (v := mirror(r[k:, k].copy())) is not None:
            r[k:, k:] -= 2 * np.outer(v, v @ r[k:, k:])
        if k < n - 2 and (v := mirror(r[k, k + 1 :].copy())) is not None:
            r[k:, k + 1 :] -= 2 * np.outer(r[k:, k + 1 :] @ v, v)
            p[:, k + 1 :] -= 2 * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(r).copy(), np.diag(r, 1).copy(), p


def _pass(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float, float] | None:
    """One dqds transform: new q and e, the smallest d and the sum of 1 / d; None if the shift is too large."""
    d, least, inverse = q[0] - shift, math.inf, 0.0
    nq, ne = [], []
    for i in range(len(e)):
        if d < 0 or d != d:
            return None
        least = min(least, d)
        inverse += 1 / d if d > 0 else math.inf
        top = d + e[i]
        nq.append(top)
        if top == 0:
            ne.append(0.0)
            d = q[i + 1] - shift
        else:
            ratio = q[i + 1] / top
            ne.append(e[i] * ratio)
            d = d * ratio - shift
    if d < 0 or d != d:
        return None
    nq.append(d)
    return nq, ne, min(least, d), inverse + (1 / d if d > 0 else math.inf)


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix by dqds, largest first."""
    top = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if top == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    heap = [([float(x) for x in (diagonal / top) ** 2], [float(x) for x in (above / top) ** 2], 0.0)]
    tiny = (16 * _EPS) ** 2
    while heap:
        q, e, moved = heap.pop()
        guess = 0.0
        while True:
            if len(q) == 1:
                found.append(max(0.0, q[0]) + moved)
                break
            if e[-1] <= tiny * (moved + q[-1]) or e[-1] < 1e-300:
                found.append(max(0.0, q[-1]) + moved)
                q, e = q[:-1], e[:-1]
                continue
            cut = next((i for i in range(len(e) - 1) if e[i] <= tiny * (moved + min(q[i], q[i + 1])) or e[i] < 1e-300), None)
            if cut is not None:
                heap += [(q[: cut + 1], e[:cut], moved), (q[cut + 1 :], e[cut + 1 :], moved)]
                break
            if q[0] * 1.5 < q[-1]:
                q, e = q[::-1], e[::-1]
            done = _pass(q, e, guess) if guess > 0 else None
            used = guess if done is not None else 0.0
            if done is None:
                done = _pass(q, e, 0.0)
                if done is None:
                    raise ArithmeticError("dqds broke down")
            q, e, least, inverse = done
            moved += used
            bound = 1 / inverse if inverse > 0 and math.isfinite(inverse) else 0.0
            # the inverse of the sum is no more than the smallest value, the smallest d no less; towards the end they meet
            guess = bound if bound > 0.5 * least else 0.9 * bound + 0.1 * least * (least < 8 * bound)
            if done[2] != least or used == 0.0 and bound == 0.0:
                guess = 0.0
    return np.sort(np.array(found))[::-1] * top * top


def twisted_vector(diagonal: np.ndarray, above: np.ndarray, value: float) -> np.ndarray:
    """Unit right singular vector of an upper bidiagonal matrix for a squared singular value, from its twisted factorisation."""
    q, e, cross, n = diagonal**2, above**2, diagonal[:-1] * above, len(diagonal)
    tiny = max(q.max(), value) * _EPS * _EPS + 1e-300
    keep = lambda x: x if abs(x) > tiny else tiny
    s, down = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        pivot = keep(s[i] + q[i])
        down[i] = cross[i] / pivot
        s[i + 1] = e[i] / pivot * s[i] - value
    p, up = np.empty(n), np.empty(max(n - 1, 0))
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = keep(e[i] + p[i + 1])
        up[i] = cross[i] / pivot
        p[i] = p[i + 1] * q[i] / pivot - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def principal(r: np.ndarray, n: int, many: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Up to `many` largest eigenvalues of r.T @ r / n, their unit vectors as rows, and the trace."""
    trace = float((r * r).sum()) / n
    if not r.size or trace == 0:
        return np.zeros(0), np.zeros((0, r.shape[1])), 0.0
    diagonal, above, p = bidiagonal(r)
    values = squared_singular_values(diagonal, above)
    values = values[values > values[0] * (len(values) * _EPS) ** 2][:many]
    vectors: list[np.ndarray] = []
    square = np.diag(diagonal) + np.diag(above, 1)
    for k, value in enumerate(values):
        z = twisted_vector(diagonal, above, value)
        close = [v for v, other in zip(vectors, values[:k]) if other - value <= 1e-5 * value]
        if close:  # values that agree to this have vectors that must be told apart by inverse iteration
            basis = np.array(close)
            z = np.random.default_rng(k).normal(size=len(z)) if np.linalg.norm(z - basis.T @ (basis @ z)) < 0.5 else z
            shifted = square.T @ square - value * (1 + 4 * _EPS) * np.eye(len(z))
            for _ in range(3):
                z -= basis.T @ (basis @ z)
                z = np.linalg.solve(shifted + np.eye(len(z)) * value * _EPS, z / np.linalg.norm(z))
                z -= basis.T @ (basis @ z)
                z -= basis.T @ (basis @ z)
                z /= np.linalg.norm(z)
        vectors.append(z)
    return values / n, np.array([p @ z for z in vectors]), trace


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows of the batch and their integers, a block of at most BLOCK_BYTES at a time."""
    x = batch.column("x")
    size = x.value_lengths().to_numpy(zero_copy_only=False)
    flat, first = x.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(size)))
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        for part in np.array_split(rows, max(1, -(-len(rows) * int(d) * 8 // BLOCK_BYTES))):
            if d and len(part):
                yield int(d), part, flat[first[part][:, None] + np.arange(d)]


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums without rounding: 64-bit integers where they suffice, Python's elsewhere."""
    most = max(abs(int(x.max())), abs(int(x.min())))
    if n * most + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(y: np.ndarray) -> list[int | None]:
    if y.dtype != object and int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 63:
        return (y * y).sum(1).tolist()
    exact = (y.astype(object) ** 2).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


_PART = "length int, part int, n long, high array<long>, low array<long>, matrix binary"


def _rows(found: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    return pa.Table.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=["length", "part", "n", "high", "low", "matrix"])


def _partial(state: Callable, merge: Callable):
    """Folds the matrices of a task into one state for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for d, _, x in _matrices(batch):
                new = state(d, x)
                held[d] = merge(held[d], new) if d in held else new
        found = [(d, TaskContext.get().partitionId(), *s) for d, s in held.items()]
        yield from _rows(found).to_batches()

    return run


def _folded(fit: DataFrame, state: Callable, merge: Callable, label: str) -> DataFrame:
    """One state for each length, merged FAN_IN at a time."""
    parts = staged(fit.mapInArrow(_partial(state, merge), _PART), label)

    def meet(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        total = None
        for r in rows:
            one = (r["n"], r["high"], r["low"], r["matrix"])
            total = one if total is None else merge(total, one)
        return _rows([(rows[0]["length"], rows[0]["part"] // FAN_IN, *total)])

    while not parts.groupBy("length").count().filter("count > 1").isEmpty():
        parts = staged(parts.groupBy("length", F.floor(F.col("part") / FAN_IN)).applyInArrow(meet, _PART), label)
    return parts


def _sums_of(d: int, x: np.ndarray) -> tuple:
    low = (x & _LOW).sum(0)
    return len(x), ((x >> 32).sum(0) + (low >> 32)).tolist(), (low & _LOW).tolist(), None


def _add_sums(a: tuple, b: tuple) -> tuple:
    low = [x + y for x, y in zip(a[2], b[2])]
    return a[0] + b[0], [x + y + (z >> 32) for x, y, z in zip(a[1], b[1], low)], [z & _LOW for z in low], None


def _triangle(rows: np.ndarray) -> bytes:
    d = rows.shape[1]
    r = np.zeros((d, d))
    found = np.linalg.qr(rows, mode="r")
    r[: len(found)] = found
    return r.tobytes()


def _triangle_of(fits: dict[int, tuple[int, list[int]]]) -> Callable:
    return lambda d, x: (len(x), None, None, _triangle(_scaled(x, *fits[d]).astype(float) / fits[d][0]))


def _join_triangles(a: tuple, b: tuple) -> tuple:
    both = [np.frombuffer(t[3]) for t in (a, b)]
    d = math.isqrt(len(both[0]))
    return a[0] + b[0], None, None, _triangle(np.concatenate(both).reshape(2 * d, d))


def _project(x: np.ndarray, n: int, sums: list[int], values: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scaled = _scaled(x, n, sums)
    return scaled, (scaled.astype(float) / n) @ directions.T / np.sqrt(values)


def _moments_of(models: dict[int, tuple]) -> Callable:
    def state(d: int, x: np.ndarray) -> tuple:
        n, sums, values, directions, _ = models[d]
        w = _project(x, n, sums, values, directions)[1]
        mean = w.mean(0)
        return len(w), None, None, np.concatenate([mean, ((w - mean).T @ (w - mean)).ravel()]).tobytes()

    return state


def _add_moments(a: tuple, b: tuple) -> tuple:
    x, y = np.frombuffer(a[3]), np.frombuffer(b[3])
    k = (math.isqrt(4 * len(x) + 1) - 1) // 2
    n = a[0] + b[0]
    apart = y[:k] - x[:k]
    spread = x[k:] + y[k:] + np.outer(apart, apart).ravel() * (a[0] * b[0] / n)
    return n, None, None, np.concatenate([x[:k] + apart * (b[0] / n), spread]).tobytes()


def _solved(many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                values, directions, trace = principal(np.frombuffer(r["matrix"]).reshape(r["length"], -1), r["n"], many)
                found.append((r["length"], r["n"], values.tolist(), directions.ravel().tolist(), trace))
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=["length", "n", "values", "directions", "trace"])

    return run


def _whitened(models: dict[int, tuple], errors: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in _matrices(batch):
                n, sums, values, directions, trace = models[d]
                if not (k := len(values)):
                    continue
                scaled, w = _project(x, n, sums, values, directions)
                each = lambda v, kind: pa.array(np.tile(v, len(rows)), kind)
                deviation = [v for v in _squares(scaled) for _ in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(np.repeat(rows, k))), each(np.arange(1, k + 1), pa.int32()), each([n] * k, pa.int64()), pa.array(deviation, pa.int64()), pa.array(w.ravel()), each(values / trace, pa.float64()), each([errors[d]] * k, pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every sound row and component."""
    huge = F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < huge)))
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * float(scale)) + F.lit(0).cast("long")).alias("x"))
    fit = staged(rows.select("x").distinct(), "fit")
    lengths = [r[0] for r in fit.groupBy(F.size("x").alias("d")).count().filter("d > 0").orderBy("d").select("d").toLocalIterator()]
    blocks: list[list[int]] = []
    for d in lengths:
        if blocks and sum(blocks[-1]) + d <= LENGTHS_AT_ONCE:
            blocks[-1].append(d)
        else:
            blocks.append([d])
    kind = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = None
    for block in blocks or [[0]]:
        inside = F.size("x").between(block[0], block[-1]) & (F.size("x") > 0)
        own = fit.filter(inside)
        sums = {r.length: (r.n, [(h << 32) + low for h, low in zip(r.high, r.low)]) for r in _folded(own, _sums_of, _add_sums, "sums").toLocalIterator()}
        triangles = _folded(own, _triangle_of(sums), _join_triangles, "triangles")
        solved = triangles.select("length", "n", "matrix").mapInArrow(_solved(components), "length int, n long, values array<double>, directions array<double>, trace double")
        models = {r.length: (*sums[r.length], np.array(r["values"]), np.array(r.directions).reshape(-1, r.length), r.trace) for r in solved.toLocalIterator()}
        spread = _folded(own, _moments_of(models), _add_moments, "moments")
        errors = {}
        for r in spread.toLocalIterator():
            k = len(models[r.length][2])
            errors[r.length] = float(np.abs(np.frombuffer(r.matrix)[k:].reshape(k, k) / r.n - np.eye(k)).max(initial=0.0))
        part = rows.filter(inside).mapInArrow(_whitened(models, errors), kind)
        out = part if out is None else out.unionByName(part)
    return out
