"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the pairwise interactions of
all features in time linear in their number. Words are lower-cased and hashed, their weight is the square root of their
share of the text; each structure statistic (shares of upper-case letters, digits, symbols, repeated words and lines,
mean word length, lengths) and each metadata column is one indicator of its bin.

The model is fitted on the driver from at most `sample` labelled rows of each label, chosen by hash, weighted back to
the labels' shares. Null and empty texts are scored from their statistics alone; without labels every score is 0.5.
Texts of any length are scored whole; repeated rows get equal scores; an empty table gives an empty result; a column of
docs that is named like the score is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from pipeloom.llm.columns import without
from pipeloom.llm.words import Chunk, chunks, give_back, tidy

WORD_BITS = 16
FACTORS = 6
SAMPLE = 3000
FIT_VALUES = 1 << 16  # that a step of the fit holds at once
STATS, BINS = 13, 33
_KINDS = np.full(256, 7, np.int64)  # not ASCII
_KINDS[:128] = 6  # symbols
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 0, 1, 2
_KINDS[[9, 11, 12, 13, 32]], _KINDS[10] = 3, 4
_KINDS[[44, 46, 39, 45, 63, 58, 59]] = 5
_KINDS[33] = 6


def _stats(c: Chunk, shares: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Bins of the structure statistics of each row. shares: of each row its distinct words, its commonest word's uses and its words that repeat the one before."""
    n = len(c.first) - 1
    size = np.diff(c.offsets)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 8 + _KINDS[c.data], minlength=8 * n).reshape(n, 8).astype(float)
    words = np.diff(c.first).astype(float)
    inside = kinds[:, [0, 1, 2, 5, 6, 7]].sum(axis=1)
    part = lambda x, of: np.where(of > 0, x / np.maximum(of, 1), 0)
    lines = kinds[:, 4] + 1
    ratios = [part(kinds[:, 1], inside), part(kinds[:, 2], inside), part(kinds[:, 6], inside), part(kinds[:, 5], inside), part(kinds[:, 7], inside), part(shares[0], words), part(shares[1], words), part(shares[2], words), _line_repeats(c)]
    out = [np.floor(np.sqrt(np.clip(r, 0, 1)) * (BINS - 1)) for r in ratios]
    logs = [np.log2(size + 1.0) * 1.5, np.log2(words + 1) * 1.5, part(inside, words) * 2, np.log2(part(words, lines) + 1) * 3]
    return np.stack(out + [np.floor(np.clip(x, 0, BINS - 1)) for x in logs], axis=1).astype(np.int64)


def _line_repeats(c: Chunk) -> np.ndarray:
    """The share of each row's lines that equal an earlier line of the row, by a fingerprint of the line's bytes."""
    n = len(c.first) - 1
    if not len(c.data):
        return np.zeros(n)
    edge = np.zeros(len(c.data) + 1, bool)
    edge[c.offsets] = True
    edge[1:] |= c.data == 10
    begin = np.flatnonzero(edge[:-1])
    place = np.arange(len(c.data)) - np.repeat(begin, np.diff(np.append(begin, len(c.data))))
    value = (c.data.astype(np.uint64) + np.uint64(7)) * ((place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03))
    line = np.add.reduceat(np.where(c.data == 10, np.uint64(0), value), begin)
    row = np.searchsorted(c.offsets, begin, "right") - 1
    order = np.lexsort((line, row))
    again = np.append(False, (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1]))
    lines = np.bincount(row, minlength=n)
    return np.where(lines > 0, np.bincount(row[order], again, n) / np.maximum(lines, 1), 0)


def _features(c: Chunk, extra: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, feature, value): the features of row i are first[i]:first[i + 1]."""
    n = len(c.first) - 1
    words = np.diff(c.first)
    key = np.repeat(np.arange(n), words) << WORD_BITS | (c.hashes(lower=True) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    same = np.append(False, key[1:] == key[:-1])[: len(key)]
    echoes = np.bincount(key[same] >> WORD_BITS, minlength=n)
    key.sort()
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    uses = np.diff(np.append(begin, len(key)))
    row, word = key[begin] >> WORD_BITS, key[begin] & ((1 << WORD_BITS) - 1)
    distinct = np.bincount(row, minlength=n)
    most = np.zeros(n)
    full = np.flatnonzero(distinct)
    if len(full):
        most[full] = np.maximum.reduceat(uses, np.searchsorted(row, full))
    bins = np.concatenate([_stats(c, (distinct, most, echoes)), *(x[:, None] for x in extra)], axis=1)
    bins += (1 << WORD_BITS) + np.arange(bins.shape[1]) * BINS
    each = bins.shape[1]
    owner = np.concatenate((row, np.repeat(np.arange(n), each)))
    order = np.argsort(owner, kind="stable")
    feature = np.concatenate((word, bins.ravel()))[order]
    value = np.concatenate((np.sqrt(uses / words[row]), np.full(n * each, 0.5)))[order].astype(np.float32)
    return np.searchsorted(owner[order], np.arange(n + 1)), feature, value


def _steps(first: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges (i, j) of the groups first[i]:first[i + 1] that hold `most` values at most, or are one group."""
    out, i = [], 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(first, first[i] + most, "right")) - 1)
        out.append((i, j))
        i = j
    return out


class FactorMachine:
    def __init__(self, features: int, factors: int = FACTORS, seed: int = 3) -> None:
        self.w0 = np.float32(0)
        self.w = np.zeros(features, np.float32)
        self.v = np.zeros((features, factors), np.float32)
        self.seed = seed

    def margins(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Linear in the number of features, by the sum-of-squares identity. Every row has a feature."""
        vx = self.v[feature] * value[:, None]
        sums = np.add.reduceat(vx, first[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), first[:-1])
        return self.w0 + np.add.reduceat(self.w[feature] * value, first[:-1]) + 0.5 * ((sums * sums).sum(axis=1) - squares)

    def fit(self, first: np.ndarray, feature: np.ndarray, value: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 100, rate: float = 0.05, decay: float = 2e-4) -> None:
        """Adam on the whole weighted sample, over the features that it has."""
        there = np.zeros(len(self.w), bool)
        there[feature] = True
        kinds = np.flatnonzero(there)
        at = (np.cumsum(there) - 1).astype(np.int32)[feature]
        order = np.argsort(at, kind="stable").astype(np.int32)
        row = np.repeat(np.arange(len(label), dtype=np.int32), np.diff(first))[order]
        kind, by_kind = at[order], value[order]
        del order
        begin = np.searchsorted(kind, np.arange(len(kinds) + 1))
        # values are taken some at a time, by row for the sums and by feature for the gradient, and none is kept for all
        rows, cols = _steps(first, FIT_VALUES), _steps(begin, FIT_VALUES)
        p = np.concatenate((self.w[kinds, None], np.random.default_rng(self.seed).normal(0, 0.02, (len(kinds), self.v.shape[1]))), axis=1).astype(np.float32)
        m, s, m0, s0 = np.zeros_like(p), np.zeros_like(p), 0.0, 0.0
        sums, y, grad = np.zeros((len(label), self.v.shape[1]), np.float32), np.zeros(len(label), np.float32), np.zeros_like(p)
        weight = weight / weight.sum()
        for step in range(1, rounds + 1):
            for i, j in rows:
                some = slice(first[i], first[j])
                vx = p[at[some], 1:] * value[some, None]
                sums[i:j] = np.add.reduceat(vx, first[i:j] - first[i], axis=0)
                y[i:j] = self.w0 + np.add.reduceat(p[at[some], 0] * value[some], first[i:j] - first[i]) + 0.5 * ((sums[i:j] * sums[i:j]).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), first[i:j] - first[i]))
            g = (weight * (1 / (1 + np.exp(-y)) - label)).astype(np.float32)
            for i, j in cols:
                some = slice(begin[i], begin[j])
                each = g[row[some]] * by_kind[some]
                part = np.concatenate((each[:, None], each[:, None] * (sums[row[some]] - p[kind[some], 1:] * by_kind[some, None])), axis=1)
                grad[i:j] = np.add.reduceat(part, begin[i:j] - begin[i], axis=0)
            grad += decay * p
            m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad * grad
            p = p - rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
            m0, s0 = 0.9 * m0 + 0.1 * g.sum(), 0.99 * s0 + 0.01 * float(g.sum()) ** 2
            self.w0 = np.float32(self.w0 - rate * (m0 / (1 - 0.9**step)) / ((s0 / (1 - 0.99**step)) ** 0.5 + 1e-6))
        self.w[kinds], self.v[kinds] = p[:, 0], p[:, 1:]


def _numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    """Bins of metadata numbers: their logarithms; 0 where null."""
    out = []
    for k in names:
        x = np.array([abs(float(v)) if v is not None else -1.0 for v in batch.column(k).to_pylist()])
        out.append(np.where(x < 0, 0, np.minimum(np.floor(1.5 * np.log2(np.maximum(x, 0) + 1)) + 1, BINS - 1)).astype(np.int64))
    return out


def train_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, metadata: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> FactorMachine:
    """Fits on rows of labels with label 0 or 1; of several labels of one id the smallest counts."""
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    total = {r.label: r.n for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    # a threshold on the hash comes before the sort, so what tasks hand on doesn't grow with the number of labels
    few = {k: F.pmod(F.xxhash64("id"), F.lit(n)) < 2 * sample + 1000 if n > 4 * sample else F.lit(True) for k, n in total.items()}
    picked = [marks.filter((F.col("label") == k) & few[k]).orderBy(F.xxhash64("id"), "id").limit(sample) for k in total]
    model = FactorMachine((1 << WORD_BITS) + (STATS + len(metadata)) * BINS)
    if len(picked) < 2:
        return model
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * sample rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *metadata).join(chosen, "id").select("text", *metadata, "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = _numbers(batch, list(metadata))
            for c in chunks(batch.column(0)):
                first, feature, value = _features(c, [x[c.rows] for x in extra])
                part = [[a[i:j].tobytes() for i, j in zip(first[:-1], first[1:])] for a in (feature.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([batch.column(len(metadata) + 1).slice(c.rows.start, len(first) - 1), *(pa.array(x, pa.binary()) for x in part)], names=["label", "feature", "value"])

    got = rows.mapInArrow(tidy(run), "label int, feature binary, value binary").toArrow()  # 2 * sample rows, unless ids repeat
    if not got.num_rows:
        return model
    got = got.sort_by([(c, "ascending") for c in got.column_names])
    feature, value = ([np.frombuffer(x.as_buffer(), kind) for x in got.column(c)] for c, kind in (("feature", np.int32), ("value", np.float32)))
    first = np.concatenate(([0], np.cumsum([len(x) for x in feature])))
    label = got.column("label").to_numpy()
    feature, value = np.concatenate(feature), np.concatenate(value)
    del got
    there = {k: max(1, int((label == k).sum())) for k in total}
    weight = np.array([total[k] / there[k] for k in label.tolist()])
    model.fit(first, feature, value, label, weight)
    give_back()
    return model


def score_quality(docs: DataFrame, model: FactorMachine, metadata: tuple[str, ...] = (), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a double column score_col from 0 to 1: how likely label 1 is."""
    docs = without(docs, score_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = _numbers(batch, list(metadata))
            scores = [np.zeros(0)]
            for c in chunks(batch.column(text_col), 1 << 18):
                y = model.margins(*_features(c, [x[c.rows] for x in extra]))
                scores.append(1 / (1 + np.exp(-y.astype(np.float64))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields]).add(score_col, DoubleType()))
