"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into passages of PASSAGE words, half overlapping. A document's passage is searched
with the HALF words after it, so that an item lies whole in the region in whose first half it begins. Regions are TF-IDF vectors over the
benchmark's terms, with statistics of the whole corpus; a randomised SVD of the corpus' regions (one pass: a
random sketch of the terms' Gram matrix, solved as a Nystroem approximation) gives the latent space, scaled to equal
variance in each direction, so that what most texts of a language share weighs no more than the rest. Regions that hold
at least LATENT of a benchmark passage's vector along its own direction there are candidates, if as many of the
passage's words stand in the region as the subsequence needs; this second test loses nothing. A candidate is
contaminated if the longest common subsequence of words covers `ratio` of the benchmark passage, or at least `weak` of
it while the item's answer (its last sentence, at most ANSWER words) stands in the document word for word. Benchmark
passages of fewer than SHORT words must stand there whole, in a row.

Words are lower-cased and free of ASCII punctuation. All terms of the benchmark that the corpus holds make the vectors,
weighted by the root of their inverse frequency and counted once in half a passage; terms that the corpus lacks are
left out, but count in the length of their passage. The benchmark is taken in blocks of ITEM_BLOCK items, each broadcast
to one run over all documents. Null and empty texts and items match nothing; rows with a null id are not reported;
documents that share an id are reported together; equal items are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeloom.llm.words import LOWER, Chunk, chunks, gram, tidy
from pipeloom.shared import staged

PASSAGE, HALF = 64, 32
FACTORS, EXTRA = 96, 8
ITEM_BLOCK = 5000
SHORT, ANSWER, HEAD = 8, 12, 3
LATENT = 0.15
PAIRS = 1 << 13
CHUNK = 1 << 18  # bytes of text at a time: a row of factors for each of its words is held
_FOLD = LOWER.copy()
_FOLD[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32
_FLAG_BITS = 18


@dataclass
class Bench:
    """A block of benchmark passages: item ids, words, answers; and its terms with their weights."""

    items: np.ndarray
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray
    flags: np.ndarray
    weights: np.ndarray | None = None

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of the benchmark's terms, and their numbers."""
        at = np.flatnonzero(self.flags[(h >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        same = self.terms[k] == h[at]
        return at[same], k[same]


def _folded(texts: pa.Array) -> Iterator[Chunk]:
    return chunks(pc.utf8_lower(texts), CHUNK, fold=_FOLD)


def _hashes(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for c in _folded(pa.array(texts, pa.string())):
        h = c.hashes()
        out += [h[i:j] for i, j in zip(c.first[:-1], c.first[1:])]
    return out


def _bench(rows: list[tuple[int, str]]) -> Bench | None:
    items, words, answers = [], [], []
    whole = _hashes([t for _, t in rows])
    last = _hashes([(t.rstrip().rstrip(".!?").replace("!", ".").replace("?", ".").rpartition(".")[2]) for _, t in rows])
    for (item, _), h, a in zip(rows, whole, last):
        for i in range(0, max(1, len(h) - HALF), HALF):
            if len(part := h[i : i + PASSAGE]):
                items.append(item)
                words.append(part)
                answers.append((a if 0 < len(a) <= ANSWER else h)[-ANSWER:])
    if not items:
        return None
    terms = np.unique(np.concatenate([np.unique(w) for w in words]))
    return Bench(np.array(items), words, answers, terms, _flags(terms))


def _flags(terms: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << _FLAG_BITS, bool)
    flags[(terms >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)] = True
    return flags


def _weighted(bench: Bench, seen: np.ndarray, total: int) -> None:
    """Keeps the terms that the corpus holds, with their weights."""
    kept = np.flatnonzero(seen)
    bench.terms, bench.flags = bench.terms[kept], _flags(bench.terms[kept])
    bench.weights = np.sqrt(np.maximum(np.log((total + 1000) / (seen[kept] + 1)), 0.3)).astype(np.float32)


def _halves(bench: Bench, c: Chunk, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """h: the hashes of the words. The terms of each half passage, once each, and their half passages, numbered through the chunk; each half passage's row, and each row's first one."""
    at, k = bench.lookup(h)
    base = np.concatenate(([0], np.cumsum(np.maximum(1, -(-np.diff(c.first) // HALF)))))
    row = np.searchsorted(c.first, at, "right") - 1
    pairs = np.unique((base[row] + (at - c.first[row]) // HALF) * len(bench.terms) + k)
    return pairs % len(bench.terms), pairs // len(bench.terms), np.repeat(np.arange(len(base) - 1), np.diff(base)), base


def _regions(x: np.ndarray, row: np.ndarray, shifts: tuple[int, ...] = (1, 2)) -> np.ndarray:
    """Sums (or unions) of x over each half passage and those of its row at the shifts from it."""
    out = x.copy()
    for d in shifts:
        a, b = slice(max(0, -d), max(0, len(x) - max(0, d))), slice(max(0, d), max(0, len(x) - max(0, -d)))
        out[a] += x[b] * (row[a] == row[b])[:, None]
    return out


def _census(bench: Bench):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(len(bench.terms), np.int64), 0
        for batch in batches:
            for c in _folded(batch.column(0)):
                h = c.hashes()
                total += len(h)
                seen += np.bincount(bench.lookup(h)[1], minlength=len(seen))
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(seen[k], total))], names=["term", "n"])

    return run


def _summed(k: np.ndarray, half: np.ndarray, n: int, weighted: np.ndarray) -> np.ndarray:
    """Sums of the weighted rows over the terms of each half passage."""
    out = np.zeros((n, weighted.shape[1]), np.float32)
    if len(k):
        some, begin = np.unique(half, return_index=True)
        out[some] = np.add.reduceat(weighted[k], begin, axis=0)
    return out


def _sketch(bench: Bench, random: np.ndarray):
    """Partial sums of (A^T A random) over regions, by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(bench.terms), random.shape[1]), np.float64)
        weighted = random * bench.weights[:, None]
        for batch in batches:
            for c in _folded(batch.column(0)):
                k, half, row, _ = _halves(bench, c, c.hashes())
                if not len(k):
                    continue
                whole = _regions(_summed(k, half, len(row), weighted), row)
                order = np.argsort(k, kind="stable")
                each = _regions(whole, row, (-1, -2))[half[order]]
                begin = np.flatnonzero(np.append(True, k[order][1:] != k[order][:-1]))
                kinds = k[order[begin]]
                out[kinds] += np.add.reduceat(each, begin, axis=0) * bench.weights[kinds, None]
        k = np.flatnonzero(np.abs(out).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([x.astype(np.float32).tobytes() for x in out[k]], pa.binary())], names=["term", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    term = table.column("term").to_numpy()
    sums = np.frombuffer(b"".join(table.column("sums").to_pylist()), np.float32).reshape(len(term), -1).astype(np.float64)
    order = np.argsort(term, kind="stable")
    kinds, begin = np.unique(term[order], return_index=True)
    total = np.add.reduceat(sums[order], begin, axis=0).astype(np.float32)
    return pa.Table.from_arrays([pa.array(kinds), pa.array([x.tobytes() for x in total], pa.binary())], names=["term", "sums"])


def _latent(sketch: np.ndarray, random: np.ndarray, factors: int) -> np.ndarray:
    """The leading right singular vectors of A from A^T A random, each divided by its singular value."""
    shift = 1e-6 * np.linalg.norm(sketch) + 1e-12
    shifted = sketch + shift * random
    core = random.T @ shifted
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-30)
    root = shifted @ (vectors[:, good] / np.sqrt(values[good]))
    left, size, _ = np.linalg.svd(root, full_matrices=False)
    kept = min(factors, int((size > 1e-6 * size[0]).sum()))
    return (left[:, :kept] * (size[0] / size[:kept])).astype(np.float32)


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a bit for each word of a."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        m = masks.get(y)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _stands(part: np.ndarray, whole: np.ndarray) -> bool:
    n = len(part)
    return any(np.array_equal(whole[i : i + n], part) for i in np.flatnonzero(whole[: len(whole) - n + 1] == part[0])) if 0 < n <= len(whole) else False


class _Answers:
    """Where the benchmark's answers may stand in a chunk's words, found by a hash of their first HEAD words."""

    def __init__(self, bench: Bench) -> None:
        heads = [a[:HEAD] for a in bench.answers]
        self.of = [(len(a), int(gram(a))) for a in heads]
        self.keys = {k: np.unique(np.array([n for size, n in self.of if size == k], np.uint64)) for k in {len(a) for a in heads}}
        self.flags = {k: _flags(keys) for k, keys in self.keys.items()}

    def places(self, c: Chunk, h: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        found = {}
        for size, keys in self.keys.items():
            g, whole = c.grams(h, size)
            i = np.flatnonzero(self.flags[size][(g >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)] & whole)
            k = np.minimum(np.searchsorted(keys, g[i]), len(keys) - 1)
            same = keys[k] == g[i]
            i, k = i[same], k[same]
            order = np.argsort(k, kind="stable")
            kinds, begin = np.unique(k[order], return_index=True)
            found.update(((size, int(keys[n])), part) for n, part in zip(kinds, np.split(i[order], begin[1:])))
        return found


def _search(bench: Bench, basis: np.ndarray, ratio: float, weak: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_terms = len(bench.terms)
        goal = np.stack([(basis[k] * bench.weights[k, None]).sum(axis=0) for k in (np.unique(bench.lookup(w)[1]) for w in bench.words)])
        size = np.linalg.norm(goal, axis=1)
        long = np.array([len(w) for w in bench.words])
        need = np.where(long < SHORT, long, np.ceil(min(ratio, weak) * long - 1e-9)).astype(np.int64)
        own = np.full((len(goal), long.max()), n_terms, np.int64)  # the terms of each passage's words
        for p, w in enumerate(bench.words):
            k = bench.lookup(w)[1]
            own[p, : len(k)] = k
        step = max(16, (1 << 23) // (n_terms + 1))
        unit = (goal / np.maximum(size, 1e-12)[:, None]).T.astype(np.float32)
        answers, weighted = _Answers(bench), basis * bench.weights[:, None]
        for batch in batches:
            docs, items, starts, covers, helds = [], [], [], [], []
            for c in _folded(batch.column(1)):
                h = c.hashes()
                k, half, row_of, base = _halves(bench, c, h)
                whole = _regions(_summed(k, half, len(row_of), weighted), row_of)
                places = answers.places(c, h)

                def answered(p: int, row: int, at: int) -> bool:
                    """Whether the answer stands in the row's words about here."""
                    a, there = bench.answers[p], places.get(answers.of[p])
                    if there is None:
                        return False
                    lo, hi = c.first[row] + max(0, at - PASSAGE), min(c.first[row + 1], c.first[row] + at + 2 * PASSAGE)
                    return any(np.array_equal(h[i : i + len(a)], a) for i in there[np.searchsorted(there, lo) : np.searchsorted(there, hi - len(a), "right")])

                for s in range(0, len(row_of), step):
                    near, goals = np.nonzero(whole[s : s + step] @ unit >= LATENT * size)
                    if not len(near):
                        continue
                    stop = min(len(row_of), s + step + 2)
                    there = np.zeros((stop - s, n_terms + 1), bool)  # which terms each region has
                    a, b = np.searchsorted(half, (s, stop))
                    there[half[a:b] - s, k[a:b]] = True
                    there = _regions(there, row_of[s:stop]).ravel()
                    for t in range(0, len(near), PAIRS):
                        i, p = near[t : t + PAIRS], goals[t : t + PAIRS]
                        stand = there.take(own[p] + i[:, None] * (n_terms + 1)).sum(axis=1)
                        for i, p, n in zip(*(x[stand >= need[p]].tolist() for x in (i, p, stand))):
                            row = int(row_of[s + i])
                            at = int(s + i - base[row]) * HALF
                            mine = h[c.first[row] : c.first[row + 1]]
                            region = mine[at : at + PASSAGE + HALF]
                            words = bench.words[p]
                            if len(words) < SHORT:
                                share = float(_stands(words, region))
                            else:
                                if n < ratio * len(words) and not answered(p, row, at):
                                    continue
                                share = _lcs(words, region) / len(words)
                                if share < ratio and not (share >= weak and answered(p, row, at)):
                                    continue
                            if share > 0:
                                docs.append(c.rows.start + row)
                                items.append(int(bench.items[p]))
                                starts.append(at)
                                covers.append(share)
                                helds.append(_lcs(words, mine[at : at + PASSAGE]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs, pa.int64())), pa.array(items, pa.int64()), pa.array(starts, pa.int64()), pa.array(covers, pa.float64()), pa.array(helds, pa.int64())], names=["doc_id", "item_id", "at_word", "cover", "held"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.65, weak: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_block: int = ITEM_BLOCK) -> DataFrame:
    """doc_id, item_id, at_word (the first word of the passage that holds it) and cover (the share of the item's passage) of every contaminated pair."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    asked = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).filter("item is not null and text is not null")
    n = asked.count()
    blocks = max(1, -(-n // item_block))
    found = spark.createDataFrame([], "doc_id long, item_id long, at_word long, cover double, held long")
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else asked
        bench = _bench([(r.item, r.text) for r in part.orderBy("item", "text").toLocalIterator()])  # about item_block items
        if bench is None or not len(bench.terms):
            continue
        total, seen = 0, np.zeros(len(bench.terms), np.int64)
        counted = rows.select("text").mapInArrow(tidy(_census(bench)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        for r in counted.toLocalIterator():  # a row for each term
            if r.term < 0:
                total = r.n
            else:
                seen[r.term] = r.n
        if not seen.any():
            continue
        _weighted(bench, seen, total)
        random = np.random.default_rng(11).normal(size=(len(bench.terms), FACTORS + EXTRA)).astype(np.float32)
        sums = rows.select("text").mapInArrow(tidy(_sketch(bench, random)), "term long, sums binary").groupBy(F.floor(F.col("term") / 256)).applyInArrow(_added, "term long, sums binary")
        sketch = np.zeros((len(bench.terms), FACTORS + EXTRA))
        for r in sums.toLocalIterator():
            sketch[r.term] = np.frombuffer(r.sums, np.float32)
        basis = _latent(sketch, random.astype(np.float64), FACTORS)
        hits = rows.mapInArrow(tidy(_search(bench, basis, ratio, weak)), "doc_id long, item_id long, at_word long, cover double, held long")
        found = found.unionByName(hits)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("cover", "held", (-F.col("at_word")).alias("before"))).alias("b"))
    return staged(best.select("doc_id", "item_id", (-F.col("b.before")).alias("at_word"), F.col("b.cover").alias("cover")), "contaminated")
