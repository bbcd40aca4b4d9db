"""Ranked lexical search over a length-stratified index.

Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z lower-cased, kept as 64-bit hashes. A
document's normaliser m depends on its length alone; documents of equal m are a stratum, and a stratum beyond
PIECE_TERMS terms is dealt into pieces. A row of the index is a piece: its terms in order, for each the term
frequencies in falling order, for each the documents. Within a piece the impact of a frequency is one number, so it is
computed once per frequency, and the largest frequency of each term bounds the score of all its documents.

A search first reads what each piece holds of the items' terms (document counts and largest frequencies). Bounds of
pieces order the visits: FIRST pieces of the highest bound give each item a score that ten documents reach, then
only pieces whose bound is no lower are visited. Both are scans of the index without a shuffle; items go in
blocks of at most BLOCK_TERMS terms, which is what tasks and driver hold of them. Scores are 64-bit integers.

Null and empty texts have no terms: such documents aren't counted or found, such items have no rows. Repeated rows are
documents (or items) of their own; null ids are kept and come last among equal scores. Very long texts are a piece of their own. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeloom.llm.words import chunks, tidy
from pipeloom.shared import staged

PIECE_TERMS = 1 << 19
PIECE_DOCS = 1 << 15
BLOCK_TERMS = 1 << 20
FIRST = 2
BROADCAST_ROWS = 1_000_000
FLAT = 90  # of 100, the share of a document's length in its normaliser
_FOLD = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_lo:_hi] = np.arange(_lo, _hi)
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class LexicalIndex:
    """pieces: m, piece, docs, terms, groups, tfs, ends, posts; documents with a term and all their terms with repeats."""

    pieces: DataFrame
    documents: int
    total: int


def _terms_in(batch: pa.RecordBatch) -> np.ndarray:
    n = [np.diff(c.first) for c in chunks(batch.column("text"), fold=_FOLD)]
    return np.concatenate(n) if n else np.zeros(0, np.int64)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_terms_in(batch), pa.int64())], names=["n"])


def normaliser(n: int, documents: int, total: int) -> int:
    return 100 - FLAT + FLAT * n * documents // max(total, 1)


def _stratified(documents: int, total: int):
    """Adds the normaliser, null without terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [normaliser(n, documents, total) if n else None for n in _terms_in(batch).tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(m, pa.int64())], names=[*batch.schema.names, "m"])

    return run


def impact(tf: np.ndarray, m: int) -> np.ndarray:
    """What a term of weight 1 adds to a score, for each frequency."""
    if len(tf) and int(tf.max()) > 9_000_000_000:  # beyond 64 bits
        return np.array([10**9 * t // (1000 * t + 8 * m) for t in tf.tolist()], np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _invert(table: pa.Table) -> pa.Table:
    """The index row of one piece."""
    order = pa.compute.sort_indices(table.column("doc_id"), null_placement="at_end") if table.num_rows > 1 else None
    table = (table if order is None else table.take(order)).combine_chunks()
    terms, rows = [], []
    for c in chunks(table.column("text"), fold=_FOLD):
        terms.append(c.hashes())
        rows.append(np.repeat(np.arange(c.rows.start, c.rows.stop), np.diff(c.first)))
    term, row = np.concatenate(terms), np.concatenate(rows)
    order = np.lexsort((row, term))
    term, row = term[order], row[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    term, row, tf = term[at], row[at], np.diff(np.append(at, len(order)))
    order = np.lexsort((row, -tf, term))
    term, row, tf = term[order], row[order], tf[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
    start = np.flatnonzero(new)
    first = np.flatnonzero(np.append(True, term[start][1:] != term[start][:-1]))
    posts = row.astype("<u2" if table.num_rows <= 1 << 16 else "<u4")
    kept = {
        "m": table.column("m")[:1], "piece": table.column("piece")[:1], "docs": pa.array([table.column("doc_id").to_pylist()], pa.list_(table.schema.field("doc_id").type)),
        "terms": term[start[first]].astype("<u8").tobytes(), "groups": first.astype("<u4").tobytes(), "tfs": tf[start].astype("<u4").tobytes(), "ends": np.append(start[1:], len(term)).astype("<u4").tobytes(), "posts": posts.tobytes(),
    }
    return pa.Table.from_arrays([v if not isinstance(v, bytes) else pa.array([v], pa.binary()) for v in kept.values()], names=list(kept))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """The index of all documents, written to the shared folder."""
    kind = docs.schema[id_col].dataType.simpleString()
    by_n = staged(docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(_count_terms), "n long").filter("n > 0").groupBy("n").agg(F.count("*").alias("docs")), "lengths")
    documents, total = (int(x or 0) for x in by_n.agg(F.sum("docs"), F.sum(F.col("docs") * F.col("n").cast("decimal(38,0)"))).first())
    m = F.lit(100 - FLAT) + F.floor(F.col("n").cast("decimal(20,0)") * FLAT * documents / max(total, 1))
    load = by_n.groupBy(m.alias("m")).agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("n")).alias("t"))  # a guess at m is enough here
    pieces = load.select(F.col("m").cast("long").alias("m"), F.greatest(F.ceil(F.col("d") / PIECE_DOCS), F.ceil(F.col("t") / PIECE_TERMS)).cast("int").alias("pieces")).filter("pieces > 1")
    pieces = staged(pieces, "strata")
    if pieces.count() <= BROADCAST_ROWS:  # 12 bytes each; beyond it the join shuffles
        pieces = F.broadcast(pieces)
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    dealt = dealt.mapInArrow(tidy(_stratified(documents, total)), f"doc_id {kind}, text string, row long, m long").filter("m is not null").join(pieces, "m", "left")
    dealt = dealt.select("doc_id", "text", "m", F.pmod(F.xxhash64("row"), F.coalesce("pieces", F.lit(1))).cast("int").alias("piece"))
    index = dealt.groupBy("m", "piece").applyInArrow(_invert, f"m long, piece int, docs array<{kind}>, terms binary, groups binary, tfs binary, ends binary, posts binary")
    return LexicalIndex(staged(index, "pieces"), documents, total)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[bytes] = []
        for c in chunks(batch.column("text"), fold=_FOLD):
            h = c.hashes()
            found += [np.unique(h[a:b]).astype("<u8").tobytes() for a, b in zip(c.first, c.first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(found, pa.binary())], names=["item_id", "terms"])


@dataclass
class _Block:
    """Some items: their distinct terms in order, and for each item (row numbers in starts) places in these."""

    terms: np.ndarray
    places: np.ndarray
    starts: np.ndarray

    def bounds(self, gains: np.ndarray) -> np.ndarray:
        """Sums over each item's terms."""
        return np.add.reduceat(np.append(gains[self.places], 0), self.starts[:-1]) if len(self.places) else np.zeros(len(self.starts) - 1, np.int64)


@dataclass
class _Piece:
    """An index row: its terms and frequencies, as arrays; of the items' terms, where they stand in it."""

    m: int
    terms: np.ndarray
    groups: np.ndarray
    tfs: np.ndarray
    ends: np.ndarray
    there: np.ndarray
    at: np.ndarray

    def gains(self, block: _Block, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block.terms), np.int64)
        out[self.there] = weights[self.there] * impact(self.tfs[self.groups[self.at]], self.m)
        return out


def _opened(batch: pa.RecordBatch, block: _Block) -> Iterator[tuple[int, _Piece]]:
    for i in range(batch.num_rows):
        terms, groups, tfs, ends = (np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in (("terms", "<u8"), ("groups", "<u4"), ("tfs", "<u4"), ("ends", "<u4")))
        at = np.minimum(np.searchsorted(terms, block.terms), len(terms) - 1)
        there = np.flatnonzero(terms[at] == block.terms)
        yield i, _Piece(batch.column("m")[i].as_py(), terms, groups, tfs.astype(np.int64), ends.astype(np.int64), there, at[there])


def _held(block: _Block):
    """Of each piece: the items' terms in it, their document counts and largest frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, p in _opened(batch, block):
                last = np.append(p.groups[1:], len(p.tfs))[p.at] - 1
                before = np.append(0, p.ends)[p.groups[p.at]]
                found.append((p.there, p.ends[last] - before, p.tfs[p.groups[p.at]]))
            columns = [pa.array([f[k].astype(np.int64) for f in found], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("m"), batch.column("piece"), *columns], names=["m", "piece", "at", "df", "tf"])

    return run


def _bounded(block: _Block, weights: np.ndarray):
    """The bound of each item in each piece that holds one of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, piece, items, bounds = [], [], [], []
            for r in range(batch.num_rows):
                gains = np.zeros(len(weights), np.int64)
                at, tf = (np.array(batch.column(c)[r].as_py(), np.int64) for c in ("at", "tf"))
                gains[at] = weights[at] * impact(tf, batch.column("m")[r].as_py())
                bound = block.bounds(gains)
                some = np.flatnonzero(bound > 0)
                m.append(np.full(len(some), batch.column("m")[r].as_py()))
                piece.append(np.full(len(some), batch.column("piece")[r].as_py()))
                items.append(some)
                bounds.append(bound[some])
            if m:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(m), pa.int64()), pa.array(np.concatenate(piece), pa.int32()), pa.array(np.concatenate(items), pa.int32()), pa.array(np.concatenate(bounds), pa.int64())], names=["m", "piece", "item", "bound"])

    return run


def _visit(block: _Block, weights: np.ndarray, least: np.ndarray, top: int, kind: pa.DataType):
    """The `top` best documents of each piece for each item whose bound there reaches its least score, which rises on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.maximum(least, 1)
        for batch in batches:
            for i, p in _opened(batch, block):
                bound = block.bounds(p.gains(block, weights))
                visits = np.flatnonzero(bound >= floor)
                if not len(visits):
                    continue
                docs = batch.column("docs")[i].values
                posts = np.frombuffer(batch.column("posts")[i].as_buffer(), "<u2" if len(docs) <= 1 << 16 else "<u4")
                ends = np.append(0, p.ends)
                last = np.append(p.groups[1:], len(p.tfs))[p.at]
                lo, hi, where = ends[p.groups[p.at]], ends[last], np.full(len(block.terms), -1)
                where[p.there] = np.arange(len(p.there))
                added = [np.repeat(impact(p.tfs[g:e], p.m), np.diff(ends[g : e + 1])) if e - g > 1 else impact(p.tfs[g:e], p.m) for g, e in zip(p.groups[p.at].tolist(), last.tolist())]
                items, found, scores = [], [], []
                for item in visits:
                    score = np.zeros(len(docs), np.int64)
                    for t in block.places[block.starts[item] : block.starts[item + 1]]:
                        if (k := where[t]) >= 0:
                            score[posts[lo[k] : hi[k]]] += weights[t] * added[k]
                    some = np.flatnonzero(score >= floor[item])
                    if len(some) > top:
                        reached = np.partition(score[some], len(some) - top)[len(some) - top]
                        floor[item] = max(floor[item], reached)
                        some = some[score[some] >= reached]
                        some = some[np.lexsort((some, -score[some]))[:top]]  # documents of a piece stand in the order of their ids
                    items.append(np.full(len(some), item))
                    found.append(some)
                    scores.append(score[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items), pa.int32()), docs.take(pa.array(np.concatenate(found))).cast(kind), pa.array(np.concatenate(scores), pa.int64())], names=["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> Iterator[tuple[list, _Block]]:
    """Items in blocks of at most BLOCK_TERMS terms (or of one item)."""

    def made(rows: list) -> tuple[list, _Block]:
        lists = [np.frombuffer(bytes(r.terms), "<u8") for r in rows]
        terms, places = np.unique(np.concatenate(lists), return_inverse=True)
        return [r.item_id for r in rows], _Block(terms, places, np.cumsum([0, *map(len, lists)]))

    held, size = [], 0
    for r in items.toLocalIterator():
        if held and size + len(r.terms) // 8 > BLOCK_TERMS:
            yield made(held)
            held, size = [], 0
        held.append(r)
        size += len(r.terms) // 8
    if held:
        yield made(held)


def search(index: LexicalIndex, items: DataFrame, top: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents of each item."""
    spark = items.sparkSession
    item_kind, doc_kind = items.schema[id_col].dataType, index.pieces.schema["docs"].dataType.elementType
    terms = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(tidy(_item_terms), f"item_id {item_kind.simpleString()}, terms binary").filter("length(terms) > 0")
    best, out = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()), None
    arrow = index.pieces.select("docs").limit(0).toArrow().schema.field("docs").type.value_type
    found_kind = f"item int, doc_id {doc_kind.simpleString()}, score long"
    for ids, block in _blocks(staged(terms, "items")):
        summary = staged(index.pieces.select("m", "piece", "terms", "groups", "tfs", "ends").mapInArrow(tidy(_held(block)), "m long, piece int, at array<long>, df array<long>, tf array<long>"), "summary")
        counts = np.zeros(len(block.terms), np.int64)
        for r in summary.select(F.explode(F.arrays_zip("at", "df")).alias("p")).groupBy("p.at").agg(F.sum("p.df").alias("df")).toLocalIterator():
            counts[r["at"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * c + 1))) for c in counts.tolist()], np.int64)
        bounds = summary.select("m", "piece", "at", "tf").mapInArrow(_bounded(block, weights), "m long, piece int, item int, bound long")
        by_bound = Window.partitionBy("item").orderBy(F.desc("bound"), "m", "piece")
        first = bounds.withColumn("k", F.row_number().over(by_bound)).filter(F.col("k") <= FIRST).select("m", "piece").distinct()  # at most FIRST rows an item
        least = np.zeros(len(ids), np.int64)
        early = index.pieces.join(F.broadcast(staged(first, "first")), ["m", "piece"], "left_semi")
        reached = early.mapInArrow(tidy(_visit(block, weights, least, top, arrow)), found_kind).withColumn("k", F.row_number().over(best)).filter(F.col("k") == top)
        for r in reached.select("item", "score").toLocalIterator():
            least[r["item"]] = r["score"]
        found = index.pieces.mapInArrow(tidy(_visit(block, weights, least, top, arrow)), found_kind)
        found = staged(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top), "ranked")
        named = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {item_kind.simpleString()}")
        part = found.join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")  # at most BLOCK_TERMS rows
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, doc_id {doc_kind.simpleString()}, score long")
    return out


ORACLE_SQL = r"""
with words as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
docs as (select r, doc_id, len(w) as n, w from words where len(w) > 0),
total as (select count(*) as d, sum(n)::bigint as l from docs),
tfs as (select r, t, count(*) as tf from (select r, unnest(w) as t from docs) group by r, t),
dfs as (select t, floor(1000 * ln((2.0 * any_value(d) + 2) / (2 * count(*) + 1)))::bigint as weight from tfs, total group by t),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
norms as (select r, doc_id, 10 + (90 * n * d) // l as m from docs, total),
scores as (select item_id, r, any_value(doc_id) as doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from asked join dfs using (t) join tfs using (t) join norms using (r) group by item_id, r)
select item_id, rank, doc_id, score from (select item_id, row_number() over (partition by item_id order by score desc, doc_id, r)::int as rank, doc_id, score from scores where score > 0) where rank <= 10
"""
