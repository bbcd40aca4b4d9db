"""Substring dedup by prefix-partitioned suffix trees over words.

A suffix is a document from one of its words on. A census of prefixes over the whole corpus deals the suffixes into
groups: by their first word where few suffixes begin with it, else by their first two, four, ... words, so that every
group fits a task's memory however common a prefix is. In its group a suffix is a leaf below the node that spells its
first `window` words; leaves are brought into node order, and an internal node of that depth with leaves of several
documents is a repeat. Each leaf of such a node but those of the smallest doc_id marks `window` words for removal;
overlapping marks make the maximal repeated spans.

The tree is cut off at `window` words, since no deeper node changes what is removed, and its nodes carry fingerprints in
the place of words: 64 bits, told apart within a group of one prefix only. Suffixes with all their words would take
thirteen times the shuffle (104 bytes in the place of 8). Leaves travel packed, one record for a piece of a task and a group; leaves of one node in a piece are settled there, and only those of its
smallest document go on. So the entries of a node in its group grow with the pieces, not with its copies.

Null texts count as empty; rows with a null doc_id are returned whole and mark nothing; rows that share a doc_id are
told apart by their text and don't mark each other; repeated rows get equal results. Texts may be of any length; an empty
table gives an empty result; other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeloom.llm.words import chunks, tidy
from pipeloom.shared import staged

LEVELS = (1, 2, 4, 8)
SLOTS, MOST_SLOTS = 1 << 12, 1 << 20
PIECE_BYTES = 1 << 21
GROUP_SUFFIXES = 3_000_000
BROADCAST_BYTES = 32 << 20
_PACKED = "grp int, docs binary, texts binary, counts binary, steps binary, jumps binary, nodes binary"


def _slots(h: np.ndarray, slots: int) -> np.ndarray:
    """The leading bits of hashes; slots is a power of two."""
    return (h >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _census(window: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(LEVELS) + 1, slots), np.int64)
        for batch in batches:
            for c in chunks(batch.column(0)):
                h = c.hashes()
                whole = c.grams(h, window)[1]
                for k, p in enumerate((*LEVELS, window)):
                    g = h if p == 1 else c.grams(h, min(p, window))[0]
                    seen[k] += np.bincount(_slots(g[whole], slots), minlength=slots)
        k, slot = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(seen[k, slot])], names=["level", "slot", "n"])

    return run


def _deal(seen: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """The group of each prefix slot at each level; -1 where longer prefixes decide. Slots in turn fill a group up to `most`."""
    group = np.full(seen.shape, -1, np.int64)
    at = 0
    for k in range(len(seen)):
        last = k == len(seen) - 1
        fill = 0
        for slot in range(seen.shape[1]):
            n = int(seen[k, slot])
            if n > most and not last:
                continue
            if fill and fill + n > most:
                at, fill = at + 1, 0
            group[k, slot], fill = at, fill + n
        at += 1
        if not last and (seen[k] <= most).all():
            break
    return group, at


def _pack(group, doc, text, pos, node) -> Iterator[tuple]:
    """One record for each group; entries come in order of (group, doc, text, pos), once more from the start where a row repeats. Places travel as steps within a row."""
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    new = np.append(True, (group[1:] != group[:-1]) | (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]) | (pos[1:] < pos[:-1]))
    step = np.where(new, pos, pos - np.append(0, pos[:-1]))
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(doc)))
    where = np.append(np.searchsorted(heads, cut), len(heads))
    for k, (i, j) in enumerate(zip(cut, np.append(cut[1:], len(doc)))):
        h = heads[where[k] : where[k + 1]]
        s = step[i:j]
        yield (
            int(group[i]), doc[h].tobytes(), text[h].tobytes(), counts[where[k] : where[k + 1]].astype(np.uint32).tobytes(),
            np.minimum(s, 255).astype(np.uint8).tobytes(), s[s >= 255].astype(np.uint32).tobytes(), None if node is None else node[i:j].tobytes(),
        )


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["grp", "docs", "texts", "counts", "steps", "jumps", "nodes"])


def _unpack(rows: list[dict]) -> tuple[np.ndarray, ...]:
    doc, text, pos = [], [], []
    for r in rows:
        counts = np.frombuffer(r["counts"], np.uint32)
        step = np.frombuffer(r["steps"], np.uint8).astype(np.int64)
        step[step == 255] = np.frombuffer(r["jumps"], np.uint32)
        total = np.cumsum(step)
        head = np.cumsum(counts) - counts
        base = total[head] - step[head]
        doc.append(np.repeat(np.frombuffer(r["docs"], np.int64), counts))
        text.append(np.repeat(np.frombuffer(r["texts"], np.int64), counts))
        pos.append((total - np.repeat(base, counts)).astype(np.uint32))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (doc, text, pos))


def _leaves(window: int, group_of: np.ndarray, groups: int):
    slots = group_of.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(zero_copy_only=False), kind="stable")))
            ids, texts = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in chunks(batch.column(2), PIECE_BYTES):
                h = c.hashes()
                node, whole = c.grams(h, window)
                sizes = np.diff(c.first)
                row = np.repeat(np.arange(c.rows.start, c.rows.stop), sizes)[whole]
                pos = (np.arange(len(h)) - np.repeat(c.first[:-1], sizes))[whole]
                group = group_of[0][_slots(h, slots)][whole]
                for k, p in enumerate((*LEVELS[1:], window), 1):
                    if not (deeper := group < 0).any():
                        break
                    group[deeper] = group_of[k][_slots(c.grams(h, min(p, window))[0][whole][deeper], slots)]
                node = node[whole]
                if not len(node):
                    continue
                order = np.argsort(node, kind="stable")  # rows ascend by doc_id, so the first leaf of a node has its smallest
                begin = np.append(True, node[order][1:] != node[order][:-1])
                low = ids[row[order[begin]]][np.cumsum(begin) - 1]
                settled = np.zeros(len(node), bool)
                settled[order] = ids[row[order]] > low
                out = []
                for what, g in ((settled, None), (~settled, group)):
                    i = np.flatnonzero(what)
                    if not len(i):
                        continue
                    if g is None:
                        out += list(_pack(np.full(len(i), int(ids[row[i[0]]]) % groups), ids[row[i]], texts[row[i]], pos[i], None))
                        continue
                    i = i[np.argsort(g[i], kind="stable")]
                    out += list(_pack(g[i], ids[row[i]], texts[row[i]], pos[i], node[i]))
                yield _records(out)

    return run


def _trees(groups: int):
    """Of one group: leaves by node; those of documents after the node's first, packed by document."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        open_rows = [r for r in rows if r["nodes"] is not None]
        doc, text, pos = _unpack(open_rows)
        if len(doc):
            node = np.concatenate([np.frombuffer(r["nodes"], np.uint64) for r in open_rows])
            order = np.argsort(node, kind="stable")
            begin = np.append(True, node[order][1:] != node[order][:-1])
            low = np.minimum.reduceat(doc[order], np.flatnonzero(begin))[np.cumsum(begin) - 1]
            late = order[doc[order] > low]
            doc, text, pos = doc[late], text[late], pos[late]
        done = _unpack([r for r in rows if r["nodes"] is None])
        doc, text, pos = (np.concatenate(x).astype(t) for *x, t in zip((doc, text, pos), done, (np.int64, np.int64, np.int64)))
        out = []
        if len(doc):
            to = doc % groups
            order = np.lexsort((pos, text, doc, to))
            out = list(_pack(to[order], doc[order], text[order], pos[order], None))
        empty = pa.schema([("grp", pa.int32())] + [(c, pa.binary()) for c in ("docs", "texts", "counts", "steps", "jumps", "nodes")])
        return pa.Table.from_batches([_records(out)] if out else [], empty)

    return run


def _spans(window: int):
    """Of one group of documents: marks joined to maximal spans of words, as (start, end) pairs."""

    def run(table: pa.Table) -> pa.Table:
        doc, text, pos = _unpack(table.to_pylist())
        order = np.lexsort((pos, text, doc))
        doc, text, pos = doc[order], text[order], pos[order].astype(np.int64)
        if len(doc):
            other = np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))
            begin = np.flatnonzero(other | np.append(True, pos[1:] > pos[:-1] + window))
            end = np.append(begin[1:], len(pos)) - 1
            pairs = np.stack((pos[begin], pos[end] + window), axis=1).astype(np.int64)
            heads = np.flatnonzero(other[begin])
            doc, text = doc[begin[heads]], text[begin[heads]]
            spans = [pairs[i:j].tobytes() for i, j in zip(heads, np.append(heads[1:], len(begin)))]
        else:
            spans = []
        return pa.Table.from_arrays([pa.array(doc.astype(np.int64)), pa.array(text.astype(np.int64)), pa.array(spans, pa.binary())], names=["id", "text_key", "spans"])

    return run


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            words = (text or b"").split()
            n_words.append(len(words))
            if spans:
                left, at = [], 0
                for i, j in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist():
                    left += words[at:i]
                    at = j
                words = left + words[at:]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        pairs = [None if s is None else np.frombuffer(s, np.int64).reshape(-1, 2).tolist() for s in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([p or [] for p in pairs], pa.list_(pa.list_(pa.int64())))],
            names=["doc_id", "n_words", "n_removed", "kept_text", "removed_spans"],
        )


def strip_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """Returns doc_id, n_words, n_removed, kept_text and removed_spans (word places) for every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    named = rows.filter("doc_id is not null and text is not null")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, max(SLOTS, 1 << (2 * size // group_suffixes).bit_length()))  # some eight slots to a group of words of five bytes
    seen = np.zeros((len(LEVELS) + 1, slots), np.int64)
    counted = named.select("text").mapInArrow(tidy(_census(window, slots)), "level int, slot int, n long").groupBy("level", "slot").agg(F.sum("n").alias("n"))
    for r in counted.toLocalIterator():  # as many rows as there are slots at most
        seen[r.level, r.slot] = r.n
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group_of, groups = _deal(seen, max(1, min(group_suffixes, int(seen[0].sum()) // least)))
    groups = max(groups, 1)
    leaves = named.mapInArrow(tidy(_leaves(window, group_of, groups)), _PACKED)
    marks = leaves.groupBy("grp").applyInArrow(_trees(groups), _PACKED)
    spans = staged(marks.groupBy("grp").applyInArrow(_spans(window), "id long, text_key long, spans binary"), "spans")
    if (spans.agg(F.sum(F.length("spans") + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        spans = F.broadcast(spans)
    joined = rows.join(spans, (rows.doc_id == spans.id) & (rows.text_key == spans.text_key), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(tidy(_strip), "doc_id long, n_words long, n_removed long, kept_text string, removed_spans array<array<long>>")
