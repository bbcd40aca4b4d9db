"""Packing documents into fixed-length sequences by cutting-stock column generation.

Each document's tokens beyond whole sequences are a remainder; the histogram of remainders by length class is the
demand of a cutting-stock problem. A linear program over patterns (how many remainders of each class share a
sequence) is solved by column generation: knapsack dynamic programming prices new patterns. The rounded patterns are
a small table, and remainders, ranked within their class, find their pattern, sequence and place from their rank.
What rounding leaves open is closed by cutting up the last sequences, whose tokens fill the gaps of the others along
one line; a rest below a sequence becomes sequences of powers of two, which need no padding.

The program sees only the histogram, whose size is fixed; ranks and sums over documents are taken in blocks. Null
and empty texts have the end token alone; repeated rows are packed separately; rows with a null id are packed too.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pipeloom.llm.words import give_back, tidy
from pipeloom.shared import staged

CLASSES = 128
REMEMBERED_BYTES = 20 << 20  # of a generation of words, of which two are kept
LONG_WORD = 64
ENTRY_BYTES = 240  # a word, its ids and their place in the table
ROWS = 100
#: Lower-case letters below U+0100 that are letters to every tokenizer, and punctuation other than apostrophes after
#: them: pre-tokens whose ids don't depend on each other.
_SHAPE = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%&*|]*)\\Z")
BROADCAST_ROWS = 1_000_000
BLOCK = 4096


class _Ids(dict):
    """word -> its ids as packed 16-bit numbers; words of the generation before last are forgotten."""

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(vocabulary)
        if t.get_vocab_size() > 1 << 16:
            raise ValueError("identifiers are kept in 16 bits")
        self.older: dict[str, bytes] = {}
        self.held = 0
        capitals = "".join(map(chr, [*range(65, 91), *range(192, 215), *range(216, 223)]))
        self.lower = t.encode(capitals, add_special_tokens=False).ids == t.encode(capitals.lower(), add_special_tokens=False).ids
        # for words of lower-case letters alone nothing is left to normalise or to part but spaces
        self.steps = self.whole = (t.normalizer, t.pre_tokenizer)
        self.letters = (normalizers.Sequence([]), pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]))
        probe = "".join(map(chr, [*range(97, 123), *range(223, 247), *range(248, 256)]))
        probe = " ".join(probe[i:] + probe[:i] for i in range(len(probe)))
        if self._with(self.letters).encode(probe, add_special_tokens=False).ids != self._with(self.whole).encode(probe, add_special_tokens=False).ids:
            self.letters = self.whole
        self.ends = np.zeros(1 << 16, bool)
        suffix = t.model.end_of_word_suffix
        self.ends[[i for i in range(t.get_vocab_size()) if suffix and (t.id_to_token(i) or "").endswith(suffix)]] = True

    def _with(self, steps: tuple):
        """The one tokenizer, with these steps before its merges."""
        if self.steps is not steps:
            self.steps = steps
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
        return self.tokenizer

    def of(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        return [np.array(e.ids, "<u2").tobytes() for e in self._with(self.whole).encode_batch_fast(words, add_special_tokens=False)]

    def many(self, words: list[str]) -> dict[str, bytes]:
        """The same for lower-case runs of letters below U+0100, which each are one pre-token: joined by spaces and parted after word ends."""
        out: dict[str, bytes] = {}
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(self._with(self.letters).encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u2")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                out.update(zip(some, self.of(some)))
                continue
            packed, at = ids.tobytes(), 0
            for w, cut in zip(some, (2 * cuts).tolist()):
                out[w] = packed[at:cut]
                at = cut
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Encodes at once what is new among the words of texts."""
        running = gc.isenabled()
        gc.disable()  # nothing here is in a cycle, and a collection would walk all words that are remembered
        try:
            self._learn(texts)
        finally:
            if running:
                gc.enable()

    def _learn(self, texts: list[list[str]]) -> None:
        if self.held >= REMEMBERED_BYTES:
            self.older = dict(self)
            self.clear()
            self.held = 0
        before = len(self)
        new = {w for w in set().union(*texts) if w not in self}  # a set's own difference would walk all words that are remembered
        if self.older:
            known = new & self.older.keys()
            self.update(zip(known, map(self.older.__getitem__, known)))
            new -= known
        letters, ended, rest, shape = set(), [], [], _SHAPE.match
        for w in new:
            m = shape(w) if len(w) <= LONG_WORD else None
            if m is None:
                if len(w) <= LONG_WORD:
                    rest.append(w)
                continue
            a, b = m.groups()
            letters.add(a)
            if b:
                ended.append((w, a, b))
        self.update(self.many([a for a in letters if a not in self]))
        ends = {b for _, _, b in ended}
        ends = dict(zip(ends, self.of(list(ends))))
        self.update([(w, self[a] + ends[b]) for w, a, b in ended])
        self.update(zip(rest, self.of(rest)))
        self.held += ENTRY_BYTES * (len(self) - before)  # words of LONG_WORD characters at most

    def __missing__(self, word: str) -> bytes:
        return self.of([word])[0]


def _lower(text: str | None) -> str:
    """Texts below U+0100 in lower case, for vocabularies that have no other; special strings are told by their case."""
    text = text or ""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@lru_cache(maxsize=4)
def _ids(vocabulary: str) -> _Ids:
    return _Ids(vocabulary)


def _encoded(vocabulary: str, end: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _ids(vocabulary)
        tail = np.array([end], "<u2").tobytes()
        give_back()
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                split = [(_lower(t) if known.lower else t or "").replace("\n", " ").split(" ") for t in part.column(1).to_pylist()]
                known.learn(split)
                packed = [b"".join(map(known.__getitem__, words)) + tail for words in split]
                total, crcs, rest = [], [], []
                for p in packed:
                    ids = np.frombuffer(p, "<u2").astype("<u4")
                    total.append(len(ids))
                    whole = len(ids) // length * length
                    crcs.append([zlib.crc32(ids[k : k + length].tobytes()) for k in range(0, whole, length)])
                    rest.append(zlib.crc32(ids[whole:].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "doc_tokens", "crcs", "rest_crc", "ids"],
                )

    return run


def _price(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of most value: unbounded knapsack over classes of sizes 1..len(value) and this room."""
    best, took = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for r in range(1, room + 1):
        k = min(r, len(value))
        gains = best[r - 1 :: -1][:k] + value[:k]
        j = int(np.argmax(gains))
        best[r], took[r] = (gains[j], j + 1) if gains[j] > best[r - 1] + 1e-12 else (best[r - 1], 0)
    pattern, r = np.zeros(len(value), np.int64), room
    while r > 0:
        if took[r]:
            pattern[took[r] - 1] += 1
            r -= took[r]
        else:
            r -= 1
    return float(best[room]), pattern


def cutting_patterns(demand: np.ndarray, room: int, most_columns: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns with their numbers of uses that cover demand[c] pieces of size c + 1, each in `room`, exactly.

    The linear program is solved from the patterns of one class alone, column by column; its solution is rounded
    down and the rest, below one use of each pattern, is placed largest piece first.
    """
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    sizes = classes + 1
    basis = np.diag(room // sizes).astype(float)
    need = demand[classes].astype(float)
    for _ in range(most_columns):
        use = np.linalg.solve(basis, need)
        dual = np.linalg.solve(basis.T, np.ones(len(classes)))
        value = np.zeros(room)
        value[classes] = np.maximum(dual, 0)
        gain, pattern = _price(value, room)
        if gain <= 1 + 1e-7:
            break
        column = pattern[classes].astype(float)
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(np.argmin(ratio))] = column
    use = np.maximum(np.linalg.solve(basis, need), 0)
    left = demand.astype(np.int64).copy()
    chosen: list[tuple[np.ndarray, int]] = []

    def take(pattern: np.ndarray, times: int) -> None:
        fits = min([times, *(left[pattern > 0] // pattern[pattern > 0])])
        if fits > 0:
            left[:] -= pattern * fits
            chosen.append((pattern, int(fits)))

    for k in np.argsort(-use):
        pattern = np.zeros(len(demand), np.int64)
        pattern[classes] = np.round(basis[:, k]).astype(np.int64)
        if pattern.any():
            take(pattern, int(use[k] + 1e-9))
    while left.any():  # at most one use of each pattern is left over
        pattern, free = np.zeros(len(demand), np.int64), room
        for c in np.flatnonzero(left)[::-1]:
            n = min(int(left[c]), free // (int(c) + 1))
            pattern[c], free = n, free - n * (int(c) + 1)
        take(pattern, int(left.max()))
    return chosen


def _place(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Rank in class -> sequence; slots: of a class the first ranks of its patterns, their first sequences and uses of the class in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = (batch.column(c).to_numpy() for c in ("class", "rank"))
            out = np.zeros(len(kind), np.int64)
            for c in np.unique(kind):
                i = np.flatnonzero(kind == c)
                first, base, each = slots[int(c)]
                k = np.searchsorted(first, rank[i], "right") - 1
                out[i] = base[k] + (rank[i] - first[k]) // each[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "seq"])

    return run


def _running(df: DataFrame, block, order: list, sums: dict[str, str], by: list[str]) -> DataFrame:
    """Adds for each of sums the total of it before the row, in the order of (block, *order) within `by`.

    Blocks are summed first, so that no task sorts more than a block or the list of blocks.
    """
    df = df.withColumn("_b", block)
    totals = df.groupBy(*by, "_b").agg(*(F.sum(c).alias(f"_t_{o}") for o, c in sums.items()))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_b", *(F.coalesce(F.sum(f"_t_{o}").over(w), F.lit(0)).alias(f"_p_{o}") for o in sums))
    inner = Window.partitionBy(*by, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.select("*", *(F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_i_{o}") for o, c in sums.items()))
    df = df.join(before, [*by, "_b"])
    return df.select("*", *((F.col(f"_i_{o}") + F.col(f"_p_{o}")).alias(o) for o in sums)).drop("_b", *(f"_{k}_{o}" for o in sums for k in "ip"))


def _cut_crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for ids, start, n in zip(batch.column("ids").to_pylist(), batch.column("start").to_pylist(), batch.column("length").to_pylist()):
            found.append(zlib.crc32(np.frombuffer(ids, "<u2", n, 2 * start).astype("<u4").tobytes()))
        kept = [c for c in batch.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(found, pa.int64())], names=[*kept, "ids_crc32"])


def pack(docs: DataFrame, vocabulary: str, length: int = 4096, end: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    unit = length // CLASSES
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = rows.mapInArrow(tidy(_encoded(vocabulary, end, length)), "doc_id long, doc_tokens long, crcs array<long>, rest_crc long, ids binary")
    encoded = staged(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    lens = encoded.select(
        "row", "doc_id", "doc_tokens", "crcs", "rest_crc", (F.col("doc_tokens") % length).alias("rest"),
        F.floor(F.col("doc_tokens") / length).cast("long").alias("wholes"), F.floor((F.col("doc_tokens") % length + unit - 1) / unit).cast("int").alias("class"),
    )
    demand = np.zeros(CLASSES, np.int64)
    total = whole = 0
    for r in lens.groupBy("class").agg(F.count("*").alias("n"), F.sum("wholes").alias("w")).collect():  # a row for each class
        total, whole = total + r.n, whole + r.w
        if r["class"]:
            demand[r["class"] - 1] = r.n
    patterns = cutting_patterns(demand, CLASSES)
    taken, base, slots = np.zeros(CLASSES, np.int64), 0, {}
    for pattern, times in patterns:
        for c in np.flatnonzero(pattern):
            slots.setdefault(int(c) + 1, []).append((int(taken[c]), base, int(pattern[c])))
            taken[c] += times * pattern[c]
        base += times
    slots = {c: tuple(np.array(x) for x in zip(*v)) for c, v in slots.items()}
    blocks = max(1, total // 50_000)
    ranked = _running(lens.select("row", "rest", "class").filter("rest > 0").withColumn("one", F.lit(1)), F.pmod(F.xxhash64("row"), F.lit(blocks)), ["row"], {"rank": "one"}, ["class"])
    placed = ranked.select("row", "rest", "class", "rank").mapInArrow(tidy(_place(slots)), "row long, rest long, class int, rank long, seq long")
    inside = Window.partitionBy("seq").orderBy(F.desc("rest"), "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = staged(placed.select("row", "rest", "seq", F.coalesce(F.sum("rest").over(inside), F.lit(0)).alias("at")), "placed")

    used = placed.groupBy("seq").agg(F.sum("rest").alias("used")).withColumn("gap", length - F.col("used"))
    used = staged(_running(used, F.floor(F.col("seq") / BLOCK), ["seq"], {"used_before": "used", "gap_before": "gap"}, []), "used")
    tokens = used.agg(F.sum("used")).first()[0] or 0
    first_cut = used.filter(F.lit(tokens) - F.col("used_before") >= F.col("gap_before")).agg(F.max("seq"), F.max_by("gap_before", "seq"), F.max_by("used_before", "seq")).first()
    cut_from, gaps_end, used_start = (x if x is not None else 0 for x in first_cut)
    left = tokens - used_start - gaps_end
    spare, at = [], gaps_end
    for bit in (*([length] * (left // length)), *(1 << k for k in range(length.bit_length() - 1, -1, -1) if (left % length) >> k & 1)):
        spare.append((base + whole + len(spare), 0, bit, at))
        at += bit
    kept = placed.filter(F.col("seq") < cut_from).select("row", F.lit(0).cast("long").alias("skip"), F.col("rest").alias("length"), F.col("seq").alias("sequence_id"), F.col("at").alias("offset"))
    holes = used.filter((F.col("seq") < cut_from) & (F.col("gap") > 0)).select(F.col("seq").alias("sequence_id"), F.col("used").alias("filled"), "gap", F.col("gap_before").alias("g"))
    if spare:
        holes = holes.unionByName(spark.createDataFrame(spare, "sequence_id long, filled long, gap long, g long"))
    line = placed.filter(F.col("seq") >= cut_from).join(used.select("seq", "used_before"), "seq").select("row", "rest", (F.col("used_before") + F.col("at") - used_start).alias("f"))
    holes = holes.withColumn("cell", F.explode(F.sequence(F.floor(F.col("g") / length), F.floor((F.col("g") + F.col("gap") - 1) / length))))
    line = line.withColumn("cell", F.explode(F.sequence(F.floor(F.col("f") / length), F.floor((F.col("f") + F.col("rest") - 1) / length))))
    lo, hi = F.greatest("f", "g"), F.least(F.col("f") + F.col("rest"), F.col("g") + F.col("gap"))
    filled = line.join(holes, "cell").filter((lo < hi) & (F.floor(lo / length) == F.col("cell")))
    filled = filled.select("row", (lo - F.col("f")).alias("skip"), (hi - lo).alias("length"), "sequence_id", (F.col("filled") + lo - F.col("g")).alias("offset"))

    rests = kept.unionByName(filled)
    info = lens.select("row", "doc_id", "doc_tokens", "rest", "rest_crc")
    rests = staged(rests.join(info, "row").select("row", "doc_id", (F.col("doc_tokens") - F.col("rest") + F.col("skip")).alias("start"), "length", (F.col("length") == F.col("rest")).alias("uncut"), "rest_crc", "doc_tokens", "sequence_id", "offset"), "rests")
    cut = rests.filter("not uncut").drop("uncut", "rest_crc")
    some = cut.select("row").distinct()
    if some.count() <= BROADCAST_ROWS:
        some = F.broadcast(some)
    cut = cut.join(encoded.select("row", "ids").join(some, "row", "left_semi"), "row").mapInArrow(tidy(_cut_crcs), "row long, doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long")
    long = _running(lens.filter("wholes > 0").select("row", "doc_id", "doc_tokens", "crcs", "wholes"), F.pmod(F.xxhash64("row"), F.lit(blocks)), ["row"], {"base": "wholes"}, [])
    long = long.select("doc_id", "doc_tokens", "base", F.posexplode("crcs").alias("k", "ids_crc32")).select(
        "doc_id", (F.col("k") * F.lit(length).cast("long")).alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.lit(base).cast("long") + F.col("base") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return rests.filter("uncut").withColumnRenamed("rest_crc", "ids_crc32").select(*out).unionByName(cut.select(*out)).unionByName(long.select(*out))
