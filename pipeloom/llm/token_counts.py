"""Token counts by heap-and-linked-list byte-pair merging, without token identifiers.

A text is cut at special strings, which count one each, then into pre-tokens. A pre-token begins as a list of byte
symbols; the adjacent pair of lowest rank is merged, the leftmost first, until no pair has a rank. Its count is the
initial symbols less the merges. Counts of short word units are remembered in a table of bounded size.

Null texts count as empty; whole texts are counted, however long; repeated rows get equal counts; an empty table gives
an empty result; columns of docs that are named like an added one are replaced by it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from pipeloom.llm.columns import without

REMEMBERED = 400_000
LONG_UNIT = 48
#: A space with white space on both sides: only there does a cut before the space change the pre-tokens.
_TANGLED = re.compile(r"\s \s")
#: Fixed: the pre-token pattern of byte-level vocabularies.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Counter(dict):
    """word unit (after a space) -> tokens, filled on demand; the units of the generation before last are forgotten."""

    def __init__(self, vocabulary: str) -> None:
        super().__init__()
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.start = [ids[s] for s in _byte_symbols()]
        self.rank, self.made = {}, []
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.rank.setdefault(ids[a] << 20 | ids[b], r)
            self.made.append(ids[a + b])
        special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.older: dict[str, int] = {}
        self.starts: dict[str, int] = {}

    def piece(self, text: str) -> int:
        """Tokens of one pre-token: its bytes less the merges."""
        rank, made = self.rank, self.made
        find = rank.get
        symbols = list(map(self.start.__getitem__, text.encode("utf-8", "surrogatepass")))
        n = count = len(symbols)
        last = n - 1
        heap = []
        a = symbols[0] << 20
        for i in range(last):
            b = symbols[i + 1]
            r = find(a | b)
            if r is not None:
                heap.append(r * n + i)
            a = b << 20
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, last))
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if j > last or find(symbols[i] << 20 | symbols[j]) != r:
                continue  # an end has been merged since
            new = symbols[i] = made[r]
            symbols[j] = -1
            count -= 1
            after[i] = k = after[j]
            if k <= last:
                before[k] = i
                r = find(new << 20 | symbols[k])
                if r is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0:
                r = find(symbols[h] << 20 | new)
                if r is not None:
                    heappush(heap, r * n + h)
        return count

    def plain(self, text: str) -> int:
        return sum(map(self._start, _PATTERN.findall(text)))

    def _start(self, text: str) -> int:
        count = self.starts.get(text)
        if count is None:
            count = self.piece(text)
            if len(text) <= LONG_UNIT:
                if len(self.starts) >= REMEMBERED:
                    self.starts.clear()
                self.starts[text] = count
        return count

    def __missing__(self, unit: str) -> int:
        count = self.older.get(unit)
        if count is None:
            if unit.isalpha():
                count = self.piece(" " + unit)
            else:
                found = _PATTERN.findall(" " + unit)
                count = self.piece(found[0]) if len(found) == 1 else sum([self[p[1:]] if p[0] == " " and len(p) > 1 else self._start(p) for p in found])
        if len(unit) <= LONG_UNIT:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[unit] = count
        return count

    def segment(self, text: str) -> int:
        if _TANGLED.search(text):
            return self.plain(text)
        first, *units = text.split(" ")
        return (self.plain(first) if first else 0) + sum(map(self.__getitem__, units))

    def text(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.segment(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.segment, parts))


@lru_cache(maxsize=4)
def _counter(vocabulary: str) -> Counter:
    """One for all tasks of a worker process."""
    return Counter(vocabulary)


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """docs with a long column count_col: tokens of text_col under the byte-level vocabulary file (the same path on every node)."""
    docs = without(docs, count_col) if count_col != text_col else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            at = batch.schema.names.index(text_col)
            counts = [counter.text(t) if t else 0 for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, count_col])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(count_col, LongType()))


def token_report(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(rows, vocabulary).drop("text").withColumn("over_limit", F.col("n_tokens") > limit)
