"""Secret scans: fixed formats, and random strings by their token efficiency.

Natural words and identifiers cost few tokens under a byte-pair vocabulary, random strings many: a run of printable
characters with few characters a token is reported as `random`; of a run with more, each stretch of tokens that has few,
widened to the separators around it where it keeps that ratio. What counts as few, and how many kinds of characters
(lower case, upper case, both mixed inside, digits) are asked for, depends on the length, since short natural runs scatter
more (LIMITS): from 20 characters on the ratio alone decides, unless the run has other symbols than base64's and
identifiers'. Known digests (hex of a digest's length), UUIDs, dates and times, numbered notices (ABC-2021-123), product
codes (groups of at most four capitals and digits), chemical formulas, hosts of addresses and spans of a fixed format are
cut out of the runs first, and what follows a host is judged part by part. Runs below 12 characters, or of fewer than 7
different ones, can't be told from words and are left.

Null and empty texts have no spans; whole texts are scanned in time linear in their length, however long; repeated rows
get equal spans; an empty table gives an empty result; other columns of docs are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeloom.llm.spans import SPANS

KINDS = ["assign", "access", "hex", "random"]
RATIO = 2.2
#: From so many characters on: the ratio as a share of the parameter, and the kinds of characters asked for.
LIMITS = [(12, 0.8, 3), (16, 0.82, 2), (20, 1.0, 1)]
LEAST = LIMITS[0][0]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORD = re.compile(r"p(?:assword|asswd)|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_RUN = re.compile(r"[!-~]{%d,}" % LEAST)
#: Runs that can pass at all: of 20 characters, or with a digit or a capital that doesn't begin them.
_HOPEFUL = re.compile(r"[0-9]|.[A-Z]")
_PLAIN = re.compile(r"[A-Za-z0-9+/_=-]*\Z")
#: Known digests, UUIDs, dates and times, numbered notices, product codes of short groups, chemical formulas.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9])(?:(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})"
    r"|[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_][0-9]{2}:?[0-9]{2}(?::?[0-9]{2}(?:[.,][0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?"
    r"|[A-Z]{2,10}-[0-9]{4}-[0-9]{3,}|[A-Z0-9]{1,4}(?:-[A-Z0-9]{1,4}){2,}"
    r"|(?:\(?(?:Cl|Br|Na|Mg|Al|Si|Ca|Fe|Cu|Zn|[HCNOPSFKI])[0-9]{0,3}\)?[0-9]{0,2}){4,})(?![A-Za-z0-9])"
)
#: The scheme and host of an address; what follows is judged part by part.
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9.-]+(?::[0-9]+)?(?=[/?#]|\Z)")
_BETWEEN = re.compile("[/?&=#]+")
#: A random string has so many different characters at least.
DISTINCT = 7
_KINDS_OF = [re.compile(x) for x in ("[a-z]", "[0-9]", "[A-Z]", "[a-z0-9][A-Z]")]
_PART = re.compile("[A-Za-z0-9+]+")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _formats(text: str) -> list[tuple[int, int, int]]:
    found = []
    if _WORD.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def _is_random(s: str, i: int, j: int, tokens: int, ratio: float) -> bool:
    """Whether the part of s from i to j, of so many tokens, is a random string."""
    n = j - i
    if n < LEAST:
        return False
    _, share, kinds = next(x for x in reversed(LIMITS) if n >= x[0])
    if n >= share * ratio * tokens:
        return False
    if not _PLAIN.match(s, i, j):
        kinds = max(kinds, 3)
    return sum(k.search(s, i, j) is not None for k in _KINDS_OF) >= kinds and not s[i:j].isdigit() and len(set(s[i:j])) >= DISTINCT


def _stretches(s: str, encoding, ratio: float) -> list[tuple[int, int]]:
    """Where s has few characters a token: all of it, or stretches of tokens in it, in linear time."""
    tokens = encoding.encode_ordinary(s)
    if _is_random(s, 0, len(s), len(tokens), ratio):
        return [(0, len(s))]
    peaks, at, begin, total, best, end = [], 0, 0, 0.0, 0.0, 0
    for t in tokens:
        n = len(encoding.decode_single_token_bytes(t))
        if total <= 0:
            if best > 0:
                peaks.append((begin, end))
            begin, total, best = at, 0.0, 0.0
        total += ratio - n
        at += n
        if total > best:
            best, end = total, at
    if best > 0:
        peaks.append((begin, end))
    parts, found = [m.span() for m in _PART.finditer(s)], []
    k = 0
    for a, b in peaks:
        while k < len(parts) and parts[k][1] <= a:
            k += 1
        last = k
        while last + 1 < len(parts) and parts[last + 1][0] < b:
            last += 1
        wide = (min(a, parts[k][0]), max(b, parts[last][1])) if k < len(parts) and parts[k][0] < b else (a, b)
        if found and wide[0] < found[-1][1]:
            wide = (a, b)
        for i, j in dict.fromkeys((wide, (a, b))):
            if j - i >= LEAST and _is_random(s, i, j, len(encoding.encode_ordinary(s[i:j])), ratio):
                found.append((i, j))
                break
    return found


def _known(text: str, start: int, stop: int) -> list[tuple[int, int]]:
    """What is known to be no secret between start and stop; after the host of an address also the signs between its parts."""
    found = [m.span() for m in _KNOWN.finditer(text, start, stop)]
    if (at := text.find("://", start, stop)) >= 0:
        for m in _ADDRESS.finditer(text[start:stop]):
            found.append((start + m.start(), start + m.end()))
        found += [m.span() for m in _BETWEEN.finditer(text, at + 3, stop)]
    return found


def _random(text: str, taken: list[tuple[int, int, int]], encoding, ratio: float) -> list[tuple[int, int, int]]:
    found = []
    spans = sorted((a, b) for a, _, b in taken)
    k = 0
    for m in _RUN.finditer(text):
        if m.end() - m.start() < LIMITS[-1][0] and not _HOPEFUL.search(text, m.start(), m.end()):
            continue
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        cuts, j = _known(text, m.start(), m.end()), k
        while j < len(spans) and spans[j][0] < m.end():
            cuts.append(spans[j])
            j += 1
        at = m.start()
        for a, b in [*sorted(cuts), (m.end(), m.end())]:
            if a - at >= LEAST:
                found += [(at + i, 3, at + j) for i, j in _stretches(text[at:a], encoding, ratio)]
            at = max(at, b)
    return found


def find_secrets(docs: DataFrame, vocabulary: str, ratio: float = RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans (kind, start, end, text), ordered by start and kind, for every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                spans = _formats(text) if text else []
                if text:
                    spans = sorted(spans + _random(text, spans, encoding, ratio))
                out.append([{"kind": KINDS[k], "start": a, "end": b, "text": text[a:b]} for a, k, b in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")
