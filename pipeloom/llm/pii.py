"""Personal data: fixed formats, and spans tagged by a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy on the driver from labelled spans: at most `train_windows` unlike windows around spans of
the fixed formats, chosen by hash from the whole corpus, a fifth of them for each kind as far as it goes and a fifth
without any span. `examples` windows are made from them: as they are, or with other digits and letters and in forms that
the formats miss (FORMS), also in the place of a word of a window without spans; numbers that are nothing of the kind
(dates, amounts, versions) are put in unmarked. Training ends when the loss settles, however few windows the corpus has.

Every character of every text is scored, in overlapping windows; each character takes its scores from the window in which
it stands furthest from the edges, and one best path is decoded over the whole text, but for stretches where the
scores rule out that a tag pays. Tagged spans are added where no format has a span; those of the
formats always stay.

Null and empty texts have no spans; whole texts are searched in time linear in their length; repeated rows get equal
spans; an empty table gives an empty result; other columns of docs are not read. Without any labelled span in the corpus
nothing is tagged.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeloom.llm.spans import SPANS
from pipeloom.llm.tagger import Tagger, symbols
from pipeloom.shared import staged

KINDS = ["email", "ip", "card", "phone"]
ADDED = ["tagged_email", "tagged_ip", "tagged_card", "tagged_phone"]
TRAIN, WINDOW, MARGIN, BESIDE = 96, 512, 24, 8
TRAIN_WINDOWS, EXAMPLES = 1200, 2000
LEAST = 7  # characters of a tagged span
TOGETHER, ROWS = 1024, 1000
_TRIGGER = re.compile("[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile("[0-9]+")
_PARTS = re.compile("[0-9]+")
_AT = re.compile(r"[A-Za-z0-9].*?(?:@|\bat\b).*?[A-Za-z0-9]", re.IGNORECASE | re.DOTALL)
_DOUBTFUL = re.compile(r"@|\bat\b|\bdot\b", re.IGNORECASE)
_JOINED = re.compile("[A-Za-z0-9]{2}")
_DIGITS = re.compile("[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def formats(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed formats."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        i = at
        while i > done and text[i - 1] in _LOCAL:
            i -= 1
        if i < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((i, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A window for each span of the formats: its text, the spans in it as kind, start, end, and their kinds; and, of some texts, one
    without spans (kind 4), where nothing looks like a span in another form."""
    for batch in batches:
        texts, spans = [], []
        for text in batch.column(0).to_pylist():
            found = formats(text) if text and _TRIGGER.search(text) else []
            for a, _, b in found:
                i = max(0, min(a - (TRAIN - (b - a)) // 2, len(text) - TRAIN))
                if b - a <= TRAIN - 8:
                    texts.append(text[i : i + TRAIN])
                    spans.append([n for x, k, y in found if i <= x and y <= i + TRAIN for n in (k, x - i, y - i)])
            digest = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
            if text and digest % 4 == 0:
                digits = [m.start() for m in _NUMBER.finditer(text)]
                i = digits[digest // 4 % len(digits)] - TRAIN // 2 if digits and digest % 8 else digest // 8 % len(text)
                i = max(0, min(i, len(text) - TRAIN))
                part = text[i : i + TRAIN]
                if not any(a < i + TRAIN and i < b for a, _, b in found) and not _DOUBTFUL.search(part) and len(_bare(part)) <= 8:
                    texts.append(part)
                    spans.append([])
        kinds = [sorted(set(s[::3])) or [len(KINDS)] for s in spans]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.int64())), pa.array(kinds, pa.list_(pa.int64()))], names=["window", "inside", "kinds"])


def _chosen(examples: DataFrame, most: int) -> list:
    """At most `most` unlike windows, by hash: of each kind an equal share of those that hold it, the rest of any kind.

    A threshold on the hash, from the number of unlike windows of a kind, comes before the sort, so what tasks hand on
    doesn't grow with their number.
    """
    examples = staged(examples.withColumn("h", F.xxhash64("window")), "examples")
    share = -(-most // (len(KINDS) + 1))
    many = {r.kind: r.n for r in examples.select(F.explode("kinds").alias("kind"), "h").groupBy("kind").agg(F.approx_count_distinct("h").alias("n")).collect()}
    chosen: dict[str, object] = {}
    rest = []
    for kind, n in sorted(many.items()):
        part = examples.filter(F.array_contains("kinds", kind))
        if n > 4 * most:
            part = part.filter(F.pmod("h", F.lit(n)) < 2 * most)
        got = part.groupBy("window").agg(F.min(F.struct("inside", "kinds")).alias("e")).orderBy(F.xxhash64("window"), "window").limit(most).select("window", "e.inside", "e.kinds").collect()
        chosen.update((w.window, w) for w in got[:share])
        rest += got[share:]
    for w in rest:
        if len(chosen) < most:
            chosen.setdefault(w.window, w)
    return list(chosen.values())


def _split_at(s: str, at: str, dot: str) -> str:
    local, _, domain = s.partition("@")
    return local + at + domain.replace(".", dot)


def _grouped(digits: str, by: str) -> str:
    return by.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _bare(s: str) -> str:
    return _DIGITS.sub("", s)


#: Forms that the formats miss, by kind.
FORMS = [
    [
        lambda s: _split_at(s, " @ ", "."), lambda s: _split_at(s, " at ", " dot "), lambda s: _split_at(s, "(at)", "."), lambda s: _split_at(s, " (at) ", " (dot) "), lambda s: _split_at(s, "[at]", "[dot]"),
        lambda s: _split_at(s, " AT ", " DOT "), lambda s: _split_at(s, "@ ", " . "), lambda s: _split_at(s, " at ", "."), lambda s: _split_at(s, " [at] ", "."), lambda s: _split_at(s, "@", " . "),
        lambda s: _split_at(s, "{at}", "."), lambda s: _split_at(s, " <at> ", "."), lambda s: _split_at(s, " {at} ", " {dot} "), lambda s: _split_at(s, "_at_", "_dot_"), lambda s: _split_at(s, "(AT)", "(DOT)"),
    ],
    [lambda s: s.replace(".", " . "), lambda s: s.replace(".", "[.]"), lambda s: s.replace(".", "(.)"), lambda s: s.replace(".", ". "), lambda s: s.replace(".", " dot "), lambda s: s.replace(".", "[dot]")],
    [lambda s: _grouped(_bare(s), "."), lambda s: _grouped(_bare(s), "/"), lambda s: _grouped(_bare(s), "_"), lambda s: _grouped(_bare(s), "  "), lambda s: _grouped(_bare(s), " - "), lambda s: _grouped(_bare(s), ":"), lambda s: _grouped(_bare(s), " . ")],
    [lambda s: s[1:], lambda s: "00" + s[1:], lambda s: "00" + _bare(s), lambda s: ".".join(_PARTS.findall(s)), lambda s: "+ " + s[1:], lambda s: "-".join(_PARTS.findall(s)), lambda s: "/".join(_PARTS.findall(s)), lambda s: " ".join(_PARTS.findall(s)), lambda s: "0" + " ".join(_PARTS.findall(s))[1:]],
]
#: Numbers that are none of the kinds.
OTHERS = ["20{d}{d}-0{e}-1{d}", "1{d}.0{e}.20{d}{d}", "{e},{d}{d}{d}.{d}{d}", "v{e}.{d}.{d}", "1{d}:{e}{d}:0{d}", "{e}{d}%", "#{e}{d}{d}{d}{d}", "{e}{d}{d}{d}", "{e}.{d}{d}", "{e}{d}{d}-{e}", "1{d}{d}{d}/{e}", "{e} {d}{d}{d} {d}{d}{d}", "id {e}{d}{d}{d}{d}{d}"]


def _varied(kind: int, s: str, r: np.random.Generator) -> str:
    """The span with other digits, an address also with other letters, half of the time in one of FORMS."""
    out = [str(r.integers(10)) if c.isdigit() and kind != 1 else c for c in s]
    if kind == 1:
        out = list(".".join(str(r.integers(256)) for _ in s.split(".")))
    elif kind == 0 and r.random() < 0.7:
        out = [chr(97 + r.integers(26)) if c.isascii() and c.islower() and r.random() < 0.5 else c for c in out]
    text = "".join(out)
    return FORMS[kind][r.integers(len(FORMS[kind]))](text) if r.random() < 0.7 else text


def _rewritten(text: str, spans: list[tuple[int, int, int]], r: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    out, moved, at, size = [], [], 0, 0
    for k, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        new = _varied(k, text[a:b], r)
        out += [text[at:a], new]
        size += a - at + len(new)
        moved.append((k, size - len(new), size))
        at = b
    return "".join(out) + text[at:], moved


def _made(windows: list[tuple[str, list[tuple[int, int, int]]]], examples: int, r: np.random.Generator) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Training windows: the given ones, then rewritten ones, each kind as often as the others."""
    plain = [t for t, s in windows if not s]
    by_kind = [[(t, (a, b)) for t, s in windows for k, a, b in s if k == kind] for kind in range(len(KINDS))]
    kinds = [k for k in range(len(KINDS)) if by_kind[k]]
    out = list(windows[: examples // 2])
    while len(out) < examples:
        kind = kinds[len(out) % len(kinds)]
        text, (a, b) = by_kind[kind][r.integers(len(by_kind[kind]))]
        if plain and r.random() < 0.5:  # in the place of a word of a window without spans, or a number of another sort
            host = plain[r.integers(len(plain))]
            gaps = [i for i, c in enumerate(host) if c == " "] or [0]
            i = gaps[r.integers(len(gaps))] + (host[:1] == " " or len(gaps) > 1)
            j = host.find(" ", i)
            j = len(host) if j < 0 else j
            if r.random() < 0.25:
                new, mark = OTHERS[r.integers(len(OTHERS))], []
                while "{" in new:
                    new = new.replace("{d}", str(r.integers(10)), 1).replace("{e}", str(r.integers(1, 10)), 1)
            else:
                new = _varied(kind, text[a:b], r)
                mark = [(kind, i, i + len(new))]
            start = max(0, i + len(new) - TRAIN + 8)
            out.append(((host[:i] + new + host[j:])[start:], [(k, x - start, y - start) for k, x, y in mark if x >= start]))
        else:
            inside = next(s for t, s in windows if t is text)
            out.append(_rewritten(text, inside, r))
    return out


def train(windows: list[tuple[str, list[tuple[int, int, int]]]], examples: int = EXAMPLES, seed: int = 9) -> Tagger:
    """Tags: 0 outside; 1 + kind at a span's first character, 5 + kind at the others."""
    made = _made(windows, examples, np.random.default_rng(seed))
    ids, gold = np.full((len(made), TRAIN), 32, np.int64), np.zeros((len(made), TRAIN), np.int64)
    for row, (text, spans) in enumerate(made):
        text = text[:TRAIN]
        ids[row, : len(text)] = symbols(text)
        for k, a, b in spans:
            if a < TRAIN:
                gold[row, a : min(b, TRAIN)] = 5 + k
                gold[row, a] = 1 + k
    model = Tagger(1 + 2 * len(KINDS))
    model.fit(ids, gold)
    return model


def _scores(model: Tagger, texts: list[str]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Emission scores of the characters of each text that has any that may be tagged, and which these are; each from the
    window in which it stands furthest from the edges."""
    codes = [symbols(t) for t in texts]
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    step = WINDOW - 2 * MARGIN
    windows = [(n, i, min(WINDOW, len(c) - i)) for n, c in enumerate(codes) for i in range(0, max(1, len(c) - 2 * MARGIN), step) if len(c)]
    windows.sort(key=lambda w: w[2])
    outside = np.full(model.tags, -1e4, np.float32)
    outside[0] = 0
    for k in range(0, len(windows), TOGETHER):
        some = windows[k : k + TOGETHER]
        ids = np.full((len(some), some[-1][2]), 32, np.int64)
        for row, (n, i, size) in enumerate(some):
            ids[row, :size] = codes[n][i : i + size]
        em = model.emissions(ids)
        hot = model.hot(em)
        for row in np.flatnonzero(hot.any(axis=0)).tolist():
            n, i, size = some[row]
            first, last = MARGIN if i else 0, size if i + size == len(codes[n]) else WINDOW - MARGIN
            if not hot[first:last, row].any():
                continue
            if n not in out:
                out[n] = np.tile(outside, (len(codes[n]), 1)), np.zeros(len(codes[n]), bool)
            out[n][0][i + first : i + last] = em[first:last, :, row]
            out[n][1][i + first : i + last] = hot[first:last, row]
    return out


def _stretches(hot: np.ndarray) -> list[tuple[int, int]]:
    """Where hot characters stand, with BESIDE on either side; stretches that touch are one."""
    at = np.flatnonzero(hot)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 2 * BESIDE) + 1
    lo, hi = at[np.append(0, cut)], at[np.append(cut - 1, len(at) - 1)]
    return list(zip(np.maximum(lo - BESIDE, 0).tolist(), np.minimum(hi + BESIDE + 1, len(hot)).tolist()))


def tag(model: Tagger, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of the tagged spans of each text."""
    parts, owner = [], []
    for n, (em, hot) in _scores(model, texts).items():
        for a, b in _stretches(hot):
            parts.append(em[a:b])
            owner.append((n, a))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for (n, at), tags in zip(owner, model.decode(parts)):
        spans: list[list[int]] = []
        for i in np.flatnonzero(tags).tolist():
            kind = int(tags[i] - 1) % len(KINDS)
            if tags[i] > len(KINDS) and spans and spans[-1][2] == i and spans[-1][1] == kind:
                spans[-1][2] = i + 1
            else:
                spans.append([i, kind, i + 1])
        out[n] += [(at + a, k, at + b) for a, k, b in spans]
    return out


def find_pii(docs: DataFrame, train_windows: int = TRAIN_WINDOWS, examples: int = EXAMPLES, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans (kind, start, end, text), ordered by start and kind, for every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.filter("text is not null").select("text").mapInArrow(_examples, "window string, inside array<long>, kinds array<long>")
    windows = [(w.window, list(zip(*[iter(w.inside)] * 3))) for w in _chosen(found, train_windows)]
    model = train(windows, examples) if any(s for _, s in windows) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = KINDS + ADDED
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                found = [formats(t) if _TRIGGER.search(t) else [] for t in texts]
                for spans, text, tagged in zip(found, texts, tag(model, texts) if model is not None else []):
                    covered = bytearray(len(text)) if tagged else b""
                    for a, _, b in spans if tagged else []:
                        covered[a:b] = b"\1" * (b - a)
                    for a, kind_of, b in tagged:
                        edges = _JOINED.match(text, max(a - 1, 0), a + 1) and a > 0 or _JOINED.match(text, b - 1, b + 1)
                        if not edges and b - a >= least and 1 not in covered[a:b] and _whole(kind_of, text[a:b]):
                            spans.append((a, len(KINDS) + kind_of, b))
                out = [[{"kind": names[k], "start": a, "end": b, "text": text[a:b]} for a, k, b in sorted(spans)] for text, spans in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def _whole(kind: int, text: str) -> bool:
    """Whether the span can be one of its kind: enough digits, or letters on both sides of an at."""
    digits = len(_bare(text))
    return (_AT.search(text) is not None, 4 <= digits <= 12, 12 <= digits <= 19, 9 <= digits <= 17)[kind]
