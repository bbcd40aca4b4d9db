"""Lexical search, whitening and chat trees against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipeloom.llm import chat_tree, lexical_search, whitening
from pipeloom.llm.chat_tree import digests, read_back
from pipeloom.llm.lexical_search import build_index, search
from pipeloom.llm.whitening import bidiagonal, principal, squared_singular_values, whiten

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute_search(docs, items, top=10):
    docs = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(FOLD))) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores, key=lambda s: s[:3])[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("piece,block", [(1 << 19, 1 << 20), (200, 30)])
def test_search_equals_brute_force(spark, monkeypatch, piece, block):
    monkeypatch.setattr(lexical_search, "PIECE_TERMS", piece)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    draw = random.Random(3)
    words = ["the", "Of", "straße", "ÄRA", "x1", "42", "don't", "a-b", "日本", "ZEBRA", "lorem"] + [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(draw.choices(words, weights=[30, 20] + [3] * (len(words) - 2), k=n))
    docs = [(k, text(draw.choice([1, 3, 8, 8, 8, 40]))) for k in range(300)]
    docs += [(1000 + k, docs[5][1]) for k in range(30)] + [(5, docs[5][1]), (7, "other words"), (None, docs[5][1]), (400, None), (401, ""), (402, "?! ..."), (403, text(20_000))]
    items = [(k, text(12)) for k in range(20)] + [(50, docs[5][1]), (51, None), (52, "--"), (53, "nowhere"), (50, "zebra"), (None, "lorem 42")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("m", F.lit("clash")).withColumn("piece", F.lit(1)).repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0))
    got = [tuple(r) for r in search(build_index(table), asked).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == brute_search(docs, items)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search(build_index(none), items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert search(build_index(some), items.limit(0)).count() == 0
    assert search(build_index(some), items).count() == 1


@pytest.mark.parametrize("kind", ["plain", "graded", "dependent", "equal", "close", "wide"])
def test_principal_values(kind):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 24))
    if kind == "graded":
        a = a * 10.0 ** -np.arange(24)
    if kind == "dependent":
        a[:, 1], a[:, 2] = 3 * a[:, 0], 0
    if kind == "equal":
        a = np.vstack([np.eye(24), -np.eye(24)])
    if kind == "close":
        q, _ = np.linalg.qr(a)
        a = q * (1 + 1e-9 * np.arange(24))
    if kind == "wide":
        a = rng.normal(size=(5, 24))
    r = np.zeros((24, 24))
    r[: min(24, len(a))] = np.linalg.qr(a, mode="r")
    values, vectors, trace = principal(r, len(a), 4)
    v = r.T @ r / len(a)
    want = np.linalg.svd(r, compute_uv=False)
    diagonal, above, _ = bidiagonal(r)
    found = squared_singular_values(diagonal, above)
    sure = want > want[0] * 1e-13
    assert np.allclose(found[: sure.sum()], want[sure] ** 2, rtol=1e-6 if kind == "graded" else 1e-12)
    assert np.allclose(v @ vectors.T, vectors.T * values, atol=1e-13 * values[0]) and np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-10)
    assert math.isclose(trace, np.trace(v), rel_tol=1e-12)


def brute_whiten(rows):
    sound = [(i, [math.floor(256 * c) + 0 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in sound} - {0}:
        fit = np.array(sorted({tuple(x) for _, x in sound if len(x) == d}), object)
        n, sums = len(fit), fit.sum(0)
        centred = np.array((fit * n - sums) / n, float)
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        order = [k for k in np.argsort(-values)[:4] if values[k] > 1e-20 * max(values.max(), 1e-300) and values[k] > 0]
        for i, x in sound:
            if len(x) == d:
                off = [n * a - s for a, s in zip(x, sums)]
                for c, k in enumerate(order):
                    out.append((i, c + 1, n, sum(o * o for o in off), float(np.array(off, float) / n @ vectors[:, k] / math.sqrt(values[k])), values[k] / values.sum()))
    return out


def test_whiten_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.2]).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[3][1]) for k in range(50)] + [(3, rows[4][1]), (2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, []), (2005, [-0.0] * 6), (None, rows[9][1])]
    rows += [(3000 + k, rng.normal(size=2).tolist()) for k in range(20)] + [(4000, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("v", F.lit(2)).repartition(40)
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = whiten(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = brute_whiten(rows)
    key = lambda r: (str(r[0]), r[1], r[2], r[3], round(abs(r[4]), 6))
    assert len(got) == len(want) > 1500
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:4] == b[:4] and abs(abs(a[4]) - abs(b[4])) < 1e-8 and math.isclose(a[5], b[5], rel_tol=1e-9) and a[6] < 1e-10
    assert whiten(table.limit(0)).count() == 0


def test_whiten_huge_entries(spark):
    rows = [(k, [1e15 * k, float(k % 3)]) for k in range(8)] + [(9, [1e300, 1.0])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=2).collect()
    assert len(got) in (9, 18) and all(r.deviation is None for r in got if r.vec_id == 9)


def test_whiten_floats_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {(r.vec_id, r.component): r for r in whiten(table).collect()}
    want = brute_whiten([(r.vec_id, [float(c) for c in r.embedding]) for r in table.collect()])
    assert len(got) == len(want) == 4 * table.count()
    for i, c, n, deviation, whitened, explained in want:
        r = got[i, c]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(whitened)) < 1e-7 and math.isclose(r.explained, explained, rel_tol=1e-9)


CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello </turn>\n"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "hello </turn>\n"), (2, 3, "user", "more"), (2, 4, "assistant", "<turn>user\nok</turn>"),
    (3, 0, "system", "be kind"), (3, 1, "user", "bye"), (3, 2, "assistant", ""),
    (4, 5, "user", "hi"), (4, None, "system", "be kind"), (4, 9, "assistant", "hello \\</turn>\n"),
    (5, 0, "us\ner\\<turn>", "\\"), (5, 1, "assistant", None), (5, 1, None, "twice"), (5, 1, None, "twice"),
    (None, 0, "user", "lost"), (None, 1, "assistant", "found \U0001f600 \\<\\/turn>"), (6, 0, "user", ""), (7, 0, "assistant", "x" * 200_000),
]


def chats(spark, more=()):
    return spark.createDataFrame([*CHATS, *more], "conv_id long, turn int, role string, text string").withColumn("branch", F.lit("clash")).withColumn("key", F.lit(0))


def written(rows):
    found = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        found.setdefault(conv, []).append((role or "", text or ""))
    return found


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_chat_trees(spark, parts):
    draw = random.Random(parts)
    more = []
    for conv in range(100, 160):
        more += [(conv, k, ["user", "assistant"][k % 2], draw.choice("ab")) for k in range(draw.randint(1, 9))]
    more += [(200 + c, k, "user", "always") for c in range(40) for k in range(3)] + [(300, k, "user", str(k % 7)) for k in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        tree = chat_tree.chat_tree(chats(spark, more).repartition(7))
        segments, attention, members = tree.segments.collect(), tree.attention.collect(), tree.members.collect()
        back = read_back(tree).collect()
        made = {r.conv_id: r for r in digests(tree).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = written([*CHATS, *more])
    want[5] = [want[5][0], *sorted(want[5][1:])]
    turns = {}
    for r in sorted(back, key=lambda r: r.position):
        turns.setdefault(r.branch, []).append(r)
    assert {m.conv_id for m in members} == set(want) == set(made)
    for m in members:
        got = [(r.role, r.text) for r in turns[m.branch]]
        assert (got == want[m.conv_id] or m.conv_id == 5 and sorted(got) == sorted(want[5])) and m.n_turns == len(got)
        assert [r.position for r in turns[m.branch]] == np.cumsum([0, *(r.length for r in turns[m.branch])])[:-1].tolist()
        d = made[m.conv_id]
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in got).encode()).hexdigest() and d.formatted_chars == m.chars == sum(r.length for r in turns[m.branch])
        loss = "".join(b for a, b in got if a == "assistant")
        assert d.loss_chars == len(loss) and d.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    # every distinct prefix is emitted once, without gaps, depth-first: the nodes below a node follow it at once
    assert len(segments) == len({tuple(v[: k + 1]) for c, v in want.items() if c != 5 for k in range(len(v))}) + 4
    segments.sort(key=lambda s: s.start)
    assert [s.start for s in segments] == np.cumsum([0, *(s.length for s in segments)])[:-1].tolist()
    assert all(len(s.text) == s.length for s in segments)
    open_positions = [0]
    for s in segments:  # a preorder: each node starts where one of those on the way to the one before it starts or ends
        while open_positions and open_positions[-1] > s.position:
            open_positions.pop()
        assert open_positions and open_positions[-1] == s.position
        open_positions.append(s.position + s.length)
    # what a branch may attend to is what stands before its own units in its conversation
    stream = "".join(s.text for s in segments)
    for b, own in turns.items():
        ranges = sorted((a.start, a.stop) for a in attention if a.branch == b)
        mine = [s for s in segments if s.branch == b]
        text = "".join(stream[x:y] for x, y in ranges) + "".join(s.text for s in mine)
        assert len(text) == sum(r.length for r in own) and mine[0].position == sum(y - x for x, y in ranges)
        assert text.endswith(mine[-1].text) and all(stream[s.loss_start : s.loss_stop] for s in mine if s.loss_start is not None)


def test_no_chats(spark):
    assert digests(chat_tree.chat_tree(chats(spark).limit(0))).count() == 0


def test_vectors_that_share_a_vec_id_stay_apart(spark):
    from pipeloom.llm.embedding_dedup import near_vectors

    a, b = [1.0] + [0.0] * 7, [0.0] * 7 + [1.0]
    near = lambda v: [x + 0.05 for x in v]
    rows = [(5, a, 1), (5, b, 1), (7, near(a), 1), (8, near(b), 1), (9, a, 2), (5, a, 1)]
    got = sorted(tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(5, 1, 5, True), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 1, 5, False), (9, 0, 9, True)]
