"""Chat formatting as prefix trees: conversations that share initial turns share their tokens.

A turn is written as <turn>role, a line break, its text and </turn> with a line break; backslashes, and the marks where
role or text hold them, are escaped by a backslash, as are line breaks in roles. The unit of all places is the code point of this form. A node
of the tree is a turn with all before it, known by 124 bits of hash. Conversations that end in one node are one
path. Chains of nodes without forks are single edges, paths are put into the order of their edges, which visits
the tree depth-first, and each node is emitted once, by the first path that holds it:

- segments: a row for each node: the branch that emits it, start in the emitted sequence, length, position (of its
  first unit in its conversation), text, and loss_start, loss_stop (the unit's range that is learned; null if none);
- attention: for each branch, ranges start to stop of the sequence that its own units may attend to besides its own
  units before them, a row for each earlier branch that emitted ancestors of it;
- members: for each conversation, its branch, n_turns and chars (its end in position units).

Turns go by `turn` (null first); turns that tie go by hash of role and text, and copies of a turn follow each other. Null
texts and roles are empty; rows with a null conv_id are one conversation. An empty table gives empty tables; other
columns are not read.

Scale: turns of a conversation are counted and hashed by running sums over range partitions, so a conversation may
hold any share of all rows. An array holds the forks of one path; a path with k forks shares its turns with k other paths, so k is
below the square root of twice all rows. What is broadcast has a row for each partition at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipeloom.shared import staged

OPEN, CLOSE = "<turn>", "</turn>"
LANES, _BITS = 4, 31


def _escaped(text: Column, lines: bool = False) -> Column:
    return F.regexp_replace(text, r"(\\|(?<=<)(?=/?turn>)" + ("|\n" if lines else "") + ")", r"\\$1")


def _unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), _escaped(role, lines=True), F.lit("\n"))


@dataclass
class ChatTree:
    segments: DataFrame
    attention: DataFrame
    members: DataFrame


def _before_blocks(blocks: DataFrame, sums: list[str]) -> DataFrame:
    """Of the blocks of keys that span several: the totals of the blocks before; fewer rows than partitions."""
    w = Window.partitionBy("key").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    found = blocks.select("key", "pid", *(F.sum(c).over(w).alias(f"{c}_before") for c in sums))
    return F.broadcast(found.filter(F.col(f"{sums[0]}_before").isNotNull()))


def _turns(rows: DataFrame, parts: int) -> DataFrame:
    """key, i, id, node, parent, pos, len, head and body of every row: its place, itself and what stands before it."""
    order = ["turn", "g1", "g2", "id"]
    light = rows.select("key", *order, "head", "body").withColumn("len", F.col("head") + F.col("body") + len(CLOSE) + 1)
    dealt = staged(light.repartitionByRange(parts, "key", *order).withColumn("pid", F.spark_partition_id()), "turns")
    counted = _before_blocks(dealt.groupBy("key", "pid").agg(F.count("*").alias("n")), ["n"])
    inner = Window.partitionBy("key", "pid").orderBy(*order)
    up_to = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(counted, ["key", "pid"], "left").withColumn("i", F.row_number().over(inner) + F.coalesce("n_before", F.lit(0)))
    lanes = [f"l{k}" for k in range(LANES)]
    for k, lane in enumerate(lanes):
        placed = placed.withColumn(f"h{k}", F.pmod(F.xxhash64("i", "g1", "g2", F.lit(k)), F.lit(1 << _BITS)))
    sums = [F.pmod(F.sum(f"h{k}").over(up_to), F.lit(1 << _BITS)).alias(lane) for k, lane in enumerate(lanes)]
    placed = staged(placed.select("key", "pid", "i", "id", "len", "head", "body", *(f"h{k}" for k in range(LANES)), *sums, F.sum("len").over(up_to).alias("stop")), "placed")
    totals = placed.groupBy("key", "pid").agg(F.max_by(F.struct("stop", *lanes), "i").alias("t")).select("key", "pid", "t.*")
    out = placed.join(_before_blocks(totals, ["stop", *lanes]), ["key", "pid"], "left")
    lane = lambda k, less: F.pmod(F.col(f"l{k}") + F.coalesce(f"l{k}_before", F.lit(0)) - less, F.lit(1 << _BITS))
    pair = lambda less: F.struct(*((F.shiftleft(lane(k, less(k)), _BITS) + lane(k + 1, less(k + 1))).alias(x) for k, x in ((0, "a"), (2, "b"))))
    return out.select("key", "i", "id", "len", "head", "body", pair(lambda k: F.lit(0)).alias("node"), pair(lambda k: F.col(f"h{k}")).alias("parent"), (F.col("stop") + F.coalesce("stop_before", F.lit(0)) - F.col("len")).alias("pos"))


def _paths(own: DataFrame, ends: DataFrame, parts: int) -> DataFrame:
    """key, chars and path of each path in depth-first order: branch numbers rise along it, pid is the part of the order."""
    edges = own.select("parent", "node").distinct()
    forks = edges.groupBy("parent").count().filter("count > 1").select("parent").unionByName(ends.select(F.col("node").alias("parent"))).distinct()
    starts = own.filter("i > 1").join(forks, "parent", "left_semi").unionByName(own.filter("i = 1"))
    paths = starts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "node", "pos"))).alias("path")).join(ends.select("key", "chars"), "key")
    paths = paths.withColumn("route", F.transform("path", lambda s: s["node"])).repartitionByRange(parts, "route").withColumn("pid", F.spark_partition_id())
    paths = staged(paths, "paths")
    number = F.row_number().over(Window.partitionBy("pid").orderBy("route"))
    return paths.select("key", "chars", "path", "pid", (F.shiftleft(F.col("pid").cast("long"), 40) + number).alias("branch"))


def chat_tree(conversations: DataFrame, learned: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> ChatTree:
    """The prefix trees of all conversations; roles in `learned` are under the loss mask."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    conv, role, text = F.col(conv_col), F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.select(conv.alias("conv"), F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("key"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"g1": F.xxhash64("role", "text"), "g2": F.xxhash64("text", F.lit(1), "role"), "head": F.length(_head(F.col("role"))), "body": F.length(_escaped(F.col("text"))), "id": F.monotonically_increasing_id()})
    rows = staged(rows, "chats")
    turns = staged(_turns(rows, parts), "nodes")
    last = turns.groupBy("key").agg(F.max_by("node", "i").alias("node"), F.max("i").alias("n_turns"), F.sum("len").alias("chars"))
    last = staged(last.join(rows.groupBy("key").agg(F.first("conv").alias("conv_id")), "key"), "last")
    ends = staged(last.groupBy("node").agg(F.min(F.struct("key", "chars")).alias("e")).select("node", "e.*"), "ends")
    own = staged(turns.join(ends.select("key"), "key", "left_semi"), "own")

    paths = _paths(own, ends, parts)
    steps = paths.select("key", "chars", "pid", "branch", F.posexplode("path").alias("k", "s"), "path")
    following = F.coalesce(F.try_element_at("path", F.col("k") + 2)["pos"], F.col("chars"))
    steps = staged(steps.select("key", "chars", "pid", "branch", F.col("s.node").alias("node"), F.col("s.pos").alias("pos"), following.alias("stop")), "steps")
    steps = steps.join(steps.groupBy("node").agg(F.min("branch").alias("source")), "node")
    steps = staged(steps, "sources")
    fresh = steps.filter("source = branch").groupBy("key", "chars", "pid", "branch").agg(F.min("pos").alias("fork")).withColumn("fresh", F.col("chars") - F.col("fork"))
    before = lambda by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    blocks = fresh.groupBy("pid").agg(F.sum("fresh").alias("t")).select("pid", F.coalesce(F.sum("t").over(before(["pid"])), F.lit(0)).alias("base"))  # a row for each part
    starts = fresh.withColumn("start", F.coalesce(F.sum("fresh").over(before(["pid", "branch"])), F.lit(0))).join(F.broadcast(blocks), "pid")
    branches = staged(starts.select("key", "branch", "fork", (F.col("start") + F.col("base") - F.col("fork")).alias("shift")), "branches")

    shared = steps.filter("source <> branch").join(branches.select(F.col("branch").alias("source"), "shift"), "source")
    attention = shared.groupBy("branch", "source").agg(F.min(F.col("pos") + F.col("shift")).alias("start"), F.max(F.col("stop") + F.col("shift")).alias("stop"))
    nodes = own.join(branches, "key").filter("pos >= fork").select("id", "branch", (F.col("pos") + F.col("shift")).alias("start"), F.col("len").alias("length"), F.col("pos").alias("position"), "head", "body")
    nodes = nodes.join(rows.select("id", "role", "text"), "id")
    mask = F.col("role").isin(*learned) & (F.col("body") > 0)
    segments = nodes.select(
        "branch", "start", "length", "position", F.concat(_head(F.col("role")), _escaped(F.col("text")), F.lit(CLOSE + "\n")).alias("text"),
        F.when(mask, F.col("start") + F.col("head")).alias("loss_start"), F.when(mask, F.col("start") + F.col("head") + F.col("body")).alias("loss_stop"),
    )
    members = last.select("conv_id", "node", "n_turns", "chars").join(ends.select("node", "key"), "node").join(branches.select("key", "branch"), "key")
    return ChatTree(staged(segments, "segments"), staged(attention, "attention"), staged(members.select("conv_id", "branch", "n_turns", "chars"), "members"))


def read_back(tree: ChatTree) -> DataFrame:
    """branch, position, role, text, learned (the unescaped text under the loss mask) and length of every turn of every branch's conversation, from what was emitted."""
    earlier = tree.attention.select(F.col("branch").alias("into"), F.col("source").alias("branch"), F.col("start").alias("lo"), F.col("stop").alias("hi"))
    earlier = earlier.join(tree.segments, "branch").filter("start >= lo and start < hi").drop("branch", "lo", "hi").withColumnRenamed("into", "branch")
    found = earlier.unionByName(tree.segments)
    form = rf"(?s)\A{OPEN}((?:[^\\\n]|\\.)*)\n(.*){CLOSE}\n\z"
    under = F.expr("substring(text, cast(loss_start - start + 1 as int), cast(loss_stop - loss_start as int))")
    return found.select("branch", "position", *(_unescaped(F.regexp_extract("text", form, k)).alias(c) for k, c in ((1, "role"), (2, "text"))), _unescaped(F.coalesce(under, F.lit(""))).alias("learned"), F.length("text").alias("length"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each branch's turns, which follow each other; nothing but the digests is kept of them."""
    names = ["branch", "turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def closed(state: list) -> dict:
        return dict(zip(names, [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]]))

    state = None
    for batch in batches:
        done = []
        for branch, role, text, learned, length in zip(*(batch.column(c).to_pylist() for c in ("branch", "role", "text", "learned", "length"))):
            if state is None or branch != state[0]:
                done += [closed(state)] if state is not None else []
                state = [branch, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(learned)
            state[4].update(learned.encode())
            state[5] += length
        if done:
            yield pa.RecordBatch.from_pylist(done)
    if state is not None:
        yield pa.RecordBatch.from_pylist([closed(state)])


def digests(tree: ChatTree) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of every conversation, read back."""
    turns = read_back(tree).repartition("branch").sortWithinPartitions("branch", "position")
    found = turns.mapInArrow(_digests, "branch long, turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return tree.members.select("conv_id", "branch").join(found, "branch").select("conv_id", F.col("turns").alias("n_turns"), "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLE_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped as (select *, replace(replace(replace(text, '\', '\\'), '<turn>', '<\turn>'), '</turn>', '<\/turn>') as e from rows)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  sum(6 + length(role) + 1 + length(e) + 7 + 1)::bigint as formatted_chars
from escaped group by conv_id
"""
