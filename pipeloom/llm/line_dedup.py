"""Line dedup over a suffix array of line sequences, with DataFrame operations only.

Suffixes begin at each line. Distributed prefix doubling ranks them by their first 1, 2, 4, ... lines: a rank is the
place of the pair of half ranks in their global sort order, and only suffixes that share their rank with another stay,
since no other has a longest common prefix of that depth. Suffixes of one rank are an LCP interval.

A run of lines repeats if an earlier place, in the order of doc_id and line, has the same lines. A repeated run is
deleted if it has `min_lines` lines, or is one, and `min_chars` characters in all. Each such run is the union of its
shortest parts of `min_lines` lines and `min_chars` characters, taken from each line on and up to each line; two parts of
n lines are equal where their first and their last 2^k lines have equal ranks, 2^k <= n < 2^(k+1). Doubling goes on until
no part is longer than the depth reached or all ranks are unique, whichever is first; the parts that an earlier copy
has join to maximal runs.

Null and empty texts stay as they are and have no runs; rows with a null doc_id stay as they are and mark nothing;
rows that share a doc_id are ordered by a hash of their text; a row repeated as it is counts once, and all its copies
get the same result. Texts may be of any length; an empty table gives an empty result; columns of docs that are named
like an added one are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipeloom.llm.columns import unused, without
from pipeloom.shared import staged

MIN_LINES, MIN_CHARS = 3, 60
BROADCAST_BYTES = 32 << 20
_TEXT = ["id", "text_key"]


def _ranked(suffixes: DataFrame, keys: list[str]) -> DataFrame:
    """Suffixes whose keys repeat, with their rank in the order of the keys and the place of their first copy."""
    groups = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("id", "text_key", "pos")).alias("first")).filter("n > 1")
    ranks = staged(groups.sort(*keys).select(*keys, "first", F.monotonically_increasing_id().alias("rank")), "ranks")
    return staged(suffixes.drop("rank", "first").join(ranks, keys).drop(*keys), "suffixes")


def _later() -> Column:
    return F.struct("id", "text_key", "pos") > F.col("first")


def _bound(lines: DataFrame, asked: Column, found: Column, ascending: bool) -> DataFrame:
    """For each line the nearest line of its stretch whose `found` is not beyond its `asked` in this direction, as `met`."""
    row = lambda value, ask: F.struct(value.alias("v"), F.lit(ask).alias("ask"))
    rows = lines.select(*_TEXT, "stretch", "pos", F.explode(F.array(row(found, 0), row(asked, 1))).alias("r")).select(*_TEXT, "stretch", "pos", "r.v", "r.ask")
    order = [F.col("v"), F.col("ask"), F.col("pos")] if ascending else [F.desc("v"), F.col("ask"), F.desc("pos")]
    seen = Window.partitionBy(*_TEXT, "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("met", F.last(F.when(F.col("ask") == 0, F.col("pos")), ignorenulls=True).over(seen)).filter("ask = 1 and met is not null")


def _parts(suffixes: DataFrame, min_lines: int, min_chars: int) -> DataFrame:
    """(id, text_key, pos, size): the shortest parts of repeated lines, in a row, that are long enough, from each line on and up to each line."""
    here = Window.partitionBy(*_TEXT).orderBy("pos")
    lines = suffixes.select(*_TEXT, "pos", "chars", (F.col("pos") - F.row_number().over(here)).alias("stretch"))
    so_far = Window.partitionBy(*_TEXT, "stretch").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("end", F.sum("chars").over(so_far)).withColumn("n", F.count("*").over(Window.partitionBy(*_TEXT, "stretch")))
    lines = lines.filter(F.col("n") >= min_lines)
    begin = F.col("end") - F.col("chars")
    on = _bound(lines, begin + min_chars, F.col("end"), ascending=False).select(*_TEXT, "stretch", "pos", F.greatest(F.col("met") - F.col("pos") + 1, F.lit(min_lines)).alias("size"))
    upto = _bound(lines, F.col("end") - min_chars, begin, ascending=True).select(*_TEXT, "stretch", F.least(F.col("met"), F.col("pos") - (min_lines - 1)).alias("from"), "pos")
    upto = upto.select(*_TEXT, "stretch", F.col("from").alias("pos"), (F.col("pos") - F.col("from") + 1).alias("size"))
    edges = lines.groupBy(*_TEXT, "stretch").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    found = on.unionByName(upto).join(edges, [*_TEXT, "stretch"])
    return found.filter("pos >= lo and pos + size - 1 <= hi").select(*_TEXT, "pos", "size").distinct()


def _once(rows: DataFrame) -> DataFrame:
    """rows with each (id, text_key) once; only texts that are repeated as they are get shuffled."""
    again = staged(rows.groupBy(*_TEXT).agg(F.count("*").alias("n")).filter("n > 1").select(*_TEXT), "again")
    if again.isEmpty():
        return rows
    return rows.join(again, _TEXT, "left_anti").unionByName(rows.join(again, _TEXT, "left_semi").dropDuplicates(_TEXT))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_key (hash of the text) and runs: the lines to delete as an ordered array of (start, stop)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), F.split(text_col, "\n").alias("lines")).filter(f"id is not null and {text_col} is not null")
    rows = _once(rows)
    # two hashes from different seeds: the salt goes in before the line
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b"), F.length(x).alias("chars")))
    lines = rows.select(*_TEXT, F.posexplode(hashed).alias("pos", "h")).select(*_TEXT, "pos", F.col("h.a").alias("a"), F.col("h.b").alias("b"), F.col("h.chars").cast("long").alias("chars"))
    suffixes = _ranked(staged(lines, "lines"), ["a", "b"])
    marks = suffixes.filter(_later() & (F.col("chars") >= min_chars)).select(*_TEXT, "pos", (F.col("pos") + 1).alias("stop"))
    parts, depth = staged(_parts(suffixes, min_lines, min_chars), "parts"), 1
    suffixes = suffixes.drop("chars")
    while True:
        longest = parts.agg(F.max("size")).first()[0] or 0  # of the parts that still can repeat
        if longest < depth:
            break
        if (now := parts.filter(f"size < {2 * depth}")).limit(1).count():
            whole = now.join(suffixes.select(*_TEXT, "pos", F.col("rank").alias("head")), [*_TEXT, "pos"]).withColumn("at", F.col("pos") + F.col("size") - depth)
            whole = staged(whole.join(suffixes.select(*_TEXT, F.col("pos").alias("at"), F.col("rank").alias("tail")), [*_TEXT, "at"]).drop("at"), "whole")
            first = whole.groupBy("size", "head", "tail").agg(F.count("*").alias("n"), F.min(F.struct("id", "text_key", "pos")).alias("first")).filter("n > 1").drop("n")
            marks = marks.unionByName(whole.join(first, ["size", "head", "tail"]).filter(_later()).select(*_TEXT, "pos", (F.col("pos") + F.col("size")).alias("stop")))
        if longest < 2 * depth:
            break
        ahead = Window.partitionBy(*_TEXT).orderBy("pos").rangeBetween(depth, depth)
        pairs = suffixes.withColumn("next", F.max("rank").over(ahead)).filter("next is not null").withColumnRenamed("rank", "half")
        suffixes = _ranked(pairs, ["half", "next"])
        depth *= 2
        parts = staged(parts.filter(F.col("size") >= depth).join(suffixes.select(*_TEXT, "pos"), [*_TEXT, "pos"]), "parts")
    here = Window.partitionBy(*_TEXT).orderBy("pos")
    reach = F.max("stop").over(here.rowsBetween(Window.unboundedPreceding, -1))
    islands = marks.groupBy(*_TEXT, "pos").agg(F.max("stop").alias("stop")).withColumn("fresh", F.coalesce(F.col("pos") > reach, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("fresh").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*_TEXT, "island").agg(F.min("pos").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy(*_TEXT).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col without the later copies, and n_lines, n_removed and removed_runs."""
    docs = without(docs, "n_lines", "n_removed", "removed_runs")
    number, key, cuts, all_lines = unused(docs, "_id", "_key", "_runs", "_lines")
    runs = staged(repeated_runs(docs, min_lines, min_chars, id_col, text_col).withColumnsRenamed({"id": number, "text_key": key, "runs": cuts}), "runs")
    if (runs.agg(F.sum(F.size(cuts) * 8 + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        runs = F.broadcast(runs)
    joined = docs.join(runs, (docs[id_col].cast("long") == runs[number]) & (F.xxhash64(docs[text_col]) == runs[key]), "left")
    joined = joined.withColumn(all_lines, F.split(text_col, "\n"))
    # what stands between the runs: from the stop of one to the start of the next
    starts = F.concat(F.transform(cuts, lambda r: r["start"]), F.array(F.size(all_lines)))
    stops = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda r: r["stop"]))
    between = F.transform(F.arrays_zip(stops.alias("a"), starts.alias("b")), lambda g: F.slice(all_lines, g["a"] + 1, g["b"] - g["a"]))
    kept = F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(between), "\n"))
    removed = F.coalesce(F.aggregate(cuts, F.lit(0), lambda s, r: s + r["stop"] - r["start"]), F.lit(0))
    n_lines = F.coalesce(F.size(all_lines), F.lit(0))
    return joined.select(*(kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), F.greatest(n_lines, F.lit(0)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), F.col(cuts).alias("removed_runs"))


#: From each line on, and up to each line, the shortest part of three lines and 60 characters; a part, or a line of 60
#: characters, that stands earlier too is deleted.
ORACLE_SQL = """
with split as materialized (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null and doc_id is not null),
lines as materialized (
  select *, sum(chars) over (partition by doc_id order by pos) as c
  from (select doc_id, pos, line, length(line) as chars from (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from split))),
wide as materialized (select a.doc_id, a.pos as lo, b.pos as hi from lines a join lines b on b.doc_id = a.doc_id and b.pos >= a.pos + 2 and b.c - a.c + a.chars >= 60),
parts as (
  select doc_id, lo, min(hi) as hi from wide group by 1, 2
  union select doc_id, max(lo), hi from wide group by doc_id, hi
  union select doc_id, pos, pos from lines where chars >= 60),
named as (select doc_id, lo, hi, array_to_string(ls[lo + 1:hi + 1], chr(10)) as w, hi - lo as n from parts join split using (doc_id)),
later as (select doc_id, lo, hi from (select *, row_number() over (partition by n, w order by doc_id, lo) as copy from named) where copy > 1),
gone as (select distinct doc_id, unnest(range(lo, hi + 1)) as pos from later),
kept as (
  select l.doc_id, count(*) as n_lines, count(g.pos) as n_removed, string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null) as kept
  from lines l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos group by l.doc_id)
select d.doc_id, coalesce(k.n_lines, 0)::bigint as n_lines, coalesce(k.n_removed, 0)::bigint as n_removed,
       case when d.text is null or d.doc_id is null then d.text else coalesce(k.kept, '') end as text
from documents d left join kept k on d.doc_id = k.doc_id
"""
