"""MinHash near-duplicate groups with tensored banding.

Two collections of `tables` small hashes, each over `band` minhash values, are formed from one signature; every pair
of one hash from either collection keys a table. So tables^2 tables of 2 * band values each cost 2 * tables * band
minhash values instead of tables^2 * 2 * band.

Rows without words have an empty set and no links; repeated rows count as copies; rows with a null doc_id take no
part. Copies (equal sets) are one node. Every candidate pair is confirmed on whole sets, unless both ends already are
in one component. Rows that share a doc_id are one document: what any of its texts is linked with is in its component.
Texts may be of any length; an empty table gives an empty result; other columns of docs are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipeloom.llm.words import Chunk, chunks, mix, tidy
from pipeloom.operators.components import components
from pipeloom.shared import staged

BAND, TABLES = 3, 12
BLOCK_BYTES = 16 << 20
BROADCAST_IDS = 2_000_000
_SEEDS = np.random.default_rng(77).integers(0, 1 << 32, (2, 2 * BAND * TABLES), dtype=np.uint32)


def _sets(chunk: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and where each row's begin."""
    h = chunk.hashes(lower=True)
    grams, whole = chunk.grams(h, words)
    sizes = np.diff(chunk.first)
    row = np.repeat(np.arange(len(sizes)), sizes)
    keep = [grams[whole]]
    owner = [row[whole]]
    for n in range(1, words):  # fewer words than a shingle has: the whole sequence is one
        short = np.flatnonzero(sizes == n)
        if len(short):
            keep.append(mix(chunk.grams(h, n)[0][chunk.first[short]] + np.uint64(n)))
            owner.append(short)
    grams, row = np.concatenate(keep), np.concatenate(owner)
    order = np.argsort(grams, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    grams, row = grams[order], row[order]
    if len(grams):
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        grams, row = grams[first], row[first]
    return grams, np.searchsorted(row, np.arange(len(sizes) + 1))


def _identity(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Two independent sums over each set, which name it."""
    return np.stack([np.add.reduceat(mix(grams ^ np.uint64(salt)), begin) for salt in (0, 0x5851F42D4C957F2D)])


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _SEEDS[0] | np.uint32(1), _SEEDS[1]
        for batch in batches:
            for c in chunks(batch.column(1), 1 << 18):
                grams, at = _sets(c, words)
                n = np.diff(at)
                full = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.uint64)
                sig = np.zeros((len(n), len(a)), np.uint32)
                if len(full):
                    begin = at[:-1][full]
                    sums[:, full] = _identity(grams, begin)
                    x = (grams >> np.uint64(32)).astype(np.uint32)
                    y = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    for k in range(len(a)):
                        v = x * a[k]
                        v ^= y + b[k]
                        v *= np.uint32(0x9E3779B1)
                        sig[full, k] = np.minimum.reduceat(v, begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.rows.start, c.rows.stop - c.rows.start), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array([s.tobytes() if k else None for s, k in zip(sig, n)], pa.binary())],
                    names=["doc_id", "n_shingles", "h1", "h2", "sig"],
                )

    return run


def _keys(sig: np.ndarray) -> np.ndarray:
    """The keys of all tables for each signature: pairs of one small hash of either collection."""
    left, right = _small(sig, 0)[:, :, None], _small(sig, TABLES)[:, None, :]
    place = np.arange(TABLES * TABLES, dtype=np.uint64).reshape(1, TABLES, TABLES)
    return mix(mix(left + place) ^ (right * np.uint64(0x9E3779B97F4A7C15))).reshape(len(sig), -1)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _emit(buckets: int):
    """Keys by bucket of the key space. Rows of a batch that share a key are tied to its smallest row here, and only
    that row meets the other batches', so a key that most rows have takes one entry a batch in its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            ids, sig = ids[order], sig[order]
            keys = _keys(sig).ravel()
            row = np.repeat(np.arange(len(ids)), TABLES * TABLES)
            order = np.argsort(keys, kind="stable")
            keys, row = keys[order], row[order]
            begin = np.append(True, keys[1:] != keys[:-1])
            size = np.diff(np.append(np.flatnonzero(begin), len(keys)))
            several = np.repeat(size > 1, size)
            tied = (keys[several], ids[row[several]], np.repeat(ids[row[begin]], size)[several])
            keys, row = keys[begin], row[begin]
            bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, row, bucket = keys[order], row[order], bucket[order]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            stop = np.append(cut[1:], len(keys))
            yield _record(bucket[cut], [keys[i:j] for i, j in zip(cut, stop)], [ids[row[i:j]] for i, j in zip(cut, stop)], [None] * len(cut))
            if len(tied[0]):
                parts = [slice(i, i + 20_000) for i in range(0, len(tied[0]), 20_000)]
                anywhere = (int(ids[0]) + np.arange(len(parts))) % buckets
                yield _record(anywhere, *([x[p] for p in parts] for x in tied))

    return run


def _record(bucket: np.ndarray, keys: list, ids: list, lows: list) -> pa.RecordBatch:
    packed = [pa.array([None if x is None else x.tobytes() for x in column], pa.binary()) for column in (keys, ids, lows)]
    return pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), *packed], names=["bucket", "keys", "ids", "lows"])


def _meet(buckets: int):
    """Of one bucket of keys: each member of a key that has several, with the key's smallest id, packed by bucket of the member."""

    def run(table: pa.Table) -> pa.Table:
        open_keys, open_ids, found = [], [], [np.zeros((0, 2), np.int64)]
        for k, i, low in zip(*(table.column(c).to_pylist() for c in ("keys", "ids", "lows"))):
            if low is None:
                open_keys.append(np.frombuffer(k, np.uint64))
                open_ids.append(np.frombuffer(i, np.int64))
            else:
                found.append(np.stack((np.frombuffer(i, np.int64), np.frombuffer(low, np.int64)), axis=1))
        if open_keys:
            keys, ids = np.concatenate(open_keys), np.concatenate(open_ids)
            order = np.argsort(keys, kind="stable")
            keys, ids = keys[order], ids[order]
            begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(begin, len(keys)))
            many = np.repeat(size > 1, size)
            found.append(np.stack((ids[many], np.repeat(np.minimum.reduceat(ids, begin), size)[many]), axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        to = (mix(pairs[:, 0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        pairs, to = pairs[order], to[order]
        cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
        stop = np.append(cut[1:], len(to))
        return pa.Table.from_arrays([pa.array(to[cut]), pa.array([pairs[i:j].tobytes() for i, j in zip(cut, stop)], pa.binary())], names=["bucket", "pairs"])

    return run


def _choose(table: pa.Table) -> pa.Table:
    """Of one bucket of members: each with a few of the smallest ids that it met: the least, and two by the order of a hash."""
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 2) for x in table.column("pairs").to_pylist())])
    picks = []
    for salt in (None, 1, 2):
        rank = pairs[:, 1] if salt is None else mix(pairs[:, 1].astype(np.uint64) * np.uint64(2 * salt + 1))
        order = np.lexsort((rank, pairs[:, 0]))
        if salt is None:
            first = np.append(True, pairs[order, 0][1:] != pairs[order, 0][:-1])[: len(order)]
        picks.append(pairs[order[first]])
    return pa.Table.from_arrays([pa.array(picks[0][:, 0]), pa.array(np.stack([p[:, 1] for p in picks], axis=1).tolist(), pa.list_(pa.int64()))], names=["id", "lows"])


def _shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(1), 1 << 18):
                grams, at = _sets(c, words)
                full = np.flatnonzero(np.diff(at))
                sums = _identity(grams, at[:-1][full]).view(np.int64) if len(full) else np.zeros((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sums[0]), pa.array(sums[1]), pa.array([grams[at[k] : at[k + 1]].tobytes() for k in full], pa.binary())], names=["h1", "h2", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            last, x = None, None
            for i, (a, b) in enumerate(zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())):
                if a is not last:
                    last, x = a, np.frombuffer(a, np.uint64)
                y = np.frombuffer(b, np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return run


def _small(sig: np.ndarray, begin: int) -> np.ndarray:
    """The small hashes of one collection."""
    part = np.zeros((len(sig), TABLES), np.uint64)
    for i in range(BAND):
        part = mix(part + sig[:, i::BAND][:, begin : begin + TABLES].astype(np.uint64) + np.uint64(1))
    return part


def _left_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_small(sig, 0).view(np.int64).tolist(), pa.list_(pa.int64()))], names=[*batch.schema.names, "left"])


def _cross(floor: float, percent: int):
    """Of two blocks of rows with one equal hash of the left collection: links between different components, a spanning
    set of them. Pairs that share a table, whose signatures agree well enough, and which share no earlier hash of that
    collection (so each is met once) are confirmed on their whole sets, a row against all its partners at once. Rows
    of the largest component ask nothing, and components that get linked are one from then on."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, block = (t.column(c).to_numpy() for c in ("id", "block"))
        comp = t.column("comp").to_numpy().copy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
        place, bi, bj = (t.column(c)[0].as_py() for c in ("place", "bi", "bj"))
        left, right = _small(sig, 0), _small(sig, TABLES)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        local = np.unique(np.concatenate(sets), return_inverse=True)[1]
        begin = np.cumsum(size) - size
        marked = np.zeros(int(local.max()) + 1, bool)
        names, count = np.unique(comp, return_counts=True)
        largest, asked = names[np.argmax(count)], np.zeros(len(ids), bool)
        out = []
        for i in np.flatnonzero(comp != largest):
            asked[i] = True
            j = np.flatnonzero((comp != comp[i]) & ~asked & ((block != block[i]) | (bi == bj)))
            j = j[(sig[j] == sig[i]).mean(axis=1) >= floor]
            j = j[(right[j] == right[i]).any(axis=1) & (np.argmax(left[j] == left[i], axis=1) == place)]
            j = j[100 * np.minimum(size[j], size[i]) >= percent * np.maximum(size[j], size[i])]
            if not len(j):
                continue
            mine = local[begin[i] : begin[i] + size[i]]
            marked[mine] = True
            ends = np.cumsum(size[j])
            at = np.repeat(begin[j] - (ends - size[j]), size[j]) + np.arange(ends[-1])
            common = np.add.reduceat(marked[local[at]].astype(np.int64), ends - size[j])
            marked[mine] = False
            j = j[100 * common >= percent * (size[j] + size[i] - common)]
            if len(j):
                met, first = np.unique(comp[j], return_index=True)
                out.append(np.stack((np.full(len(met), ids[i]), ids[j[first]]), axis=1))
                one = largest if largest in met else comp[i]
                comp[np.isin(comp, np.append(met, comp[i]))] = one
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *out])
        return pa.Table.from_arrays([pa.array(pairs.min(axis=1) if len(pairs) else pairs[:, 0]), pa.array(pairs.max(axis=1) if len(pairs) else pairs[:, 1])], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_BYTES) -> DataFrame:
    """Returns doc_id, n_shingles, component_id, kept for every row of docs; links are 100 * common >= percent * union."""
    spark = docs.sparkSession
    floor = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / (2 * BAND * TABLES)) ** 0.5
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = staged(rows.mapInArrow(tidy(_signatures(words)), "doc_id long, n_shingles long, h1 long, h2 long, sig binary"), "signatures")
    full = sigs.filter("n_shingles > 0 and doc_id is not null")
    # numbered in the order of their smallest doc_id, so the smallest node of a component has its smallest doc_id
    nodes = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig")).sort("doc", "h1", "h2")
    nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() * TABLES * TABLES // 4_000_000)
    packed = nodes.select("id", "sig").mapInArrow(tidy(_emit(buckets)), "bucket int, keys binary, ids binary, lows binary")
    met = packed.groupBy("bucket").applyInArrow(_meet(buckets), "bucket int, pairs binary")
    members = staged(met.groupBy("bucket").applyInArrow(_choose, "id long, lows array<long>"), "members")

    sig_of = nodes.select("id", "sig")
    star = members.select("id", F.explode(F.array_distinct("lows")).alias("a")).filter("id <> a").select("a", F.col("id").alias("b"))
    star = star.join(sig_of.select(F.col("id").alias("a"), F.col("sig").alias("x")), "a").join(sig_of.select(F.col("id").alias("b"), F.col("sig").alias("y")), "b")
    star = staged(star.mapInArrow(tidy(_screen(floor)), "a long, b long"), "pairs")

    wanted = staged(members.select("id").join(nodes.select("id", "doc", "h1", "h2"), "id"), "wanted")
    asked = wanted.select(F.col("doc").alias("doc_id")).distinct()
    if asked.count() <= BROADCAST_IDS:  # 8 bytes each; beyond it the join shuffles
        asked = F.broadcast(asked)
    sets = rows.join(asked, "doc_id", "left_semi").mapInArrow(tidy(_shingles(words)), "h1 long, h2 long, shingles binary").dropDuplicates(["h1", "h2"])
    sets = staged(sets.join(wanted.select("id", "h1", "h2"), ["h1", "h2"]).select("id", "shingles"), "sets")
    links = staged(_confirmed(star, sets, percent), "links").unionByName(staged(_same_document(full, nodes), "same"))
    more = _rest(members, sig_of, components(links), sets, percent, floor, block)
    comp = components(links.unionByName(staged(more, "links")))
    low = comp.join(nodes.select(F.col("id").alias("component_id"), "doc"), "component_id").select(F.col("node").alias("id"), F.col("doc").alias("c"))
    node = nodes.select("h1", "h2", "id", "doc").join(low, "id", "left").select("h1", "h2", F.coalesce("c", "doc").alias("c"))
    copies = sigs.select("doc_id", "n_shingles", "h1", "h2").join(node, ["h1", "h2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    return copies.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_document(full: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of each doc_id that has several."""
    sets = F.struct("h1", "h2")
    several = full.groupBy("doc_id").agg(F.min(sets).alias("lo"), F.max(sets).alias("hi")).filter("lo <> hi").select("doc_id")
    each = full.join(several, "doc_id").select("doc_id", "h1", "h2").join(nodes.select("id", "h1", "h2"), ["h1", "h2"]).select("doc_id", "id").distinct()
    least = each.groupBy("doc_id").agg(F.min("id").alias("a"))
    return each.join(least, "doc_id").filter("a <> id").select("a", F.col("id").alias("b"))


def _screen(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array(_agree(x, y) >= floor))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    return a.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(tidy(_confirm(percent)), "a long, b long")


def _rest(members: DataFrame, sig_of: DataFrame, comp: DataFrame, sets: DataFrame, percent: int, floor: float, block: int) -> DataFrame:
    """Links that the chosen pairs leave out: among all pairs that share a table, those of different components.

    Two rows share a table if they share a hash of either collection, so rows meet by their hashes of the left one and
    are compared there. Hashes whose rows already are in one component need nothing. The rows of a frequent hash are
    cut into blocks, and each pair of blocks is a group of its own, so that no group holds more than two blocks.
    """
    named = members.select("id").join(comp.select(F.col("node").alias("id"), "component_id"), "id", "left").join(sig_of, "id").select("id", F.coalesce("component_id", "id").alias("comp"), "sig")
    named = staged(named.mapInArrow(tidy(_left_hashes), "id long, comp long, sig binary, left array<long>"), "named")
    sized = named.join(sets.select("id", F.octet_length("shingles").alias("bytes")), "id")
    spread = sized.select("id", "comp", "bytes", F.posexplode("left").alias("place", "hash"))
    mixed = spread.groupBy("place", "hash").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.sum("bytes").alias("bytes"))
    mixed = mixed.filter("c1 <> c2").select("place", "hash", F.ceil(F.col("bytes") / block).cast("int").alias("blocks"))
    dealt = spread.join(mixed, ["place", "hash"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("place", "hash", "id", "comp", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")).join(named.select("id", "sig"), "id").join(sets, "id")
    return dealt.groupBy("place", "hash", "bi", "bj").applyInArrow(_cross(floor, percent), "a long, b long")
