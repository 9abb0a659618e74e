"""SimHash fingerprints and their groups, with candidates pruned on a ring of segments.

A fingerprint is cut into seven segments on a ring. If two fingerprints differ in
at most d bits, some run of segments starts where, for every length l, the first
l segments differ in at most l * d / 7 bits together. For d = 2 the first three
must be equal: their bits are the key of a candidate. The longer runs of the
chain prune what is left, and only the rest is compared in full.

Fingerprints are made distinct first. Below ``most`` fingerprints of one key the
members of a key are linked in one task, which returns one link a member. Keys
with more are linked through the values one bit away from their members: two
fingerprints within two bits share such a value, and no value has more members
than it has free bits. So no pairs within a group are made rows, however large
the group is.

Defined cases: null, empty and blank texts have fingerprint zero and form one
group with others close to zero; a null doc_id stays null and a group of null
ids has a null component; repeated rows share a fingerprint, thus a group; an
empty table gives no rows; other columns are ignored by ``groups`` and kept by
``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.components import components
from kerbline.llm.texts import ascii_lower
from kerbline.operators.stage import stage

SEGMENTS = 7
BITS = 2


def shingle_hashes(text: Column, words: int) -> Column:
    """XXH64 (seed 42) of each run of words; of all words where there are fewer; none for no words."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    parts = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]"), lambda w: w != "")
    runs = lambda w: F.transform(F.slice(w, 1, F.size(w) - words + 1), lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, words)])))
    return once(parts, lambda w: F.when(F.size(w) >= words, runs(w)).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<bigint>")))


def majority(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of hashes: bits set in more than half of them."""
    size = np.diff(offsets)
    out = np.zeros(len(size), np.uint64)
    rows = np.flatnonzero(size)
    # sums of four 16-bit lanes at a time; longer rows are summed in parts
    per_row = -(-size[rows] // 65535)
    row = np.repeat(np.arange(len(rows)), per_row)
    first = np.cumsum(per_row) - per_row
    starts = offsets[rows][row] + 65535 * (np.arange(len(row)) - first[row])
    for shift in range(16) if len(rows) else ():
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & np.uint64(0x0001000100010001), starts)
        for lane in range(4):
            part = ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
            count = np.add.reduceat(part, first)
            out[rows] |= (2 * count > size[rows]).astype(np.uint64) << np.uint64(shift + 16 * lane)
    return out


def _reseeded(hashes: np.ndarray, number: int) -> np.ndarray:
    """Hashes for the fingerprint of this number; those of number 0 are the given ones."""
    if not number:
        return hashes
    x = hashes + np.uint64(number) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


def fingerprints(docs: DataFrame, words: int = 3, prints: int = 1) -> DataFrame:
    """doc_id, fingerprint (a signed 64-bit number) and an array of it and of ``prints`` - 1 more of other hashes, for every row."""

    def run(batches):
        for batch in batches:
            lists = batch.column("hashes")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            hashes = lists.flatten().to_numpy().view(np.uint64)
            found = np.stack([majority(offsets - offsets[0], _reseeded(hashes, k)) for k in range(prints)], 1).view(np.int64)
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * prints, pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found[:, 0].copy()), values], names=["doc_id", "fingerprint", "prints"])

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingle_hashes(F.col("text").cast("string"), words).alias("hashes"))
    return hashed.mapInArrow(run, "doc_id long, fingerprint long, prints array<long>")


def _segments() -> list[tuple[int, int]]:
    """(shift, mask) of each segment, from the lowest bits up."""
    width = [64 // SEGMENTS + (i < 64 % SEGMENTS) for i in range(SEGMENTS)]
    return [(sum(width[:i]), (1 << width[i]) - 1) for i in range(SEGMENTS)]


def _zero_run(bits: int) -> int:
    """Segments that must be equal at the start of a chain."""
    return next(n for n in range(SEGMENTS, -1, -1) if n * bits // SEGMENTS == 0)


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def linked(values: np.ndarray, start: int, bits: int = BITS) -> np.ndarray:
    """For fingerprints of one key: the place of the first member that each is linked to, over any path."""
    segments = _segments()
    ring = [segments[(start + k) % SEGMENTS] for k in range(SEGMENTS)]
    budget = [(k + 1) * bits // SEGMENTS for k in range(SEGMENTS)]
    equal = _zero_run(bits)
    root = np.full(len(values), -1)
    rest = np.arange(len(values))
    while len(rest):
        head, rest = rest[0], rest[1:]
        root[head], front = head, [head]
        while front and len(rest):
            apart = values[rest] ^ values[front.pop()]
            spent = np.zeros(len(rest), np.int64)
            near = np.arange(len(rest))
            for k in range(equal, SEGMENTS):
                shift, mask = ring[k]
                spent = spent + np.bitwise_count((apart[near] >> np.uint64(shift)) & np.uint64(mask))
                within = spent <= budget[k]
                near, spent = near[within], spent[within]
            # the whole chain has been summed: what is left differs in at most ``bits`` bits
            root[rest[near]] = head
            front.extend(rest[near].tolist())
            rest = np.delete(rest, near)
    return root


def links(distinct: DataFrame, most: int = 4096) -> DataFrame:
    """Edges (u, v) between fingerprints that connect all rows (fingerprint, number, value) of one number within two bits of each other, over any path."""
    segments, equal = _segments(), _zero_run(BITS)
    value = F.col("value")

    def arc(start: int) -> int:
        return _as_long(sum(segments[(start + k) % SEGMENTS][1] << segments[(start + k) % SEGMENTS][0] for k in range(equal)))

    keys = F.array(*[F.struct((F.col("number") * SEGMENTS + i).alias("start"), value.bitwiseAND(F.lit(arc(i))).alias("key")) for i in range(SEGMENTS)])
    arcs = distinct.select("fingerprint", "value", F.inline(keys))
    sizes = arcs.groupBy("start", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = arcs.join(sizes, ["start", "key"])

    def run(batches):
        for batch in batches:
            us, vs = [], []
            lists = batch.column("members")
            ends = lists.offsets.to_numpy()
            values, nodes = (c.to_numpy() for c in lists.flatten().flatten())
            for start, a, b in zip(batch.column("start").to_pylist(), ends[:-1] - ends[0], ends[1:] - ends[0]):
                root = linked(values[a:b].view(np.uint64), start % SEGMENTS)
                us.append(nodes[a:b])
                vs.append(nodes[a:b][root])
            none = np.zeros(0, np.int64)
            u, v = (np.concatenate([none, *x]) for x in (us, vs))
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    few = shared.where(F.col("n") <= most).groupBy("start", "key").agg(F.collect_list(F.struct("value", "fingerprint")).alias("members"))
    few = few.select("start", "members").mapInArrow(run, "u long, v long")
    # within a key only bits outside its equal segments can differ
    free = [F.array(F.lit(0).cast("long"), *[F.lit(_as_long(1 << b)).cast("long") for b in range(64) if not arc(i) >> b & 1]) for i in range(SEGMENTS)]
    flips = F.coalesce(*[F.when(F.col("start") % SEGMENTS == i, x) for i, x in enumerate(free)])
    near = shared.where(F.col("n") > most).select("start", "key", "fingerprint", "value", F.explode(flips).alias("flip"))
    near = near.select("start", "key", "fingerprint", value.bitwiseXOR(F.col("flip")).alias("near"))
    first = F.min("fingerprint").over(Window.partitionBy("start", "key", "near"))
    many = near.select(F.col("fingerprint").alias("u"), first.alias("v")).where("u <> v")
    return few.union(many)


def groups(docs: DataFrame, words: int = 3, prints: int = 1, most: int = 4096) -> DataFrame:
    """doc_id, fingerprint and component_id, the smallest doc_id reachable, for every row.

    Rows are linked where one of their ``prints`` fingerprints, each of other
    hashes, differs in at most two bits; more of them link more of the rows that
    are alike but not nearly equal.
    """
    found = stage(fingerprints(docs, words, prints), "fingerprints")
    distinct = stage(found.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "distinct")
    values = found.select("fingerprint", F.posexplode("prints").alias("number", "value")).distinct() if prints > 1 else distinct.select("fingerprint", F.lit(0).alias("number"), F.col("fingerprint").alias("value"))
    roots = components(links(values, most))
    rooted = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.join(least, "root").select("fingerprint", "component_id")
    return found.select("doc_id", "fingerprint").join(classes, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, words: int = 3, prints: int = 1) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with its own columns.

    Rows with the same doc_id, or with a null one, count as one document.
    """
    kept = groups(docs, words, prints).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.struct("doc_id").alias("kept")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    one = Window.partitionBy("id").orderBy(F.xxhash64("row"))
    joined = rows.join(kept, F.col("id").eqNullSafe(F.col("kept.doc_id")), "left_semi")
    return joined.withColumn("place", F.row_number().over(one)).where("place = 1").select("row.*")


def digits(fingerprint: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
