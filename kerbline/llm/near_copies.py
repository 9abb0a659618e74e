"""Near copies by exact similarity of word shingles; fingerprints only name the candidates.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of at least 0.8. Candidates come from two kinds of fingerprints:
SimHash values within two bits of each other, and equal MinHash bands. A band of
five values is shared with probability s^5, so of two texts with similarity s one
of 16 bands is missed with probability (1 - s^5)^16: 0.2 % at 0.8, less above.

Texts with equal shingle sets are one node. Nodes connected by candidate links
are brought together once, with their shingles, and compared exactly in one task;
a group with more shingles than ``_CHUNK`` is dealt into chunks, and each two of
them meet in a task, so a task's memory is bounded and no pair is left out (work
on such a group grows with the square of its chunks).

Defined cases: null, empty and blank texts have no shingles and are copies of each
other alone; texts of fewer than five words have one shingle, all their words;
every row counts for itself, whether its doc_id is null, repeated or unique; an
empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm import simhash
from kerbline.llm.components import components
from kerbline.llm.texts import ragged
from kerbline.operators.stage import stage

WORDS = 5
LEAST = 0.8
BANDS = 16
BAND_ROWS = 5
_CHUNK = 1 << 20
_ROWS = 1000


def bands(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One value a band and row of hashes; rows without hashes have zeros."""
    rows = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, BANDS), np.uint64)
    for k in range(BANDS * BAND_ROWS if len(rows) else 0):
        least = np.minimum.reduceat(simhash._reseeded(hashes, k + 1), offsets[:-1][rows])
        out[rows, k // BAND_ROWS] = simhash._reseeded(out[rows, k // BAND_ROWS] ^ least, k + 1)
    return out


def sketches(rows: DataFrame, prints: int) -> DataFrame:
    """key, id, shingles (a digest of their set), n, prints and bands of every row (key, id, text)."""

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = column.offsets.to_numpy().astype(np.int64)
        return offsets - offsets[0], column.flatten().to_numpy().view(np.uint64)

    def run(batches):
        import xxhash

        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                at, three = lists(batch.column("votes"))
                offsets, five = lists(batch.column("hashes"))
                votes = np.stack([simhash.majority(at, simhash._reseeded(three, k)) for k in range(prints)], 1)
                own = [np.unique(five[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                nested = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("id"), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64()), nested(votes), nested(bands(offsets, five))],
                    names=["key", "id", "shingles", "n", "prints", "bands"],
                )

    given = rows.select("key", "id", simhash.shingle_hashes(F.col("text"), 3).alias("votes"), simhash.shingle_hashes(F.col("text"), WORDS).alias("hashes"))
    return given.mapInArrow(run, "key long, id long, shingles binary, n long, prints array<long>, bands array<long>")


def alike(offsets: np.ndarray, hashes: np.ndarray, least: float = LEAST) -> np.ndarray:
    """For sets of hashes: the first set that each is linked to by similarities of at least ``least``, over any path."""
    count = len(offsets) - 1
    size = np.diff(offsets)
    _, code = np.unique(hashes, return_inverse=True)
    order = np.argsort(code, kind="stable")
    holder = np.repeat(np.arange(count), size)[order]
    ends = np.cumsum(np.bincount(code))
    begins = np.append(0, ends[:-1])[: len(ends)]
    root = np.full(count, -1)
    for head in range(count):
        if root[head] >= 0:
            continue
        root[head], front = head, [head]
        while front and (root < 0).any():
            one = front.pop()
            own = code[offsets[one] : offsets[one + 1]]
            both = np.bincount(holder[ragged(begins[own], ends[own] - begins[own])], minlength=count)
            near = np.flatnonzero((root < 0) & (both > 0) & (both >= least * (size[one] + size - both) - 1e-9))
            root[near] = head
            front.extend(near.tolist())
    return root


def candidates(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all nodes with a shared band, or with a SimHash value within two bits, over any path."""
    values = nodes.select(F.col("node").alias("fingerprint"), F.posexplode("prints").alias("number", "value"))
    shared = nodes.where("n > 0").select("node", F.posexplode("bands").alias("band", "value"))
    first = shared.groupBy("band", "value").agg(F.min("node").alias("v"), F.count("*").alias("m")).where("m > 1").drop("m")
    return simhash.links(values).union(shared.join(first, ["band", "value"]).where("node <> v").select(F.col("node").alias("u"), "v"))


def confirmed(nodes: DataFrame, rows: DataFrame, loose: DataFrame, chunk: int = _CHUNK) -> DataFrame:
    """Edges (u, v) between nodes of one loose group that connect all that are alike, over any path."""
    held = stage(loose.join(nodes.select("node", "n"), "node"), "loose")
    sizes = held.groupBy("root").agg((F.sum("n") / F.lit(chunk)).cast("long").alias("more"))
    member = held.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("more") + 1))
    others = F.when(F.col("more") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("more")), lambda j: j != F.col("own")))
    text = rows.join(held.select(F.col("node").alias("key")), "key").select(F.col("key").alias("node"), F.array_distinct(simhash.shingle_hashes(F.col("text"), WORDS)).alias("hashes"))
    met = member.select("root", "node", "own", F.explode(others).alias("other")).select("root", "node", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def compare(group: pa.Table) -> pa.Table:
        parts = [np.asarray(x, np.int64) for x in group.column("hashes").combine_chunks().to_numpy(zero_copy_only=False)]
        node = group.column("node").to_numpy()
        order = np.argsort(node)
        offsets = np.concatenate([[0], np.cumsum([len(parts[i]) for i in order])]).astype(np.int64)
        root = alike(offsets, np.concatenate([parts[i] for i in order]))
        u, v = node[order], node[order][root]
        return pa.table([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

    return met.join(text, "node").groupBy("root", "low", "high").applyInArrow(compare, "u long, v long")


def keep_one(docs: DataFrame, prints: int = 8) -> DataFrame:
    """One row of each group of near copies, the one with the smallest doc_id (null ids last), with its own columns."""
    whole = stage(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("key")), "rows")
    rows = whole.select("key", F.col("row.doc_id").cast("long").alias("id"), F.col("row.text").cast("string").alias("text"))
    found = sketches(rows, prints)
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    # the values of equal sets of shingles differ where shingles repeat: any row may stand for them
    nodes = found.groupBy("shingles").agg(F.min(F.struct(rank.alias("rank"), "n", "prints", "bands")).alias("first"))
    nodes = stage(nodes.select(F.col("first.rank.key").alias("node"), F.col("first.rank").alias("rank"), "first.n", "first.prints", "first.bands"), "nodes")
    loose = components(candidates(nodes))
    roots = components(confirmed(nodes, rows, loose))
    kept = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("rank").alias("rank")).select(F.col("rank.key").alias("key"))
    return whole.join(kept, "key", "left_semi").select("row.*")
