"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

A count is stored as its level on a logarithmic scale: the n-gram is put into the
filter once for every level up to its own. Asking for level 1, 2, ... until the
filter says no gives the level back. The filter is small enough for every worker;
a text is scored by interpolating bigram and unigram frequencies read from it,
with several weights whose results are averaged.
Beside it, the exact add-one unigram score is computed from exact counts.

Documents are tokenized once, into blocks of token codes with the block's
distinct words. Words and n-grams leave a block once each, packed by ranges of
their hash; a range is summed in one task and holds about a million of the tokens
at most, so neither a frequent word nor a large corpus makes a large group. Exact
word counts travel back to the blocks that asked. Words and n-grams are told apart by
64-bit hashes, and by 40 bits within a range.

The filter has ``BITS_PER_TOKEN`` bits for each training token at every size, so its
rate of false positives does not grow with the corpus. It is cut by ranges of
hash. While all parts together have at most ``BROADCAST_BITS`` (256 MB) they are
broadcast; beyond that each block sends its n-grams to their ranges, where the part is built, and
gets their levels back. Both ways hold the same bits and give the same
scores, and nothing but a bounded filter ever reaches the driver.

Defined cases: a null or empty text is its end alone; a null doc_id stays null
and hashes as empty text; repeated rows are learnt and scored again; without
training tokens every probability is 1 / (1 * 1); an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.texts import blocks, held_out, words
from kerbline.operators.stage import stage

BLOCK_BYTES = 8_000_000
BROADCAST_BITS = 1 << 31
BITS_PER_TOKEN = 6
KEY_BITS = 40  # of an n-gram within a range; with a million tokens a range hardly any two share them
PROBES = 4
GROWTH = 1.3
TRUSTS = (20.0, 2000.0, float("inf"))
_RANGE_TOKENS = 1 << 20
_END = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, codes binary, words binary, counts binary, n_train long"


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unigrams(word: np.ndarray) -> np.ndarray:
    return _mix(word + np.uint64(1))


def bigrams(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(_mix(before) + word * np.uint64(0xD6E8FEB86659FD93))


def thresholds(largest: int = 1 << 50) -> np.ndarray:
    """Smallest count of each level, from level 1."""
    out = [1]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return np.array(out, np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2^32, compressed by bytes of equal weight."""
    import zstandard

    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def tokenized(docs: DataFrame, held) -> DataFrame:
    """One row for each block of documents: token codes, distinct words by code, and their training counts.

    Code 0 is the end of a text; the others follow from the most frequent word on.
    """

    def run(batches):
        base = TaskContext.get().partitionId() << 32
        for number, batch in enumerate(blocks(batches, limit=BLOCK_BYTES)):
            offsets, codes, distinct = words(batch.column("text"))
            place = np.empty(len(distinct), np.int64)
            place[np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")] = np.arange(1, len(distinct) + 1)
            sizes = np.diff(offsets) + 1
            sequence = np.zeros(int(sizes.sum()), np.int64)
            inner = np.ones(len(sequence), bool)
            inner[np.cumsum(sizes) - 1] = False
            sequence[inner] = place[codes]
            hashes = np.empty(len(distinct) + 1, np.uint64)
            hashes[0] = _END
            hashes[place] = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
            out = batch.column("held")
            train = np.repeat(~out.to_numpy(zero_copy_only=False), sizes)
            counts = np.bincount(sequence[train], minlength=len(hashes))
            row = [base + number, batch.column("doc_id").to_pylist(), out.to_pylist(), sizes.tolist(), _packed(sequence), hashes.astype("<u8").tobytes(), _packed(counts), int(train.sum())]
            del codes, sequence, inner, train, distinct, place
            pa.default_memory_pool().release_unused()
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            names = ["block", "doc_ids", "held", "sizes", "codes", "words", "counts", "n_train"]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    return given.mapInArrow(run, BLOCKS)


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    """Values of one row after the other, so that only one block is unpacked at a time."""
    for k in range(batch.num_rows):
        yield tuple(batch.column(c)[k].as_py() for c in range(batch.num_columns))
        pa.default_memory_pool().release_unused()


def _ranges(ordered: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, begin, stop) of the ranges of hash that occur, for ordered hashes."""
    at = (ordered >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(ordered), np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
    return list(zip(at[first].tolist(), first.tolist(), [*first[1:].tolist(), len(at)]))


def word_totals(table: DataFrame, bits: int) -> DataFrame:
    """block, part, totals: training counts of the block's words in hash order, cut by ranges; with the distinct words in training of each range."""

    def ask(batches):
        for batch in batches:
            for block, data, counted in _rows(batch):
                own = np.frombuffer(data, "<u8")
                order = np.argsort(own, kind="stable")
                own, n = own[order], _unpacked(counted)[order]
                found = _ranges(own, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(found), pa.int64()), pa.array([r for r, _, _ in found], pa.int64()), pa.array([own[a:b].tobytes() for _, a, b in found], pa.binary()), pa.array([_packed(n[a:b]) for _, a, b in found], pa.binary())],
                    names=["block", "part", "words", "counts"],
                )

    def answer(asked: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, "<u8") for x in asked.column("words").to_pylist()]
        counts = np.concatenate([_unpacked(x) for x in asked.column("counts").to_pylist()])
        distinct, back = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(back, counts, len(distinct)).astype(np.int64)
        ends = np.cumsum([len(x) for x in lists])
        parts = [total[back[e - len(x) : e]].astype("<i8").tobytes() for x, e in zip(lists, ends.tolist())]
        seen = [int((total > 0).sum())] + [0] * (len(parts) - 1)
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        return pa.table([asked.column("block"), asked.column("part"), pa.array([squeeze(p) for p in parts], pa.binary()), pa.array(seen, pa.int64())], names=["block", "part", "totals", "distinct"])

    rows = table.select("block", "words", "counts").mapInArrow(ask, "block long, part long, words binary, counts binary")
    return rows.groupBy("part").applyInArrow(answer, "block long, part long, totals binary, distinct long")


def _sequence(codes: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, codes before them, row of each); before the first one stands an end."""
    sequence = _unpacked(codes)
    before = np.append(0, sequence[:-1])[: len(sequence)]
    return sequence, before, np.repeat(np.arange(len(sizes)), sizes)


def _block_ngrams(word: np.ndarray, sequence: np.ndarray, before: np.ndarray, train: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs of codes that occur in ``train``, n-grams, their counts): those pairs' bigrams, then unigrams of the words with a count."""
    pair, n = np.unique(before[train] << 32 | sequence[train], return_counts=True)
    which = np.flatnonzero(known)
    return pair, np.concatenate([bigrams(word[pair >> 32], word[pair & 0xFFFFFFFF]), unigrams(word[which])]), np.concatenate([n, known[which]])


def _key(gram: np.ndarray, bits: int) -> np.ndarray:
    return (gram << np.uint64(bits)) >> np.uint64(64 - KEY_BITS)


def _keys(gram: np.ndarray, bits: int) -> np.ndarray:
    """The ``KEY_BITS`` after the ``bits`` that name the range, as bytes a row."""
    return np.ascontiguousarray(_key(gram, bits).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8])


def _numbers(keys: list[bytes]) -> np.ndarray:
    size = KEY_BITS // 8
    wide = np.zeros((sum(map(len, keys)) // size, 8), np.uint8)
    wide[:, :size] = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, size)
    return wide.view("<u8").ravel()


def ngrams(table: DataFrame, bits: int, asked: bool = False) -> DataFrame:
    """block, part, keys, counts: training unigrams and bigrams of each block with their counts, in order of hash and cut by its ranges.

    With ``asked`` all n-grams of the block, those that training did not see with count 0.
    """

    def run(batches):
        for batch in batches:
            for block, held, sizes, codes, data, counted in _rows(batch):
                word = np.frombuffer(data, "<u8")
                sequence, before, row = _sequence(codes, sizes)
                train = ~np.array(held, bool)[row]
                single = _unpacked(counted)
                pair, gram, n = _block_ngrams(word, sequence, before, train, single)
                if asked:
                    every, gram, _ = _block_ngrams(word, sequence, before, np.ones(len(train), bool), np.ones(len(word), np.int64))
                    seen = np.zeros(len(every), np.int64)
                    seen[np.searchsorted(every, pair)] = n[: len(pair)]
                    n = np.concatenate([seen, single])
                order = np.argsort(gram, kind="stable")
                gram, n = gram[order], n[order]
                found = _ranges(gram, bits)
                keys = _keys(gram, bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(found), pa.int64()), pa.array([r for r, _, _ in found], pa.int64()), pa.array([keys[a:b].tobytes() for _, a, b in found], pa.binary()), pa.array([_packed(n[a:b]) for _, a, b in found], pa.binary())],
                    names=["block", "part", "keys", "counts"],
                )

    return table.select("block", "held", "sizes", "codes", "words", "counts").mapInArrow(run, "block long, part long, keys binary, counts binary")


def _probes(key: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """First place and step of the places where (key, level) leaves its bits."""
    x = _mix(key + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
    return x, (x << np.uint64(32)) | (x >> np.uint64(32)) | np.uint64(1)


def _place(place: np.ndarray, size: int) -> np.ndarray:
    """Place among ``size`` bits, evenly from the upper half of a hash."""
    return ((place >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


@dataclass
class Filter:
    """Bits of all ranges; ``bits`` name a range, ``size`` bits, a multiple of eight, are a range's part."""

    data: np.ndarray
    bits: int
    size: int

    def level(self, gram: np.ndarray) -> np.ndarray:
        """Highest level up to which the filter holds each n-gram; 0 for none."""
        part = (gram >> np.uint64(64 - self.bits)) * np.uint64(self.size) if self.bits else np.zeros(len(gram), np.uint64)
        return self.level_of(_key(gram, self.bits), part)

    def level_of(self, key: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The level of keys whose part begins at bit ``part``; levels end with the last threshold, however full the filter is."""
        out, left = np.zeros(len(key), np.int64), np.arange(len(key))
        for level in range(1, len(thresholds()) + 1):
            if not len(left):
                break
            place, step = _probes(key, level)
            for _ in range(PROBES):
                at = _place(place, self.size) + part
                hit = (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                left, key, part, place, step = left[hit], key[hit], part[hit], place[hit], step[hit]
                place = place + step
            out[left] = level
        return out

    def false_rate(self) -> float:
        """Share of n-grams never seen that the filter takes for seen once."""
        return float((np.bitwise_count(self.data).sum() / (8 * len(self.data))) ** PROBES)


def _filter_part(key: np.ndarray, counts: np.ndarray, size: int) -> Filter:
    """The part of one range, from keys with their counts; those with count 0 leave nothing."""
    key, back = np.unique(key[counts > 0], return_inverse=True)
    level = np.searchsorted(thresholds(), np.bincount(back, counts[counts > 0], len(key)).astype(np.int64), side="right")
    each = np.repeat(np.arange(len(key)), level)
    place, step = _probes(key[each], np.arange(len(each)) - np.repeat(np.cumsum(level) - level, level) + 1)
    marked = np.zeros(size, bool)
    for _ in range(PROBES):
        marked[_place(place, size).astype(np.int64)] = True
        place = place + step
    return Filter(np.packbits(marked, bitorder="little"), 0, size)


def filter_of(grams: DataFrame, bits: int, size: int) -> Filter:
    """The filter of all n-grams on the driver; each range's part is made in one task. The caller bounds 2^bits * size."""

    def build(rows: pa.Table) -> pa.Table:
        counts = np.concatenate([_unpacked(x) for x in rows.column("counts").to_pylist()])
        made = _filter_part(_numbers(rows.column("keys").to_pylist()), counts, size)
        return pa.table([rows.column("part")[:1], pa.array([made.data.tobytes()], pa.binary())], names=["part", "data"])

    data = np.zeros((1 << bits) * size // 8, np.uint8)
    for row in grams.select("part", "keys", "counts").groupBy("part").applyInArrow(build, "part long, data binary").toLocalIterator():
        data[row["part"] * size // 8 : (row["part"] + 1) * size // 8] = np.frombuffer(row["data"], np.uint8)
    return Filter(data, bits, size)


def answered(grams: DataFrame, size: int) -> DataFrame:
    """block, part, levels: a byte for each n-gram that a block asked for, from the part built where its range is."""

    def run(rows: pa.Table) -> pa.Table:
        import zstandard

        keys = rows.column("keys").to_pylist()
        counts = [_unpacked(x) for x in rows.column("counts").to_pylist()]
        made = _filter_part(_numbers(keys), np.concatenate(counts), size)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        told = []
        for own in keys:  # block by block, so that no more than one block's probes are held
            key = _numbers([own])
            told.append(squeeze(made.level_of(key, np.zeros(len(key), np.uint64)).astype(np.uint8).tobytes()))
        return pa.table([rows.column("block"), rows.column("part"), pa.array(told, pa.binary())], names=["block", "part", "levels"])

    return grams.groupBy("part").applyInArrow(run, "block long, part long, levels binary")


def _log_mean(parts: list[np.ndarray]) -> np.ndarray:
    """log10 of the mean of numbers given by their log10."""
    most = np.maximum.reduce(parts)
    return most + np.log10(sum(10.0 ** (p - most) for p in parts) / len(parts))


def text_scores(level, word: np.ndarray, codes: bytes, sizes: list[int], total: int, distinct: int, trusts: tuple[float, ...] = TRUSTS) -> np.ndarray:
    """log10 probability of each text; ``level`` gives the levels of n-grams.

    A level stands for the mean of its counts. After a word seen c times the bigram
    frequency weighs c / (c + trust), the smoothed unigram frequency the rest. A
    text's probability is the mean of what the trusts give it: copies of
    training text are told by bigrams, new text by words.
    """
    limits = thresholds()
    counts = np.concatenate([[0.0], (limits[:-1] + limits[1:] - 1) / 2, [float(limits[-1])]])
    sequence, before, _ = _sequence(codes, sizes)
    starts = np.cumsum(sizes) - sizes
    pair, back = np.unique(before << 32 | sequence, return_inverse=True)
    back = back.astype(np.int32)
    found = counts[level(np.concatenate([bigrams(word[pair >> 32], word[pair & 0xFFFFFFFF]), unigrams(word)]))]
    double, single = found[: len(pair)], found[len(pair) :]
    first = single[pair >> 32]
    share = np.minimum(double / np.maximum(first, 1), 1)
    smooth = np.minimum((single[pair & 0xFFFFFFFF] + 1) / (total + distinct + 1), 1)
    weights = [first / (first + trust) for trust in trusts]
    return _log_mean([np.add.reduceat(np.log10(w * share + (1 - w) * smooth)[back], starts) for w in weights])


def _in_hash_order(levels: np.ndarray):
    """Levels given in order of hash, as a function of the n-grams."""

    def level(gram: np.ndarray) -> np.ndarray:
        out = np.empty(len(gram), np.int64)
        out[np.argsort(gram, kind="stable")] = levels
        return out

    return level


def score(docs: DataFrame, folds: int = 7, fold: int = 2, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learnt from those not held out."""
    spark = docs.sparkSession
    table = stage(tokenized(docs, held_out(F.col("doc_id"), folds, fold)), "blocks")
    total = int(table.agg(F.sum("n_train").alias("n")).first()["n"] or 0)
    bits = (total // _RANGE_TOKENS).bit_length()
    size = max(64, -(-BITS_PER_TOKEN * total >> bits) // 64 * 64 + 64)
    totals = stage(word_totals(table, bits), "totals")
    distinct = int(totals.agg(F.sum("distinct").alias("n")).first()["n"] or 0)
    told = totals.select("block", "part", "totals", F.lit(None).cast("binary").alias("levels"))
    if size << bits <= broadcast_bits:
        shared = spark.sparkContext.broadcast(filter_of(ngrams(table, bits), bits, size))  # its size is checked here
    else:
        shared = None
        told = told.union(answered(ngrams(table, bits, asked=True), size).select("block", "part", F.lit(None).cast("binary").alias("totals"), "levels"))

    def judge(own: pa.Table, counts: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        rows = list(zip(*(counts.column(c).to_pylist() for c in ("part", "totals", "levels"))))
        parts = sorted((part, data) for part, data, _ in rows if data is not None)
        level = shared.value.level if shared else _in_hash_order(np.frombuffer(b"".join(unpack(data) for _, data in sorted((part, data) for part, _, data in rows if data is not None)), np.uint8))
        found: list[list] = [[], [], [], [], [], []]
        for ids, held, sizes, codes, data in _rows(own.select(["doc_ids", "held", "sizes", "codes", "words"])):
            word = np.frombuffer(data, "<u8")
            known = np.empty(len(word), np.int64)
            known[np.argsort(word, kind="stable")] = np.concatenate([np.frombuffer(unpack(p), "<i8") for _, p in parts])
            sequence = _unpacked(codes)
            starts = np.cumsum(sizes) - sizes
            base = np.log10((known + 1) / (total + distinct + 1))[sequence]
            own_score = text_scores(level, word, codes, sizes, total, distinct)
            for column, values in zip(found, (ids, held, sizes, np.add.reduceat((known > 0)[sequence], starts, dtype=np.int64), np.add.reduceat(base, starts), own_score)):
                column.extend(values)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.table([pa.array(v, k) for v, k in zip(found, kinds)], names=names)

    own = table.select("block", "doc_ids", "held", "sizes", "codes", "words").groupBy("block")
    scored = own.cogroup(told.groupBy("block")).applyInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
