"""Byte-level BPE over distinct words by replaying the merges in rank order.

A task treats the distinct words of a block of documents as one corpus. An
inverted index leads from a token pair to the word positions where it stands;
the ranks are replayed in order, each merge touches only the positions listed
for its pairs, and only the pairs beside a merged position are indexed anew.
The result of a word does not depend on the words beside it in the corpus, so
blocks need no exchange of rows.

Defined cases: a null or empty text has no ids; a null doc_id stays null; a
repeated row is encoded again; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.texts import Memo, blocks, coded, pieces, ragged

BLOCK_BYTES = 16_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token from a file of base64 tokens and ranks."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Replay:
    """Encodes distinct words together; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.joined: dict[int, int] = {}

    def rank(self, pair: int) -> int:
        """Rank of a pair (left << 32 | right), or -1."""
        got = self.joined.get(pair)
        if got is None:
            if len(self.joined) > 500_000:
                self.joined.clear()
            got = self.joined[pair] = self.ranks.get(self.token[pair >> 32] + self.token[pair & 0xFFFFFFFF], -1)
        return got

    def alone(self, word: bytes) -> list[int]:
        """One word by itself: join the leftmost pair of lowest rank until none is left."""
        ids = [self.ranks[bytes([b])] for b in word]
        while len(ids) > 1:
            found = [(r, i) for i in range(len(ids) - 1) if (r := self.rank(ids[i] << 32 | ids[i + 1])) >= 0]
            if not found:
                break
            r, i = min(found)
            ids[i : i + 2] = [r]
        return ids

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        lengths = np.ones(len(words), np.int64)
        open_ = np.flatnonzero(whole < 0)
        ids, own, odd = self._replay([words[i] for i in open_])
        lengths[open_] = own
        starts = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.int32)
        out[starts[whole >= 0]] = whole[whole >= 0]
        out[ragged(starts[open_], own)] = ids
        if len(odd):  # words whose merges must interleave
            rows = np.split(out, starts[1:])
            for i in open_[odd]:
                rows[i] = np.array(self.alone(words[i]), np.int32)
            out, lengths = np.concatenate(rows), np.array([len(x) for x in rows], np.int64)
        return out, lengths

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids a word, words to encode alone)."""
        size = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        symbol = self.single[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        follower, leader = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ends = np.cumsum(size)
        follower[ends - 1], leader[ends - size] = -1, -1
        index: dict[int, list[tuple[int, np.ndarray]]] = {}
        queue: list[int] = []
        odd = np.zeros(len(words), bool)

        def add(left: np.ndarray, now: int) -> None:
            pair = symbol[left] << 32 | symbol[follower[left]]
            order = np.argsort(pair, kind="stable")
            pair, left = pair[order], left[order]
            cuts = np.flatnonzero(np.diff(pair)) + 1
            starts = [0, *cuts.tolist()] if len(pair) else []
            for a, b, key in zip(starts, [*starts[1:], len(pair)], pair[starts].tolist()):
                rank = self.rank(key)
                if rank < 0:
                    continue
                if rank < now:
                    odd[word[left[a:b]]] = True
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(queue, rank)
                index[rank].append((key, left[a:b]))

        add(np.flatnonzero(follower >= 0), -1)
        while queue:
            rank = heapq.heappop(queue)
            listed = index.pop(rank)
            left = np.concatenate([p for _, p in listed])
            pair = np.repeat([k for k, _ in listed], [len(p) for _, p in listed])
            right = follower[left]
            left = np.sort(left[(right >= 0) & (symbol[left] << 32 | symbol[right] == pair)])
            if not len(left):
                continue
            right = follower[left]
            meets = np.append(False, right[:-1] == left[1:])
            if meets.any():  # overlapping pairs: every other one, from the left
                at = np.arange(len(left))
                left = left[(at - np.maximum.accumulate(np.where(meets, 0, at))) % 2 == 0]
                right = follower[left]
            after = follower[right]
            symbol[left], symbol[right], follower[left] = rank, -1, after
            leader[after[after >= 0]] = left[after >= 0]
            before = leader[left]
            near = np.sort(np.concatenate([left[after >= 0], before[before >= 0]]))
            add(near[np.append(True, near[1:] != near[:-1])[: len(near)]], rank)
        alive = symbol >= 0
        return symbol[alive], np.bincount(word[alive], minlength=len(words)), np.flatnonzero(odd)


def encoder(ranks: dict[bytes, int], pattern: str):
    """Function from an array of texts to (row order, offsets, ids)."""
    import regex

    split = regex.compile(pattern).findall
    words = Memo(Replay(ranks).encode, 300_000)

    def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [split(s) for s in strings]
        flat = pa.array(list(chain.from_iterable(parts)), pa.string()).dictionary_encode()
        codes = flat.indices.to_numpy()
        ids, starts, lengths = words.lookup(flat.dictionary.cast(pa.binary()).to_pylist())
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])
        bounds = np.cumsum([0] + [len(p) for p in parts])
        return ids[ragged(starts[codes], lengths[codes])], np.diff(ends[bounds])

    strings = Memo(encode, 300_000)

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order, lists = pieces(texts)
        offsets, codes, distinct = coded(lists)
        codes = codes * 2 + 1  # all but the first string of a text keep the space before them
        codes[offsets[:-1]] -= 1
        used = np.flatnonzero(np.bincount(codes, minlength=2 * len(distinct)))
        ids, starts, lengths = strings.lookup([" " * (c & 1) + distinct[c >> 1] for c in used.tolist()])
        place = np.zeros(2 * len(distinct), np.int64)
        place[used] = np.arange(len(used))
        at = place[codes]
        ends = np.concatenate([[0], np.cumsum(lengths[at])])
        return order, ends[offsets], ids[ragged(starts[at], lengths[at])].astype("<u4")

    return run


def decoder(ranks: dict[bytes, int]):
    """Function from ids to the bytes they stand for."""
    ordered = sorted(ranks.items(), key=lambda item: item[1])
    lengths = np.zeros(ordered[-1][1] + 1, np.int64)
    lengths[[rank for _, rank in ordered]] = [len(token) for token, _ in ordered]
    flat, starts = np.frombuffer(b"".join(token for token, _ in ordered), np.uint8), np.cumsum(lengths) - lengths
    return lambda ids: flat[ragged(starts[ids], lengths[ids])].tobytes()


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens and the ids as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary file: fixed size

    def run(batches):
        encode_ = encoder(shared.value, pattern)
        for batch in blocks(batches, limit=BLOCK_BYTES):
            order, ends, ids = encode_(batch.column("text"))
            rows = [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(order)), pa.array(np.diff(ends), pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return _input(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id and the bytes that the ids stand for; null ids stand for none."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        decode_ = decoder(shared.value)
        for batch in batches:
            rows = [decode_(np.frombuffer(x or b"", "<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Encode, decode the ids, and return the digests of both; one pass, so that ids stay in the task."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        encode_, decode_ = encoder(shared.value, pattern), decoder(shared.value)
        for batch in blocks(batches, limit=BLOCK_BYTES):
            order, ends, ids = encode_(batch.column("text"))
            rows = [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(order)), pa.array(np.diff(ends), pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in rows], pa.string()), pa.array([hashlib.sha256(decode_(x)).hexdigest() for x in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _input(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
