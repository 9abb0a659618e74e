"""Best-fit packing of token sequences under several capacities at once.

A piece of length L costs (L tokens, 1 document, L^2 attention). Pieces of one
length are the same vector, so the best-fit search runs over lengths with their
counts, at most ``max_tokens`` of them, and over groups of bins with equal
residuals. Its result is a list of placements: ranks [low, high) of a length go
``per_bin`` each into consecutive bins. The pieces themselves never leave Spark:
each gets its rank within its length and looks up its placement.

Defined cases: a null or empty text is the separator alone; a null doc_id stays
null; a repeated row is packed again; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import os
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.texts import Memo, blocks, coded, ragged
from kerbline.operators.stage import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, slice int, nth long"
PLACEMENTS = "length long, low long, high long, bin long, per_bin long, base long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, and how bins are chosen.

    ``rule`` "norm" takes the bin whose weighted residual after the piece is
    smallest; "dot" the one whose weighted residual agrees best with the piece.
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"

    @property
    def longest(self) -> int:
        """Longest piece that fits an empty sequence."""
        return min(self.tokens, math.isqrt(self.attention))


def place(lengths: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """Placements of all pieces, longest first: (length, low, high, first bin, pieces a bin, offset of the first)."""
    if capacity.documents < 1 or capacity.longest < 1:
        raise ValueError("a sequence must hold a document of one token")
    full = np.array([capacity.tokens, capacity.documents, capacity.attention], np.int64)
    weights = np.array(capacity.weights)
    left, first, count = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out, bins = [], 0
    for length in sorted(lengths, reverse=True):
        item, todo, low = np.array([length, 1, length * length], np.int64), lengths[length], 0
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while todo:
            fits = np.flatnonzero((left >= item).all(1))
            if len(fits):
                rest = left[fits] / full
                score = -(rest * (item / full)) @ weights if capacity.rule == "dot" else (rest - item / full) ** 2 @ weights
                g = int(fits[np.argmin(score)])
            else:
                most = int((full // item).min()) if capacity.rule == "norm" else 1
                left, first = np.vstack([left, full]), np.append(first, bins)
                count = np.append(count, -(-todo // most))
                bins, g = bins + int(count[-1]), len(first) - 1
            # by residual norm a bin that took a piece stays the best one while it fits
            most = int((left[g] // item).min()) if capacity.rule == "norm" else 1
            whole, odd = divmod(min(todo, most * int(count[g])), most)
            base, start, rest = int(full[0] - left[g, 0]), int(first[g]), left[g].copy()
            made = [(whole, most, start)] * bool(whole) + [(1, odd, start + whole)] * bool(odd)
            for bins_used, each, at in made:
                out.append((length, low, low + bins_used * each, at, each, base))
                low, todo = low + bins_used * each, todo - bins_used * each
            over = int(count[g]) - sum(m[0] for m in made)
            keep = np.arange(len(first)) != g
            new = [(rest - each * item, at, n) for n, each, at in made] + [(rest, start + int(count[g]) - over, over)] * bool(over)
            left = np.vstack([left[keep], *[x[0] for x in new]])
            first = np.append(first[keep], [x[1] for x in new])
            count = np.append(count[keep], [x[2] for x in new])
        open_ = left[:, 0] > 0
        left, first, count = left[open_], first[open_], count[open_]
    return out


#: Fixed value: how the vocabulary's tokenizer parts normalized text.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"


#: Fixed value: the marks that normalization may compose with a letter from A to Z.
_MARKS = r"[\x{300}-\x{36F}]"


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte: itself where printable, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}


def _encoder(vocabulary: str):
    """Function from distinct strings without spaces to (all ids, ids a string), as the tokenizer encodes them.

    Strings are normalized together and cut into parts; only distinct parts reach
    the merges. Strings that may hold a special token are encoded as they are.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary)
    split, character = regex.compile(_PARTS).findall, _byte_characters()

    def merged(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [[t.id for t in tokenizer.model.tokenize(p if p.isascii() and p.isprintable() else "".join(map(character.__getitem__, p.encode())))] for p in parts]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    memo = Memo(merged)

    def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = [i for i, s in enumerate(strings) if "<|" in s or "\0" in s]
        plain = strings
        if special:
            plain = list(strings)
            for i in special:
                plain[i] = ""
        parts = [split(s) for s in tokenizer.normalizer.normalize_str("\0".join(plain)).split("\0")] if plain else []
        flat = pa.array(list(chain.from_iterable(parts)), pa.string()).dictionary_encode()
        codes = flat.indices.to_numpy()
        ids, starts, lengths = memo.lookup(flat.dictionary.to_pylist())
        ends = np.concatenate([[0], np.cumsum(lengths[codes])])[np.cumsum([0] + [len(p) for p in parts])]
        ids = ids[ragged(starts[codes], lengths[codes])]
        if not special:
            return ids, np.diff(ends)
        rows = np.split(ids, ends[1:-1])
        for i in special:
            rows[i] = np.array(tokenizer.encode(strings[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    return encode


def _folded(texts: pa.Array) -> pa.Array:
    """Texts with fewer distinct strings and the same tokens: the tokenizer folds case and drops white space itself.

    It composes marks with their letters first, and some letters compose only where they are small.
    """
    cased = pc.or_(pc.match_substring(texts, "<|"), pc.match_substring_regex(texts, _MARKS))  # special tokens have a case
    lower = pc.if_else(cased, texts, pc.ascii_lower(texts))
    return pc.replace_substring(lower, "\n", " ")


def cut_pieces(docs: DataFrame, vocabulary: str, longest: int, separator: int = 0) -> DataFrame:
    """Token pieces of all texts, numbered within slice and length.

    White space parts tokens in this kind of vocabulary, so each distinct
    space-delimited string is encoded once per task.
    """

    def run(batches):
        memo = Memo(_encoder(vocabulary))
        seen = np.zeros(longest + 1, np.int64)
        slice_ = TaskContext.get().partitionId()
        for batch in blocks(batches):
            offsets, codes, distinct = coded(pc.split_pattern(_folded(batch.column("text")), " "))
            ids, starts, lengths = memo.lookup(distinct)
            per_word = lengths[codes]
            flat = ids[ragged(starts[codes], per_word)].astype("<u4")
            ends = np.concatenate([[0], np.cumsum(per_word)])[offsets]
            rows: list[list] = [[], [], [], [], [], []]
            for doc, (a, b) in zip(batch.column("doc_id").to_pylist(), zip(ends[:-1].tolist(), ends[1:].tolist())):
                own = np.append(flat[a:b], np.uint32(separator)).astype("<u4")
                for piece, start in enumerate(range(0, len(own), longest)):
                    part = own[start : start + longest]
                    for column, value in zip(rows, (doc, piece, start, len(part), zlib.crc32(part.tobytes()), seen[len(part)])):
                        column.append(value)
                    seen[len(part)] += 1
            doc, piece, start, length, crc, nth = rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([slice_] * len(doc), pa.int32()), pa.array(nth, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "slice", "nth"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str, capacity: Capacity = Capacity(), separator: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    spark = docs.sparkSession
    cut = stage(cut_pieces(docs, vocabulary, capacity.longest, separator), "pieces")
    # a slice is one task's share: ranks need only counts per slice and length
    counts = cut.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = counts.select("length", "slice", (F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")).alias("before"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    plan = spark.createDataFrame(place(lengths, capacity), PLACEMENTS)  # bounded by lengths and groups of bins, not by documents
    ranked = cut.join(before, ["length", "slice"]).withColumn("rank", F.col("before") + F.col("nth"))
    nth = F.col("rank") - F.col("low")
    return (
        ranked.join(F.broadcast(plan.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("sequence_id", F.col("bin") + F.expr("(rank - low) div per_bin"))
        .withColumn("offset", F.col("base") + nth % F.col("per_bin") * F.col("length"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    )
