"""Shared handling of document tables and of text inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds much more than ``limit`` bytes of text or more than ``rows`` rows; null texts become empty.

    A single text above the limit is a block of its own.
    """
    for batch in batches:
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
        batch = batch.set_column(at, pa.field(column, pa.large_string()), text)
        size = pc.binary_length(text).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(size, done + limit, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """List array of strings as (offsets of rows, code of each string, distinct strings)."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    return offsets - offsets[0], flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of texts without nulls, A-Z lower-cased: (offsets, codes, distinct words)."""
    if lower:
        texts = pc.ascii_lower(texts)
    # one space between words, none around them
    texts = pc.utf8_trim(pc.replace_substring_regex(texts, r"[\x20\x09-\x0D]+", " "), " ")
    offsets, codes, distinct = coded(pc.split_pattern(texts, " "))
    if "" in distinct:  # a text without words splits into one empty string
        empty = distinct.index("")
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
        codes = codes - (codes > empty)
        distinct = distinct[:empty] + distinct[empty + 1 :]
    return offsets, codes, distinct


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... of all rows, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


class Memo:
    """Ids of distinct strings, kept between the blocks of a task; beyond ``limit`` only those of the last block stay."""

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.place: dict = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def lookup(self, strings: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, start of each string's ids, their number); the strings are distinct."""
        new = [s for s in strings if s not in self.place]
        if new:
            ids, lengths = self.encode(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new))))
            starts = len(self.ids) + np.cumsum(lengths) - lengths
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, starts])
            self.lengths = np.concatenate([self.lengths, lengths])
        at = np.fromiter(map(self.place.__getitem__, strings), np.int64, len(strings))
        if len(self.place) > self.limit:
            self.place = dict(zip(strings, range(len(strings))))
            self.ids, self.lengths = self.ids[ragged(self.starts[at], self.lengths[at])], self.lengths[at]
            self.starts = np.cumsum(self.lengths) - self.lengths
            at = np.arange(len(strings))
        return self.ids, self.starts[at], self.lengths[at]


_BESIDE_SPACE = r"^ | $| [\s\p{Z}\x0B\x1C-\x1F\x{85}]|[\s\p{Z}\x0B\x1C-\x1F\x{85}] "
_ALONE = re.compile(r"(?<=\S) (?=\S)")


def pieces(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Cut texts at single spaces between other characters: (row order, list array).

    Rows with other white space beside a space are cut only where it is safe and
    come last.
    """
    odd = pc.match_substring_regex(texts, _BESIDE_SPACE).to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    rest = pa.array([_ALONE.split(t) for t in texts.filter(pa.array(odd)).to_pylist()], plain.type)
    return np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)]), pa.concat_arrays([plain, rest])
