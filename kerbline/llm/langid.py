"""Language of a text by the out-of-place distance of rank-ordered n-gram profiles.

A profile is a language's most frequent letter n-grams (one to three characters
of a lower-cased word, its borders counted) in order of frequency. A text's own
most frequent n-grams are ranked the same way; the distance to a profile is the
sum of the places that each n-gram is out of its place there, or the length of a
profile where it is missing. The nearest profile names the language.

Defined cases: a null text, or one without letters, is ``und`` with score 0;
equal distances give the first language in code point order; equal counts rank in
code point order of the n-gram; a null doc_id stays null and hashes as empty
text; repeated rows are judged again; without labelled rows every text is
``und``; an empty table gives no rows; other columns are ignored by ``predict``
and kept by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.llm.texts import blocks, held_out
from kerbline.operators.stage import stage

LENGTH = 300
UNKNOWN = "und"
_BITS = 17  # of a character's number within a block; three of them and a row's number share a 64-bit key
_ROWS = 1 << 12
_BLOCK_BYTES = 2_000_000
_BORDER = 1


def _rank_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each text by (row, n-gram): rows, n-grams, counts, and the letters that the numbers stand for."""
    lower = pc.utf8_lower(texts)
    size = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    points = np.frombuffer("".join(f"{t}\n" for t in lower.to_pylist()).encode("utf-32-le"), np.uint32)
    used = np.flatnonzero(np.bincount(points))
    letters = np.array([c for c in used.tolist() if chr(c).isalpha()], np.int64)
    letters = letters[: (1 << _BITS) - 2]  # rarer scripts beyond 131070 letters in one block count as borders
    number = np.full(int(used[-1]) + 1, _BORDER, np.int64)
    number[letters] = np.arange(2, len(letters) + 2)
    row = np.repeat(np.arange(len(size)), size)
    symbol = number[points]
    # one border between words, also before the first
    keep = (symbol != _BORDER) | np.append(False, symbol[:-1] != _BORDER)[: len(symbol)]
    symbol, row = np.append(_BORDER, symbol[keep]), np.append(0, row[keep])
    a, b, c = symbol[:-2], symbol[1:-1], symbol[2:]
    letter = symbol != _BORDER
    inner = letter[1:-1]
    pair = letter[:-1] | letter[1:]
    found = np.concatenate([
        (row << 3 * _BITS | symbol)[letter],
        (np.where(letter[:-1], row[:-1], row[1:]) << 3 * _BITS | symbol[:-1] << _BITS | symbol[1:])[pair],
        (row[1:-1] << 3 * _BITS | a << 2 * _BITS | b << _BITS | c)[inner],
    ])
    found.sort()
    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
    key = found[first]
    return key >> 3 * _BITS, key & ((1 << 3 * _BITS) - 1), np.diff(np.append(first, len(found))), letters


def _spell(gram: int, letters: np.ndarray) -> str:
    digits = [d for d in (gram >> 2 * _BITS, gram >> _BITS & (1 << _BITS) - 1, gram & (1 << _BITS) - 1) if d]
    return "".join("_" if d == _BORDER else chr(letters[d - 2]) for d in digits)


def _number(gram: str, place: dict[str, int]) -> int:
    """Number of a spelled n-gram, or -1 where a letter is not in the block."""
    out = 0
    for character in gram:
        digit = _BORDER if character == "_" else place.get(character, -1)
        if digit < 0:
            return -1
        out = out << _BITS | digit
    return out


def counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over the whole texts of all rows with a language."""

    def run(batches):
        for batch in blocks(batches, limit=_BLOCK_BYTES, rows=_ROWS):
            rows, grams, n, letters = _rank_keys(batch.column("text"))
            lang = batch.column("lang").dictionary_encode()
            key = lang.indices.to_numpy()[rows].astype(np.int64) << 3 * _BITS | grams
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            total = np.add.reduceat(n[order], first) if len(first) else n[:0]
            key = key[first]
            names = lang.dictionary.to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in (key >> 3 * _BITS).tolist()], pa.string()), pa.array([_spell(g, letters) for g in (key & ((1 << 3 * _BITS) - 1)).tolist()], pa.string()), pa.array(total, pa.int64())],
                names=["lang", "gram", "n"],
            )

    labelled = docs.where(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return labelled.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(docs: DataFrame, length: int = LENGTH) -> dict[str, list[str]]:
    """The most frequent n-grams of each language, in order; ``length`` of them a language reach the driver."""
    total = stage(counts(docs), "grams")
    names = sorted(r["lang"] for r in total.select("lang").distinct().collect())
    return {name: [r["gram"] for r in total.where(F.col("lang") == name).orderBy(F.desc("n"), "gram").limit(length).collect()] for name in names}


def _judge(texts: pa.Array, profiles: dict[str, list[str]], length: int) -> tuple[list[str], np.ndarray]:
    names = sorted(profiles)
    best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    rows, grams, n, letters = _rank_keys(texts)
    if not len(rows) or not names:
        return best, score
    order = np.argsort(rows << 32 | (1 << 32) - 1 - np.minimum(n, (1 << 32) - 1), kind="stable")
    rows, grams = rows[order], grams[order]
    start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
    rows, grams, rank = rows[rank < length], grams[rank < length], rank[rank < length]

    place = {chr(c): i + 2 for i, c in enumerate(letters.tolist())}
    numbered = {name: [_number(g, place) for g in profiles[name]] for name in names}
    known = np.array(sorted({g for own in numbered.values() for g in own} | {-1}), np.int64)
    ranks = np.full((len(known), len(names)), -1, np.int32)
    for column, name in enumerate(names):
        ranks[np.searchsorted(known, numbered[name]), column] = np.arange(len(numbered[name]))
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    theirs = np.where((known[at] == grams)[:, None], ranks[at], -1)
    apart = np.where(theirs < 0, length, np.abs(theirs - rank[:, None]))
    start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    distance = np.add.reduceat(apart, start, dtype=np.int64)
    nearest = distance.argmin(1)
    used = np.diff(np.append(start, len(rows)))
    for row, k in zip(rows[start].tolist(), nearest.tolist()):
        best[row] = names[k]
    score[rows[start]] = 1 - distance.min(1) / (length * used)
    return best, score


def judged(docs: DataFrame, carried: Column, found: dict[str, list[str]], length: int = LENGTH) -> DataFrame:
    """``carried`` as row, lang_pred, score of every row; the prediction reads the text alone."""

    def run(batches):
        for batch in blocks(batches, limit=_BLOCK_BYTES, rows=_ROWS):
            best, score = _judge(batch.column("text"), found, length)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

    given = docs.select(carried.alias("row"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def predict(docs: DataFrame, folds: int = 4, fold: int = 2, length: int = LENGTH) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learnt from the rows that are not held out."""
    out = held_out(F.col("doc_id"), folds, fold)
    found = profiles(docs.where(~out), length)
    judged_ = judged(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id")), found, length)
    return judged_.select("row.doc_id", held_out(F.col("row.doc_id"), folds, fold).alias("held_out"), "lang_pred", "score")


def keep(docs: DataFrame, least: float = 0.15, length: int = LENGTH) -> DataFrame:
    """The documents in a language that the labels teach, with their own columns."""
    found = profiles(docs, length)
    return judged(docs, F.struct("*"), found, length).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
