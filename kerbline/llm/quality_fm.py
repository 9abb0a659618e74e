"""Quality classifier: a factorisation machine over hashed words, structure and size.

A text is a sparse vector: its words hashed into buckets, with logarithmic counts
of unit length together, and statistics of its structure and size. The machine adds to
a linear score the interaction of every pair of features through low-rank
factors; with the square of sums minus the sum of squares that takes time linear in
the features of a text. Prediction reads the text alone.

It is fitted on the driver with at most ``SAMPLE`` labelled rows, chosen by a hash of
their id, each of at most ``BUCKETS`` + ``STATISTICS`` numbers; everything else runs
over all rows in tasks.

Defined cases: null and empty texts have size statistics only; null labels are
ignored; without labelled rows, or with one label only, the score is the share of
label 1, or 0.5; a null doc_id stays null; repeated rows are scored again; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.llm.texts import blocks, held_out, words

BUCKETS = 1 << 13
STATISTICS = 11
FACTORS = 8
SAMPLE = 4000


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of rows, feature, value), features in order and distinct within a row."""
    n = len(texts)
    offsets, codes, distinct = words(texts)
    count = np.diff(offsets)
    bucket = np.array([zlib.crc32(w.encode()) % BUCKETS for w in distinct], np.int64)
    row = np.repeat(np.arange(n), count)
    same = np.append(False, (codes[1:] == codes[:-1]) & (row[1:] == row[:-1]))[: len(codes)]
    same = np.bincount(row, same, n)
    key = np.sort(row * BUCKETS + bucket[codes])
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    times = np.log1p(np.diff(np.append(first, len(key))))
    row, index = key[first] // BUCKETS, key[first] % BUCKETS
    norm = np.sqrt(np.bincount(row, times * times, n))
    times = times / norm[row]

    def found(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(float)

    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)
    per_word, per_character = np.maximum(count, 1), np.maximum(size, 1)
    lines = found("\n") + 1
    repeats = 1 - np.bincount(row, minlength=n) / per_word
    statistics = np.stack([
        np.log1p(count) / 10, np.log1p(size) / 12, np.minimum(size / per_word / 20, 2), np.minimum(found(r"[#*$%&|<>]") / per_word, 2), found(r"\p{Lu}") / per_character,
        found("[0-9]") / per_character, np.minimum(found("[.,;:]") / per_word, 2), np.minimum(found("[!?]") / per_word, 2), np.minimum(5 * lines / per_word, 2), np.where(count > 0, repeats, 0), 2 * same / per_word,
    ], 1)
    rows = np.concatenate([row, np.repeat(np.arange(n), STATISTICS)])
    order = np.argsort(rows, kind="stable")
    index = np.concatenate([index, np.tile(BUCKETS + np.arange(STATISTICS), n)])[order]
    value = np.concatenate([times, statistics.ravel()])[order]
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), index, value.astype(np.float32)


def _raw(machine: Machine, offsets: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic function, and each row's sum of weighted factors; every row has features."""
    starts = offsets[:-1]
    if not len(starts):
        return np.zeros(0), np.zeros((0, FACTORS))
    weighted = machine.factors[index] * value[:, None]
    sums = np.add.reduceat(weighted, starts)
    pairs = (sums * sums - np.add.reduceat(weighted * weighted, starts)).sum(1) / 2
    return machine.bias + np.add.reduceat(machine.linear[index] * value, starts) + pairs, sums


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score(machine: Machine, texts: pa.Array) -> np.ndarray:
    return _logistic(_raw(machine, *features(texts))[0])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 600, batch: int = 100, rate: float = 0.1, decay: float = 1e-5) -> Machine:
    """Adaptive gradient descent on the logistic loss; the same rows give the same machine."""
    size = BUCKETS + STATISTICS
    random = np.random.default_rng(7)
    share = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size, np.float32), random.normal(0, 0.05, (size, FACTORS)).astype(np.float32))
    if len(set(labels.tolist())) < 2:
        machine.factors[:] = 0
        return machine
    seen_linear, seen_factors, seen_bias = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(-(-steps * batch // len(rows))):
        order = random.permutation(len(rows))
        for start in range(0, len(order), batch):
            own = order[start : start + batch]
            index, value = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
            lengths = np.array([len(rows[i][0]) for i in own])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            raw, sums = _raw(machine, offsets, index, value)
            error = np.repeat((_logistic(raw) - labels[own]) / len(own), lengths)
            step = error * value
            slope = step[:, None] * (np.repeat(sums, lengths, 0) - machine.factors[index] * value[:, None])
            bias = float((error * np.repeat(1 / lengths, lengths)).sum())
            touched, back = np.unique(index, return_inverse=True)
            linear = np.bincount(back, step, len(touched)) + decay * machine.linear[touched]
            factors = np.stack([np.bincount(back, slope[:, f], len(touched)) for f in range(FACTORS)], 1) + decay * machine.factors[touched]
            seen_linear[touched] += linear**2
            seen_factors[touched] += factors**2
            seen_bias += bias**2
            machine.linear[touched] -= rate * linear / np.sqrt(seen_linear[touched])
            machine.factors[touched] -= rate * factors / np.sqrt(seen_factors[touched])
            machine.bias -= rate * bias / seen_bias**0.5
    return machine


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` rows of ``labels`` (doc_id, quality) with their texts."""

    def run(batches):
        for batch in blocks(batches):
            offsets, index, value = features(batch.column("text"))
            rows = [(index[a:b].astype("<i4").tobytes(), value[a:b].astype("<f4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "quality", "features", "numbers"])

    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")  # a bounded sample
    found = joined.mapInArrow(run, "doc_id long, quality int, features binary, numbers binary")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "features", "numbers").limit(sample).collect()  # repeated ids: always the same rows
    found.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["features"], r["numbers"]))
    return fit([(np.frombuffer(r["features"], "<i4"), np.frombuffer(r["numbers"], "<f4")) for r in found], np.array([r["quality"] for r in found], float))


def predict(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, least: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; learnt from labels of the rows that are not held out."""
    machine = train(docs, labels.where(~held_out(F.col("doc_id"), folds, fold)), sample)

    def run(batches):
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(machine, batch.column("text")).astype(float))], names=["doc_id", "score"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = given.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))
