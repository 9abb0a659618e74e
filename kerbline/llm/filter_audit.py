"""What each filter of a chain removes, in any order, from truth tables of survival.

Five filters are either passed or failed by a document, so 32 subsets of filters
can be applied to it. A document becomes one 32-bit word whose bit S says that it
survives subset S. The words of a part and a label are added bit by bit with
carry-save adders: three words of one weight become a sum word of that weight
and a carry word of the next, until one word a weight is left. So 32 counts of
survivors stand for all documents, and every order of the filters is read from
them: what a step removes is the difference of two subsets.

The filters: A, under 200 words; B, fewer than half of the words are distinct; C,
more than 3 % of the characters are A-Z; D, one of ``#$%&*|``; E, the text of a
document with a smaller id, in the whole table. For E texts travel as SHA-256:
equal rows are counted first, the smallest id of each digest is found with
partial minima, and a row asks by (digest, id) whether it is that one, so the
copies of one text spread over all tasks.

Defined cases: a null text is empty and fails A; a null lang is the part of the empty
string; a null doc_id passes E, makes no other row fail it, and has no label;
repeated rows, also with the same id, count each, and do not fail E through each
other; a label that is null or missing is neither good nor toxic, of several rows
for one id any that says 1 counts; an empty table gives no rows; other columns
are ignored. A text may be of any length.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.texts import blocks, words
from kerbline.operators.stage import stage

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
_COPY = 1 << FILTERS.index("E")
_UPPER, _INNER, _MARK = 1, 2, 4


def survival_words() -> np.ndarray:
    """For each set of failed filters the word of the subsets that let the document through."""
    failed, subset = np.arange(SUBSETS)[:, None], np.arange(SUBSETS)[None, :]
    return ((failed & subset == 0) << subset).sum(1).astype(np.uint32)


def positional_popcounts(word: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is set, a word counting ``times`` times, by carry-save addition."""
    weights = [word[times >> k & 1 == 1] for k in range(int(times.max(initial=0)).bit_length())]
    out, k = np.zeros(SUBSETS, np.int64), 0
    while k < len(weights):
        rest, carries = weights[k], []
        while len(rest) > 1:
            third = len(rest) // 3
            if third:
                a, b, c = rest[: 3 * third].reshape(3, -1)
                half = a ^ b
                carries.append(a & b | half & c)
                rest = np.concatenate([half ^ c, rest[3 * third :]])
            else:
                carries.append(rest[:1] & rest[1:])
                rest = rest[:1] ^ rest[1:]
        if len(rest):
            out += (rest[0].astype(np.int64) >> np.arange(SUBSETS) & 1) << k
        if carries:
            carry = np.concatenate(carries)
            if k + 1 < len(weights):
                weights[k + 1] = np.concatenate([weights[k + 1], carry])
            else:
                weights.append(carry)
        k += 1
    return out


def _failures(texts: pa.Array) -> np.ndarray:
    """Failed filters A to D of each text, as bits."""
    kind = np.zeros(256, np.uint8)
    kind[65:91] = _UPPER
    kind[0x80:0xC0] = _INNER
    kind[list(b"#$%&*|")] = _MARK
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    rows = np.flatnonzero(np.diff(offsets))
    starts = offsets[:-1][rows] - offsets[0]
    data = texts.buffers()[2]
    kinds = kind[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.zeros(0, np.uint8)

    def held(which: int) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        if len(rows):
            out[rows] = np.add.reduceat(kinds & which != 0, starts, dtype=np.int64)
        return out

    points = np.diff(offsets) - held(_INNER)
    at, codes, distinct = words(texts, lower=False)
    n = np.diff(at)
    pairs = np.unique(np.repeat(np.arange(len(texts)), n) * max(1, len(distinct)) + codes)
    different = np.bincount(pairs // max(1, len(distinct)), minlength=len(texts))
    tests = (n < 200, 100 * different < 50 * n, 100 * held(_UPPER) > 3 * points, held(_MARK) > 0)
    return sum(test.astype(np.int32) << i for i, test in enumerate(tests))


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, failed (A to D as bits) and the number of equal rows n."""

    def run(batches):
        for batch in blocks(batches):
            texts = batch.column("text")
            digests = [hashlib.sha256(t.as_buffer()).digest() for t in texts.cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(_failures(texts), pa.int32())], names=["doc_id", "part", "digest", "failed"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    found = given.mapInArrow(run, "doc_id long, part string, digest binary, failed int")
    return found.groupBy("doc_id", "part", "digest", "failed").agg(F.count("*").alias("n"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (A to E as bits), good, toxic and n of the documents."""
    rows = stage(facts(docs), "facts")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("is_first", F.lit(True))
    copy = F.col("is_first").isNull() & F.col("doc_id").isNotNull()
    return rows.join(first, ["digest", "doc_id"], "left").join(_told(labels), "doc_id", "left").select(
        "part", F.when(copy, F.col("failed").bitwiseOR(F.lit(_COPY))).otherwise(F.col("failed")).alias("failed"),
        F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "n",
    )


def _told(labels: DataFrame) -> DataFrame:
    says = lambda name: F.max(F.coalesce(F.col(name).cast("int"), F.lit(0)) == 1).alias(name)
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("good"), "toxic").where("doc_id is not null")
    return ids.groupBy("doc_id").agg(says("good"), says("toxic"))


def survivors(rows: DataFrame) -> DataFrame:
    """part and, by subset of filters, how many documents survive it: all, good and toxic ones."""
    table = survival_words()

    def run(batches):
        for batch in batches:
            part = batch.column("part").dictionary_encode()
            good, toxic, failed, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic", "failed", "n"))
            group = part.indices.to_numpy().astype(np.int64) << 2 | good.astype(np.int64) << 1 | toxic
            order = np.argsort(group, kind="stable")
            group, word, n = group[order], table[failed[order]], n[order]
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)]).tolist()
            counts = [positional_popcounts(word[a:b], n[a:b]) for a, b in zip(start, [*start[1:], len(group)])]
            names, key = part.dictionary.to_pylist(), group[start]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in (key >> 2).tolist()], pa.string()), pa.array(key & 2 != 0), pa.array(key & 1 != 0), pa.array([c.tolist() for c in counts], pa.list_(pa.int64()))],
                names=["part", "good", "toxic", "counts"],
            )

    partial = rows.mapInArrow(run, "part string, good boolean, toxic boolean, counts array<long>")
    each = partial.select("part", "good", "toxic", F.posexplode("counts").alias("subset", "n"))
    of = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0).cast("long"))
    sums = each.groupBy("part", "subset").agg(F.sum("n").alias("n"), of(F.col("good")).alias("n_good"), of(F.col("toxic")).alias("n_toxic"))
    row = F.sort_array(F.collect_list(F.struct("subset", "n", "n_good", "n_toxic")))  # 32 of them
    return sums.groupBy("part").agg(row.alias("row")).select("part", *[F.col(f"row.{c}").alias(c) for c in ("n", "n_good", "n_toxic")])


def _shapley(n: Column, bit: int) -> Column:
    """What a filter removes, summed over all orders: each subset of the others precedes it in |S|! (4 - |S|)! of them."""
    others = [s for s in range(SUBSETS) if not s & bit]
    weight = lambda s: math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count())
    return sum(((n[s] - n[s | bit]) * F.lit(weight(s)) for s in others), F.lit(0).cast("long"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with what the step keeps and removes and the filter's other counts."""
    found = survivors(judged(docs, labels))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    found = found.withColumn("shapleys", F.array(*[_shapley(F.col("n"), 1 << i) for i in range(len(FILTERS))]))
    steps = found.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    prior = F.expr("substring(filter_order, 1, step - 1)")
    place = F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)"))  # from 1
    done = sum((F.when(F.instr(prior, letter) > 0, 1 << i).otherwise(0) for i, letter in enumerate(FILTERS)), F.lit(0))
    steps = steps.withColumn("done", done).withColumn("place", place).withColumn("bit", F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("place")))
    at = lambda column, subset: F.get(F.col(column), subset)
    after, whole = F.col("done").bitwiseOR(F.col("bit")), SUBSETS - 1
    gone = lambda column: at(column, F.col("done")) - at(column, after)
    return steps.select(
        "part", "filter_order", "step", at("n", after).alias("kept"), gone("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", F.col("bit")) - gone("n")).alias("redundant"),
        (at("n", F.lit(whole) - F.col("bit")) - at("n", F.lit(whole))).alias("unique_fails"),
        gone("n_good").alias("good_lost"), gone("n_toxic").alias("toxic_lost"), F.element_at("shapleys", F.col("place")).alias("shapley"),
    )


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, good, toxic,
    CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN translate(t, '#$%&*|', '') <> t THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS m
  FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good = 1) AS n_good, count(*) FILTER (WHERE toxic = 1) AS n_toxic FROM f GROUP BY ALL),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.x || b2.x || c.x || d2.x || e.x AS filter_order, [a.bit, b2.bit, c.bit, d2.bit, e.bit] AS bits
  FROM b a, b b2, b c, b d2, b e WHERE a.bit + b2.bit + c.bit + d2.bit + e.bit = 31 AND (a.bit | b2.bit | c.bit | d2.bit | e.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, list_sum([0] || bits[1:step - 1])::INTEGER AS done FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o) x),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN m & (done | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & done = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & done <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & done = 0 AND m & bit <> 0 THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & done = 0 AND m & bit <> 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""
