"""URLs allowed or blocked by rules, and the rest by two character language models.

A rule names a host and the beginning of a path; it fits that host and all its
subdomains, and of several the longest decides. The URLs that the rules decide
teach two Markov models over characters, one for accepted and one for rejected
URLs. Their order varies: a character is predicted from the longest of its last
three characters that training saw at least ``LEAST`` times, smoothed by Witten
and Bell's blend with the next shorter ones. The score of a URL is the mean difference
of the two log-likelihoods per character, the end counted. A fifth of the taught
URLs, by a hash of the URL, is kept out of the models: the threshold that errs
least on them, both kinds weighing alike, decides the URLs without a rule.

Characters fall into 45 classes (letters without case, digits as one, common
punctuation, the rest), so a model has at most 45^4 numbers at any size of the
input; these travel to the workers, and counts of that many at most reach the
driver.

Defined cases: a null URL, or one without ``://``, has an empty host and path and
is judged by its characters (none for null); without taught URLs of both kinds
every other URL has score 0 and is allowed; without any kept out the threshold is 0, and of
equal thresholds the one nearest to 0 is taken; a null page_id stays null;
repeated rows teach and are judged again; an empty table gives no rows; other
columns are ignored. A URL may be of any length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.texts import ascii_lower, blocks

#: Characters with a class of their own beside letters and digits.
PUNCTUATION = "-._~:/?#&=%+,;@"
CLASSES = 1 + 26 + 1 + len(PUNCTUATION) + 2
CONTEXT = 3
LEAST = 4
FOLDS = 5
BINS = 4096
SPAN = 8.0
_BLOCK_BYTES = 2_000_000


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", False), Rule("example.net", "/en/", True), Rule("example.com", "/de/", False), Rule("org", "/fr/", True))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    part = lambda group: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group), F.lit(""))
    return ascii_lower(part(1)), part(2)


def ruled(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null for none."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.allow).otherwise(verdict)
    return name, verdict


def _class_of_byte() -> np.ndarray:
    out = np.full(256, CLASSES - 2, np.uint8)
    out[0x80:] = CLASSES - 1
    for k in range(26):
        out[ord("a") + k] = out[ord("A") + k] = 1 + k
    out[ord("0") : ord("9") + 1] = 27
    for k, character in enumerate(PUNCTUATION):
        out[ord(character)] = 28 + k
    return out


def grams(urls: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number of each predicted class with the three before it, first of each URL); the border, class 0, ends a URL."""
    size = CONTEXT + 1
    offsets = np.frombuffer(urls.buffers()[1], np.int64)[urls.offset : urls.offset + len(urls) + 1]
    data = urls.buffers()[2]
    symbol = _class_of_byte()[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    row = np.repeat(np.arange(len(urls)), np.diff(offsets))
    flat = np.zeros(len(symbol) + size * len(urls), np.int64)
    flat[np.arange(len(symbol)) + size * row + CONTEXT] = symbol
    whole = sum(flat[k : len(flat) - CONTEXT + k] * CLASSES ** (CONTEXT - k) for k in range(size)) if len(flat) else flat
    predicted = np.ones(len(whole), bool)
    for k in range(CONTEXT):  # windows that end in the borders before the next URL
        predicted[(offsets[1:-1] + size * np.arange(1, len(urls)) - CONTEXT + k)] = False
    return whole[predicted], offsets[:-1] + np.arange(len(urls))


def counts(taught: DataFrame) -> DataFrame:
    """allow, gram, n over all rows (url, allow)."""

    def run(batches):
        for batch in blocks(batches, "url", _BLOCK_BYTES):
            gram, start = grams(batch.column("url"))
            allow = np.repeat(batch.column("allow").to_numpy(zero_copy_only=False), np.diff(np.append(start, len(gram))))
            key, n = np.unique(gram << 1 | allow, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key & 1 == 1), pa.array(key >> 1), pa.array(n, pa.int64())], names=["allow", "gram", "n"])

    return taught.select("url", "allow").mapInArrow(run, "allow boolean, gram long, n long").groupBy("allow", "gram").agg(F.sum("n").alias("n"))


def log_likelihoods(n: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Natural logarithm of the probability of each class after each three, by number of the gram."""
    n = n.reshape((CLASSES,) * (CONTEXT + 1)).astype(float)
    p = np.full(CLASSES, 1 / CLASSES)
    for k in range(CONTEXT + 1):
        own = n.sum(axis=tuple(range(CONTEXT - k)))
        total, kinds = own.sum(-1, keepdims=True), (own > 0).sum(-1, keepdims=True)
        p = np.where(total >= (least if k else 1), (own + kinds * p) / np.maximum(total + kinds, 1), p)
    return np.log(p).ravel()


def ratios(taught: DataFrame, least: int = LEAST) -> np.ndarray | None:
    """Difference of the two models' log-likelihoods by number of the gram; None without URLs of both kinds."""
    found = counts(taught).toArrow()
    allow, gram, n = (found.column(c).to_numpy() for c in ("allow", "gram", "n"))
    allow = allow.astype(bool)
    if allow.all() or not allow.any():
        return None
    each = []
    for kind in (allow, ~allow):
        own = np.zeros(CLASSES ** (CONTEXT + 1), np.int64)
        own[gram[kind]] = n[kind]
        each.append(log_likelihoods(own, least))
    return (each[0] - each[1]).astype(np.float32)


def scored(rows: DataFrame, ratio: np.ndarray | None) -> DataFrame:
    """The rows (with a column url) and their score."""
    if ratio is None:
        return rows.withColumn("score", F.lit(0.0))
    shared = rows.sparkSession.sparkContext.broadcast(ratio)  # CLASSES^4 numbers of four bytes

    def run(batches):
        for batch in blocks(batches, "url", _BLOCK_BYTES):
            gram, start = grams(batch.column("url"))
            sums = np.add.reduceat(shared.value[gram].astype(float), start) if len(start) else np.zeros(0)
            score = sums / np.diff(np.append(start, len(gram)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(batch.schema.field(c).type if c != "url" else pa.string()) for c in batch.schema.names), pa.array(score, pa.float64())], names=[*batch.schema.names, "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, score double")


def threshold(kept_out: DataFrame) -> float:
    """The score that parts accepted from rejected rows (allow, score) with the smallest mean of both error rates."""
    place = F.least(F.greatest(F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN))), F.lit(0)), F.lit(BINS - 1))
    seen = np.zeros((2, BINS))
    for r in kept_out.groupBy("allow", place.cast("int").alias("place")).count().collect():  # at most 2 * BINS rows
        seen[int(r["allow"]), r["place"]] = r["count"]
    total = seen.sum(1)
    if not total.all():
        return 0.0
    # a threshold at the lower border of a bin: accepted ones below it and rejected ones from it on are wrong
    below = np.concatenate([np.zeros((2, 1)), seen.cumsum(1)], 1)
    wrong = below[1] / total[1] + (total[0] - below[0]) / total[0]
    border = np.arange(BINS + 1) * (2 * SPAN / BINS) - SPAN
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(border[best[np.abs(border[best]).argmin()]])


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, least: int = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page's URL."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("allow"))
    taught = rows.where(F.col("allow").isNotNull()).select("url", "allow", (F.crc32(F.col("url").cast("binary")) % FOLDS == 0).alias("kept_out"))
    ratio = ratios(taught.where(~F.col("kept_out")), least)
    limit = threshold(scored(taught.where("kept_out").select("url", "allow"), ratio)) if ratio is not None else 0.0
    allowed = F.coalesce("allow", F.col("score") >= limit)
    return scored(rows, ratio).select("page_id", "host", "path", "rule", F.when(allowed, "allow").otherwise("block").alias("verdict"), "score")
