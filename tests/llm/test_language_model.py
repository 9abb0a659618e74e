"""Scores of the Bloom filter model against plain counts, and the filter at every size."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from kerbline.llm import ngram_lm

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def plain_scores(rows):
    """log10 probabilities from exact counts, rounded to the levels' means."""
    limits = ngram_lm.thresholds()
    means = [0.0, *((limits[:-1] + limits[1:] - 1) / 2), float(limits[-1])]
    rounded = lambda n: means[int(np.searchsorted(limits, n, side="right"))]
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in rows}
    single, double = Counter(), Counter()
    for i, own in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            single.update(own)
            double.update(zip([None, *own], own))
    total, distinct = sum(single.values()), len(single)
    out = {}
    for i, own in tokens.items():
        each = []
        for trust in ngram_lm.TRUSTS:
            sum_ = 0.0
            for before, word in zip([None, *own], own):
                first = rounded(single[before])
                share = min(rounded(double[before, word]) / max(first, 1), 1)
                smooth = min((rounded(single[word]) + 1) / (total + distinct + 1), 1)
                weight = first / (first + trust)
                sum_ += np.log10(weight * share + (1 - weight) * smooth)
            each.append(sum_)
        most = max(each)
        out[i] = most + np.log10(sum(10.0 ** (x - most) for x in each) / len(each))
    return out


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def test_scores_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BITS_PER_TOKEN", 400)  # hardly any false positives
    docs = documents(spark)
    want = plain_scores([tuple(r) for r in docs.collect()])
    got = {r["doc_id"]: r["score"] for r in ngram_lm.score(docs).collect()}
    assert got.keys() == want.keys()
    assert np.mean([got[i] == pytest.approx(want[i], abs=1e-6) for i in want]) > 0.97
    assert all(abs(got[i] - want[i]) < 3 for i in want)


def test_ranges_answer_as_the_broadcast_filter_does(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "_RANGE_TOKENS", 5000)
    monkeypatch.setattr(ngram_lm, "BLOCK_BYTES", 60_000)
    docs = documents(spark).repartition(3).union(spark.createDataFrame([(None, None), (7, ""), (8, "Zyx unseen")], "doc_id long, text string"))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["base_score"])
    one, other = (sorted(ngram_lm.score(docs, broadcast_bits=b).collect(), key=key) for b in (1 << 31, 0))
    assert one == other and len(one) == docs.count()
    assert ngram_lm.score(docs.where("false"), broadcast_bits=0).collect() == []


@pytest.mark.parametrize("count", [2_000, 128_000])
def test_false_positives_do_not_grow_with_the_corpus(count):
    rng = np.random.default_rng(count)
    key = rng.integers(0, 1 << 48, count, np.uint64)
    made = ngram_lm._filter_part(key, np.ones(count, np.int64), ngram_lm.BITS_PER_TOKEN * count // 64 * 64)
    strangers = made.level_of(rng.integers(0, 1 << 48, 50_000, np.uint64), np.zeros(50_000, np.uint64))
    assert (strangers > 0).mean() == pytest.approx((1 - np.exp(-4 / 6)) ** 4, abs=0.02)
    assert (made.level_of(key, np.zeros(count, np.uint64)) >= 1).all()


def test_a_full_filter_ends():
    full = ngram_lm.Filter(np.full(1024, 255, np.uint8), 0, 8192)
    assert (full.level(np.arange(1000, dtype=np.uint64)) == len(ngram_lm.thresholds())).all()
    assert ngram_lm._filter_part(np.arange(500_000, dtype=np.uint64), np.full(500_000, 1 << 40), 64).false_rate() == 1.0
