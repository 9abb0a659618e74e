"""Near copies against all pairs of five-word shingle sets."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kerbline.llm import near_copies
from kerbline.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def least_of_groups(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if like(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def edited(seed=8, copies=60):
    """Texts of 300 words, each with a copy that has scattered changes and is 0.8 to 0.95 alike."""
    rng, out = random.Random(seed), []
    while len(out) < 2 * copies:
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        other = [f"x{rng.randrange(3000)}" if rng.random() < 0.016 else w for w in words]
        if 0.8 <= like(shingles(" ".join(words)), shingles(" ".join(other))) < 0.95:
            out += [" ".join(words), " ".join(other)]
    return out


def test_scattered_edits_are_found_and_others_stay(spark):
    texts = edited()
    # alike in part, below 0.8: these stay
    apart = [" ".join([f"a{k % 2}x{i}" if i < 40 else f"a{k // 2}y{i}" for i in range(300)]) for k in range(20)]
    rows = [*texts, *apart, None, " ", "few words", "few  WORDS", "few other words"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    want = {i for i, r in enumerate(least_of_groups([shingles(t) for t in rows])) if r == i}
    assert len(want) == 60 + 20 + 3 and len(texts) == 120
    kept = {r["doc_id"] for r in corpus_pipeline.one_of_each_group(spark, docs, SF).collect()}
    assert kept == want


def test_documents_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    root = least_of_groups([shingles(r["text"]) for r in rows])
    got = near_copies.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [rows[i]["doc_id"] for i, r in enumerate(root) if r == i]


def test_rows_without_or_with_the_same_id_count_for_themselves(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(30))
    rows = [(None, words("a"), 0), (None, words("b"), 1), (None, words("a"), 2), (7, words("c"), 3), (7, words("d"), 4), (9, words("d"), 5), (8, words("b"), 6)]
    kept = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(0, words("a")), (8, words("b")), (7, words("c")), (7, words("d"))])
    assert near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string, key int").where("false")).collect() == []


def test_chunks_of_a_large_group_all_meet(spark):
    rng = random.Random(3)
    texts, now = [], [f"w{i}" for i in range(200)]
    for _ in range(120):  # a chain: only neighbours are alike
        now = list(now)
        at = rng.randrange(200)
        for k in range(15):
            now[(at + k) % 200] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(now))
    sets = [shingles(t) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "key long, text string")
    nodes = rows.select(F.col("key").alias("node")).join(spark.createDataFrame([(i, len(s)) for i, s in enumerate(sets)], "node long, n long"), "node")
    loose = nodes.select("node", F.lit(0).cast("long").alias("root"))
    for chunk in (1 << 20, 3000):
        roots = {r["node"]: r["root"] for r in components(near_copies.confirmed(nodes, rows, loose, chunk)).collect()}
        assert [roots.get(i, i) for i in range(len(texts))] == least_of_groups(sets)


def test_exact_comparison_of_sets():
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 1 << 62, 40) for _ in range(6)]
    sets = [set(b[rng.random(40) > 0.08].tolist()) for b in base for _ in range(8)] + [set()]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    assert near_copies.alike(offsets, np.array([x for s in sets for x in s], np.int64)).tolist() == least_of_groups(sets)
