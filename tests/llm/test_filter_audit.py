"""Counts of the filter audit against applying every order of the filters to every document."""

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kerbline.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t ", "one two", "one two", "One TWO", "a $ b", "é" * 40 + "A", "A" + "b" * 33, "A" + "b" * 32, " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)),
    " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 99}" for i in range(200)), "| " * 250, "x\x0by\x0cz " * 100, "中文 " * 201, "LOUD # WORDS " * 100, "w" * 100_000 + " tail",
]


def failed(text, copy):
    words = WORD.findall(text)
    tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)
    return {x for x, test in zip("ABCDE", tests) if test}


def applied(rows, labels):
    """Every order applied filter by filter to (doc_id, text, lang) rows."""
    first = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    shapley = Counter()
    for part in {lang or "" for _, _, lang in rows}:
        docs = [(i, failed(t or "", i is not None and first[t or ""] < i)) for i, t, lang in rows if (lang or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                fails = sum(x in f for _, f in docs)
                out[part, "".join(order), step] = [len(left), len(gone), fails - len(gone), sum(f == {x} for _, f in docs), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[part, x] += len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def found(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}


def test_equals_applying_the_filters(spark):
    rows = [(100 - k, t, ("en", None, "", "de")[k % 4]) for k, t in enumerate(TEXTS)]
    rows += [(None, "one two", "en"), (None, "null id", None), rows[3], rows[3], (3, "one two", "de"), (3, "another text for a used id", "en"), (500, TEXTS[10], None)]
    labels = [(i, i % 2, 1 - i % 2) for i in range(80, 101)] + [(None, 1, 1), (3, 0, None), (3, 1, None), (500, None, 1), (7777, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 1, "clash", 2, False) for r in rows], "doc_id long, text string, lang string, part string, n int, digest string, failed int, good boolean")
    told = spark.createDataFrame([(*r, "clash", "clash") for r in labels], "doc_id long, quality int, toxic int, lang string, text string")
    got = found(filter_audit.audit(docs.repartition(4), told))
    assert got == applied(rows, labels) and len(got) == 3 * 600


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.where("false"), labels).collect() == []
    assert found(filter_audit.audit(docs, labels)) == applied([(1, "a", "en")], [])


def test_one_text_in_a_third_of_all_rows(spark):
    rows = [(i, "the same words" if i % 3 == 0 else f"own words {i}", "en") for i in range(3000)]
    labels = [(i, i % 2, 0) for i in range(0, 3000, 5)]
    got = found(filter_audit.audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == applied(rows, labels)


@pytest.mark.parametrize("size", [0, 1, 2, 3, 4, 8, 100, 12345])
def test_carry_save_counts(size):
    rng = np.random.default_rng(size)
    word = rng.integers(0, 1 << 32, size, dtype=np.uint32)
    times = np.where(rng.random(size) < 0.1, rng.integers(1, 1 << 40, size), 1)
    naive = [int(times[(word >> np.uint32(bit)) & 1 == 1].sum()) for bit in range(32)]
    assert filter_audit.positional_popcounts(word, times).tolist() == naive


def test_words_tell_the_surviving_subsets():
    table = filter_audit.survival_words()
    for mask, word in enumerate(table.tolist()):
        assert [word >> s & 1 for s in range(32)] == [int(mask & s == 0) for s in range(32)]


def test_sliced_blocks():
    texts = pa.array([t or "" for t in TEXTS], pa.large_string())
    whole = filter_audit._failures(texts)
    assert filter_audit._failures(texts.slice(5, 9)).tolist() == whole[5:14].tolist()
    assert filter_audit._failures(texts.slice(0, 0)).tolist() == []
