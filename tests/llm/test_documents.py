"""Rules, fingerprints, groups, notices, languages, scores and pages against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kerbline.llm import html_text, langid, license_scan, ngram_lm, quality_fm, quality_rules, simhash, winnow
from kerbline.llm.components import components
from kerbline.llm.license_notices import CUES, NOTICES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, m int, failed string, score string, fingerprint int, slice int, key int"
ODD = [
    None, "", " \n\t ", "one", "one two", "one two three", "one two three", "ÉÀ É Test\x0bx", "a b c a b c a b c", "line\nline\n \nline\nother", "# * $ % & | < > #", "12345 678", "x" * 3000,
    "the cat sat on the mat and the cat sat on the hat " * 9, "Le chat noir dort sur le grand lit de la maison bleue. " * 12, "LOUD WORDS!! " * 60, " ".join(f"w{i}" for i in range(3000)), "中文 文本 中文",
]


def documents(spark, texts=ODD, lang="en"):
    rows = [(i, t, lang, "s", 1, "clash", 2, "clash", "clash", 3, 4, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "null id here", None, None, None, None, None, None, None, None, None, None), rows[3]], SCHEMA)


def text_of(doc_id, texts=ODD):
    return "null id here" if doc_id is None else texts[doc_id] or ""


def signed(x):
    return x - (1 << 64) if x >> 63 else x


# rules


def measured(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_measure_as_defined(spark):
    rows = quality_rules.verdicts(documents(spark)).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        n, chars, symbols, lines, repeated = measured(text_of(r["doc_id"]))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeated)
        assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n)
        assert not (r["kept"] and r["base_failed"])
    assert quality_rules.verdicts(documents(spark).where("false")).collect() == []


def test_policies_and_ablation_combine_bits(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = quality_rules.ledger(docs).cache()
    failed = [r["failed"] for r in judged.select("failed").collect()]
    for policy, rules in quality_rules.POLICIES.items():
        mask = quality_rules.bits(rules)
        assert quality_rules.keep(docs, policy).count() == sum(not f & mask for f in failed)
        for r in quality_rules.ablation(judged, policy).collect():
            bit = quality_rules.bits([r["rule"]])
            assert (r["n_failed"], r["n_alone"], r["n_kept_without"]) == (sum(bool(f & bit) for f in failed), sum(f & mask == bit for f in failed), sum(not f & mask & ~bit for f in failed))
    assert quality_rules.keep(documents(spark)).columns == documents(spark).columns


# fingerprints


def kept(text, words=5, window=8):
    def mixed(numbers):
        seed = 42
        for x in numbers:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=seed)
        return signed(seed)

    h = [signed(xxhash.xxh64_intdigest(w, seed=42)) for w in WORD.findall(text)]
    grams = [mixed(h[i : i + words]) for i in range(len(h) - words + 1)] if len(h) >= words else [mixed(h)] if h else []
    out = []
    for i in range(max(1, len(grams) - window + 1) if grams else 0):
        least = min(g >> 24 for g in grams[i : i + window])
        at = max(j for j in range(i, min(i + window, len(grams))) if grams[j] >> 24 == least)
        if (least, at) not in out:
            out.append((least, at))
    return out


def test_winnowing_keeps_rightmost_minima_with_places(spark):
    for r in winnow.fingerprints(documents(spark)).collect():
        assert list(zip(r["hashes"], r["positions"])) == kept(text_of(r["doc_id"]))


def test_edited_texts_take_their_end_from_the_next_document(spark):
    texts = [t for t in ODD if t is not None] + ["é" * 31, "one two three four five six seven " * 5]
    docs = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r for r in winnow.edits(docs).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        r, following = rows[3 * i], texts[(i + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, b, c = ({h for h, _ in kept(t)} for t in (text, edited, following))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(a, b)) and r["near_next"] == pytest.approx(like(a, c))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (kept(text) == kept(edited))
    assert len({rows[3 * texts.index("one two three")]["fingerprint"], rows[3 * (texts.index("one two three") + 1)]["fingerprint"]}) == 1


def test_neighbours_are_found_over_many_slices_and_sparse_ids(spark):
    ids = sorted({random.Random(9).randrange(1, 1 << 40) for _ in range(3000)} | set(range(5000, 8000)) | {1 << 60})
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(7)
    found = {r["doc_id"]: r["next_text"] for r in winnow.with_next(docs, lambda t: F.length(t)).select("doc_id", "next_text").collect()}
    assert found == {i: f"t{j}" for i, j in zip(ids, [*ids[1:], ids[0]])}
    one = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    assert winnow.edits(one).first()["near_next"] == 1.0
    assert winnow.edits(one.where("false")).collect() == []


# near copies


def simhashed(text):
    words = WORD.findall(text.translate(LOWER))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints(spark):
    for r in simhash.groups(documents(spark)).collect():
        assert r["fingerprint"] % (1 << 64) == simhashed(text_of(r["doc_id"]))
    assert simhash.groups(documents(spark).where("false")).collect() == []
    assert {r["component_id"] for r in simhash.groups(documents(spark)).where("doc_id in (0, 1, 2)").collect()} == {0}


def test_long_rows_are_voted_in_parts():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 200_000, np.uint64)
    offsets = np.array([0, 0, 150_000, 200_000])
    want = [0] + [sum(1 << b for b in range(64) if 2 * int((hashes[x:y] >> np.uint64(b) & np.uint64(1)).sum()) > y - x) for x, y in ((0, 150_000), (150_000, 200_000))]
    assert simhash.majority(offsets, hashes).tolist() == want


@pytest.mark.parametrize("most", [4096, 3])
def test_links_equal_all_pairs(spark, most):
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(40)}
    for base in list(values)[:8]:
        chain = base
        for _ in range(25):
            chain ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(chain)
            values.add(base ^ (1 << rng.randrange(64)))
    values = sorted(values)
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    distinct = spark.createDataFrame([(signed(v), 0, signed(v)) for v in values], "fingerprint long, number int, value long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(distinct, most)).collect()}
    got = {}
    for i, v in enumerate(values):
        got.setdefault(roots.get(signed(v), signed(v)), set()).add(find(i))
    assert all(len(x) == 1 for x in got.values()) and len(got) == len({find(i) for i in range(len(values))})


def test_more_fingerprints_link_as_any_of_them_does(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.where("n_chars > 500").orderBy("doc_id").limit(12).collect()
    rows = [(1000 * r["doc_id"] + k, " ".join(w if (i + 7 * k) % (30 * (k + 1)) else "changed" for i, w in enumerate(r["text"].split(" ")))) for r in base for k in range(6)]
    edited = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r["doc_id"]: [v % (1 << 64) for v in r["prints"]] for r in simhash.fingerprints(edited, prints=4).collect()}
    group = {i: {i} for i in prints}
    for a in prints:
        for b in prints:
            if a < b and any((x ^ y).bit_count() <= 2 for x, y in zip(prints[a], prints[b])) and group[a] is not group[b]:
                group[a] |= group[b]
                for i in group[b]:
                    group[i] = group[a]
    got = simhash.groups(edited, prints=4).collect()
    assert all(r["component_id"] == min(group[r["doc_id"]]) for r in got)
    assert len({r["component_id"] for r in got}) < len({r["component_id"] for r in simhash.groups(edited).collect()})


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    rows = simhash.keep_one(docs).collect()
    groups = simhash.groups(docs).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted({g["component_id"] for g in groups if g["component_id"] is not None})
    assert simhash.keep_one(docs).columns == docs.columns


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5)], "u long, v long")
    assert {(r["node"], r["root"]) for r in components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


# notices


def test_every_notice_is_found_word_by_word():
    scanner = license_scan.Scanner()
    for name, texts in NOTICES.items():
        for text in texts:
            assert re.search(CUES, text, re.I)
            whole = f"Foo bar baz.\n{text}\nMore prose, of the usual kind."
            (found,) = scanner.scan(whole)[1]
            assert (found.license, found.missing, found.added) == (name, (), ()) and whole[found.begin : found.stop] == text.rstrip("./")
            ranks = {i: 1 - len(g.compress(text.encode())) / len(scanner.alone.compress(text.encode())) for i, g in enumerate(scanner.given)}
            assert scanner.notices[max(ranks, key=ranks.get)][0] == name


def test_variants_are_told_and_others_left(spark):
    mit = NOTICES["mit"][4].replace("any person", "any human being")
    texts = [mit, "Licensed under the GNU General Public License, version 9.", "the license of this is unknown", None, "", "Released under the MIT License. Licensed under CC BY-NC 4.0.", "LICENSE " * 500]
    rows = {r["doc_id"]: r for r in license_scan.licenses(documents(spark, texts)).collect()}
    assert (rows[0]["licenses"], rows[0]["n_differences"]) == ("mit", 3)
    assert [rows[i]["n_found"] for i in (1, 2, 3, 4, 6)] == [0] * 5 and rows[5]["licenses"] == "cc-by-nc-4.0,mit"
    assert license_scan.licenses(documents(spark, texts).where("false")).collect() == []


# languages


def ranked(texts):
    count = Counter()
    for text in texts:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            w = f"_{word}_"
            count.update(w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1))
            count.update(word)
    # the border sorts before all letters
    return [g for g, _ in sorted(count.items(), key=lambda x: (-x[1], len(x[0]), x[0].replace("_", "\0")))], count


def test_languages_by_out_of_place_distance(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    length = 150
    profiles = langid.profiles(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"), length)
    for lang, own in profiles.items():
        want, count = ranked(r["text"] for r in rows if r["lang"] == lang and not held[r["doc_id"]])
        assert [count[g] for g in own] == [count[g] for g in want[:length]]
    for r in langid.predict(docs, length=length).where("doc_id < 60").collect():
        text = rows[[x["doc_id"] for x in rows].index(r["doc_id"])]["text"]
        top = ranked([text])[0][:length]
        far = {lang: sum(abs(i - own.index(g)) if g in own else length for i, g in enumerate(top)) for lang, own in profiles.items()}
        assert r["lang_pred"] == min(sorted(far), key=far.get) and r["score"] == pytest.approx(1 - min(far.values()) / (length * len(top)))
    right = langid.predict(docs).join(docs, "doc_id").where("held_out").selectExpr("avg(cast(lang = lang_pred as int)) a").first()["a"]
    assert right > 0.95


def test_texts_without_letters_are_undetermined(spark):
    docs = documents(spark)
    rows = langid.predict(docs).collect()
    assert len(rows) == len(ODD) + 2 and all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in text_of(r["doc_id"]))) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.predict(docs.where("false")).collect() == []
    assert {r["lang_pred"] for r in langid.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.keep(docs).columns == docs.columns and langid.keep(docs).where("doc_id = 11").count() == 0


# language model


def test_base_scores_and_counts_are_exact(spark):
    docs = documents(spark)
    tokens = [WORD.findall(text_of(r["doc_id"]).translate(LOWER)) + [None] for r in docs.collect()]
    ids = [r["doc_id"] for r in docs.collect()]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i in ids]
    count = Counter(t for own, h in zip(tokens, held) if not h for t in own)
    total = sum(count.values())
    want = sorted((-1 if i is None else i, h, len(t), sum(x in count for x in t), total, round(sum(math.log10((count[x] + 1) / (total + len(count) + 1)) for x in t), 6)) for i, t, h in zip(ids, tokens, held))
    rows = ngram_lm.score(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(r["score"] <= 0 for r in rows)
    assert ngram_lm.score(docs.where("false")).collect() == []


def test_the_model_beats_the_base_on_held_out_text(spark):
    row = ngram_lm.score(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row["s"] > row["b"]


def test_the_filter_never_forgets_and_rarely_invents(spark):
    table = ngram_lm.tokenized(documents(spark), F.lit(False)).cache()
    found = ngram_lm.filter_of(ngram_lm.ngrams(table, 2), 2, 1 << 17)
    limits = ngram_lm.thresholds()
    tokens = [WORD.findall(text_of(r["doc_id"]).translate(LOWER)) for r in documents(spark).collect()]
    number = lambda t: int(ngram_lm._END) if t is None else xxhash.xxh64_intdigest(t)
    pairs = Counter((a, b) for t in tokens for a, b in zip([None, *t], [*t, None]))
    single = Counter(x for t in tokens for x in [*t, None])
    keys = list(pairs)
    got = found.level(ngram_lm.bigrams(*(np.array([number(k[i]) for k in keys], np.uint64) for i in (0, 1))))
    want = np.searchsorted(limits, [pairs[k] for k in keys], side="right")
    assert (got >= want).all() and (got == want).mean() > 0.97
    assert (found.level(ngram_lm.unigrams(np.array([number(k) for k in single], np.uint64))) >= np.searchsorted(limits, list(single.values()), side="right")).all()
    strangers = found.level(np.random.default_rng(2).integers(0, 1 << 63, 20_000, np.uint64))
    assert (strangers > 0).mean() < 3 * found.false_rate() + 0.01


# quality


def test_interactions_equal_all_pairs():
    offsets, index, value = quality_fm.features(pa.array([t or "" for t in ODD], pa.large_string()))
    rng = np.random.default_rng(3)
    size = quality_fm.BUCKETS + quality_fm.STATISTICS
    machine = quality_fm.Machine(0.3, rng.normal(size=size).astype(np.float32), rng.normal(0, 0.3, (size, quality_fm.FACTORS)).astype(np.float32))
    raw, _ = quality_fm._raw(machine, offsets, index, value)
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        if b - a > 60:
            continue
        i, x = index[a:b], value[a:b]
        assert len(set(i.tolist())) == len(i)
        pairs = sum(float(machine.factors[i[p]] @ machine.factors[i[q]]) * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert raw[k] == pytest.approx(0.3 + float(machine.linear[i] @ x) + pairs, rel=1e-3, abs=1e-3)


def test_repeated_ids_beyond_the_sample_give_the_same_model(spark):
    rows = [(i % 5, f"text {i} of many {'good words' if i % 2 else 'bad bad bad'}") for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    machines = [quality_fm.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels, sample=40) for n in (1, 3, 7)]
    assert all((m.linear == machines[0].linear).all() and (m.factors == machines[0].factors).all() for m in machines)


def test_quality_is_learnt_and_all_rows_scored(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_fm.predict(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) > 0.95 * len(rows)
    odd = quality_fm.predict(documents(spark), spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(odd) == len(ODD) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in odd)
    assert quality_fm.predict(docs.where("false"), labels).collect() == []
    assert all(r["score"] == 0.5 for r in quality_fm.predict(documents(spark), labels.where("false")).collect())


# pages

PROSE = "Long prose stands here, with commas, and more words than any other part of the page has. "


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("<p>a", "a"), ("a < b & c &lt; d", "a < b & c < d"), ("<!-- open <p>x", ""), ("<p title=\"abc>x</p>y<p>z", "x y z"), ("<ul><li>a<li>b</ul>", "a b"),
        ("<article><h1>T&amp;t</h1><p>one<b>two</b>\n three<br>four<p>five</article><footer>no</footer>", "T&t onetwo three four five"),
        (f"<body><nav><a>menu</a></nav><div class='content'><h2>Head</h2><p>{PROSE}</p><p>Short.</p></div><div class='comments'><p>{PROSE}</p></div></body>", f"Head {PROSE.strip()} Short."),
        (f"<header><h1>Site</h1></header><main><p>{PROSE}</p><form>a<input>b</form><div class='ad banner'>buy</div></main><aside>s</aside>", PROSE.strip()),
        (f"<div id=x><p>{PROSE}</p><p>{PROSE}</p></div><div id=y><a href=1>one</a> <a href=2>two</a></div>", f"{PROSE}{PROSE}".strip()),
        ("<script>var a = '<p>no</p>';</script><style>p{}</style><noscript>no</noscript>", ""), ("<div>" * 2000 + "deep", "deep"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_generated_pages_give_their_article(spark):
    import html

    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r for r in html_text.extract(spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit("clash"))).collect()}
    for r in rows:
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        want = " ".join(x for x in (" ".join(html.unescape(part).split()) for part in re.split(r"</?(?:p|h1|br)>", inner)) if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    nulls = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert [r["text"] for r in html_text.extract(nulls).collect()] == ["", "", ""]
