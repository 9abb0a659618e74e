"""Hosts, rules and character models of the URL filter against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kerbline.llm import url_filter
from kerbline.llm.url_filter import CLASSES, CONTEXT, RULES

SF = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string, host string, path string, rule string, score string, allow string"
ODD = [
    None, "", "no scheme", "://", "http://", "http://NET/", "http://net", "http://net/x", "http://xnet/x", "http://a.NET/x?y://z", "http://example.net/en/1", "http://www.Example.net/en/", "http://example.net/en",
    "http://badexample.net/en/1", "http://a.org/fr/2#x", "http://a.org/FR/2", "http://org/fr/", "http://example.com/de/x", "http://example.com?/de/", "http://example.com#/de/", "http://b.example.com/de/?q=/en/",
    "http://user@example.com:80/de/1", "http://example.com.net/de/1", "//net/x", "x://y://net/", "http://example.com/\n/de/", "http://é.org/fr/ü", "http://a.org/en/" + "x" * 200_000, "ftp://h.org/fr/../", "http://example.org//fr/",
]


def parts(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:stop]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def classes(url):
    out = []
    for b in (url or "").encode():
        c = chr(b).lower()
        out.append(CLASSES - 1 if b >= 128 else 1 + ord(c) - 97 if "a" <= c <= "z" else 27 if c.isdigit() else 28 + url_filter.PUNCTUATION.index(c) if c in url_filter.PUNCTUATION else CLASSES - 2)
    return [*out, 0]


def model(urls, least):
    """Witten and Bell's blend, context by context, without tables."""
    seen = Counter()
    for url in urls:
        own = [0] * CONTEXT + classes(url)
        for i in range(CONTEXT, len(own)):
            for k in range(CONTEXT + 1):
                seen[tuple(own[i - k : i]), own[i]] += 1
    total, kinds = Counter(), Counter()
    for (context, _), n in seen.items():
        total[context] += n
        kinds[context] += 1

    def p(context, symbol):
        shorter = p(context[1:], symbol) if context else 1 / CLASSES
        if total[context] < (least if context else 1):
            return shorter
        return (seen[context, symbol] + kinds[context] * shorter) / (total[context] + kinds[context])

    def mean_log(url):
        own = [0] * CONTEXT + classes(url)
        return sum(math.log(p(tuple(own[i - CONTEXT : i]), own[i])) for i in range(CONTEXT, len(own))) / (len(own) - CONTEXT)

    return mean_log


def expected(urls, least=url_filter.LEAST):
    taught = [(u, r.allow) for u in urls if (r := rule_of(*parts(u)))]
    fold = [(u, a) for u, a in taught if zlib.crc32(u.encode()) % url_filter.FOLDS]
    out = [(u, a) for u, a in taught if not zlib.crc32(u.encode()) % url_filter.FOLDS]
    models = [model([u for u, a in fold if a == kind], least) for kind in (True, False)]
    score = lambda u: models[0](u) - models[1](u)
    return score, [(score(u), a) for u, a in out]


def made(seed=5, count=400):
    rng = random.Random(seed)
    hosts = [("example.net", "en"), ("a.org", "fr"), ("bad.net", "en"), ("casino.example.com", "de"), ("blog.org", "en"), ("shop.example.com", "fr")]
    out = []
    for _ in range(count):
        host, lang = rng.choice(hosts)
        out.append(f"http{rng.choice(['', 's'])}://{rng.choice(['', 'www.', 'm.'])}{host}/{lang}/{rng.choice(['news', 'win-cash', 'story', 'free-pills'])}{rng.randrange(1000)}{rng.choice(['', '.html', '?page=2'])}")
    return out


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "clash", "clash", "clash", "clash", "clash", "clash") for i, u in enumerate(ODD)] + [(None, ODD[10], None, None, None, None, None, None)]
    got = url_filter.judge(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        url = ODD[10] if r["page_id"] is None else ODD[r["page_id"]]
        rule = rule_of(*parts(url))
        assert (r["host"], r["path"], r["rule"]) == (*parts(url), rule.name if rule else None), url
        assert r["verdict"] in ("allow", "block") and (not rule or (r["verdict"] == "allow") == rule.allow), url


def test_scores_and_threshold_equal_plain_models(spark):
    urls = [*made(), *made()[:30], "https://blog.org/en/x.html", None, ""]
    score, kept_out = expected([u or "" for u in urls])
    got = url_filter.judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(4)).collect()
    assert len(got) == len(urls)
    for r in got:
        assert r["score"] == pytest.approx(score(urls[r["page_id"]] or ""), abs=1e-5)
    free = [r for r in got if r["rule"] is None]
    limits = sorted({r["score"] for r in free if r["verdict"] == "allow"}), sorted({r["score"] for r in free if r["verdict"] == "block"})
    assert not limits[0] or not limits[1] or limits[1][-1] < limits[0][0]
    # the threshold errs no more on the kept-out URLs than any of their scores would
    limit = url_filter.threshold(spark.createDataFrame(kept_out, "score double, allow boolean"))

    def wrong(x):
        return np.mean([s < x for s, a in kept_out if a]) + np.mean([s >= x for s, a in kept_out if not a])

    # a bin is 1/256 wide
    assert wrong(limit) <= min(wrong(round(s * 256) / 256) for s, _ in kept_out) + 1e-9


def test_missing_kinds_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/fr/1"), (2, "http://a.org/en/1")], "page_id long, url string")
    assert {(r["page_id"], r["verdict"], r["score"]) for r in url_filter.judge(pages).collect()} == {(1, "allow", 0.0), (2, "allow", 0.0)}
    assert url_filter.judge(pages.where("false")).collect() == []


def test_grams_of_sliced_arrays():
    urls = pa.array(["abc", "", "x", "http://a.b/", "é"], pa.large_string())
    gram, start = url_filter.grams(urls.slice(1, 3))
    want = []
    for url in ["", "x", "http://a.b/"]:
        own = [0] * CONTEXT + classes(url)
        want += [sum(own[i - CONTEXT + k] * CLASSES ** (CONTEXT - k) for k in range(CONTEXT + 1)) for i in range(CONTEXT, len(own))]
    assert gram.tolist() == want and start.tolist() == [0, 1, 3]
    assert [len(x) for x in url_filter.grams(urls.slice(0, 0))] == [0, 0]


def test_kept_out_urls_of_rules_are_told_apart(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        host, path = parts(r["url"])
        rule = rule_of(host, path)
        assert (got[r["page_id"]]["host"], got[r["page_id"]]["path"], got[r["page_id"]]["rule"]) == (host, path, rule.name if rule else None)
    score, kept_out = expected([r["url"] for r in rows])
    assert np.mean([(s >= 0) == a for s, a in kept_out]) > 0.9
