"""Quality rules as a ledger: every rule is evaluated once and leaves one failure bit.

The ledger keeps the measurements and a bit for each failed rule. A policy is a
version name and a set of rules; applying it, or asking what would change
without one of its rules, only combines bits and reads no text again.

Columns only: no Python runs on the rows. Three-word windows are compared by 64-bit hashes,
so two different windows of one text are taken for equal once in about 10^12
texts of a thousand words.

Defined cases: a null or empty text has no words and fails ``few_words``; a null
doc_id stays null; a repeated row is judged again; an empty table gives no rows;
other columns are ignored by ``ledger`` and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_upper", "n_digits", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules in the order of their bits; a rule is true where a text fails it.
RULES: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "few_words": lambda m: m("n_words") < 50,
    "repeated_words": lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"),
    "symbols": lambda m: 5 * m("n_symbols") > m("n_words"),
    "repeated_lines": lambda m: (m("n_lines") >= 5) & (10 * m("n_dup_lines") > 3 * m("n_lines")),
    "short_words": lambda m: m("word_chars") < 2 * m("n_words"),
    "long_words": lambda m: m("word_chars") > 15 * m("n_words"),
    "upper_case": lambda m: 2 * m("n_upper") > m("word_chars"),
    "digits": lambda m: 10 * m("n_digits") > 3 * m("word_chars"),
}
BASE = ("few_words", "repeated_words")

#: Versions of the policy: which rules reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "upper_case"),
    "v2": tuple(RULES),
}


def bits(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in rules)


def _count(text: Column, others: str) -> Column:
    """Characters that are not of the given class."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def _repeat_words(grams: Column) -> Column:
    """Words within windows that occur again; ``grams`` has a hash for each window."""
    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def covered(rows: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(rows, i)["g"] == F.get(rows, j)["g"], F.lit(False))
        again = F.filter(F.transform(rows, lambda r, k: F.when(same(k, k - 1) | same(k, k + 1), r["i"])), lambda i: i.isNotNull())
        # windows cover three words, fewer where the next one begins earlier
        steps = F.transform(F.array(F.sort_array(again)), lambda a: F.aggregate(F.transform(a, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(a, k + 1) - i, F.lit(3)))), F.lit(0), lambda x, y: x + y))
        return F.get(steps, F.lit(0))

    whole = F.get(F.transform(F.array(ordered), covered), F.lit(0))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), whole).otherwise(0)


def measures(text: Column) -> Column:
    """Struct of all measurements; each intermediate array is bound once by a lambda over one element."""
    text = F.coalesce(text, F.lit(""))
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    hashes = lambda parts: F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\x0b\x0c\r")) != "")
    words = lambda h: F.struct(F.size(h).alias("n"), once(windows(h), _repeat_words).alias("again"))
    # a text has one part more than white space characters
    of_words = once(F.split(text, SPACE), lambda parts: F.struct(F.size(parts).alias("parts"), once(hashes(parts), words).alias("of")))
    of_lines = once(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    found = F.struct(of_words.alias("w"), of_lines.alias("l"))
    return once(
        found,
        lambda f: F.struct(
            f["w"]["of"]["n"].cast("long").alias("n_words"), (F.length(text) - f["w"]["parts"] + 1).cast("long").alias("word_chars"), _count(text, f"[^{SYMBOLS}]+").alias("n_symbols"),
            _count(text, "[^A-Z]+").alias("n_upper"), _count(text, "[^0-9]+").alias("n_digits"),
            f["l"]["n"].cast("long").alias("n_lines"), f["l"]["again"].cast("long").alias("n_dup_lines"), f["w"]["of"]["again"].cast("long").alias("n_repeat_words"),
        ),
    )


def _failures(measured: Column) -> Column:
    """Bitmask of the rules that the measurements fail."""
    out = F.lit(0).cast("long")
    for bit, rule in enumerate(RULES.values()):
        out = out.bitwiseOR(F.when(rule(lambda name: measured[name]), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _judged(docs: DataFrame) -> DataFrame:
    """``row`` with the given columns, ``m`` with measurements, ``failed`` with bits."""
    rows = docs.select(F.struct("*").alias("row"))
    # inline() is a barrier: a filter on the bits must not copy the measurements into itself
    measured = rows.select("row", F.inline(F.array(F.struct(measures(F.col("row")["text"].cast("string")).alias("m")))))
    return measured.select("row", "m", _failures(F.col("m")).alias("failed"))


def passes(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(bits(POLICIES[policy])).cast("long")) == 0


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, all measurements and the failure bits of each document."""
    return _judged(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), *[F.col("m")[name].alias(name) for name in MEASURES], "failed")


def keep(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The documents that pass the policy, with their own columns."""
    return _judged(docs).where(passes(F.col("failed"), policy)).select("row.*")


def ablation(judged: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that stay without it.

    The ledger is first reduced to one row per set of bits, so the rest does not
    depend on the number of documents. Each rule has a row, also for an empty ledger.
    """
    mask = bits(POLICIES[policy])
    sets = judged.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("failed")).agg(F.count("*").alias("n"))
    rules = judged.sparkSession.createDataFrame([(rule, bits([rule])) for rule in POLICIES[policy]], "rule string, bit long")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    one = [
        sets.agg(
            F.lit(r["rule"]).alias("rule"), count(F.col("failed").bitwiseAND(F.lit(r["bit"])) != 0).alias("n_failed"),
            count(F.col("failed") == r["bit"]).alias("n_alone"), count(F.col("failed").bitwiseAND(F.lit(mask & ~r["bit"])) == 0).alias("n_kept_without"),
        )
        for r in rules.collect()
    ]
    out = one[0]
    for more in one[1:]:
        out = out.union(more)
    return out


def verdicts(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with what the base rules and the policy decide."""
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(F.col("failed"), "base")).alias("base_failed"), (passes(F.col("failed"), "base") & passes(F.col("failed"), policy)).alias("kept"), "failed",
    )


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
p AS (
  SELECT rid, doc_id, t, translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS bare,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') <> '') AS ls
  FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM p) x),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM g) x WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) o GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(bare) AS BIGINT) AS word_chars,
    CAST(length(bare) - length(translate(bare, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    length(bare) - length(translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper,
    length(bare) - length(translate(bare, '0123456789', '')) AS n_digits,
    len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM p LEFT JOIN covered USING (rid)),
b AS (
  SELECT *,
    CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END + CASE WHEN 10 * n_digits > 3 * word_chars THEN 128 ELSE 0 END AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed FROM b
"""
