"""Document fingerprints by winnowing, in columns only.

The grams of a text are its runs of five words, or all its words where there are
fewer. Of every window of eight neighbouring grams the one with the smallest
hash is kept, the rightmost of equal ones, with its position. So any two texts that
share twelve words in a row share a fingerprint, and none is kept for runs
shorter than five.

A kept gram is one number: 40 bits of the hash above 24 bits that fall as the
position grows, so that the smaller number is the smaller hash and then the one further right.
Positions of texts beyond 2^24 words are known modulo 2^24.

Defined cases: null and empty texts have no grams and are alike with likeness 1
to each other and 0 to all others; a null doc_id stays null and comes first in
order; repeated doc_ids follow each other in the order of a hash of their text;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
WINDOW = 8
_POSITION = (1 << 24) - 1
_ROWS = 1000  # of a slice, about
_RANGES = 200
_BROADCAST_ROWS = 1_000_000


def _once(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _grams(text: Column, words: int) -> Column:
    """Hash of each run of words."""
    hashes = F.transform(F.filter(F.split(text, r"[\x20\x09-\x0D]"), lambda w: w != ""), lambda w: F.xxhash64(w))
    runs = lambda h: F.transform(F.slice(h, 1, F.size(h) - words + 1), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, words)]))
    return _once(hashes, lambda h: F.when(F.size(h) >= words, runs(h)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))


def kept(text: Column, words: int = WORDS, window: int = WINDOW) -> Column:
    """The kept grams of a text in order, each as hash and falling position in one number."""
    place = lambda g, i: g.bitwiseAND(F.lit(~_POSITION)).bitwiseOR(F.lit(_POSITION).cast("long") - i.cast("long").bitwiseAND(F.lit(_POSITION)))
    marked = _once(_grams(F.coalesce(text, F.lit("")), words), lambda g: F.transform(g, place))
    starts = lambda m: F.slice(m, 1, F.greatest(F.size(m) - window + 1, F.least(F.size(m), F.lit(1))))
    least = lambda m: F.transform(starts(m), lambda _, i: F.array_min(F.slice(m, i + 1, window)))
    return F.array_distinct(_once(marked, least))


def hashes(kept_: Column) -> Column:
    """The hashes of kept grams, each once."""
    return F.array_distinct(F.transform(kept_, lambda k: F.shiftright(k, 24)))


def positions(kept_: Column) -> Column:
    """The word at which each kept gram begins, from 0."""
    return F.transform(kept_, lambda k: F.lit(_POSITION) - k.bitwiseAND(F.lit(_POSITION)))


def digest(kept_: Column) -> Column:
    """Text that stands for all kept grams with their positions."""
    return F.sha2(F.array_join(kept_.cast("array<string>"), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of either that both have; 1 for two without any."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, 1.0).otherwise(both / total)


def fingerprints(docs: DataFrame, words: int = WORDS, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes and positions of the kept grams of each document."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), kept(F.col("text").cast("string"), words, window).alias("kept"))
    return found.select("doc_id", F.transform("kept", lambda k: F.shiftright(k, 24)).alias("hashes"), positions(F.col("kept")).alias("positions"))


def _slice(key: Column, bounds: list[int], parts: int) -> Column:
    """Number of a slice that does not fall as the key grows: quantile range, then an equal part of the range."""
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    at = F.size(F.filter(array, lambda b: b <= key))
    low, high = F.get(array, at - 1), F.get(array, at)
    share = (key.cast("double") - low.cast("double")) / (high.cast("double") - low.cast("double"))
    part = F.least(F.floor(share * parts), F.lit(parts - 1).cast("long"))
    return at.cast("long") * parts + F.coalesce(part, F.lit(0).cast("long"))


def with_next(docs: DataFrame, derive) -> DataFrame:
    """doc_id, text, own and the next document's text and own, by ascending doc_id; the last one's next is the first.

    ``derive`` makes the column own from a text. Rows are dealt by slices of
    neighbouring ids, each with a copy of the next slice's first document.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    fractions = [i / _RANGES for i in range(_RANGES + 1)]
    seen = rows.agg(F.count("*").alias("n"), F.percentile_approx("key", fractions, 10000).alias("bounds")).first()
    slice_ = _slice(F.col("key"), sorted(set(seen["bounds"] or [])), max(1, seen["n"] // (_RANGES * _ROWS) + 1)) if seen["n"] else F.lit(0).cast("long")
    sliced = rows.withColumn("slice", slice_)
    heads = sliced.groupBy("slice").agg(F.min("key").alias("head"))  # narrow: one row for about a thousand documents
    order = Window.orderBy("slice")
    first = F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("slice").alias("to"), F.coalesce(F.lead("head").over(order), first).alias("head"))
    if seen["n"] // _ROWS <= _BROADCAST_ROWS:
        heads = F.broadcast(heads)
    copies = rows.join(heads, F.col("key") == F.col("head")).select("doc_id", "text", "key", F.col("to").alias("slice"), F.lit(1).alias("copy"))
    dealt = sliced.select("doc_id", "text", "key", "slice", F.lit(0).alias("copy")).union(copies).repartition("slice")
    dealt = dealt.withColumn("own", derive(F.col("text")))
    following = Window.partitionBy("slice").orderBy("copy", "key", F.xxhash64("text"))
    led = dealt.select("doc_id", "text", "own", "copy", F.lead("text").over(following).alias("next_text"), F.lead("own").over(following).alias("next_own"))
    return led.where("copy = 0").drop("copy")


def edits(docs: DataFrame) -> DataFrame:
    """Each document beside an edited text, whose last half is the beginning of the next document."""
    pairs = with_next(docs, kept)
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), size - half), F.substr("next_text", F.lit(1), half))
    made = pairs.select("doc_id", size.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", kept(F.col("edited")).alias("edited_own"), "next_own")
    sets = made.select("*", hashes(F.col("own")).alias("a"), hashes(F.col("edited_own")).alias("b"), hashes(F.col("next_own")).alias("c"))
    return sets.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("own")).alias("fingerprint"), digest(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"), F.size("own").cast("long").alias("n_kept"),
    )
