"""Builds that can be interrupted, fail for some keys, and be taken up again.

Layout under a build's folder::

    rows/attempt=A/part=P/   results of attempt A for the keys of part P
    manifest/                one row per key and attempt: outcome, number of rows, message

An attempt writes rows into folders of its own, by dynamic partition overwrite, so a
repeated write replaces itself; then one manifest row per key, which is the
commit. Readers take rows only through the manifest. So whatever a crash
leaves behind is invisible, no result is doubled, and earlier results are not
written again.

A key fails if its rows carry an ``error``, or if building its part raises; other
keys go on. Errors in ``fatal`` (a service that is down) end the attempt, and what
was committed stays. The next attempt takes the keys without a result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.operators.stage import stage

BUILT, EMPTY, FAILED = "built", "empty", "failed"
PARTS = 256
BATCH = 32


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def _attempts(spark: SparkSession, path: str) -> list[int]:
    """Attempts that have written rows, committed or not."""
    fs, place = _fs(spark, f"{path}/rows")
    names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("attempt="))


def manifest(spark: SparkSession, path: str, on: Sequence[str]) -> DataFrame | None:
    """The latest outcome of every key that was tried: keys, attempt, part, outcome, n_rows, message; None before the first."""
    if not _exists(spark, f"{path}/manifest"):
        return None
    rows = spark.read.parquet(f"{path}/manifest")
    last = rows.groupBy(*on).agg(F.max_by(F.struct("attempt", "part", "outcome", "n_rows", "message"), "attempt").alias("__m"))
    return last.select(*on, "__m.*")


def pending(keys: DataFrame, path: str, on: Sequence[str], *, retry_empty: bool = False) -> DataFrame:
    """The keys without a result; those that gave no rows count as done unless ``retry_empty``."""
    found = manifest(keys.sparkSession, path, on)
    keys = keys.select(*on).distinct()
    if found is None:
        return keys
    done = found.where(F.col("outcome").isin(BUILT) if retry_empty else F.col("outcome") != FAILED)
    return keys.join(done.select(*on), list(on), "left_anti")


def _commit(spark: SparkSession, path: str, outcomes: DataFrame) -> None:
    outcomes.write.mode("append").parquet(f"{path}/manifest")


def _write(rows: DataFrame, path: str, on: Sequence[str], attempt: int, part: Column) -> DataFrame:
    """Write the rows of a batch into the attempt's folders and return them as read back."""
    spark = rows.sparkSession
    placed = rows.withColumn("attempt", F.lit(attempt)).withColumn("part", part)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("attempt", "part").parquet(f"{path}/rows")
    return spark.read.schema(placed.schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows").where(F.col("attempt") == attempt)


def resumable_build(
    keys: DataFrame, path: str, on: Sequence[str], build: Callable[[DataFrame], DataFrame], *,
    parts: int = PARTS, parts_per_batch: int = BATCH, retry_empty: bool = False, fatal: tuple[type[BaseException], ...] = (),
) -> DataFrame:
    """Build the pending keys and return those that failed, with a message.

    ``build`` takes keys and returns their rows, keys included, and optionally a
    column ``error``. Keys are dealt into ``parts`` by hash; a batch of parts is
    one job and one commit. A batch that raises is halved down to single parts,
    whose keys then fail together.
    """
    on = list(on)
    spark = keys.sparkSession
    part = F.pmod(F.xxhash64(*on), F.lit(parts)).cast("int")
    todo = stage(pending(keys, path, on, retry_empty=retry_empty).withColumn("part", part), "pending")
    attempt = 1 + max([0, *_attempts(spark, path)])
    known = manifest(spark, path, on)
    if known is not None:
        attempt = max(attempt, 1 + (known.agg(F.max("attempt")).first()[0] or 0))
    open_parts = [r["part"] for r in todo.select("part").distinct().orderBy("part").collect()]  # at most ``parts``

    def outcomes(batch: DataFrame, found: DataFrame | None, message: str | None) -> DataFrame:
        base = batch.select(*on, "part", F.lit(attempt).alias("attempt"))
        if found is None:
            return base.select("*", F.lit(FAILED).alias("outcome"), F.lit(0).cast("long").alias("n_rows"), F.lit(message).alias("message"))
        error = F.col("error") if "error" in found.columns else F.lit(None).cast("string")
        per = found.groupBy(*on).agg(F.count("*").alias("n_rows"), F.min(error).alias("message"))
        tried = base.join(per, on, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("long")))
        outcome = F.when(F.col("message").isNotNull(), FAILED).when(F.col("n_rows") == 0, EMPTY).otherwise(BUILT)
        return tried.select(*on, "part", "attempt", outcome.alias("outcome"), "n_rows", "message")

    def run(numbers: list[int]) -> None:
        batch = todo.where(F.col("part").isin(numbers))
        try:
            found = _write(build(batch.select(*on)), path, on, attempt, part).where(F.col("part").isin(numbers))
        except fatal:
            raise
        except Exception as broken:
            if len(numbers) > 1:
                run(numbers[: len(numbers) // 2])
                run(numbers[len(numbers) // 2 :])
            else:
                _commit(spark, path, outcomes(batch, None, f"{type(broken).__name__}: {broken}"[:500]))
            return
        _commit(spark, path, outcomes(batch, found, None))

    for k in range(0, len(open_parts), parts_per_batch):
        run(open_parts[k : k + parts_per_batch])
    tried = manifest(spark, path, on)
    if tried is None:
        return keys.select(*on).limit(0).withColumn("message", F.lit(None).cast("string"))
    return keys.select(*on).distinct().join(tried.where(F.col("outcome") == FAILED).select(*on, "message"), on)


def built_rows(spark: SparkSession, path: str, on: Sequence[str]) -> DataFrame:
    """The committed rows of a build: those that the manifest names."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    done = manifest(spark, path, on).where(F.col("outcome") == BUILT).select(*on, "attempt", "part")
    return rows.drop("error").join(done, [*on, "attempt", "part"], "left_semi").drop("attempt", "part")


def drop_uncommitted(spark: SparkSession, path: str) -> int:
    """Delete the folders of attempts that no manifest row names; returns how many."""
    named = set()
    if _exists(spark, f"{path}/manifest"):
        named = {r["attempt"] for r in spark.read.parquet(f"{path}/manifest").select("attempt").distinct().collect()}
    left = [a for a in _attempts(spark, path) if a not in named]
    for attempt in left:
        fs, place = _fs(spark, f"{path}/rows/attempt={attempt}")
        fs.delete(place, True)
    return len(left)
