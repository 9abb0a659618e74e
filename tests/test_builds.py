"""Resumable builds, chunked recordings, line decoding and archive hours."""

import math

import pytest
from pyspark.sql import functions as F

from kerbline.operators import roads
from kerbline.plans import derived
from kerbline.sources import builds, readers, sinks
from kerbline.streaming import live

ON = ["k"]


def rows_of(todo, times=2):
    return todo.withColumn("v", F.explode(F.sequence(F.lit(1), F.lit(times))))


def keys_of(spark, n):
    return spark.createDataFrame([(i,) for i in range(n)], "k long")


def outcomes(spark, path):
    return {r["k"]: (r["outcome"], r["n_rows"]) for r in builds.manifest(spark, path, ON).collect()}


def test_failed_keys_are_tried_again_and_others_are_not(spark, tmp_path):
    path, seen = str(tmp_path / "b"), []

    def build(todo, bad):
        seen.append(sorted(r["k"] for r in todo.collect()))
        return rows_of(todo).where("k % 7 <> 3").withColumn("error", F.when(F.col("k").isin(bad), F.concat(F.lit("no "), "k")))

    failed = builds.resumable_build(keys_of(spark, 40), path, ON, lambda t: build(t, [5, 6]), parts=4, parts_per_batch=2)
    assert sorted((r["k"], r["message"]) for r in failed.collect()) == [(5, "no 5"), (6, "no 6")]
    assert outcomes(spark, path)[3] == (builds.EMPTY, 0) and outcomes(spark, path)[4] == (builds.BUILT, 2)
    seen.clear()
    assert builds.resumable_build(keys_of(spark, 41), path, ON, lambda t: build(t, []), parts=4, parts_per_batch=4).collect() == []
    assert [k for s in seen for k in s] == [5, 6, 40]  # one batch holds all that is pending
    got = sorted((r["k"], r["v"]) for r in builds.built_rows(spark, path, ON).collect())
    assert got == [(k, v) for k in range(41) if k % 7 != 3 for v in (1, 2)]
    seen.clear()
    builds.resumable_build(keys_of(spark, 41), path, ON, lambda t: build(t, []), parts=4)
    assert seen == []
    builds.resumable_build(keys_of(spark, 41), path, ON, lambda t: build(t, []), parts=4, parts_per_batch=4, retry_empty=True)
    assert [k for s in seen for k in s] == [3, 10, 17, 24, 31, 38]


def test_a_part_that_raises_fails_alone(spark, tmp_path):
    path = str(tmp_path / "b")

    def build(todo):
        return rows_of(todo).withColumn("v", F.when(F.col("k") == 11, F.raise_error(F.lit("broken"))).otherwise(F.col("v")))

    failed = {r["k"] for r in builds.resumable_build(keys_of(spark, 60), path, ON, build, parts=16, parts_per_batch=16).collect()}
    part = {r["k"]: r["part"] for r in builds.manifest(spark, path, ON).collect()}
    assert failed == {k for k in range(60) if part[k] == part[11]}
    assert {r["k"] for r in builds.built_rows(spark, path, ON).collect()} == set(range(60)) - failed


def test_a_crash_before_the_commit_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    commit, calls = builds._commit, []

    def crash(*args):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        commit(*args)

    monkeypatch.setattr(builds, "_commit", crash)
    with pytest.raises(KeyboardInterrupt):
        builds.resumable_build(keys_of(spark, 30), path, ON, rows_of, parts=4, parts_per_batch=2)
    done = {k for k, (outcome, _) in outcomes(spark, path).items() if outcome == builds.BUILT}
    assert 0 < len(done) < 30
    assert {r["k"] for r in builds.built_rows(spark, path, ON).collect()} == done
    builds.resumable_build(keys_of(spark, 30), path, ON, rows_of, parts=4, parts_per_batch=2)
    assert sorted((r["k"], r["v"]) for r in builds.built_rows(spark, path, ON).collect()) == [(k, v) for k in range(30) for v in (1, 2)]


def test_a_crash_of_the_first_attempt_is_swept(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "b")
    monkeypatch.setattr(builds, "_commit", lambda *args: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        builds.resumable_build(keys_of(spark, 5), path, ON, rows_of)
    monkeypatch.undo()
    assert builds.drop_uncommitted(spark, path) == 1 and builds.drop_uncommitted(spark, path) == 0
    builds.resumable_build(keys_of(spark, 5), path, ON, rows_of)
    assert builds.built_rows(spark, path, ON).count() == 10


def test_fatal_errors_end_the_attempt(spark, tmp_path):
    class Down(Exception):
        pass

    def build(todo):
        raise Down

    path = str(tmp_path / "b")
    with pytest.raises(Down):
        builds.resumable_build(keys_of(spark, 5), path, ON, build, fatal=(Down,))
    assert builds.manifest(spark, path, ON) is None
    assert builds.resumable_build(keys_of(spark, 0), path, ON, build, fatal=(Down,)).collect() == []


def reading(trip, chunk, line, second, ax):
    return (trip, chunk, line, f"2024-01-02 08:00:{second:09.6f}", ax)


def chunks(spark, rows):
    given = spark.createDataFrame(rows, "trip_id string, chunk int, line long, at string, ax double")
    return given.select("trip_id", "chunk", "line", F.to_timestamp("at").alias("ts"), "ax", *[F.lit(None).cast("double").alias(c) for c in ("ay", "az", "gx", "gy", "gz")])


def test_chunks_are_stitched_in_file_order(spark, tmp_path):
    rows = [reading("T 1", 1, 0, 5.0, 1.0), reading("T 1", 1, 1, 6.0, 2.0), reading("T 1", 1, 2, 4.0, 3.0), reading("T 1", 2, 0, 6.0, 99.0), reading("T 1", 2, 1, 6.5, 4.0), reading("T/2+%", 1, 0, 1.0, 7.0)]
    path = str(tmp_path / "m")
    sinks.write_motion_chunks(chunks(spark, rows), path)
    got = readers.scan_motion(spark, path).orderBy("trip_id", "t").collect()
    # seconds count from the first line, a later line may be earlier; of equal times the first line stays
    assert [(r["trip_id"], r["i"], r["t"], r["ax"]) for r in got] == [("T 1", 0, -1.0, 3.0), ("T 1", 1, 0.0, 1.0), ("T 1", 2, 1.0, 2.0), ("T 1", 3, 1.5, 4.0), ("T/2+%", 0, 0.0, 7.0)]
    first = (tmp_path / "m" / "trip_id=T 1" / "chunk=000001").glob("part-*")
    assert next(first).read_text().splitlines()[0] == ",".join(("timestamp", "ax", "ay", "az", "gx", "gy", "gz", "interval_ms", "agx", "agy", "agz"))


def test_a_stream_of_chunks_goes_on_where_it_stopped(spark, tmp_path):
    path, target, checkpoint = (str(tmp_path / n) for n in "abc")
    rows = [reading("T", 1 + i // 10, i, i / 2, float(i)) for i in range(60)]
    counts = []
    for part in ((1, 2), (3, 4, 5), (), (6,)):
        if part:
            sinks.write_motion_chunks(chunks(spark, rows).where(F.col("chunk").isin(*part)), path, mode="append")
        live.store_motion(spark, path, target, checkpoint, files_per_trigger=1).awaitTermination()
        counts.append(spark.read.parquet(target).count())
    assert counts == [20, 50, 50, 60]
    want = [(r["i"], r["t"], r["ax"]) for r in readers.scan_motion(spark, path).orderBy("i").collect()]
    assert [(r["i"], r["t"], r["ax"]) for r in live.stored_motion(spark, target).orderBy("i").collect()] == want and len(want) == 60


def plain_encoding(points):
    out, before = "", (0, 0)
    for point in points:
        whole = tuple(math.floor(abs(x) * 1e6 + 0.5) * (1 if x >= 0 else -1) for x in point)
        for a, b in zip(whole, before):
            number = 2 * (a - b) if a >= b else -2 * (a - b) - 1
            while number >= 32:
                out, number = out + chr(number % 32 + 32 + 63), number // 32
            out += chr(number + 63)
        before = whole
    return out


def test_lines_are_decoded_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(roads, "LINE_BYTES", 50)
    lines = {"a": [(42.0 + (-1) ** i * i / 7, -87.0 - i / 3) for i in range(500)], "b": [(0.0, 0.0)], "c": [], "d": [(-90.0, 180.0), (90.0, -180.0)]}
    given = spark.createDataFrame([*[(k, plain_encoding(v)) for k, v in lines.items()], ("e", None)], "shape_id string, shape string")
    got = roads.matched_vertices(given.repartition(3)).orderBy("shape_id", "idx").collect()
    want = [(k, i, round(p[0], 6), round(p[1], 6)) for k, v in lines.items() for i, p in enumerate(v)]
    assert [(r["shape_id"], r["idx"], round(r["lat"], 6), round(r["lon"], 6)) for r in got] == want
    nested = spark.createDataFrame([(k, v) for k, v in lines.items()], "shape_id string, points array<struct<lat:double,lon:double>>")
    spelled = {r["shape_id"]: r["s"] for r in nested.select("shape_id", derived.encoded_line(F.col("points")).alias("s")).collect()}
    assert spelled == {k: plain_encoding(v) for k, v in lines.items()}


def test_recent_hours_read_only_their_folders(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.range(200).select(
        F.lit("cta").alias("agency"), F.col("id").cast("string").alias("entity_id"), F.lit("B").alias("vehicle_id"), F.lit("22").alias("route_id"), F.lit("T").alias("trip_id"), F.current_timestamp().alias("timestamp"),
        F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(1.0).alias("bearing"), F.lit(2023).alias("year"), F.lit(12).alias("month"), F.when(F.col("id") < 100, 9).otherwise(31).alias("day"), (F.col("id") % 20).cast("int").alias("hour"),
    )
    rows.write.partitionBy("agency", "year", "month", "day", "hour").parquet(path)
    assert [(r["day"], r["hour"]) for r in readers.archive_hours(spark, path, "cta").collect()] == [(d, h) for d in (9, 31) for h in range(20)]
    recent = readers.scan_recent_hours(spark, path, 2)
    assert {(r["day"], r["hour"]) for r in recent.collect()} == {(31, 18), (31, 19)} and recent.count() == 10
    plan = recent._jdf.queryExecution().executedPlan()
    filters = plan.toString().split("PartitionFilters: [")[1]
    assert all(c in filters.split("PushedFilters")[0] for c in ("year", "month", "day"))
    plan.execute().count()
    assert plan.collectLeaves().apply(0).metrics().apply("numPartitions").value() == 2
    assert readers.archive_hours(spark, str(tmp_path / "none")).collect() == []
