"""Tables are broadcast by their measured size, not by that of the files they come from."""

from pyspark.sql import functions as F

from kerbline.operators.stage import stage
from kerbline.plans.workspace import measured_broadcasts

NAMES = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def _joins(df, part):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_rows_of_an_explode_count_for_a_broadcast(spark):
    before = {n: spark.conf.get(n, None) for n in NAMES}
    try:
        for n in NAMES:
            spark.conf.unset(n)
        measured_broadcasts(spark)
        measured_broadcasts(spark)  # a second call keeps the threshold
        few = stage(spark.range(300).select(F.col("id").alias("k"), F.lit("x" * 100).alias("s")), "few")
        many = few.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(400))))  # some kB in files, 15 MB as rows
        facts = stage(spark.range(600).select((F.col("id") % 600).alias("k")), "facts")
        large = facts.join(many, "k").agg(F.count("s"), F.sum("j"))
        assert "BroadcastHashJoin" not in _joins(large, "sparkPlan")
        assert large.collect()[0][:] == (300 * 400, 300 * 400 * 401 // 2)
        small = facts.join(few, "k").groupBy("s").count()
        assert small.collect()[0]["count"] == 300
        assert "BroadcastHashJoin" in _joins(small, "executedPlan")
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
