"""Written tables between pipeline steps.

A step whose result is read more than once is written to the shared folder that
the cluster names in ``spark.checkpoint.dir``. The written table cuts the
lineage, survives lost executors, and lets each later reader take only the
columns it needs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="kerbline-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/kerbline/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads the written table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables this process staged; returns how many."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done
