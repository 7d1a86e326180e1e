"""Sessions with the settings that the operators count on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "millrace", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings come on top, dots written as __."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoints(spark: SparkSession) -> None:
    """Gives the session the shared folder of spark.checkpoint.dir; only a session on one machine
    (local) that has no such setting gets a temporary one. Files that nothing refers to any more
    are removed."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the checkpoint folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many parts at least as there are cores: a small file of one part would be
    worked by one task. Tables with parts enough stay as they are, without a shuffle."""
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":  # it has shuffles of its own
        return df
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


#: Rows of a part that `dealt` aims at.
PART_ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys, in as many parts as they need: by bytes, short rows that are much alike
    would come to parts of many millions, which a task sorts in memory."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))
    return df.repartition(parts, *keys)


def scratch(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, for tables that go when the application ends."""
    checkpoints(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file written by the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
