"""Session settings that results depend on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def settle(spark: SparkSession) -> SparkSession:
    """Turns off the planner's reuse of a union's inputs' partitioning.

    With it (Spark 4.1.2) a union of two inputs that a window has partitioned by one key reports their partitioning while it
    has twice their partitions, and a join after it fails to zip them or pairs the wrong ones, which loses and doubles rows.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder of spark.checkpoint.dir; what is written there goes when the driver's JVM ends.

    Without that setting a local session uses a folder of its own; a cluster must name one.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/lodestrata-scratch"
    path = f"{root.rstrip('/')}/lodestrata/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a path of its own in the shared folder and read again, for a result that a plan uses many times."""
    spark = settle(df.sparkSession)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
