"""Session settings shared by tests, the benchmark and stand-alone use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, **extra: str) -> SparkSession:
    """A UTC session for one machine; a cluster brings its own master and sizes."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("tidemark")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share, under the session's checkpoint folder; a temporary one on a single machine without that."""
    context = spark.sparkContext
    shared = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that all machines of the cluster share.")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in a shared folder: computed once, read by column from now on.

    The table goes when the driver ends.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
