"""Tables that cut the lineage of iterative plans, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and all tasks run in the driver's machine, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines see")
        base = FALLBACK_DIR
    return f"{base.rstrip('/')}/arborfolio/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table below spark.checkpoint.dir, read back, and its path."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
