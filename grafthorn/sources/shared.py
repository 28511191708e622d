"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, a temporary folder on one machine and an error on a cluster."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="grafthorn-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/grafthorn-core-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows as a table in the shared folder, bucketed by ``keys``: a join or grouping by them doesn't shuffle it again."""
    spark = df.sparkSession
    name = f"grafthorn_{uuid.uuid4().hex}"
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("path", shared_dir(spark)).bucketBy(number, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)
