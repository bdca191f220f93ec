"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; under a temporary folder where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.loomgraph.local.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.loomgraph.local.dir", base)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``shared_folder`` named."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str = "graph", named: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table there: cuts lineage and survives lost executors. Its path joins ``named``."""
    path = shared_folder(df.sparkSession, label)
    if named is not None:
        named.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
