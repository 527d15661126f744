"""Tables written between steps, in the folder that driver and executors share: they cut lineage, are computed once, survive lost executors, and tell the planner their size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a new folder in local mode, an error on a cluster."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: steps need a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-steps-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own; its attribute path says where."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.path = path
    return out


def remove(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
