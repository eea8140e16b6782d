"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the checkpoint folder of the context. Only a plain local session, as in
    tests, gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"/tmp/spark-tidemark-{uuid.uuid4().hex}")
        base = spark.sparkContext.getCheckpointDir()
    return base


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors, and
    gives the optimizer true sizes."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tidemark_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `cut` wrote and nothing reads any more; all that was made from them must have
    been written itself."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._tidemark_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
