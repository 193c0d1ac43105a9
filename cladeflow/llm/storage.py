"""Materialised intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session, as in tests, may do without a setting: there the
    driver's temporary folder is seen by all tasks. On a cluster it would not be, so that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="cladeflow-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(table: DataFrame) -> DataFrame:
    """The table written as Parquet to the shared folder and read from there.

    A lost executor loses none of it, later plans know its size, and columns are read as needed. The table stays
    until ``drop_table`` or, as results may refer to it, until the folder is deleted.
    """
    spark = table.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    table.write.parquet(path)
    made = spark.read.schema(table.schema).parquet(path)
    made._cut_path = path
    return made


def drop_table(table: DataFrame) -> None:
    """Delete a table made by ``cut_lineage`` that no later plan reads."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table._cut_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
