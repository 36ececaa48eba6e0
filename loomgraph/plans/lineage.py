"""Cutting lineage on storage that every executor can read.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Only where that is unset (a
single machine, as in tests) does the library choose a temporary folder of its own.
"""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; later steps read it back."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
