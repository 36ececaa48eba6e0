"""Reading the input tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``, with only ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def of_graph(spark: SparkSession, sf_dir: str, name: str, graph: str, *columns: str) -> DataFrame:
    """The rows of one graph; the condition reaches the scan, and where a table is partitioned by graph only its folder is read.

    A graph that isn't there has no rows; an empty name is an error.
    """
    if not graph:
        raise ValueError("graph must not be empty")
    rows = table(spark, sf_dir, name).filter(F.col("graph") == graph)
    return rows.select(*columns) if columns else rows
