"""Running numbers without one task for a whole group."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.lineage import cut


def running_sum(rows: DataFrame, group: list[str], order: list[str], amount: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``amount`` over the rows of the group up to and with each.

    Rows are sorted into ranges of (group, order); each range is summed by itself, and what the ranges
    of a group before it come to is added, so that a group can spread over any number of tasks.
    ``order`` must tell the rows of a group apart.
    """
    ranged = rows.withColumn("_amount", amount).repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged)
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = ranged.groupBy("_part", *group).agg(F.sum("_amount").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("_part", *(F.col(c).alias(f"_{c}") for c in group), F.coalesce(before, F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_its")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    summed = ranged.withColumn(name, F.sum("_amount").over(within)).join(starts.withColumnRenamed("_part", "_its"), same)
    return summed.withColumn(name, F.col(name) + F.col("_start")).drop("_amount", "_part", "_its", "_start", *(f"_{c}" for c in group))
