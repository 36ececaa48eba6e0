"""Re-ingest of markdown files as they arrive (an addition; the batch form is ``operators.ingest``)."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ``apply(docs, batch)`` with the ``(source, text)`` of the markdown files that came since the last time.

    Of several versions of one file in a batch the last modified counts.  ``apply`` must write by
    batch number, so that a batch that is run again after a failure changes nothing.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    arrived = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[mM][dD]").load(folder)

    def take(batch: DataFrame, number: int) -> None:
        last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("modificationTime")))
        docs = batch.withColumn("nth", last).filter("nth = 1").select(F.regexp_replace("path", "^file:", "").alias("source"), F.decode("content", "UTF-8").alias("text"))
        apply(docs, number)

    return arrived.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
