"""Continuous import: export rows land in a folder, new events reach the timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from keepsake.plans.tables import import_events
from keepsake.session import configure


def landed(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 1000
           ) -> DataFrame:
    """Event rows as they arrive. ``files_per_batch`` bounds the size of one merge."""
    configure(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def import_continuously(incoming: DataFrame, timeline: str, checkpoint: str,
                        available_now: bool = False) -> StreamingQuery:
    """Append the events of each batch that are not stored yet; of the stored keys only the batch's buckets are read.

    The key holds no processing time, so late rows need no rule, and a batch that runs again after a
    failure finds its rows stored and adds nothing.
    """
    def merge(batch: DataFrame, _: int) -> None:
        import_events(batch.sparkSession, timeline, batch)

    writer = incoming.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now
            else writer.trigger(processingTime="1 minute")).start()
