"""Streaming over the mutation log: hourly counts, and a catalog table folded micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.operators.catalog_ops import fold_log

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """Counts by hour and type; for a stream give the lateness after which an hour closes."""
    if late:
        events = events.withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.unix_micros(F.col("window.start")).alias("hour"), "type", "n")


def fold_stream(log: DataFrame, folder: str, checkpoint: str):
    """Append each micro-batch of the log to a table by batch id, so that a batch that is run again replaces itself.

    ``folded`` gives the catalog that the table amounts to.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return log.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded(spark: SparkSession, folder: str) -> DataFrame:
    return fold_log(spark.read.parquet(folder))
