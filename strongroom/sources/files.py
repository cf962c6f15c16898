"""Relations of the object catalog over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_600_000_000


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored files: ordinal, file_id, name, size, created_at, modified_at, content (UTF-8 bytes), source, lang."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id").alias("ordinal"), F.md5(name).alias("file_id"), name.alias("name"), F.octet_length("text").cast("long").alias("size"),
        (F.col("doc_id") + EPOCH).alias("created_at"), (F.col("doc_id") + EPOCH + F.col("n_chars")).alias("modified_at"), F.encode("text", "utf-8").alias("content"), "source", "lang",
    )


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: key, at (microseconds), event_id, kind (``delete`` for errors, else ``put``), type, size."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "event_id",
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("kind"), F.col("event_type").alias("type"), F.floor(F.col("value") * 100).cast("long").alias("size"),
    )
