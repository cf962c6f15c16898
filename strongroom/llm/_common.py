"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; an input of fewer splits than there are cores is dealt out to all of them."""
    docs, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; only a local master without one gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(shared)


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage is cut, and a lost executor only rereads shared files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def whole_text(column: str | Column = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds ``rank``, from 0 in this order: a distributed sort, then a count for each partition, which is all that reaches the driver."""
    id_name = fresh_name(rows, "id")
    ordered = checkpoint(rows.orderBy(*order).withColumn(id_name, F.monotonically_increasing_id()))
    partition = F.shiftright(id_name, 33)
    counts = {r["p"]: r["n"] for r in ordered.groupBy(partition.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, so_far = [], 0
    for p in sorted(counts):
        before += [F.lit(p), F.lit(so_far)]
        so_far += counts[p]
    if not before:
        return ordered.withColumn("rank", F.lit(0).cast("long")).drop(id_name)
    offset = F.element_at(F.create_map(*before), partition.cast("int"))
    return ordered.withColumn("rank", (offset + F.col(id_name).bitwiseAND((1 << 33) - 1)).cast("long")).drop(id_name)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
