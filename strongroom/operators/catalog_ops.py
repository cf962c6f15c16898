"""Catalog operators: lookups, upserts, deletes, renames, versions and slots as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(files: DataFrame, key: str = "name") -> DataFrame:
    """Of files with equal names the one with the least ordinal."""
    rest = [c for c in files.columns if c != key]
    return files.groupBy(key).agg(F.min_by(F.struct(*rest), "ordinal").alias("f")).select(key, "f.*")


def lookup(wanted: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """The first match of each wanted key (a token column, so the scan can prune)."""
    return wanted.join(first_match(files, key), key)


def dedupe_batch(batch: DataFrame) -> DataFrame:
    """``name, pos, size, micros`` of batch(name, pos, size, micros): the last source of a name wins, at the place of the first."""
    return batch.groupBy("name").agg(F.min("pos").alias("pos"), F.max_by("size", "pos").alias("size"), F.max_by("micros", "pos").alias("micros"))


def upsert(files: DataFrame, batch: DataFrame, last_ordinal: Column | int) -> DataFrame:
    """files(name, ordinal, size, created_at, modified_at) after a batch: a known name keeps its ordinal and created_at.

    Only a name's first match is overwritten; a new name's ordinal is its place in the batch after the last one.
    """
    new = dedupe_batch(batch).select("name", F.col("pos").alias("b_pos"), F.col("size").alias("b_size"), F.col("micros").alias("b_at"))
    firsts = files.groupBy("name").agg(F.min("ordinal").alias("first"))
    both = firsts.join(new, "name", "full_outer")
    kept = files.join(both, "name", "left")
    hit = (F.col("ordinal") == F.col("first")) & F.col("b_pos").isNotNull()
    kept = kept.select("name", "ordinal", F.when(hit, F.col("b_size")).otherwise(F.col("size")).alias("size"), "created_at", F.when(hit, F.col("b_at")).otherwise(F.col("modified_at")).alias("modified_at"))
    base = F.lit(last_ordinal) if isinstance(last_ordinal, int) else last_ordinal
    added = both.where("first is null").select("name", (base + F.col("b_pos")).alias("ordinal"), F.col("b_size").alias("size"), F.col("b_at").alias("created_at"), F.col("b_at").alias("modified_at"))
    return kept.unionByName(added)


def delete(files: DataFrame, names: DataFrame) -> DataFrame:
    """Without all rows of the names."""
    return files.join(names, "name", "left_anti")


def rename(files: DataFrame, renames: DataFrame) -> DataFrame:
    """renames(name, new_name, micros): a name's first match gets the new name and modified_at; the rest stays."""
    firsts = files.groupBy("name").agg(F.min("ordinal").alias("first")).join(renames, "name")
    joined = files.join(firsts, "name", "left")
    hit = F.col("ordinal") == F.col("first")
    changed = {"name": F.when(hit, F.col("new_name")).otherwise(F.col("name")), "modified_at": F.when(hit, F.col("micros")).otherwise(F.col("modified_at"))}
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in files.columns))


def append(files: DataFrame, more: DataFrame) -> DataFrame:
    """Both, names that are there twice included."""
    return files.unionByName(more)


def fold_log(log: DataFrame) -> DataFrame:
    """``key, created, modified, writes, size`` since the last delete of each key; keys without a write since are gone."""
    place = F.struct("micros", "event_id")
    last = log.where("kind = 'delete'").groupBy("key").agg(F.max(place).alias("gone"))
    puts = log.where("kind = 'put'").join(last, "key", "left").where(F.col("gone").isNull() | (place > F.col("gone")))
    return puts.groupBy("key").agg(F.min("micros").alias("created"), F.max("micros").alias("modified"), F.count(F.lit(1)).alias("writes"), F.max_by("size", place).alias("size"))


def with_version(files: DataFrame, versions: DataFrame, default: Column) -> DataFrame:
    """versions(file_id, version) joined on; a file without one has the default."""
    return files.join(versions, "file_id", "left").withColumn("version", F.coalesce("version", default))


def active_slot(slots: DataFrame, keys: list[str]) -> DataFrame:
    """slots(slot, data_offset, valid): of the valid ones the greatest data_offset, the lower slot at a tie."""
    return slots.where("valid").groupBy(*keys).agg(F.max_by(F.struct("slot", "data_offset"), F.struct("data_offset", -F.col("slot"))).alias("s")).select(*keys, "s.*")


def unwrap_candidate(slots: DataFrame, keys: list[str]) -> DataFrame:
    """The first usable slot, else the first that has the magic."""
    usable, magic = F.min_by("slot", F.when(F.col("usable"), F.col("place"))), F.min_by("slot", F.when(F.col("has_magic"), F.col("place")))
    return slots.groupBy(*keys).agg(F.coalesce(usable, magic).alias("slot"))
