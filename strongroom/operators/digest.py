"""One digest for a table, whatever its order: a tree over the hashes of its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a row's hash that make a group, level by level: 16 million groups of rows, then at most 4,096 of them a group.
DIGITS = (6, 3)


def table_digest(macs: DataFrame, mac: str, keys: list[str] | None = None) -> DataFrame:
    """``keys, rows, digest``: how many rows there are, and a SHA-256 over the hex hashes in column mac as a multiset.

    A hash that repeats counts once, with its number.  Without keys an empty table gives one row.
    """
    keys = keys or []
    each = macs.groupBy(*keys, mac).agg(F.count(F.lit(1)).alias("__n")).withColumn("__h", F.concat_ws(":", mac, F.col("__n").cast("string"))).select(*keys, "__n", "__h", F.col(mac).alias("__p"))
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("__h")), ","), 256)
    for digits in DIGITS:
        groups = each.groupBy(*keys, F.substring("__p", 1, digits).alias("__p")).agg(F.sum("__n").alias("__n"), joined.alias("__s"))
        each = groups.select(*keys, "__n", F.concat_ws(":", "__p", "__s").alias("__h"), "__p")
    return each.groupBy(*keys).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"), joined.alias("digest"))


def row_mac(hmac: Callable[[Column], Column], *values: Column) -> Column:
    """The keyed hash of a row's values, each with its length before it, so that no two rows read alike."""
    parts = []
    for v in values:
        text = F.coalesce(v.cast("string"), F.lit(""))
        parts += [F.when(v.isNull(), F.lit("-")).otherwise(F.octet_length(text).cast("string")), F.lit(":"), text]
    return F.lower(F.hex(hmac(F.encode(F.concat(*parts), "utf-8"))))
