"""Layout arithmetic as column expressions: chunk counts, sealed lengths, offsets, metadata size, garbage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strongroom.model import CHUNK, HEADER, OVERHEAD, SLOT


def chunk_count(size: Column, chunk: int = CHUNK) -> Column:
    return F.floor((size + (chunk - 1)) / chunk).cast("long")


def chunk_plain_len(size: Column, idx: Column, chunk: int = CHUNK) -> Column:
    return F.least(F.lit(chunk).cast("long"), size - idx * chunk)


def chunk_sealed_len(size: Column, idx: Column, chunk: int = CHUNK) -> Column:
    return chunk_plain_len(size, idx, chunk) + OVERHEAD


def storage_used(size: Column, chunk: int = CHUNK) -> Column:
    return size + chunk_count(size, chunk) * OVERHEAD


def chunk_indices(size: Column, chunk: int = CHUNK) -> Column:
    """0 .. count - 1; empty for an empty file."""
    n = chunk_count(size, chunk)
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))


def chunk_refs(base: Column, size: Column, chunk: int = CHUNK) -> Column:
    """array<struct<offset, len>>; a chunk's place in the array is its index."""
    return F.transform(chunk_indices(size, chunk), lambda i: F.struct((base + i * (chunk + OVERHEAD)).alias("offset"), chunk_sealed_len(size, i, chunk).alias("len")))


def manifest_entry_len(name_bytes: Column, chunks: Column) -> Column:
    return F.lit(8 + 32 + 8 + OVERHEAD) + name_bytes + 8 + 16 + 8 + chunks * 12


def store_entry_len(chunks: Column) -> Column:
    return F.lit(8 + 32 + 8 + 8) + chunks * 12


def sealed_manifest_len(m: Column) -> Column:
    return F.when(m <= CHUNK, m + OVERHEAD).otherwise(8 + m + chunk_count(m) * (4 + OVERHEAD))


def region_len(manifest: Column, store: Column) -> Column:
    return 16 + store + sealed_manifest_len(manifest)


def garbage_bytes(file_len: Column, live: Column, metadata: Column) -> Column:
    return F.when(file_len <= HEADER, F.lit(0)).otherwise(F.greatest(F.lit(0), file_len - (live + metadata + HEADER))).cast("long")


def garbage_ratio(garbage: Column, file_len: Column) -> Column:
    return F.when(file_len == 0, F.lit(0.0)).otherwise(garbage / file_len)


def range_end(size: Column, offset: Column, length: Column) -> Column:
    """Where a read of length bytes at offset ends: within the file, at its end if it begins behind it."""
    return F.when(offset >= size, size).otherwise(F.least(size, offset + length))


def range_indices(size: Column, offset: Column, length: Column, chunk: int = CHUNK) -> Column:
    """The chunks that a read touches; none for an empty read."""
    end = range_end(size, offset, length)
    first, last = F.floor(offset / chunk).cast("long"), F.floor((end - 1) / chunk).cast("long")
    return F.when((offset < size) & (length > 0), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def windows(size: Column, width: int) -> Column:
    """array<struct<start, end>> that cover the file."""
    starts = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1, F.lit(width).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(size, s + width).alias("end")))


def slot_offset(slot: Column) -> Column:
    return (slot * SLOT).cast("long")


def inactive_slot(slot: Column) -> Column:
    return 1 - slot
