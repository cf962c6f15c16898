"""Constants and schemas of the object catalog."""

from pyspark.sql import types as T

# Fixed values of the data model.
MAGIC = b"SRM1"
CHUNK = 65_536
NONCE, TAG = 12, 16
OVERHEAD = NONCE + TAG
SLOT = 8_192
HEADER = 2 * SLOT
MAX_METADATA = 64 * 1024 * 1024
MAX_FILES = 1_000_000
MAX_CHUNKS = 1 << 24
COMPACT_RATIO = 0.5
FIRST_GENERATION = 1

FILES = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("name_enc", T.BinaryType()),
        T.StructField("name_lookup", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("modified_at", T.LongType()),
        T.StructField("version", T.LongType()),
    ]
)
CHUNKS = T.StructType(
    [
        T.StructField("file_id", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("chunk_idx", T.LongType()),
        T.StructField("sealed", T.BinaryType()),
    ]
)
