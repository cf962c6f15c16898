"""Queries of the object catalog over the given tables; each has the same result in DuckDB's SQL."""

from __future__ import annotations

import hmac
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strongroom.functions import keyed, layout, text
from strongroom.model import CHUNK, COMPACT_RATIO, HEADER, MAGIC, MAX_CHUNKS, MAX_FILES, MAX_METADATA, OVERHEAD
from strongroom.operators import catalog_ops as ops
from strongroom.operators.digest import table_digest
from strongroom.operators.running import running_total
from strongroom.sources.files import EPOCH, files, mutations

QUERIES = {}
ORACLES: dict[str, str] = {}

#: A public key for queries whose results are compared; real keys never appear here.
TEST_KEY = bytes(range(32))
#: A chunk size at which most documents have several chunks.
SMALL = 1024

_F = f"""f as (select doc_id as ordinal, concat_ws('/', source, lang, cast(doc_id as varchar)) as name, md5(concat_ws('/', source, lang, cast(doc_id as varchar))) as file_id,
  strlen(text) as size, doc_id + {EPOCH} as created_at, doc_id + {EPOCH} + n_chars as modified_at, text, source, lang from documents)"""
_E = """e as (select user_id as key, epoch_us(ts) as micros, event_id, case when event_type = 'error' then 'delete' else 'put' end as kind, event_type as type,
  cast(floor(value * 100) as bigint) as size from events)"""


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _hex_pads(key: bytes) -> tuple[str, str]:
    key = key.ljust(64, b"\0")
    return bytes(k ^ 0x36 for k in key).hex(), bytes(k ^ 0x5C for k in key).hex()


def _sql_hmac(key: bytes, message: str) -> str:
    inner, outer = _hex_pads(key)
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


# --- listings


@query("q_p1_list_file_info", f"with {_F} select name, size, created_at, modified_at, size + {OVERHEAD} * ((size + {CHUNK - 1}) // {CHUNK}) as storage_used from f")
def list_file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("name", "size", "created_at", "modified_at", layout.storage_used(F.col("size")).alias("storage_used"))


@query("q_p2_list_names", f"with {_F} select ordinal, name from f")
def list_names(spark, sf_dir):
    return files(spark, sf_dir).select("ordinal", "name")


@query("q_t1_list_sorted", f"with {_F} select name, size from f order by name")
def list_sorted(spark, sf_dir):
    return files(spark, sf_dir).select("name", "size").orderBy("name")


def _twice(f: DataFrame) -> DataFrame:
    """Every name twice, the second time larger and later."""
    return ops.append(f.select("name", "ordinal", "size"), f.select("name", (F.col("ordinal") + 10**12).alias("ordinal"), (F.col("size") + 1).alias("size")))


@query("q_p3_size_of_first", f"with {_F}, t as (select name, ordinal, size from f union all select name, ordinal + 1000000000000, size + 1 from f) select name, min(ordinal) as ordinal, min_by(size, ordinal) as size from t group by name")
def size_of_first(spark, sf_dir):
    return ops.first_match(_twice(files(spark, sf_dir)))


@query("q_t2_first_match", f"with {_F} select md5(text) as content_md5, min(ordinal) as ordinal, min_by(name, ordinal) as name from f group by text")
def first_by_content(spark, sf_dir):
    f = files(spark, sf_dir).select(F.md5("content").alias("content_md5"), "ordinal", "name")
    return ops.first_match(f, "content_md5").select("content_md5", "ordinal", "name")


@query("q_h11_lookup_join", f"with {_F} select l.doc_id, f.name, f.size, {_sql_hmac(keyed.NameKey(TEST_KEY).lookup_key, 'encode(f.name)')} as token from labels l join f on f.ordinal = l.doc_id")
def lookup_join(spark, sf_dir):
    """The labelled documents found by the token of their name, as a keyed equi-join."""
    key = keyed.NameKey(TEST_KEY)
    f = files(spark, sf_dir).select("ordinal", "name", "size")
    tokens = f.withColumn("token", key.lookup(F.col("name")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    wanted = labels.join(f.select(F.col("ordinal").alias("doc_id"), F.col("name").alias("w")), "doc_id").select("doc_id", key.lookup(F.col("w")).alias("token"))
    return ops.lookup(wanted, tokens, "token").select("doc_id", "name", "size", "token")


@query("q_p4_find_by_name", """with w as (select page_id, case when page_id % 7 = 0 then url || '?' else url end as name from pages), q as (select url, min(page_id) as first_page, count(*) as n from pages group by url)
  select w.page_id, q.first_page, coalesce(q.n, 0) as n from w left join q on q.url = w.name""")  # fmt: skip
def find_by_name(spark, sf_dir):
    """Pages asked for by the token of a name: the first of that name, or null if there is none (as for a seventh of them)."""
    key = keyed.NameKey(TEST_KEY)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    stored = pages.select(F.col("page_id").alias("ordinal"), key.lookup(F.col("url")).alias("token"))
    many = stored.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    asked = pages.select("page_id", key.lookup(F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("?"))).otherwise(F.col("url"))).alias("token"))
    found = asked.join(ops.first_match(stored, "token"), "token", "left").join(many, "token", "left")
    return found.select("page_id", F.col("ordinal").alias("first_page"), F.coalesce("n", F.lit(0)).alias("n"))


@query("q_p5_name_equals", f"with {_F} select ordinal, source = 'src0' and lang = 'en' as equal from f")
def name_equals(spark, sf_dir):
    """A sealed name compared after opening; one that doesn't open is unequal."""
    key = keyed.NameKey(TEST_KEY)
    f = files(spark, sf_dir).withColumn("folder", F.concat_ws("/", "source", "lang"))
    opened = key.open(key.seal(F.col("folder"), F.lit("vault")), F.lit("vault"))
    return f.select("ordinal", F.coalesce(opened == "src0/en", F.lit(False)).alias("equal"))


@query("q_p6_usable_slot", f"with {_E} select event_id, size >= {HEADER} and kind = 'put' as usable from e")
def usable_slot(spark, sf_dir):
    m = mutations(spark, sf_dir)
    return m.select("event_id", ((F.col("size") >= HEADER) & (F.col("kind") == "put")).alias("usable"))


@query("q_p7_valid_offset", f"with {_E} select event_id, size from e where size >= {HEADER} and size < 1000000")
def valid_offset(spark, sf_dir):
    return mutations(spark, sf_dir).where((F.col("size") >= HEADER) & (F.col("size") < 1_000_000)).select("event_id", "size")


@query("q_p11_unknown_ts", f"with {_E} select event_id, case when size - 5000 > 0 then size - 5000 end as seconds from e")
def unknown_ts(spark, sf_dir):
    return mutations(spark, sf_dir).select("event_id", text.seconds_or_null(F.col("size") - 5000).alias("seconds"))


@query("q_s4_primary_usable", f"select doc_id, hex(encode(case when doc_id % 2 = 0 then '{MAGIC.decode()}' || text else text end))[1:8] = '{MAGIC.hex().upper()}' as usable from documents")
def primary_usable(spark, sf_dir):
    """Whether a stored file begins with the container's magic, which every second one is given."""
    f = files(spark, sf_dir)
    stored = F.when(F.col("ordinal") % 2 == 0, F.concat(F.lit(MAGIC), "content")).otherwise(F.col("content"))
    return f.select(F.col("ordinal").alias("doc_id"), text.has_magic(stored).alias("usable"))


# --- layout

_CHUNKED = f"(size + {SMALL - 1}) // {SMALL}"


@query("q_w1_chunk_counts", f"with {_F} select ordinal, {_CHUNKED} as n, size + {OVERHEAD} * ({_CHUNKED}) as storage_used from f")
def chunk_counts(spark, sf_dir):
    size = F.col("size")
    return files(spark, sf_dir).select("ordinal", layout.chunk_count(size, SMALL).alias("n"), layout.storage_used(size, SMALL).alias("storage_used"))


@query("q_w4_chunk_refs", f"with {_F} select ordinal, i as idx, {HEADER} + i * {SMALL + OVERHEAD} as offset, least({SMALL}, size - i * {SMALL}) + {OVERHEAD} as len from f, unnest(generate_series(0, {_CHUNKED} - 1)) as u(i)")
def chunk_refs(spark, sf_dir):
    f = files(spark, sf_dir).select("ordinal", F.posexplode(layout.chunk_refs(F.lit(HEADER).cast("long"), F.col("size"), SMALL)).alias("idx", "ref"))
    return f.select("ordinal", F.col("idx").cast("long").alias("idx"), "ref.offset", "ref.len")


@query("q_w7_last_chunk", f"with {_F} select ordinal, case when size > 0 then {_CHUNKED} - 1 end as idx, case when size > 0 then size - ({_CHUNKED} - 1) * {SMALL} end as plain_len from f")
def last_chunk(spark, sf_dir):
    """The last chunk and its length; an empty file has none."""
    r = F.col("r")
    refs = files(spark, sf_dir).select("ordinal", layout.chunk_refs(F.lit(0).cast("long"), F.col("size"), SMALL).alias("r"))
    return refs.select("ordinal", F.when(F.size(r) > 0, F.size(r) - 1).cast("long").alias("idx"), (F.get(r, F.size(r) - 1)["len"] - OVERHEAD).alias("plain_len"))


def _sized(spark, sf_dir) -> DataFrame:
    f = files(spark, sf_dir).select("ordinal", "name", "size", "source")
    return f.withColumn("n", layout.chunk_count(F.col("size"))).withColumn("used", layout.storage_used(F.col("size")))


_SIZED = f"{_F}, g as (select ordinal, name, size, source, (size + {CHUNK - 1}) // {CHUNK} as n, size + {OVERHEAD} * ((size + {CHUNK - 1}) // {CHUNK}) as used from f)"
_META = f"""m as (select cast(10 + sum(8 + 32 + 8 + {OVERHEAD} + strlen(name) + 8 + 16 + 8 + 12 * n) as bigint) as manifest, cast(16 + sum(8 + 32 + 8 + 8 + 12 * n) + 64 as bigint) as store, %s from g %s),
  r as (select *, 16 + store + case when manifest <= {CHUNK} then manifest + {OVERHEAD} else 8 + manifest + 32 * ((manifest + {CHUNK - 1}) // {CHUNK}) end as region from m)"""
_META_ALL = _META % ("count(*) as files, cast(sum(used) as bigint) as live, cast(sum(size) as bigint) as bytes", "")
_META_SOURCE = _META % ("source, count(*) as files, cast(sum(used) as bigint) as live, cast(sum(size) as bigint) as bytes", "group by source")


def _metadata(sized: DataFrame, *keys: str) -> DataFrame:
    n = F.col("n")
    m = sized.groupBy(*keys).agg(
        (F.sum(layout.manifest_entry_len(F.octet_length("name").cast("long"), n)) + 10).alias("manifest"), (F.sum(layout.store_entry_len(n)) + 16 + 64).alias("store"),
        F.count(F.lit(1)).alias("files"), F.sum("used").alias("live"), F.sum("size").alias("bytes"),
    )
    return m.withColumn("region", layout.region_len(F.col("manifest"), F.col("store")))


@query("q_s22_metadata_len", f"with {_SIZED}, {_META_SOURCE} select source, manifest, store, region from r")
def metadata_len(spark, sf_dir):
    return _metadata(_sized(spark, sf_dir), "source").select("source", "manifest", "store", "region")


@query("q_w5_append_layout", f"with {_SIZED} select ordinal, n, used, cast(coalesce(sum(used) over (order by ordinal rows between unbounded preceding and 1 preceding), 0) + {HEADER} as bigint) as base from g")
def append_layout(spark, sf_dir):
    laid = running_total(_sized(spark, sf_dir).select("ordinal", "n", "used"), "ordinal", F.col("used"), "before")
    return laid.select("ordinal", "n", "used", (F.col("before") + HEADER).alias("base"))


@query("q_w6_compact_layout", f"with {_SIZED}, {_META_ALL} select ordinal, n, cast(coalesce(sum(used) over (order by ordinal rows between unbounded preceding and 1 preceding), 0) + {HEADER} + r.region as bigint) as base from g, r")
def compact_layout(spark, sf_dir):
    sized = _sized(spark, sf_dir)
    row = _metadata(sized).first()
    laid = running_total(sized.select("ordinal", "n", "used"), "ordinal", F.col("used"), "before")
    return laid.select("ordinal", "n", (F.col("before") + HEADER + (row["region"] or 0)).alias("base"))


_GARBAGE = f"""{_SIZED}, {_META_SOURCE}, h as (select *, {HEADER} + live + region + cast(bytes * files % 97 * live // 50 as bigint) as file_len from r),
  k as (select *, case when file_len <= {HEADER} then 0 else greatest(0, file_len - ({HEADER} + live + region)) end as garbage from h)"""


def _garbage(spark, sf_dir) -> DataFrame:
    """A vault for each source, with a tail of dead bytes that its figures determine."""
    m = _metadata(_sized(spark, sf_dir), "source")
    dead = F.expr("(bytes * files % 97 * live) div 50")
    m = m.withColumn("file_len", HEADER + F.col("live") + F.col("region") + dead)
    m = m.withColumn("garbage", layout.garbage_bytes(F.col("file_len"), F.col("live"), F.col("region")))
    return m.withColumn("ratio", layout.garbage_ratio(F.col("garbage"), F.col("file_len")))


@query("q_a3_garbage_bytes", f"with {_GARBAGE} select source, file_len, live, region, cast(garbage as bigint) as garbage from k")
def garbage_bytes(spark, sf_dir):
    return _garbage(spark, sf_dir).select("source", "file_len", "live", "region", "garbage")


@query("q_a4_garbage_ratio", f"with {_GARBAGE} select source, garbage / file_len as ratio from k")
def garbage_ratio(spark, sf_dir):
    return _garbage(spark, sf_dir).select("source", "ratio")


@query("q_m10_autocompact_trigger", f"with {_GARBAGE} select source, garbage / file_len > {COMPACT_RATIO} as compact from k")
def autocompact_trigger(spark, sf_dir):
    return _garbage(spark, sf_dir).select("source", (F.col("ratio") > COMPACT_RATIO).alias("compact"))


@query("q_a5_info", f"""with {_GARBAGE}, x as (select source, count(*) = count(*) filter (where ordinal % 1000 <> 7) as mirrored from g group by source)
  select k.source, files, bytes as size_bytes, cast(garbage as bigint) as garbage_bytes, garbage / file_len as garbage_ratio, mirrored from k join x on x.source = k.source""")  # fmt: skip
def info(spark, sf_dir):
    """Figures of a vault for each source, whose mirror has lost the row of every thousandth file: it counts if its digest is the listing's."""
    listing = _listing_macs(spark, sf_dir)
    whole = table_digest(listing, "mac", ["source"]).select("source", "digest")
    mirror = table_digest(listing.where("ordinal % 1000 <> 7"), "mac", ["source"]).select("source", F.col("digest").alias("mirror"))
    same = whole.join(mirror, "source", "left").select("source", F.coalesce(F.col("digest") == F.col("mirror"), F.lit(False)).alias("mirrored"))
    figures = _garbage(spark, sf_dir).select("source", "files", F.col("bytes").alias("size_bytes"), F.col("garbage").alias("garbage_bytes"), F.col("ratio").alias("garbage_ratio"))
    return figures.join(same, "source")


def _listing_macs(spark, sf_dir) -> DataFrame:
    """source, ordinal, mac: a keyed hash of each row of the listing."""
    row = F.concat_ws(":", "file_id", F.col("size").cast("string"))
    return files(spark, sf_dir).select("source", "ordinal", F.lower(F.hex(keyed.hmac256(TEST_KEY, keyed.utf8(row)))).alias("mac"))


@query("q_h23_ratio_text", f"with {_GARBAGE} select source, printf('%.1f', garbage / file_len * 100) || '%' as ratio from k")
def ratio_text(spark, sf_dir):
    return _garbage(spark, sf_dir).select("source", text.percent(F.col("ratio")).alias("ratio"))


@query("q_a6_counts", f"with {_F} select source, lang, count(*) as files, cast(sum(size) as bigint) as bytes, max(size) as largest from f group by source, lang")
def counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("size").alias("largest"))


@query("q_s21_ceilings", f"with {_SIZED}, {_META_SOURCE} select source, files > {MAX_FILES} as too_many, region > {MAX_METADATA} as too_large, false as too_long from r")
def ceilings(spark, sf_dir):
    sized = _sized(spark, sf_dir)
    longest = sized.groupBy("source").agg((F.max("n") > MAX_CHUNKS).alias("too_long"))
    m = _metadata(sized, "source").select("source", (F.col("files") > MAX_FILES).alias("too_many"), (F.col("region") > MAX_METADATA).alias("too_large"))
    return m.join(longest, "source")


@query("q_s17_slot_offset", f"with {_E} select event_id, (event_id % 2) * 8192 as slot_offset, 1 - event_id % 2 as inactive from e")
def slot_offsets(spark, sf_dir):
    slot = F.col("event_id") % 2
    return mutations(spark, sf_dir).select("event_id", layout.slot_offset(slot).alias("slot_offset"), layout.inactive_slot(slot).alias("inactive"))


# --- contents


@query("q_s10_chunk_lengths", f"with {_F} select ordinal, i as idx, least({SMALL}, size - i * {SMALL}) as len from f, unnest(generate_series(0, {_CHUNKED} - 1)) as u(i)")
def chunk_lengths(spark, sf_dir):
    c = chunks(files(spark, sf_dir), SMALL)
    return c.select("ordinal", F.col("chunk_idx").alias("idx"), F.octet_length("plain").cast("long").alias("len"))


def chunks(f: DataFrame, size: int = CHUNK) -> DataFrame:
    """ordinal, file_id, chunk_idx, plain: the contents in pieces."""
    cut = f.select("ordinal", "file_id", "content", F.explode(layout.chunk_indices(F.col("size"), size)).alias("chunk_idx"))
    return cut.select("ordinal", "file_id", "chunk_idx", F.substring(F.col("content"), (F.col("chunk_idx") * size + 1).cast("int"), F.lit(size)).alias("plain"))


def assembled(c: DataFrame, *keys: str) -> DataFrame:
    """Contents from pieces: one file is one row, as when it was read."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", "plain")))
    return c.groupBy(*keys).agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["plain"])).alias("content"))


@query("q_s14_get_hash", f"with {_F} select ordinal, sha256(text) as sha from f")
def get_hash(spark, sf_dir):
    f = files(spark, sf_dir)
    whole = f.select("ordinal").join(assembled(chunks(f, SMALL), "ordinal"), "ordinal", "left")
    return whole.select("ordinal", F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("sha"))


@query("q_s15_range_chunks", f"with {_F} select ordinal, i as idx from f, unnest(generate_series((size // 3) // {SMALL}, (least(size, size // 3 + 1500) - 1) // {SMALL})) as u(i) where size > 0")
def range_chunks(spark, sf_dir):
    start = F.floor(F.col("size") / 3).cast("long")
    return files(spark, sf_dir).select("ordinal", F.explode(layout.range_indices(F.col("size"), start, F.lit(1500), SMALL)).alias("idx"))


@query("q_s15_range_bytes", "select doc_id, coalesce(lower(hex(encode(text))[2 * 1017 + 1 : 2 * 1047]), '') as bytes, least(strlen(text), 1047) as ends from documents")
def range_bytes(spark, sf_dir):
    """Bytes 1,017 to 1,047, over the edge of two chunks: only these are assembled; a read behind the end is empty."""
    f = files(spark, sf_dir)
    size, offset, length = F.col("size"), F.lit(1017), F.lit(30)
    touched = f.select("ordinal", "file_id", "content", "size", F.explode(layout.range_indices(size, offset, length, SMALL)).alias("chunk_idx"))
    pieces = touched.select("ordinal", "chunk_idx", F.substring(F.col("content"), (F.col("chunk_idx") * SMALL + 1).cast("int"), F.lit(SMALL)).alias("plain"))
    whole = f.select("ordinal", "size").join(assembled(pieces, "ordinal"), "ordinal", "left")
    # What is assembled begins at the first touched chunk, which is the first of the file.
    return whole.select(F.col("ordinal").alias("doc_id"), F.coalesce(F.lower(F.hex(F.substring("content", 1018, 30))), F.lit("")).alias("bytes"), layout.range_end(size, offset, length).cast("long").alias("ends"))


@query("q_s25_read_windows", f"with {_F} select ordinal, i as start, least(size, i + 4096) as end_at from f, unnest(generate_series(0, size - 1, 4096)) as u(i)")
def read_windows(spark, sf_dir):
    w = files(spark, sf_dir).select("ordinal", F.explode(layout.windows(F.col("size"), 4096)).alias("w"))
    return w.select("ordinal", "w.start", F.col("w.end").alias("end_at"))


@query("q_s3_restore_listing", f"with {_F} select f.name, f.size, l.doc_id is not null as has_content from f left join labels l on l.doc_id = f.ordinal")
def restore_listing(spark, sf_dir):
    """A listing survives the loss of contents (here: kept for labelled files)."""
    kept = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("ordinal"), F.lit(True).alias("kept"))
    f = files(spark, sf_dir).select("ordinal", "name", "size")
    return f.join(kept, "ordinal", "left").select("name", "size", F.coalesce("kept", F.lit(False)).alias("has_content"))


# --- mutations

_EXISTING = "x as (select key as name, min(event_id) as ordinal, min_by(size, event_id) as size, min(micros) as created_at, min(micros) as modified_at from e where type in ('signup', 'view') group by key)"
_BATCH = "b as (select key as name, min(event_id) as pos, max_by(size, event_id) as size, max_by(micros, event_id) as micros from e where type = 'purchase' group by key)"


def _existing(m: DataFrame) -> DataFrame:
    return m.where(F.col("type").isin("signup", "view")).groupBy(F.col("key").alias("name")).agg(F.min("event_id").alias("ordinal"), F.min_by("size", "event_id").alias("size"), F.min("micros").alias("created_at"), F.min("micros").alias("modified_at"))


def _batch(m: DataFrame) -> DataFrame:
    return m.where("type = 'purchase'").select(F.col("key").alias("name"), F.col("event_id").alias("pos"), "size", "micros")


@query("q_u2_batch_dedupe", f"with {_E}, {_BATCH} select * from b")
def batch_dedupe(spark, sf_dir):
    return ops.dedupe_batch(_batch(mutations(spark, sf_dir)))


@query("q_a8_batch_count", f"with {_E} select type, count(*) as items, count(distinct key) as names from e group by type")
def batch_count(spark, sf_dir):
    return mutations(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("key").alias("names"))


@query("q_m3_batch_upsert", f"""with {_E}, {_EXISTING}, {_BATCH} select coalesce(x.name, b.name) as name, coalesce(x.ordinal, 1000000000 + b.pos) as ordinal, coalesce(b.size, x.size) as size,
  coalesce(x.created_at, b.micros) as created_at, coalesce(b.micros, x.modified_at) as modified_at from x full join b on x.name = b.name""")  # fmt: skip
def batch_upsert(spark, sf_dir):
    m = mutations(spark, sf_dir)
    return ops.upsert(_existing(m), _batch(m), 10**9)


@query("q_m4_put_lww", f"with {_E} select key as name, count(*) as puts, min(micros) as created_at, max(micros) as modified_at, arg_max(size, (micros, event_id)) as size from e where kind = 'put' group by key")
def put_lww(spark, sf_dir):
    m = mutations(spark, sf_dir).where("kind = 'put'")
    return m.groupBy(F.col("key").alias("name")).agg(F.count(F.lit(1)).alias("puts"), F.min("micros").alias("created_at"), F.max("micros").alias("modified_at"), F.max_by("size", F.struct("micros", "event_id")).alias("size"))


@query("q_m5_delete", f"with {_E}, {_EXISTING} select * from x where name not in (select key from e where kind = 'delete' and size % 3 = 0)")
def delete(spark, sf_dir):
    m = mutations(spark, sf_dir)
    return ops.delete(_existing(m), m.where("kind = 'delete' and size % 3 = 0").select(F.col("key").alias("name")))


@query("q_m6_rename", f"""with {_E}, y as (select cast(key as varchar) as name, event_id as ordinal, size, micros as modified_at from e where type in ('view', 'signup')),
  r as (select cast(key as varchar) as name, max(micros) as micros from e where type = 'click' group by key), z as (select name, min(ordinal) as first from y group by name)
  select case when r.name is not null and ordinal = first then 'moved/' || y.name else y.name end as name, ordinal, size, case when r.name is not null and ordinal = first then r.micros else modified_at end as modified_at
  from y join z using (name) left join r on r.name = y.name""")  # fmt: skip
def rename(spark, sf_dir):
    m = mutations(spark, sf_dir).withColumn("name", F.col("key").cast("string"))
    f = m.where("type in ('view', 'signup')").select("name", F.col("event_id").alias("ordinal"), "size", F.col("micros").alias("modified_at"))
    r = m.where("type = 'click'").groupBy("name").agg(F.max("micros").alias("micros")).withColumn("new_name", F.concat(F.lit("moved/"), "name"))
    return ops.rename(f, r)


@query("q_m2_append_dup", f"with {_F}, t as (select name, ordinal, size from f union all select name, ordinal + 1000000000000, size + 1 from f) select name, count(*) as copies, cast(sum(size) as bigint) as bytes from t group by name")
def append_dup(spark, sf_dir):
    return _twice(files(spark, sf_dir)).groupBy("name").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes"))


@query("q_fold_log", f"""with {_E}, s as (select *, sum(case when kind = 'delete' then 1 else 0 end) over (partition by key order by micros, event_id rows unbounded preceding) as seg from e), l as (select key, max(seg) as seg from s group by key)
  select s.key, min(micros) as created, max(micros) as modified, count(*) as writes, arg_max(size, (micros, event_id)) as size from s join l on s.key = l.key and s.seg = l.seg where kind = 'put' group by s.key""")  # fmt: skip
def fold_log(spark, sf_dir):
    return ops.fold_log(mutations(spark, sf_dir))


@query("q_w8_generation", f"with {_E} select event_id, 1 + row_number() over (order by micros, event_id) as generation from e")
def generation(spark, sf_dir):
    m = running_total(mutations(spark, sf_dir).select("micros", "event_id"), "micros", F.lit(1), "before", ["event_id"])
    return m.select("event_id", (F.col("before") + 2).cast("long").alias("generation"))


@query("q_w9_file_version", f"with {_E}, g as (select *, 1 + row_number() over (order by micros, event_id) as generation from e) select key, max(generation) as version from g where kind = 'put' group by key")
def file_version(spark, sf_dir):
    m = running_total(mutations(spark, sf_dir).select("micros", "event_id", "key", "kind"), "micros", F.lit(1), "before", ["event_id"])
    return m.where("kind = 'put'").groupBy("key").agg((F.max("before") + 2).cast("long").alias("version"))


@query("q_j1_version_default", f"with {_F} select f.name, coalesce(l.quality + 2, 7) as version from f left join labels l on l.doc_id = f.ordinal")
def version_default(spark, sf_dir):
    f = files(spark, sf_dir).select("name", "file_id", "ordinal")
    v = spark.read.parquet(f"{sf_dir}/labels.parquet").join(f.select(F.col("ordinal").alias("doc_id"), "file_id"), "doc_id").select("file_id", (F.col("quality") + 2).alias("version"))
    return ops.with_version(f, v, F.lit(7)).select("name", "version")


@query("q_j5_chunk_join", f"with {_F} select ordinal, count(*) as chunks, cast(sum(least({SMALL}, size - i * {SMALL})) as bigint) as bytes from f join labels l on l.doc_id = f.ordinal, unnest(generate_series(0, {_CHUNKED} - 1)) as u(i) group by ordinal")
def chunk_join(spark, sf_dir):
    """Files joined to their chunks on file id."""
    f = files(spark, sf_dir)
    wanted = f.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("ordinal")), "ordinal", "left_semi").select("ordinal", F.col("file_id").alias("id"))
    c = chunks(f, SMALL).select("file_id", F.octet_length("plain").alias("n"))
    return wanted.join(c, F.col("id") == F.col("file_id")).groupBy("ordinal").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("bytes"))


@query("q_j6_survivors", f"with {_E} select key, count(*) as n from e where kind = 'put' and key in (select key from e where kind = 'delete') group by key")
def survivors(spark, sf_dir):
    m = mutations(spark, sf_dir)
    return m.where("kind = 'put'").join(m.where("kind = 'delete'").select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("q_u1_union", f"with {_E}, {_EXISTING} select name, ordinal, size from x union all select key, event_id, size from e where type = 'click'")
def union(spark, sf_dir):
    m = mutations(spark, sf_dir)
    return ops.append(_existing(m).select("name", "ordinal", "size"), m.where("type = 'click'").select(F.col("key").alias("name"), F.col("event_id").alias("ordinal"), "size"))


# --- slots


@query("q_t3_active_slot", f"with {_E} select key, arg_max(event_id % 2, (size // 100, -(event_id % 2))) as slot, max(size // 100) as data_offset from e where kind = 'put' group by key")
def active_slot(spark, sf_dir):
    m = mutations(spark, sf_dir).select("key", (F.col("event_id") % 2).alias("slot"), F.expr("size div 100").alias("data_offset"), (F.col("kind") == "put").alias("valid"))
    return ops.active_slot(m, ["key"])


@query("q_t4_unwrap_candidate", f"with {_E} select key, coalesce(min(event_id) filter (where kind = 'put' and size >= {HEADER}), min(event_id) filter (where kind = 'put')) as slot from e group by key")
def unwrap_candidate(spark, sf_dir):
    put = F.col("kind") == "put"
    m = mutations(spark, sf_dir).select("key", F.col("event_id").alias("slot"), F.col("event_id").alias("place"), (put & (F.col("size") >= HEADER)).alias("usable"), put.alias("has_magic"))
    return ops.unwrap_candidate(m, ["key"])


# --- keyed and small functions


@query("q_h7_hmac256", f"with {_F} select ordinal, {_sql_hmac(TEST_KEY, 'encode(name)')} as mac from f")
def hmac256(spark, sf_dir):
    return files(spark, sf_dir).select("ordinal", F.lower(F.hex(keyed.hmac256(TEST_KEY, keyed.utf8(F.col("name"))))).alias("mac"))


@query("q_h5_hmac512")
def hmac512(spark, sf_dir):
    return files(spark, sf_dir).select("ordinal", F.lower(F.hex(keyed.hmac512(TEST_KEY, keyed.utf8(F.col("name"))))).alias("mac"))


_LE = "unhex(array_to_string(list_transform(generate_series(15, 1, -2), lambda i: substr(lpad(hex(%s), 16, '0'), i, 2)), ''))"


@query("q_h22_le64", f"with {_F} select ordinal, lower(hex({_LE % 'size * 1000003'})) as le from f")
def le64(spark, sf_dir):
    return files(spark, sf_dir).select("ordinal", F.lower(F.hex(keyed.le64(F.col("size") * 1000003))).alias("le"))


@query("q_h9_subkey", f"with {_F} select ordinal, {_sql_hmac(hmac.new(bytes(32), TEST_KEY, sha256).digest(), f'''encode('chunk') || encode(file_id) || {_LE % 'ordinal'} || unhex('01')''')} as subkey from f")
def subkey(spark, sf_dir):
    return files(spark, sf_dir).select("ordinal", F.lower(F.hex(keyed.subkey(TEST_KEY, "chunk", F.col("file_id"), F.col("ordinal")))).alias("subkey"))


@query("q_a7_store_digest", f"""with {_F}, m as (select source, {_sql_hmac(TEST_KEY, "encode(file_id || ':' || size)")} as mac, count(*) as n from f group by all),
  a as (select source, mac[1:6] as p, sha256(string_agg(mac || ':' || n, ',' order by mac)) as s from m group by all), b as (select source, p[1:3] as q, sha256(string_agg(p || ':' || s, ',' order by p)) as s from a group by all)
  select source, {_sql_hmac(TEST_KEY, "encode(sha256(string_agg(q || ':' || s, ',' order by q)))")} as digest from b group by source""")  # fmt: skip
def store_digest(spark, sf_dir):
    """A keyed digest of each source's listing, by a tree over the hashes of its rows."""
    whole = table_digest(_listing_macs(spark, sf_dir), "mac", ["source"])
    return whole.select("source", F.lower(F.hex(keyed.hmac256(TEST_KEY, keyed.utf8(F.col("digest"))))).alias("digest"))


@query("q_h12_name_roundtrip", f"with {_F} select ordinal, name as opened, {OVERHEAD} + strlen(name) as sealed_len, false as opens_elsewhere from f")
def name_roundtrip(spark, sf_dir):
    key = keyed.NameKey(TEST_KEY)
    f = files(spark, sf_dir).withColumn("sealed", key.seal(F.col("name"), F.lit("vault")))
    return f.select("ordinal", key.open(F.col("sealed"), F.lit("vault")).alias("opened"), F.octet_length("sealed").cast("long").alias("sealed_len"), key.open(F.col("sealed"), F.lit("other")).isNotNull().alias("opens_elsewhere"))


def _sealed(f: DataFrame, key: keyed.ContentKey, size: int = CHUNK) -> DataFrame:
    return chunks(f, size).withColumn("sealed", key.seal(F.col("plain"), F.col("file_id"), F.col("chunk_idx"), F.lit(1).cast("long")))


def _roundtrip(f: DataFrame, size: int) -> DataFrame:
    key = keyed.ContentKey(TEST_KEY)
    s = _sealed(f, key, size)
    opened = key.open(F.col("sealed"), F.col("file_id"), F.col("chunk_idx"), F.lit(1).cast("long"))
    return s.select("ordinal", F.col("chunk_idx").alias("idx"), F.sha2(opened, 256).alias("sha"), F.octet_length("sealed").cast("long").alias("sealed_len"))


def _sql_roundtrip(size: int) -> str:
    return f"with {_F} select ordinal, i as idx, sha256(unhex(substr(hex(encode(text)), 2 * {size} * i + 1, 2 * {size}))) as sha, least({size}, size - i * {size}) + {OVERHEAD} as sealed_len from f, unnest(generate_series(0, (size - 1) // {size})) as u(i) where size > 0"


@query("q_h13_seal_roundtrip", _sql_roundtrip(SMALL))
def seal_roundtrip(spark, sf_dir):
    """Sealed and opened in small chunks: the hash of what comes back, for each chunk of all files."""
    return _roundtrip(files(spark, sf_dir), SMALL)


@query("q_h13_seal_roundtrip_all", _sql_roundtrip(CHUNK))
def seal_roundtrip_all(spark, sf_dir):
    """The same in chunks of the stored size."""
    return _roundtrip(files(spark, sf_dir), CHUNK)


@query("q_tamper_detect", f"with {_F} select ordinal, i as idx, true as opens, false as other_index, false as other_version, false as changed from f, unnest(generate_series(0, (size - 1) // {CHUNK})) as u(i) where size > 0")
def tamper_detect(spark, sf_dir):
    """A chunk opens at its own place only, and not with a byte changed."""
    key = keyed.ContentKey(TEST_KEY)
    s = _sealed(files(spark, sf_dir), key)
    one, sealed = F.lit(1).cast("long"), F.col("sealed")
    flipped = F.when(F.hex(F.substring(sealed, -1, 1)) == "00", F.lit(b"\x01")).otherwise(F.lit(b"\x00"))
    changed = F.concat(F.substring(sealed, F.lit(1), F.octet_length(sealed) - 1), flipped)
    opens = lambda data, idx, version: key.open(data, F.col("file_id"), idx, version).isNotNull()
    idx = F.col("chunk_idx")
    return s.select("ordinal", idx.alias("idx"), opens(sealed, idx, one).alias("opens"), opens(sealed, idx + 1, one).alias("other_index"), opens(sealed, idx, one + 1).alias("other_version"), opens(changed, idx, one).alias("changed"))


@query("q_m12_reseal", f"with {_F} select ordinal, i as idx, least({CHUNK}, size - i * {CHUNK}) as plain_len, least({CHUNK}, size - i * {CHUNK}) + {OVERHEAD} as sealed_len from f, unnest(generate_series(0, (size - 1) // {CHUNK})) as u(i) where size > 0")
def reseal(spark, sf_dir):
    """Opened and sealed anew for the next version, chunk by chunk."""
    key = keyed.ContentKey(TEST_KEY)
    one = F.lit(1).cast("long")
    opened = _sealed(files(spark, sf_dir), key).withColumn("plain", key.open(F.col("sealed"), F.col("file_id"), F.col("chunk_idx"), one))
    again = opened.withColumn("again", key.seal(F.col("plain"), F.col("file_id"), F.col("chunk_idx"), one + 1))
    return again.select("ordinal", F.col("chunk_idx").alias("idx"), F.octet_length("plain").cast("long").alias("plain_len"), F.octet_length("again").cast("long").alias("sealed_len"))


@query("q_h16_password_class", r"""select doc_id, regexp_matches(t, '[A-Z]') as upper, regexp_matches(t, '[a-z]') as lower, regexp_matches(t, '[0-9]') as digit, regexp_matches(t, '[^A-Za-z0-9-]') as symbol, length(t) = 29 and regexp_matches(t, '^[^-]{5}(-[^-]{5}){4}$') as grouped
  from (select doc_id, replace(md5(text)[1:5] || '-' || md5(text)[6:10] || '-' || md5(text)[11:15] || '-' || md5(text)[16:20] || '-' || md5(text)[21:25], 'a', 'A') as t from documents)""")  # fmt: skip
def password_class(spark, sf_dir):
    """Classes and format of texts made from each document's hash."""
    h = F.md5(F.col("content"))
    f = files(spark, sf_dir).select(F.col("ordinal").alias("doc_id"), F.replace(F.concat_ws("-", *(F.substring(h, 1 + 5 * k, 5) for k in range(5))), F.lit("a"), F.lit("A")).alias("t"))
    return f.select("doc_id", text.password_classes(F.col("t")).alias("c"), text.is_grouped(F.col("t")).alias("grouped")).select("doc_id", "c.*", "grouped")


@query("q_h17_file_ids", f"with {_F} select ordinal, file_id, length(file_id) = 32 as is_id from f")
def file_ids(spark, sf_dir):
    return files(spark, sf_dir).select("ordinal", "file_id", (F.char_length("file_id") == 32).alias("is_id"))


@query("q_h19_basename", r"select page_id, regexp_extract(url, '[^/]*$') as base, case when starts_with(url, 'https:/') then substr(url, 9) else url end as below from pages")
def basename(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", text.basename(F.col("url")).alias("base"), text.portable(F.col("url"), F.lit("https:/")).alias("below"))


@query("q_h20_memory", "select l_orderkey, l_linenumber, case when cast(l_partkey % 513 as varchar) in ('128', '256', '512') then cast(l_partkey % 513 as integer) end as mib from lineitem")
def memory(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", text.memory_mib((F.col("l_partkey") % 513).cast("string")).alias("mib"))


@query("q_h21_error_map", f"with {_E} select event_id, case type when 'error' then case when event_id % 2 = 0 then 1 else 4 end when 'click' then 2 when 'view' then 5 when 'signup' then 1 else 9 end as code from e")
def error_map(spark, sf_dir):
    """What went wrong, as a wire code; every second event is one of opening, where an authentication failure is a wrong password."""
    kinds = {"error": "CRYPTO", "click": "NOT_FOUND", "view": "IO", "signup": "WRONG_PASSWORD"}
    kind = F.element_at(F.create_map(*(F.lit(x) for item in kinds.items() for x in item)), F.col("type"))
    return mutations(spark, sf_dir).select("event_id", text.error_code(kind, F.col("event_id") % 2 == 0).alias("code"))


@query("q_h8_equal", f"with {_F}, g as (select source, text, min(ordinal) as first from f group by source, text) select f.ordinal, f.ordinal <> g.first as repeated from f join g on f.source = g.source and f.text = g.text")
def equal_contents(spark, sf_dir):
    """Whether a file repeats an earlier one of its source: contents compared by their hash."""
    f = files(spark, sf_dir).select("ordinal", "source", F.sha2("content", 256).alias("sha"))
    firsts = f.groupBy("source", "sha").agg(F.min("ordinal").alias("first"))
    return f.join(firsts, ["source", "sha"]).select("ordinal", (F.col("ordinal") != F.col("first")).alias("repeated"))


@query("q_stream_windows", "select epoch_us(time_bucket(interval '1 hour', ts)) as hour, event_type as type, count(*) as n from events group by 1, 2")
def stream_windows(spark, sf_dir):
    """The log by hour and type, as the streaming job counts it."""
    from strongroom.streaming.ingest import hourly

    return hourly(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
