import hashlib
import hmac

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strongroom.functions import keyed, layout, text
from strongroom.operators.catalog_ops import active_slot, rename, unwrap_candidate, upsert
from strongroom.operators.running import range_number, running_total
from strongroom.streaming.ingest import EVENTS, fold_stream, folded, hourly


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("size", "n", "used"), [(0, 0, 0), (1, 1, 29), (65536, 1, 65564), (65537, 2, 65593), (131072, 2, 131128), (200000, 4, 200112), (300000, 5, 300140), (900000, 14, 900392)])
def test_chunks_of_a_size(spark, size, n, used):
    s = F.lit(size).cast("long")
    row = one(spark, layout.chunk_count(s), layout.storage_used(s), layout.chunk_refs(F.lit(16384).cast("long"), s))
    assert tuple(row)[:2] == (n, used) and sum(r["len"] for r in row[2]) == used
    assert [r["offset"] for r in row[2]] == [16384 + 65564 * i for i in range(n)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400_000), st.integers(0, 500_000), st.integers(0, 200_000)), min_size=1, max_size=20))
def test_ranges_and_windows(spark, rows):
    df = spark.createDataFrame(rows, "size long, offset long, length long")
    got = df.select("*", layout.range_indices(F.col("size"), F.col("offset"), F.col("length")).alias("i"), layout.windows(F.col("size"), 100_000).alias("w")).collect()
    for r in got:
        touched = sorted({b // 65536 for b in (r["offset"], min(r["size"], r["offset"] + r["length"]) - 1)}) if r["offset"] < r["size"] and r["length"] else []
        want = list(range(touched[0], touched[-1] + 1)) if touched else []
        assert r["i"] == want and sum(w["end"] - w["start"] for w in r["w"]) == r["size"]


def test_keyed_functions(spark):
    key, message = b"k" * 80, "naïve/\x00name"
    row = one(spark, keyed.hmac256(key, keyed.utf8(F.lit(message))), keyed.hmac512(b"k", keyed.utf8(F.lit(message))), keyed.le64(F.lit(0x80FF01).cast("long")), keyed.subkey(key, "chunk", F.lit("id"), F.lit(5).cast("long")))
    assert bytes(row[0]) == hmac.new(key, message.encode(), hashlib.sha256).digest() and bytes(row[1]) == hmac.new(b"k", message.encode(), hashlib.sha512).digest()
    assert bytes(row[2]) == (0x80FF01).to_bytes(8, "little") and bytes(row[3]) == keyed.hkdf(key, b"chunkid" + (5).to_bytes(8, "little"))
    names = keyed.NameKey(key)
    sealed = names.seal(F.lit(message), F.lit("a"))
    row = one(spark, names.open(sealed, F.lit("a")), names.open(sealed, F.lit("b")), names.open(F.lit(b"short"), F.lit("a")), sealed, names.seal(F.lit(message), F.lit("a")), names.lookup(F.lit(message)))
    assert row[0] == message and row[1] is None and row[2] is None and row[3] == row[4] and row[5] == names.lookup_value(message)


def test_small_functions(spark):
    row = one(spark, text.basename(F.lit(r"C:\a\b.txt")), text.portable(F.lit(r"C:\a\b.txt"), F.lit("C:/a")), text.memory_mib(F.lit("256")), text.memory_mib(F.lit("x")), text.percent(F.lit(0.1234)))
    assert tuple(row) == ("b.txt", "b.txt", 256, None, "12.3%")
    for _ in range(64):
        p = text.generate_grouped_password()
        assert len(p) == 29 and [i for i, c in enumerate(p) if c == "-"] == [5, 11, 17, 23]
        assert all(any(c in kind for c in p) for kind in (text.UPPER, text.LOWER, text.DIGITS, text.SYMBOLS))
    assert [len(text.generate_password(n)) for n in (0, 1, 3, 4, 9)] == [0, 1, 3, 4, 9]


@pytest.mark.parametrize("ranges", [2, 7, 256])
def test_running_total(spark, ranges):
    rows = [(i * 37 % 101, i, i % 5) for i in range(300)] + [(None, 999, 2)]
    df = spark.createDataFrame(rows, "o int, id int, v int").repartition(7)
    got = {r["id"]: r["t"] for r in running_total(df, "o", F.col("v"), "t", ["id"], ranges=ranges).collect()}
    total, want = 0, {}
    for _, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want[i] = total
        total += v
    assert got == want and running_total(df.limit(0), "o", F.col("v"), "t").count() == 0


def test_mutations(spark):
    files = spark.createDataFrame([("a", 0, 1, 10, 10), ("a", 1, 2, 11, 11), ("b", 2, 3, 12, 12)], "name string, ordinal long, size long, created_at long, modified_at long")
    batch = spark.createDataFrame([("a", 0, 7, 20), ("c", 1, 8, 21), ("c", 2, 9, 22)], "name string, pos long, size long, micros long")
    assert sorted(map(tuple, upsert(files, batch, 3).collect())) == [("a", 0, 7, 10, 20), ("a", 1, 2, 11, 11), ("b", 2, 3, 12, 12), ("c", 4, 9, 22, 22)]
    r = spark.createDataFrame([("a", "z", 30)], "name string, new_name string, micros long")
    assert sorted(tuple(x)[:2] for x in rename(files, r).collect()) == [("a", 1), ("b", 2), ("z", 0)]
    slots = spark.createDataFrame([("k", 0, 5, True), ("k", 1, 5, True), ("k", 1, 9, False)], "key string, slot int, data_offset int, valid boolean")
    assert [tuple(x) for x in active_slot(slots, ["key"]).collect()] == [("k", 0, 5)]
    heads = spark.createDataFrame([("k", 0, 0, False, True), ("k", 1, 1, True, True), ("m", 1, 1, False, True), ("n", 0, 0, False, False)], "key string, slot int, place int, usable boolean, has_magic boolean")
    assert sorted(map(tuple, unwrap_candidate(heads, ["key"]).collect())) == [("k", 1), ("m", 1), ("n", None)]


def test_streaming_fold_and_hours(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select(*EVENTS.fieldNames())
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    log = lambda e: e.select(F.col("user_id").alias("key"), F.unix_micros("ts").alias("micros"), "event_id", F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("kind"), F.floor(F.col("value") * 100).cast("long").alias("size"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fold_stream(log(stream), str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    from strongroom.operators.catalog_ops import fold_log

    assert sorted(map(tuple, folded(spark, str(tmp_path / "table")).collect())) == sorted(map(tuple, fold_log(log(events)).collect()))
    q = hourly(stream, "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, hourly(events).collect()))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 50, 1000])
def test_range_number(spark, n):
    import bisect
    import random

    r = random.Random(n)
    points = sorted(r.sample(range(-5000, 5000), n))
    keys = [*range(-5005, 5005, 7), *points]
    got = [x[0] for x in spark.createDataFrame([(k,) for k in keys], "k long").select(range_number(points, F.col("k"))).collect()]
    if n:
        assert got == [bisect.bisect_right(points, k) for k in keys]


def test_error_codes_magic_and_memory(spark):
    kind = lambda k, o: text.error_code(F.lit(k), F.lit(o))
    row = one(spark, kind("CRYPTO", True), kind("CRYPTO", False), kind("IO", True), kind(None, False), kind("?", True), text.has_magic(F.lit(b"SRM1x")), text.has_magic(F.lit(b"SRM")), text.has_magic(F.lit(None).cast("binary")), text.memory_mib_or_fail(F.lit("256")))
    assert tuple(row) == (1, 4, 5, 9, 9, True, False, False, 256)
    with pytest.raises(Exception, match="not 64"):
        one(spark, text.memory_mib_or_fail(F.lit("64")))


def test_table_digest_sees_multisets(spark):
    from strongroom.operators.digest import row_mac, table_digest

    def digest(rows):
        t = spark.createDataFrame(rows, "a string, b long").repartition(3)
        return tuple(table_digest(t.select(row_mac(lambda x: keyed.hmac256(b"k", x), F.col("a"), F.col("b")).alias("m")), "m").first())

    rows = [(f"n{i}", i) for i in range(300)] + [(None, 1), ("", 1), ("1", 1), ("x", None)]
    whole = digest(rows)
    assert whole[0] == 304 and digest(rows[::-1]) == whole
    assert len({whole, digest(rows[1:]), digest([*rows, rows[0]]), digest([*rows, rows[0], rows[0]]), digest([("n0", 1), *rows[1:]]), digest([("n00", None), *rows[1:]])}) == 6
    assert digest([])[0] == 0
