import glob
import hashlib
import hmac
import math
import os

import duckdb
import pytest

import __spark_entry__
from strongroom.queries import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12)
    return bytes(a) == bytes(b) if isinstance(a, (bytes, bytearray)) else a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    key = lambda row: [(v is None, str(v)) for v in row]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    other = sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=key)
    assert len(got) == len(other) and all(same(x, y) for a, b in zip(got, other, strict=True) for x, y in zip(a, b, strict=True))


def test_hmac512(spark):
    rows = catalog.QUERIES["q_h5_hmac512"](spark, DATA).collect()
    names = {r["ordinal"]: r["name"] for r in catalog.list_names(spark, DATA).collect()}
    assert len(rows) == len(names) and all(r["mac"] == hmac.new(catalog.TEST_KEY, names[r["ordinal"]].encode(), hashlib.sha512).hexdigest() for r in rows)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_contents_of_all_chunks_come_back(spark, tmp_path):
    chunk = 65_536
    texts = ["", "a", "b" * chunk, "c" * chunk + "d", "é€x" * 40_000, "e" * 3 * chunk]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    name, want = "q_h13_seal_roundtrip_all", []
    for i, t in enumerate(texts):
        b = t.encode()
        want += [(i, k // chunk, hashlib.sha256(b[k : k + chunk]).hexdigest(), len(b[k : k + chunk]) + catalog.OVERHEAD) for k in range(0, len(b), chunk)]
    got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select("ordinal", "idx", "sha", "sealed_len").collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == want and sorted(con.sql(f"select ordinal, idx, sha, sealed_len from ({catalog.ORACLES[name]})").fetchall()) == want
    assert max(idx for _, idx, _, _ in got) == 3
