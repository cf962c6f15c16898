import os

import pytest

from strongroom.plans import vault as V
from strongroom.sources.directory import DirectorySource, walk

FAST = V.KdfParams(128, 1, 1)


def cyclic(n):
    return bytes(i % 251 for i in range(n))


@pytest.fixture
def vault(spark, tmp_path):
    v = V.Vault.create(spark, str(tmp_path / "v"), "secret", FAST)
    v.auto_compact_ratio = None
    return v


def names(v):
    return sorted(r["name"] for r in v.list_file_info().collect())


def items(spark, *rows):
    return spark.createDataFrame([(n, i, bytearray(c)) for i, (n, c) in enumerate(rows)], "name string, pos long, content binary")


def test_create_open_and_passwords(spark, vault):
    assert names(vault) == [] and vault.generation == 1
    vault.put("a.txt", b"hello world")
    with pytest.raises(V.WrongPassword):
        V.Vault.open(spark, vault.path, "other")
    vault.change_password("new", FAST)
    with pytest.raises(V.WrongPassword):
        V.Vault.open(spark, vault.path, "secret")
    again = V.Vault.open(spark, vault.path, "new")
    assert again.get("a.txt") == b"hello world" and again.generation == 2
    with pytest.raises(V.Rollback):
        V.Vault.open(spark, vault.path, "new", min_generation=3)
    with pytest.raises(V.NotFound):
        V.Vault.open(spark, vault.path + "-none", "new")


def test_batch_upsert_keeps_identity(spark, vault):
    assert vault.add_paths(items(spark, ("b", b"1"), ("a", b"22"), ("b", b"333"), ("", b"")).where("name <> ''")) == 3
    rows = {r["name"]: r for r in vault.files().collect()}
    assert rows["b"]["size"] == 3 and vault.get("b") == b"333" and vault.get("a") == b"22"
    vault.put("b", b"4444")
    new = {r["name"]: r for r in vault.files().collect()}
    assert new["b"]["file_id"] == rows["b"]["file_id"] and new["b"]["ordinal"] == rows["b"]["ordinal"] and new["b"]["created_at"] == rows["b"]["created_at"]
    assert (new["a"]["version"], new["b"]["version"], vault.generation) == (2, 3, 3)
    with pytest.raises(V.InvalidArgument):
        vault.add_paths(items(spark, ("x", b""), ("", b"")))
    assert vault.add_paths(items(spark).limit(0)) == 0 and vault.generation == 3 and names(vault) == ["a", "b"]


def test_ranges_and_edges(spark, vault):
    data = cyclic(200_000)
    vault.add_paths(items(spark, ("big", data), ("empty", b""), ("edge", bytes(2 * 65536))))
    assert vault.get("big") == data and vault.get("empty") == b"" and vault.get("edge") == bytes(131072)
    for offset, length in ((0, 200_000), (65526, 20), (0, 5), (199_990, 100), (300_000, 5), (0, 0), (1, 2**63)):
        got, end = vault.read_range("big", offset, length)
        assert got == data[offset : offset + length] and end == (min(200_000, offset + length) if got else min(offset, 200_000))
    used = {r["name"]: r["storage_used"] for r in vault.list_file_info().collect()}
    assert used == {"big": 200_112, "empty": 0, "edge": 131_128}
    with pytest.raises(V.NotFound):
        vault.read_range("none", 0, 1)


def test_delete_rename_and_missing(vault):
    vault.put("a", b"1")
    vault.put("b", b"2")
    vault.rename("a", "b")
    assert names(vault) == ["b", "b"] and vault.get("b") == b"1"
    vault.put("b", b"3")
    assert vault.get("b") == b"3" and names(vault) == ["b", "b"]
    vault.delete("b")
    assert names(vault) == []
    for fails in (lambda: vault.delete("b"), lambda: vault.rename("b", "c"), lambda: vault.get("b"), lambda: vault.size("b")):
        with pytest.raises(V.NotFound):
            fails()


def test_garbage_and_compaction(spark, vault):
    vault.add_paths(items(spark, ("keep", b"\2" * 64_000), ("drop", b"\2" * 256_000)))
    assert vault.info()["garbage_ratio"] < 0.1
    vault.delete("drop")
    info = vault.info()
    assert info["garbage_ratio"] > 0.5 and info["files"] == 1
    vault.compact()
    assert vault.info()["garbage_bytes"] == 0 and vault.get("keep") == b"\2" * 64_000
    assert [r["version"] for r in vault.files().collect()] == [vault.generation]
    vault.auto_compact_ratio = 0.25
    before = vault.generation
    vault.put("keep", b"\3" * 64_000)
    assert vault.generation == before + 2 and vault.info()["garbage_ratio"] < 0.1 and vault.get("keep") == b"\3" * 64_000


def test_lost_listing_lost_and_changed_chunks(spark, vault):
    vault.put("a", cyclic(70_000))
    vault._delete(f"files/gen={vault.generation}")
    again = V.Vault.open(spark, vault.path, "secret")
    assert names(again) == ["a"] and again.generation == 2
    stored = [tuple(r) for r in spark.read.schema(V.CHUNKS).parquet(f"{vault.path}/chunks").select(*V.CHUNKS.fieldNames()).collect()]
    bad = [(f, v, i, bytearray(bytes(s)[:-1] + bytes([bytes(s)[-1] ^ 1])) if i == 1 else s) for f, v, i, s in stored]
    vault._delete("chunks/gen=2")
    spark.createDataFrame(bad, V.CHUNKS).write.parquet(f"{vault.path}/chunks/gen=2")
    assert names(again) == ["a"]
    with pytest.raises(V.Corrupt):
        again.get("a")
    assert again.read_range("a", 0, 10)[0] == cyclic(10)


def test_survivors_stay(spark, vault):
    vault.put("a", b"\1" * 300_000)
    before = sorted(os.listdir(f"{vault.path}/chunks/gen=2"))
    vault.put("b", b"\2")
    assert sorted(os.listdir(f"{vault.path}/chunks/gen=2")) == before and vault.get("a") == b"\1" * 300_000


def test_directory_source(spark, tmp_path):
    root = tmp_path / "tree"
    for name, content in (("photos/beach/1.jpg", b"1"), ("docs/readme.md", b""), (".hidden", b"h"), ("_x", b"x"), ("top.txt", b"t")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
    (root / "link").symlink_to(root / "top.txt")
    (root / "none").mkdir()
    spark.dataSource.register(DirectorySource)
    got = {r["name"]: bytes(r["content"]) for r in spark.read.format("directory").option("filesPerPartition", 2).load(str(root)).collect()}
    assert got == {"photos/beach/1.jpg": b"1", "docs/readme.md": b"", ".hidden": b"h", "_x": b"x", "top.txt": b"t"}
    assert [n for _, n in walk(str(root / "top.txt"))] == ["top.txt"]
