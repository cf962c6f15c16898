"""Two writers, jobs that die, and listings that somebody changed."""

import os

import pytest

from strongroom.functions.text import ERRORS
from strongroom.plans import vault as V
from tests.test_vault import FAST, cyclic, items, names, vault  # noqa: F401


def rewrite(spark, v, folder, change):
    path = f"{v.path}/{folder}/gen={v.generation}"
    rows = [tuple(r) for r in spark.read.schema(V.FILES).parquet(path).select(*V.FILES.fieldNames()).collect()]
    v._delete(f"{folder}/gen={v.generation}")
    spark.createDataFrame(change(rows), V.FILES).write.parquet(path)


@pytest.mark.parametrize("change", [lambda r: r[1:], lambda r: [*r, r[0]], lambda r: [(*r[0][:-1], 1), *r[1:]], lambda r: [(*r[0][:4], r[0][4] + 1, *r[0][5:]), *r[1:]]], ids=["dropped", "doubled", "older version", "other size"])
def test_a_changed_listing_does_not_open(spark, vault, change):
    vault.add_paths(items(spark, ("a", b"1"), ("b", b"22")))
    rewrite(spark, vault, "files", change)
    with pytest.raises(V.Corrupt) as caught:
        V.Vault.open(spark, vault.path, "secret")
    assert V.error_code(caught.value, opening=True) == ERRORS["WRONG_PASSWORD"] and V.error_code(caught.value) == ERRORS["CRYPTO"]


def test_a_changed_seal_does_not_open(spark, vault):
    vault.put("a", b"1")
    seal = vault._seal() | {"stored": 5}
    spark.createDataFrame([tuple(seal[c] for c in V.SEAL)], "generation long, rows long, stored long, digest string, mac string").write.mode("overwrite").json(f"{vault.path}/seals/gen=2")
    with pytest.raises(V.Corrupt):
        V.Vault.open(spark, vault.path, "secret")


def test_an_older_seal_and_listing_are_a_rollback(spark, vault):
    vault.put("a", b"1")
    vault.put("a", b"2")
    for folder in ("files", "mirror", "seals"):
        vault._delete(f"{folder}/gen=3")
    with pytest.raises(V.Rollback):
        V.Vault.open(spark, vault.path, "secret", min_generation=3)


def test_two_writers(spark, vault):
    other = V.Vault.open(spark, vault.path, "secret")
    with vault._claimed(2), pytest.raises(V.Claimed):
        other.put("b", b"2")
    vault._unclaim(2)
    vault.put("a", b"1")
    with pytest.raises(V.Rollback):
        other.put("b", b"2")
    again = V.Vault.open(spark, vault.path, "secret")
    assert names(again) == ["a"] and again.get("a") == b"1"


@pytest.mark.parametrize("step", ["chunks", "files", "seals", "mirror"])
def test_a_job_that_dies(spark, vault, monkeypatch, step):
    """Death after each step: nothing before the seal is published, everything after it is."""
    vault.put("a", b"1")
    dying = V.Vault.open(spark, vault.path, "secret")

    class Death(BaseException):
        pass

    real_fs = V.Vault._delete
    if step == "chunks":
        monkeypatch.setattr(V.Vault, "_commit", lambda *_: (_ for _ in ()).throw(Death()))
    elif step in ("files", "seals"):
        name = "_digest" if step == "files" else "_mac_of"
        real = getattr(V.Vault, name)
        monkeypatch.setattr(V.Vault, name, lambda self, *a: (_ for _ in ()).throw(Death()) if self.generation == 2 and self is dying and (step == "files" or a[0].get("generation") == 3) else real(self, *a))
    else:
        read = type(spark.read).schema
        monkeypatch.setattr(V.Vault, "_tidy", lambda *_: (_ for _ in ()).throw(Death()))
        assert read
    monkeypatch.setattr(V.Vault, "_delete", lambda self, folder: None if self is dying else real_fs(self, folder))  # a dead job cleans nothing
    with pytest.raises(Death):
        dying.put("a", b"22")
    monkeypatch.undo()
    again = V.Vault.open(spark, vault.path, "secret")
    if step == "mirror":
        assert again.get("a") == b"22"
        return
    assert again.generation == 2 and again.get("a") == b"1"
    with pytest.raises(V.Claimed):
        again.put("a", b"333")
    again.break_claim()
    again.put("a", b"333")
    assert V.Vault.open(spark, vault.path, "secret").get("a") == b"333"


def test_a_failed_change_gives_its_claim_back(spark, vault):
    with pytest.raises(V.InvalidArgument):
        vault.add_paths(items(spark, ("", b"1")))
    with pytest.raises(V.NotFound):
        vault.delete("none")
    vault.put("a", b"1")
    assert vault.generation == 2 and sorted(os.listdir(f"{vault.path}/claims"))[-1].startswith("gen=2")


def test_changes_read_no_chunks(spark, vault):
    """Chunks that are gone don't hinder a change of another file, nor the figures."""
    vault.put("a", b"1" * 70_000)
    vault.auto_compact_ratio = 0.99
    before = vault.info()
    for name in os.listdir(f"{vault.path}/chunks/gen=2"):
        if name.endswith(".parquet"):
            with open(f"{vault.path}/chunks/gen=2/{name}", "wb") as file:
                file.write(b"broken")
    assert vault.info() == before
    vault.put("b", b"2")
    vault.rename("b", "c")
    assert vault.get("c") == b"2" and vault.info()["files"] == 2


def test_append_windows_and_extract(spark, vault, tmp_path):
    data = cyclic(200_000)
    vault.put("d/a", b"old")
    vault.append("d/a", data)
    assert names(vault) == ["d/a", "d/a"] and vault.get("d/a") == b"old"
    vault.add_paths(items(spark, ("big", data), ("empty", b""), ("d/e/f", b"x")))
    seen = []
    windows = list(vault.read_windows("big", 70_000, lambda done, size: seen.append((done, size))))
    assert [len(w) for w in windows] == [70_000, 70_000, 60_000] and b"".join(windows) == data
    assert seen == [(70_000, 200_000), (140_000, 200_000), (200_000, 200_000)] and list(vault.read_windows("empty")) == []
    vault.extract(str(tmp_path / "out"), vault.files().where("name <> 'd/a'"))
    assert (tmp_path / "out/big").read_bytes() == data and (tmp_path / "out/empty").read_bytes() == b"" and (tmp_path / "out/d/e/f").read_bytes() == b"x"
    assert not [n for _, _, f in os.walk(tmp_path / "out") for n in f if n.endswith(".part")]
    vault.put("../x", b"1")
    with pytest.raises(V.InvalidArgument):
        vault.extract(str(tmp_path / "out"))


def test_a_changing_source_is_read_once(spark, vault):
    from pyspark.sql import functions as F

    noise = spark.range(3).select(F.concat(F.lit("f"), "id").alias("name"), F.col("id").alias("pos"), F.encode(F.uuid().cast("string"), "utf-8").alias("content"))
    assert vault.add_paths(noise) == 3
    for name in names(vault):
        assert len(vault.get(name)) == 36


def test_codes_and_description():
    assert V.error_code(V.NotFound()) == 2 and V.error_code(ValueError()) == 9 and V.error_code(V.TooLarge()) == 7 and V.error_code(OSError()) == 5
    assert V.error_code(V.WrongPassword(), True) == 1 and "128 MiB" in FAST.describe()
